"""Similarity join of documents on word shingles, with Bayesian pruning of candidate pairs.

Bands of MinHash values propose pairs; documents that share a band key are compared on further MinHash values, 16 at a
time. After each step a pair is dropped when, under a uniform prior of its similarity, the posterior probability of
reaching the threshold has fallen below ``tolerance``. Documents that surviving pairs connect are a group; its pairs are
pruned alike, and what is left is verified by exact Jaccard similarity.

Defined cases: null and empty texts, and texts without any word, link with nothing and are a class of their own
(``class_id`` is the row's doc_id). Texts with fewer words than ``width`` have one shingle, of all their words.
Repeated rows are copies: each counts as a linked document of the others, and only one of them is kept. Rows with equal
ids and different texts are documents of their own; ``keep_one_of_each`` tells them apart. Rows whose doc_id is null are
compared and counted like any other; a class of such rows only has a null ``class_id``, and ``keep_one_of_each`` keeps
one of its texts. An empty table gives an empty result. Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lsh
from .common import discard, materialize
from .lsh import least_matches, pruner

__all__ = ["jaccard_classes", "keep_one_of_each", "least_matches", "pruner"]


def classed(docs: DataFrame, width: int, threshold: float, sketch: int, tolerance: float, missed: float) -> DataFrame:
    """docs: (key, text). (key, body, class_id, n_links, rep): one row per input row that has a word."""
    docs = docs.select("key", body_of("text").alias("body"), "text")
    bands, rows = lsh.tune_bands(threshold, missed, most=208)
    items, mine, nodes = lsh.near_classes(docs, mode="text", width=width, threshold=threshold, bands=bands, rows=rows, min_words=1, sketch=sketch, prune=pruner(threshold, sketch, tolerance))
    first = nodes.groupBy("cls").agg(F.coalesce(F.min(F.when(F.col("rep.key").isNotNull(), F.col("rep"))), F.min("rep")).alias("first"))
    first = materialize(first, "first")  # a table of its own, so that a join with a class of very many nodes may be split
    named = materialize(nodes.join(first, "cls").select("node", "copies", "n_links", "first"), "named")
    discard(mine, nodes, first)
    own = F.struct("key", "body", "item")
    return items.join(named, "node", "left").select("key", "body", F.coalesce("first", own).alias("first"), (F.coalesce("n_links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))


def body_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def has_word(text: str) -> Column:
    return F.coalesce(F.lower(text), F.lit("")).rlike(r"[0-9a-z\x{80}-\x{10ffff}]")


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, sketch: int = 128, tolerance: float = 1e-6, missed: float = 1e-6) -> DataFrame:
    """One row per input row: key, class_id (smallest key of its component), n_links, kept (it is the class's first)."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = classed(docs, width, threshold, sketch, tolerance, missed)
    found = found.select(F.col("key").alias(key), F.col("first.key").alias("class_id"), "n_links", F.col("key").eqNullSafe(F.col("first.key")).alias("kept"))
    # rows without a word never became items
    alone = docs.where(~has_word("text")).select(F.col("key").alias(key), F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def keep_one_of_each(docs: DataFrame, width: int = 5, threshold: float = 0.8, sketch: int = 128, tolerance: float = 1e-6, missed: float = 1e-6) -> DataFrame:
    """The documents without those near copies that come later (by id, then by a hash of the text); of repeated rows one
    stays, and so do all rows without a word. ``docs`` has doc_id and text; its columns may have any other names."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # the caller's names cannot clash with ours
    rows = docs.toDF(*names)
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    found = classed(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), width, threshold, sketch, tolerance, missed)
    first = F.struct("first.key", "first.body")
    stay = found.where(F.struct("key", "body").eqNullSafe(first)).groupBy("key", "body").agg(F.count("*").alias("times"))
    stay = materialize(stay, "stay")
    both = rows.where(has_word(text)).join(stay.hint("merge"), F.col(key).eqNullSafe(F.col("key")) & (body_of(text) == F.col("body")))
    once = both.where("times = 1").select(names)
    often = both.where("times > 1").select(*names, "body").dropDuplicates([key, "body"]).select(names)
    return rows.where(~has_word(text)).unionByName(once).unionByName(often).toDF(*docs.columns)


#: The same in DuckDB, for ids that are not null and not repeated: shingles as strings, all pairs that share one.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
reach AS (SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT l.a, r.r FROM reach r JOIN links l ON l.b = r.v),
least AS (SELECT v, min(r) AS c FROM reach GROUP BY v),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, c AS class_id, coalesce(n, 0) AS n_links, c = doc_id AS kept FROM least JOIN d ON v = doc_id LEFT JOIN degree ON a = doc_id
"""
