"""Benchmark decontamination: short test items inside long documents, by DataFrame operations only.

An item is looked for by MinHash winners: the shingles of the item that are smallest under several hash functions. A
winner is a uniform draw from the item's shingles, so the share of winners that a document holds estimates the
*containment* of the item, however long the document is (MinHash values of a whole long document say next to nothing
about a short item). Items are partitioned by size: those of up to ``draws`` shingles keep them all, larger ones draw
``draws`` winners. A document is a candidate if it holds so many winners that a containment of ``threshold`` would show
fewer with a probability below ``missed`` only; exact containment of shingles verifies it. Nothing but fixed-width
numbers is broadcast, and only below ``BROADCAST_BYTES``.

A word is a maximal run of letters and digits (Unicode) of the lower-cased text; a shingle is ``width`` words; a text
with fewer words has one shingle, of all its words. For items that short, documents are cut into windows of as many words
as well (each such length is a further pass over the documents, and only lengths that occur are made), so that a test item
of two words is found inside a long text. Defined cases: null or
empty texts, and items without words, match nothing; items with the same id are one item with the shingles of all (a
null id is one item, too); rows with a null id match like others and give null ids; repeated rows give their pairs once.
``drop_contaminated`` tells rows by id and text. Empty tables give an empty result, or all documents. Further columns
are ignored by the search and kept by the removal, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of the item side up to which it may be broadcast.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_words(df: DataFrame, text: str) -> DataFrame:
    """Adds ``h_``, the hashes of the words. The one-row generator keeps the optimizer from copying the expression to
    each place that uses it."""
    return df.withColumn("h_", F.explode(F.array(F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))))


def windows(width: int) -> Column:
    """Array of structs c0, c1, ...: the words of each shingle; a shorter text is one shingle, filled up with nulls."""
    n = F.size("h_")
    column = lambda k: F.when(n >= width, F.slice("h_", F.lit(k + 1), F.greatest(n - (width - 1), F.lit(0)))).when(n > 0, F.array(F.get("h_", F.lit(k)))).otherwise(F.array().cast("array<bigint>"))
    return F.arrays_zip(*[column(k).alias(f"c{k}") for k in range(width)])


def each_gram(df: DataFrame, text: str, width: int) -> DataFrame:
    """(other columns, gram): a row for each shingle."""
    kept = [c for c in df.columns if c != text]
    return with_words(df, text).select(*kept, F.inline(windows(width))).select(*kept, F.xxhash64(*[f"c{k}" for k in range(width)]).alias("gram"))


def all_grams(df: DataFrame, text: str, width: int, short: list[int]) -> DataFrame:
    """The shingles of each text, and its windows of each of the ``short`` lengths."""
    return reduce(DataFrame.unionByName, [each_gram(df, text, w) for w in (width, *short)])


def bounded(df: DataFrame) -> DataFrame:
    """Broadcast if it has been seen to be small: its rows, of a few numbers each, are counted. Beyond, the join shuffles."""
    return F.broadcast(df) if df.count() * 24 <= BROADCAST_BYTES else df


def least_drawn(draws: int, threshold: float, missed: float) -> int:
    """How many of ``draws`` winners a document holds at least, but for a probability of ``missed``, if it holds
    ``threshold`` of the item."""
    below = 0.0
    for k in range(draws):
        below += math.comb(draws, k) * threshold**k * (1 - threshold) ** (draws - k)
        if below > missed:
            return max(k, 1)
    return draws


def containing(docs: DataFrame, benchmark: DataFrame, width: int, threshold: float, missed: float, draws: int, item: str) -> DataFrame:
    """docs: (key, body, text). (key, body, item_id, n_shared, n_item) of rows that hold ``threshold`` of an item."""
    docs = docs.where("text IS NOT NULL")
    items = benchmark.select(F.col(item).alias("item_id"), F.col("text").alias("item_text")).where("item_text IS NOT NULL")
    counted = with_words(items, "item_text").where((F.size("h_") > 0) & (F.size("h_") < width))
    short = sorted(r["n"] for r in counted.select(F.size("h_").alias("n")).distinct().collect())  # fewer than ``width``
    grams = materialize(each_gram(items, "item_text", width).distinct(), "items")
    sizes = grams.groupBy("item_id").agg(F.count("*").alias("n_item"))
    # one number names an item from here on, whatever its id is
    named = materialize(sizes.select("item_id", "n_item", F.xxhash64("item_id", F.lit(1)).alias("item")), "sizes")
    grams = grams.select(F.xxhash64("item_id", F.lit(1)).alias("item"), "gram")
    sized = grams.join(bounded(named.select("item", "n_item")), "item")
    # small items keep every shingle; of larger ones each draw keeps the shingle that is smallest under its hash
    small = sized.where(F.col("n_item") <= draws).select("item", "gram", F.lit(1).alias("times"), F.ceil(F.col("n_item") * threshold - 1e-9).cast("int").alias("least"))
    large = sized.where(F.col("n_item") > draws).select("item", "gram", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("k"))
    won = large.groupBy("item", "k").agg(F.min(F.struct(F.xxhash64("gram", "k").alias("h"), "gram"))["gram"].alias("gram")).groupBy("item", "gram").agg(F.count("*").cast("int").alias("times"))
    winners = materialize(small.unionByName(won.withColumn("least", F.lit(least_drawn(draws, threshold, missed)))), "winners")
    hits = materialize(all_grams(docs, "text", width, short).join(bounded(winners.select("gram").distinct()), "gram").select("key", "body", "gram").distinct(), "hits")
    near = hits.join(bounded(winners), "gram").groupBy("key", "body", "item").agg(F.sum("times").alias("held"), F.min("least").alias("least")).where("held >= least")
    near = materialize(near.select("key", "body", "item"), "candidates")
    # exact containment: the candidates' shingles meet those of their items
    chosen = near.select(F.col("key").alias("key_"), F.col("body").alias("body_")).distinct()
    source = docs.join(chosen.hint("merge"), F.col("key").eqNullSafe(F.col("key_")) & (F.col("body") == F.col("body_")), "left_semi")
    have = all_grams(source, "text", width, short).select(F.struct("key", "body").alias("row"), "gram").distinct()
    want = near.join(grams, "item").select(F.struct("key", "body").alias("row"), "gram", "item")
    found = want.join(have, ["row", "gram"]).groupBy("row", "item").agg(F.count("*").alias("n_shared"))
    found = found.join(bounded(named), "item").where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9)
    return found.select("row.key", "row.body", "item_id", "n_shared", "n_item")


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, missed: float = 1e-6, draws: int = 24, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, item, n_shared, n_item, containment) of every document that holds ``threshold`` of an item's shingles."""
    rows = docs.select(F.col(key).alias("key"), body_of("text").alias("body"), "text")
    out = containing(rows, benchmark, width, threshold, missed, draws, item).drop("body").distinct()
    return out.select(F.col("key").alias(key), F.col("item_id").alias(item), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def body_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, missed: float = 1e-6, draws: int = 24, item: str = "item_id") -> DataFrame:
    """The documents that hold no item. ``docs`` has doc_id and text; its columns may have any other names."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # the caller's names cannot clash with ours
    own = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names)
    hits = containing(rows.select(F.col(own["doc_id"]).alias("key"), body_of(own["text"]).alias("body"), F.col(own["text"]).alias("text")), benchmark, width, threshold, missed, draws, item)
    hits = materialize(hits.select("key", "body").distinct(), "contaminated")
    return rows.join(hits.hint("merge"), F.col(own["doc_id"]).eqNullSafe(F.col("key")) & (body_of(own["text"]) == F.col("body")), "left_anti").toDF(*docs.columns)


#: The same in DuckDB, over shingles as strings; windows of one to four words are there for items that short.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d UNION SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND 4))),
bg AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM b),
n AS (SELECT item_id, count(*) AS n_item FROM bg GROUP BY item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN bg USING (g) GROUP BY doc_id, item_id) JOIN n USING (item_id)
WHERE n_shared >= 0.8 * n_item - 1e-9
"""
