"""Ranked lexical search: the k best documents of every item, by a sum of integer term weights.

A term is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the whole text, only A-Z lower-cased.
With N documents that hold a term, L terms in all of them and df documents that hold a term, its weight is
``floor(1000 * ln((2N + 2) / (2df + 1)))``; tf occurrences in a document of n terms count ``weight * (10^9 tf div (1000 tf +
20 m))``, its impact, with ``m = 50 + (50 n N) div L``. A document's score is the sum over the item's terms, once each.

The join is seeded by thresholds. Each term stores a k-th impact: a value that at least k of its documents reach, taken
from counts of impacts in 256 steps, and its largest impact. The largest k-th impact of an item's terms is a lower bound
of its k-th score. Ordered by largest impact, the terms after which the rest can't add up to the bound are pruned: their
documents are no candidates by themselves. Documents are read in blocks against the items; a block's candidates are the
documents of the terms left, and if what the pruned terms can add brings any of them to the bound, they are rescored with
all terms, in 64-bit integers. A task raises an item's bound when it has seen k documents, and returns k of each item at
most, so that what meets in the last sort is bounded by items, k and tasks.

Only terms of items are kept from the documents, as one row of (term, tf) lists for each. Items go in blocks of about
``block`` (item, term) rows, which is what a task gets to know at a time; a single item stays in one block. Words are
looked up by 64-bit hashes and their length.

Defined cases: null and empty texts, of items too, hold no term; items of one id (null is one too) are one item with the
terms of all its rows; each row of the documents is a document by itself, so repeated rows each get a rank; equal scores
go by ascending doc_id, null last; fewer than k documents with a score above 0 give fewer rows; empty tables give an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, parts
from .shingling import _IS_WORD, buffers, mix, powers, slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HITS = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
STEP_BITS = 12  # an impact without its weight is below 2^20


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, length in bytes, row) of every term of the texts."""
    raw, offsets = buffers(texts)
    raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IS_WORD[raw]
    first = np.zeros(len(raw) + 2, bool)
    first[offsets + 1] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first[1:]))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first[1:]))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw)), out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * powers(len(raw) + 1, inverse=True)[starts])
    return hashes, ends - starts, np.searchsorted(offsets, starts, side="right") - 1


@dataclass
class Vocabulary:
    hashes: np.ndarray  # ascending; a term's number is its place here
    sizes: np.ndarray
    seen: np.ndarray

    @classmethod
    def of(cls, terms: list[str]) -> tuple[Vocabulary, np.ndarray]:
        """The vocabulary, and the number of each term."""
        hashes, sizes, _ = term_hashes(pa.array(terms, pa.large_string()))
        order = np.argsort(hashes, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        seen = np.zeros(1 << 16, bool)
        seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        return cls(hashes[order], sizes[order], seen), number

    def find(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes that are terms, their numbers)."""
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        same = (self.hashes[at] == hashes[maybe]) & (self.sizes[at] == sizes[maybe])
        return maybe[same], at[same]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def found_terms(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """One row for each document with a term: doc_id, n, and the vocabulary's terms in it with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at, size in slices(batch.column(1)):
                hashes, sizes, rows = term_hashes(batch.column(1).slice(at, size))
                n = np.bincount(rows, minlength=size)
                place, number = known.find(hashes, sizes)
                pairs, tfs = np.unique(rows[place] * len(known.hashes) + number, return_counts=True)
                row, term = np.divmod(pairs, len(known.hashes))
                some = np.flatnonzero(n)
                have = np.bincount(row, minlength=size)[some]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, size).take(pa.array(some)), pa.array(n[some]), lists(term, have, pa.int32()), lists(tfs, have, pa.int64())], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(run, HITS)


def term_bounds(hits: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(term, df, kth, top) of every term found: impacts without the weight; ``kth`` is 0 with fewer than k documents."""
    m = F.lit(50) + F.expr(f"(50 * n * {n_docs}L) div {n_terms}L")
    one = hits.select(m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(F.col("x.terms").alias("term"), F.expr("(1000000000L * x.tfs) div (1000 * x.tfs + 20 * m)").alias("s"))
    steps = one.groupBy("term", F.shiftright("s", STEP_BITS).alias("step")).agg(F.count("*").alias("c"), F.min("s").alias("least"), F.max("s").alias("top"))
    reached = F.sum("c").over(Window.partitionBy("term").orderBy(F.desc("step")))  # at most 256 rows a term
    return steps.withColumn("reached", reached).groupBy("term").agg(F.sum("c").alias("df"), F.coalesce(F.max(F.when(F.col("reached") >= k, F.col("least"))), F.lit(0)).alias("kth"), F.max("top").alias("top"))


@dataclass
class Items:
    """Items of a block: the terms of item ``i`` are ``terms[first[i]:first[i + 1]]``, by falling largest impact."""

    first: np.ndarray
    terms: np.ndarray
    rest: np.ndarray  # largest sum of impacts from this term of the item to its last
    bound: np.ndarray  # lower bound of each item's k-th score
    weight: np.ndarray  # of each term

    @classmethod
    def of(cls, item: np.ndarray, term: np.ndarray, weight: np.ndarray, kth: np.ndarray, top: np.ndarray) -> Items:
        most = (weight * top)[term]
        order = np.lexsort((term, -most, item))
        item, term, most = item[order], term[order], most[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(item))])
        to_end = np.concatenate([np.cumsum(most[::-1])[::-1], [0]])
        rest = to_end[:-1] - np.repeat(to_end[first[1:]], np.diff(first))
        return cls(first, term, rest, np.maximum.reduceat((weight * kth)[term], first[:-1]), weight)


class Best:
    """The k best documents of each item so far: by score, then id, null ids last."""

    def __init__(self, items: Items, k: int):
        self.k, self.bound, self.rows = k, items.bound.copy(), {}

    def add(self, item: int, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        if item in self.rows:
            score, null, doc = (np.concatenate(x) for x in zip(self.rows[item], (score, null, doc), strict=True))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.rows[item] = (score[order], null[order], doc[order])
        if len(order) == self.k:
            self.bound[item] = max(self.bound[item], score[order[-1]])


def score_block(items: Items, best: Best, doc: np.ndarray, null: np.ndarray, m: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
    impact = items.weight[terms] * (1_000_000_000 * tfs // (1000 * tfs + 20 * np.repeat(m, counts)))
    order = np.argsort(terms, kind="stable")
    holder, impact = np.repeat(np.arange(len(doc)), counts)[order], impact[order]
    at = np.searchsorted(terms[order], np.arange(len(items.weight) + 1))
    for i in range(len(items.bound)):
        lo, hi, bound = items.first[i], items.first[i + 1], best.bound[i]
        total = np.zeros(len(doc), np.int64)
        left = lo + int(np.count_nonzero(items.rest[lo:hi] >= max(bound, 1)))  # terms from here on can't reach the bound
        for t in items.terms[lo:left].tolist():
            total[holder[at[t] : at[t + 1]]] += impact[at[t] : at[t + 1]]
        more = int(items.rest[left]) if left < hi else 0
        some = np.flatnonzero((total > 0) & (total + more >= bound))
        if not len(some):
            continue
        for t in items.terms[left:hi].tolist():
            total[holder[at[t] : at[t + 1]]] += impact[at[t] : at[t + 1]]
        some = some[total[some] >= bound]
        if len(some):
            best.add(i, total[some], null[some], doc[some])


def best_of_tasks(hits: DataFrame, items: Items, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each task the k best of each item, if they reach its bound."""
    shared = hits.sparkSession.sparkContext.broadcast(items)  # of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = shared.value, None
        for batch in batches:
            best = best or Best(own, k)
            ids, n, terms, tfs = batch.columns
            value = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
            m = 50 + 50 * value(n) * n_docs // n_terms
            score_block(own, best, value(ids.fill_null(0)), value(ids.is_null()), m, value(terms.value_lengths()), value(terms.flatten()), value(tfs.flatten()))
        for i, (score, null, doc) in best.rows.items() if best else ():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), i), pa.int64()), pa.array(doc, mask=null.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"])

    return hits.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 50, block: int = 50_000) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    asked = materialize(items.select("item_id", F.explode(F.array_distinct(words)).alias("term")).distinct(), "asked")
    blocks = -(-asked.count() // block)
    out = []
    for b in range(blocks):
        pairs = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()  # about ``block`` rows
        if not len(pairs):
            continue
        ids = {x: i for i, x in enumerate(dict.fromkeys(pairs["item_id"].to_pylist()))}
        terms = sorted(set(pairs["term"].to_pylist()))
        words, number = Vocabulary.of(terms)
        hits = materialize(found_terms(docs, words), "hits")
        seen = hits.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not seen["docs"]:
            discard(hits)
            break
        weight, kth, top = (np.zeros(len(terms), np.int64) for _ in range(3))
        for r in term_bounds(hits, seen["docs"], seen["terms"], k).toLocalIterator():  # one row a term of the block
            weight[r.term], kth[r.term], top[r.term] = math.floor(1000 * math.log((2 * seen["docs"] + 2) / (2 * r.df + 1))), r.kth, r.top
        place = {t: number[i] for i, t in enumerate(terms)}
        known = Items.of(np.array([ids[x] for x in pairs["item_id"].to_pylist()]), np.array([place[t] for t in pairs["term"].to_pylist()]), weight, kth, top)
        names = spark.createDataFrame([(i, x) for x, i in ids.items()], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        out.append(materialize(best_of_tasks(hits, known, seen["docs"], seen["terms"], k).join(F.broadcast(names), "item").drop("item"), "best"))
        discard(hits)
    discard(asked)
    if not out:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    best = reduce(DataFrame.unionByName, out)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # what tasks return of one item is dealt over parts first, so that no task sorts all of it
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts(spark)))
    few = best.withColumn("place", F.row_number().over(Window.partitionBy("item_id", part).orderBy(*order))).where(F.col("place") <= k).drop("place")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS terms FROM documents),
n AS (SELECT k, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY k, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
s AS (SELECT k, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)) AS s FROM p JOIN n USING (k), g),
r AS (SELECT item_id, k, doc_id, CAST(sum(w * s) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN s USING (term) GROUP BY item_id, k, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50"""
