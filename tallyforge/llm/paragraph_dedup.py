"""Removal of repeated paragraphs: MinHash banding, exact Jaccard similarity, clusters of removals by components.

A paragraph is a line of the text, or a run of *units* that line breaks do not bind. Both go through the same steps:
bands tuned for recall propose pairs, pairs are verified by exact Jaccard similarity of their word shingles, and of
every component of links the first paragraph (by doc_id, then a hash of the text, then position) stays.

Lines come first. What is left of each text is then cut by content: a unit starts at a word pair whose hash is the
least among ``lsh.REACH`` pairs on either side, so that a passage has the same units wherever it sits, but for those at
its two ends. Repeated units that follow each other and have ``span`` words together are one paragraph and go; shorter
runs stay, as phrases.

Defined cases: null texts count as empty and keep an empty text; lines with fewer words than ``min_words`` are never
removed by themselves; paragraphs of equal words are copies whatever their punctuation and case. A row is told by its
doc_id and text: rows with equal ids, or without an id, and different texts are different documents, and repeated rows
(same id and text) keep or lose the same. Rows with a null doc_id come after all others. An empty table gives an empty
result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lsh
from . import shingling as S
from .common import discard, materialize

SPAN = 20
SKETCH = 32


def repeated_items(docs: DataFrame, mode: str, width: int, threshold: float, min_words: int, bands: int, rows: int, tolerance: float = 1e-6) -> DataFrame:
    """docs: (key, body, text). (key, body, items): number and cluster (the smallest node) of each item to remove."""
    items, mine, nodes = lsh.near_classes(docs, mode=mode, width=width, threshold=threshold, bands=bands, rows=rows, min_words=min_words, sketch=SKETCH, prune=lsh.pruner(threshold, SKETCH, tolerance))
    many = nodes.where("copies > 1 OR n_links > 0")
    first = many.groupBy("cls").agg(F.coalesce(F.min(F.when(F.col("rep.key").isNotNull(), F.col("rep"))), F.min("rep")).alias("keeper"))
    first = materialize(first, "first")  # a table of its own, so that a join with a class of very many nodes may be split
    named = materialize(many.join(first, "cls").select("node", "cls", "keeper"), "named")
    at = F.struct("key", "body", "item")
    gone = mine.join(named.hint("merge"), "node").where(~at.eqNullSafe(F.col("keeper"))).select("key", "body", F.struct("item", F.col("cls").alias("cluster")).alias("gone"))
    # at most the items of one text; of repeated rows each item once
    gone = materialize(gone.groupBy("key", "body").agg(F.collect_set("gone").alias("items")), "gone")
    discard(items, mine, nodes, first, named)
    return gone


def with_items(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs and the ``items`` to remove from each (null: none)."""
    told = gone.withColumnsRenamed({"key": "key_", "body": "body_"}).hint("merge")
    return docs.join(told, F.col("key").eqNullSafe(F.col("key_")) & (F.col("body") == F.col("body_")), "left").drop("key_", "body_")


def cut_units(texts: pa.Array, gone: list[list[dict] | None], span: int) -> Iterator[tuple[str, list[int]]]:
    """Of each text what is left without those runs of the units in ``gone`` (item, cluster) that have ``span`` words, and
    the first cluster of each run."""
    _, item, row, _ = lsh.items_of(texts, "unit")
    first_unit = np.searchsorted(row, np.arange(len(texts))).tolist()
    first_word = np.searchsorted(item, np.arange(len(row) + 1))
    _, starts, ends, raw, offsets = S.word_spans(texts)
    for k, units in enumerate(gone):
        begin, stop = int(offsets[k]), int(offsets[k + 1])
        runs: list[list[int]] = []
        for u in sorted(units or (), key=lambda x: x["item"]):
            at = first_unit[k] + u["item"]
            a, b = int(first_word[at]), int(first_word[at + 1])
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b, u["cluster"]])
        runs = [r for r in runs if r[1] - r[0] >= span]
        out, at = [], begin
        for a, b, _ in runs:
            end = int(ends[b - 1])
            after = int(starts[b]) if b < len(starts) and starts[b] < stop else stop
            out.append(raw[at : int(starts[a])])
            at = after if after < stop and b"\n" not in raw[end:after] else end
        yield b"".join([*out, raw[at:stop]]).decode(), [c for *_, c in runs]


def remove_repeated_paragraphs(docs: DataFrame, width: int = 5, threshold: float = 0.8, min_words: int = 5, missed: float = 1e-4, missed_units: float = 1e-2, span: int = SPAN) -> DataFrame:
    """Per row: doc_id, n_paragraphs (lines), n_removed (characters with their line breaks), n_spans (lines and runs of
    units removed), clusters (those removed from, ascending; of a run, that of its first unit), kept_sha256, kept_text.

    ``missed``: the probability that lines, and ``missed_units`` that units, of similarity ``threshold`` share no band;
    equal ones always do."""
    docs = docs.select(F.col("doc_id").alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"), "text")
    bands, rows = lsh.tune_bands(threshold, missed, width=3)
    gone = repeated_items(docs, "line", width, threshold, min_words, bands, rows)
    key = docs.schema["key"].dataType.simpleString()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, items in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = (text or "").split("\n")
                drop = {x["item"]: x["cluster"] for x in items or ()}
                kept = "\n".join(x for i, x in enumerate(own) if i not in drop) if drop else text or ""
                out.append((len(own), len(text or ""), len(drop), sorted(set(drop.values())), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()), strict=True))], names=["key", "n_paragraphs", "n_chars", "n_lines", "clusters", "text"])

    left = with_items(docs, gone).select("key", "text", "items").mapInArrow(lines, f"key {key}, n_paragraphs long, n_chars long, n_lines long, clusters array<long>, text string")
    left = materialize(left.withColumn("body", F.xxhash64("text")), "kept")
    discard(gone)
    bands, rows = lsh.tune_bands(threshold, missed_units, width=2)
    gone = repeated_items(left.select("key", "body", "text"), "unit", width, threshold, width, bands, rows)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, rows in S.slices(whole.column(5)):
                yield cut(whole.slice(at, rows))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, gone = batch.column(5), batch.column(6)
        some = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
        done = dict(zip(some.tolist(), cut_units(texts.take(pa.array(some)), gone.take(pa.array(some)).to_pylist(), span), strict=True))
        out = []
        for k, (chars, n, clusters, text) in enumerate(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)):
            kept, more = done.get(k, (text, []))
            named = sorted({*clusters, *more}) or None
            out.append((chars - len(kept), n + len(more), named, hashlib.sha256(kept.encode()).hexdigest(), kept))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_paragraphs", "n_removed", "n_spans", "clusters", "kept_sha256", "kept_text"])

    both = with_items(left, gone).select("key", "n_paragraphs", "n_chars", "n_lines", "clusters", "text", "items")
    return both.mapInArrow(units, f"doc_id {key}, n_paragraphs long, n_removed long, n_spans long, clusters array<long>, kept_sha256 string, kept_text string")
