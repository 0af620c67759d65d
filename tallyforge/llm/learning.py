"""Bounded samples of labelled rows, and what the two classifiers share."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % of


def fold_of(key: int | None, of: int) -> int:
    return zlib.crc32(b"" if key is None else str(key).encode()) % of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, of: int, held_out: int, most: int) -> tuple[list[str], np.ndarray]:
    """(texts, 0/1 labels) of at most ``most`` labelled rows outside the held-out fold, in the order of a hash of the id.

    The ids are chosen first and are at most ``most``, so they may be broadcast to the scan of the texts.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", of) != held_out))
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    # of several rows with one id the text of the smallest hash; so at most ``most`` texts reach the driver
    one = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = one.toPandas().sort_values("doc_id")
    return rows["text"].tolist(), rows["y"].to_numpy(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
