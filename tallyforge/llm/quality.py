"""Quality classifier: hashed word and character n-gram vectors, averaged per document, and a softmax over two labels.

Vectors and output are learned together by stochastic gradient descent in numpy. Since the average and the output are
linear up to the softmax, scoring needs one number for each bucket (the vector's part in the difference of the two
outputs); the average of these over a whole text is one table lookup for each word and n-gram.

Training uses at most ``most`` labelled rows outside the held-out fold (a documented bound); scores cover all rows and
whole texts. Defined cases: null and empty texts have no feature and get the score of the bias alone; labels of other
ids, null labels and null ids are not learned from; with fewer than two labels present the score is their share (0.5
without any); of several texts of one labelled id one is learned from, and of several labels the greater. Each of several
repeated rows gets its own row and the same score; a score at the threshold is predicted 1. An empty table gives an empty
result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import fold, labelled_sample, sigmoid
from .shingling import buffers, mix, powers, slices

BUCKETS = 1 << 18
GRAMS = (2, 3, 4)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word, word pair and character n-gram. Case and punctuation count."""
    raw, offsets = buffers(texts)
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    white = raw <= 32
    wide = raw.astype(np.uint32)
    out, rows = [], []
    for g in GRAMS:
        if n < g:
            continue
        m = n - g + 1
        code = np.zeros(m, np.uint32)
        for k in range(g):
            code = (code << np.uint32(8)) | wide[k : k + m]
        ok = row_of[:m] == row_of[g - 1 :]
        for k in range(1, g - 1):  # white space only at either end: the edge of a word
            ok &= ~white[k : k + m]
        code = code[ok] * np.uint32(0x9E3779B1) + np.uint32(g * 0x85EBCA6B & 0xFFFFFFFF)
        code ^= code >> np.uint32(15)
        out.append((code * np.uint32(0xC2B2AE35) >> np.uint32(14)).astype(np.int64))
        rows.append(row_of[:m][ok])
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    inside = np.concatenate([[False], ~white, [False]])
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(n), out=prefix[1:])
    words = mix((prefix[ends] - prefix[starts]) * powers(n + 1, inverse=True)[starts])
    of = row_of[starts]
    out.append((words >> np.uint64(46)).astype(np.int64))
    rows.append(of)
    if len(words) > 1:
        pair = mix(words[:-1] * np.uint64(3) + words[1:] + np.uint64(7)) >> np.uint64(46)
        pair[words[:-1] == words[1:]] = 1  # a word said twice, whichever
        ok = of[:-1] == of[1:]
        out.append(pair[ok].astype(np.int64))
        rows.append(of[:-1][ok])
    return np.concatenate(out), np.concatenate(rows)


def train(texts: list[str], labels: np.ndarray, dims: int = 8, epochs: int = 3, rate: float = 0.5, seed: int = 1) -> tuple[np.ndarray, float]:
    """(number for each bucket, bias): the score of a text is sigmoid(mean of its features' numbers + bias)."""
    share = float(labels.mean()) if len(labels) else 0.5
    if len(labels) < 2 or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    docs = []
    arr = pa.array(texts, pa.large_string())
    for at, n in slices(arr):
        buckets, rows = features(arr.slice(at, n))
        order = np.argsort(rows, kind="stable")
        buckets, rows = buckets[order], rows[order]
        cut = np.searchsorted(rows, np.arange(n + 1))
        for a, b in zip(cut.tolist(), cut.tolist()[1:], strict=False):
            ids, counts = np.unique(buckets[a:b], return_counts=True)
            docs.append((ids.astype(np.int32), (counts / max(b - a, 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    out = np.zeros((2, dims), np.float32)
    bias = np.zeros(2, np.float32)
    steps, total = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)).tolist():
            ids, weight = docs[i]
            now = rate * (1 - steps / total)
            steps += 1
            mean = weight @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= now * np.outer(p, mean)
            bias -= now * 0.1 * p
            # an average spreads the step over all features; scale it back as subword models do
            vectors[ids] -= (now * np.minimum(weight * len(ids), 4.0))[:, None] * back[None, :]
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def score_quality(docs: DataFrame, labels: DataFrame, most: int = 5000, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    texts, y = labelled_sample(docs, labels, "quality", 5, 0, most)
    numbers, bias = train(texts, y)
    model = docs.sparkSession.sparkContext.broadcast(numbers)  # BUCKETS numbers: 1 MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            for at, n in slices(batch.column(2)):
                buckets, rows = features(batch.column(2).slice(at, n))
                total = np.bincount(rows, table[buckets], n)
                count = np.bincount(rows, minlength=n)
                score = sigmoid(total / np.maximum(count, 1) + bias)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
