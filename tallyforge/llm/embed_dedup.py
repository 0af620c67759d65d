"""Near-duplicate vectors by cosine, compared tile by tile in PCA order.

All vectors are rotated to principal axes, those of most variance first. Rows are ordered by the first axis and packed
into chunks and chunks into blocks; a pair of blocks is one unit of work, so that a chunk travels once for each block;
two chunks form a tile unless their ranges on that axis are too far apart for any pair to reach the
threshold (unit vectors of cosine c are sqrt(2 - 2c) apart). In a tile, products of the leading dimensions plus the
product of the suffix norms bound the cosine from above; pairs whose bound is below the threshold stop there, the rest
go on to more dimensions, and the last ones get their cosine in double precision from the unrotated vectors. Where that
is so near the threshold that rounding could decide, exact arithmetic does: a cosine of exactly the threshold links.

A tile returns link counts and a spanning forest, never all pairs, and exact copies are one row throughout.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id
link with nothing. Vectors are compared with those of equal length only; each length that two or more distinct vectors
have is compared in jobs of its own. Repeated rows (same id and vector) count as one vector,
and each gives its own row. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, parts
from .lsh import grouped

LEADING = (16, 32)
#: Vectors of a chunk at most, and bytes of it; chunks of a block; rows compared at once; partial sums added at once.
CHUNK = 2048
CHUNK_BYTES = 1 << 20
SIDE = 8
ROWS = 512
FAN = 8


def scaled(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose largest component is from 0.5 to 1, and their lengths. They are scaled by powers of two, which rounds
    nothing, so no square overflows or vanishes and a cosine at the threshold stays there."""
    raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, initial=0.0))[1][:, None])
    return raw, np.sqrt(np.einsum("ij,ij->i", raw, raw))


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    rows, length = scaled(raw)
    return rows / length[:, None]


def reaches(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the cosine of two vectors reaches the threshold, as the decimal number it is written as, without rounding."""
    x, y = ([Fraction(v) for v in r.tolist()] for r in (a, b))
    dot, least = sum(p * q for p, q in zip(x, y, strict=True)), Fraction(str(threshold))
    return dot * abs(dot) >= least * abs(least) * sum(p * p for p in x) * sum(q * q for q in y)


def valid_rows(vectors: pa.Array) -> list[bytes | None]:
    """The vectors that can link, in double precision; None for the others."""
    out: list[bytes | None] = [None] * len(vectors)
    by_length: dict[int, tuple[list[int], list]] = {}
    for i, v in enumerate(vectors.to_pylist()):
        if v and not any(x is None for x in v):
            at, held = by_length.setdefault(len(v), ([], []))
            at.append(i)
            held.append(v)
    for at, held in by_length.values():
        m = np.array(held, np.float64) + 0.0
        for k in np.flatnonzero(np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)).tolist():
            out[at[k]] = m[k].tobytes()
    return out


def axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Columns: principal axes in descending order, from one partial sum for each partition, added up in a tree."""
    size = 1 + dims + dims * dims

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram, n = np.zeros(dims), np.zeros((dims, dims)), 0
        for batch in batches:
            if batch.num_rows:
                x = unit(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, dims))
                total, gram, n = total + x.sum(0), gram + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], total, gram.reshape(-1)]).tobytes()], pa.binary())], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(size)
        for batch in batches:
            for x in batch.column(0):
                whole += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], names=["s"])

    n = parts(vectors.sparkSession)
    sums = vectors.select("v").coalesce(n).mapInArrow(partial, "s binary")
    while n > 1:
        n = -(-n // FAN)
        sums = sums.repartition(n).mapInArrow(add, "s binary")
    whole = np.sum([np.frombuffer(r["s"]) for r in sums.collect()] or [np.zeros(size)], axis=0)  # one row of size numbers
    n = max(whole[0], 1.0)
    mean = whole[1 : dims + 1] / n
    _, vecs = np.linalg.eigh(whole[dims + 1 :].reshape(dims, dims) / n - np.outer(mean, mean))
    return np.ascontiguousarray(vecs[:, ::-1])


def tile_links(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], ra: np.ndarray, rb: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (left, right) places of pairs whose cosine reaches the threshold; of one chunk, left < right. ``a`` and
    ``b`` are ``scaled`` vectors, ``ra`` and ``rb`` their unit vectors on the principal axes."""
    (va, length_a), (vb, length_b) = a, b
    dims = va.shape[1]
    stops = [k for k in LEADING if k < dims] or [dims]

    def rest(r: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt(np.maximum(np.einsum("ij,ij->i", r[:, k:], r[:, k:]), 0))

    suffix_a, suffix_b = {k: rest(ra, k) for k in stops}, {k: rest(rb, k) for k in stops}
    k0 = stops[0]
    wide_b = np.ascontiguousarray(np.concatenate([rb[:, :k0], suffix_b[k0][:, None]], axis=1).T)
    least = threshold - 1e-9
    for at in range(0, len(va), ROWS):
        begin = at if same else 0
        bound = np.concatenate([ra[at : at + ROWS, :k0], suffix_a[k0][at : at + ROWS, None]], axis=1) @ wide_b[:, begin:]
        left, right = np.nonzero(bound >= least)
        left, right = left + at, right + begin
        if same:
            later = left < right
            left, right = left[later], right[later]
        for k in stops[1:]:
            part = np.einsum("ij,ij->i", ra[left, :k], rb[right, :k]) + suffix_a[k][left] * suffix_b[k][right]
            left, right = left[part >= least], right[part >= least]
        if len(left):
            cosine = np.einsum("ij,ij->i", va[left], vb[right]) / (length_a[left] * length_b[right])
            good = cosine >= threshold
            for k in np.flatnonzero(np.abs(cosine - threshold) <= 1e-15 * dims).tolist():  # within what rounding may change
                good[k] = reaches(va[left[k]], vb[right[k]], threshold)
            left, right = left[good], right[good]
        if len(left):
            yield left, right


def length_links(nodes: DataFrame, dims: int, threshold: float, chunk: int) -> DataFrame:
    """nodes: (v, node, copies) of one length. Rows (kind, a, b): kind 0, node a has b linked vectors in a tile; kind 1, a
    link of a spanning forest."""
    spark = nodes.sparkSession
    turn = axes(nodes, dims)
    chunk = max(min(chunk, CHUNK_BYTES // (8 * dims)), 64)
    width = float(np.sqrt(max(2 - 2 * threshold, 0.0))) + 1e-6

    def first_axis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, dims) if batch.num_rows else np.empty((0, dims))
            yield pa.RecordBatch.from_arrays([pa.array(unit(x) @ turn[:, 0] if batch.num_rows else [], pa.float64()), *batch.columns], names=["p", "v", "node", "copies"])

    placed = materialize(nodes.select("v", "node", "copies").mapInArrow(first_axis, "p double, v binary, node long, copies long"), "placed")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held, n = TaskContext.get().partitionId(), 0, [], 0

        def out(t: pa.Table) -> pa.RecordBatch:
            nonlocal made
            p = t.column("p").to_numpy()
            blob = b"".join(t.column("v").to_pylist())
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + (made - 1) // SIDE], pa.int64()), pa.array([made], pa.int32()), pa.array([p.min()]), pa.array([p.max()]), pa.array([t.column("node").to_numpy().tobytes()], pa.binary()), pa.array([t.column("copies").to_numpy().tobytes()], pa.binary()), pa.array([blob], pa.binary())], names=["block", "chunk", "lo", "hi", "nodes", "copies", "vectors"])

        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, chunk - n)
                batch = batch.slice(take.num_rows)
                held.append(take)
                n += take.num_rows
                if n == chunk:
                    yield out(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield out(pa.Table.from_batches(held))

    n_parts = max(1, min(parts(spark), -(-placed.count() // (chunk * SIDE))))
    dealt = placed.repartitionByRange(n_parts, "p").sortWithinPartitions("p")
    packs = materialize(dealt.mapInArrow(chunks, "block long, chunk int, lo double, hi double, nodes binary, copies binary, vectors binary"), "chunks")
    meta = packs.groupBy("block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cells = F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))
    left = meta.select(F.col("block").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(cells).alias("cell"))
    near = F.sequence(F.floor(F.col("lo") / width) - 1, F.floor(F.col("hi") / width) + 1)
    right = meta.select(F.col("block").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.explode(near).alias("cell"))
    pairs = left.join(right, "cell").where((F.col("a") <= F.col("b")) & (F.col("lo_b") - F.col("hi_a") <= width) & (F.col("lo_a") - F.col("hi_b") <= width)).select("a", "b").distinct()
    pairs = materialize(pairs, "pairs")

    def tile(one: dict, two: dict, same: bool) -> pa.RecordBatch | None:
        na, ca, nb, cb = one["nodes"], one["copies"], two["nodes"], two["copies"]
        names = na if same else np.concatenate([na, nb])
        count = np.zeros(len(names), np.int64)
        label = np.arange(len(names))
        tree: list[tuple[int, int]] = []
        for x, y in tile_links(one["scaled"], two["scaled"], one["turned"], two["turned"], same, threshold):
            r = y if same else y + len(na)
            count += np.bincount(x, cb[y], len(names)).astype(np.int64) + np.bincount(r, ca[x], len(names)).astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist() + [len(x)]
            for p, q in zip(begin, begin[1:], strict=False):
                me = int(x[p])
                of = label[r[p:q]]
                new, first = np.unique(of[of != label[me]], return_index=True)
                if len(new):
                    places = r[p:q][of != label[me]][first]
                    tree += [(me, int(z)) for z in places]
                    label[np.isin(label, new)] = label[me]
        some = np.flatnonzero(count)
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array([0] * len(some) + [1] * len(tree), pa.int32()), pa.array(np.concatenate([names[some], names[[x for x, _ in tree]]])), pa.array(np.concatenate([count[some], names[[y for _, y in tree]]]))],
            names=["kind", "a", "b"],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a_id, b_id), t in grouped(batches, 2):
            sides: tuple[list[dict], list[dict]] = ([], [])
            for r in t.to_pylist():
                rows, length = scaled(np.frombuffer(r["vectors"], np.float64).reshape(-1, dims))
                sides[r["side"]].append({"lo": r["lo"], "hi": r["hi"], "nodes": np.frombuffer(r["nodes"], np.int64), "copies": np.frombuffer(r["copies"], np.int64), "scaled": (rows, length), "turned": rows / length[:, None] @ turn})
            alone = a_id == b_id
            for i, one in enumerate(sides[0]):
                for j, two in enumerate(sides[0] if alone else sides[1]):
                    if (alone and j < i) or two["lo"] - one["hi"] > width or one["lo"] - two["hi"] > width:
                        continue
                    if (found := tile(one, two, alone and i == j)) is not None:
                        yield found

    # a pair of blocks is one unit of work: a chunk travels once for each block that it is compared with
    side = lambda k, s: pairs.where("a <> b" if k else "true").join(packs, F.col(s) == F.col("block")).select("a", "b", F.lit(k).alias("side"), "chunk", "lo", "hi", "nodes", "copies", "vectors")
    tiles = side(0, "a").unionByName(side(1, "b")).repartition(4 * parts(spark), "a", "b").sortWithinPartitions("a", "b", "side", "chunk")
    return materialize(tiles.mapInArrow(compare, "kind int, a long, b long"), "links")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", column: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """Per row: key, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(valid_rows(batch.column(1)), pa.binary())], names=["vec_id", "v"])

    packed = materialize(rows.mapInArrow(pack, "vec_id long, v binary"), "vectors")
    able = packed.where("v IS NOT NULL AND vec_id IS NOT NULL")
    nodes = materialize(able.groupBy("v").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies")), "nodes")
    by_length = nodes.withColumn("dims", (F.octet_length("v") / 8).cast("int"))
    lengths = sorted(r["dims"] for r in by_length.groupBy("dims").count().where("count > 1").collect())  # one row for each length
    links = spark.createDataFrame([], "kind int, a long, b long")
    for dims in lengths:
        links = links.unionByName(length_links(by_length.where(F.col("dims") == dims).drop("dims"), dims, threshold, chunk))
    counts = links.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("linked"))
    comps = connected_components(links.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = nodes.join(counts, "node", "left").join(comps, "node", "left")
    named = materialize(named.select("v", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "named")
    found = able.join(named, "v").select("vec_id", "n_links", "component_id")
    alone = packed.where("v IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).select(F.col("vec_id").alias(key), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The same in DuckDB: unit vectors, all pairs of equal length, and components by the least reachable id.
ORACLE = """
WITH RECURSIVE able AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
u AS (SELECT DISTINCT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM able WHERE list_bool_or(list_transform(e, lambda x: x <> 0))),
links AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS v, vec_id AS r FROM u UNION SELECT l.a, r.r FROM reach r JOIN links l ON l.b = r.v),
least AS (SELECT v, min(r) AS c FROM reach GROUP BY v),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(l.c, e.vec_id) AS component_id, coalesce(l.c, e.vec_id) IS NOT DISTINCT FROM e.vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least l ON l.v = e.vec_id
"""
