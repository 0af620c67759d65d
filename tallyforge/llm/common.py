"""Shared folder, lineage cuts and connected components used by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_dir

#: Deletes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind: their results are written or at the driver by then."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a lineage cut that survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, what)
    with shuffles_go(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more, or those that tables with a handle of theirs come from."""
    for t in tables:
        path = getattr(t, "_written", None)
        if path:
            jvm = t.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) -> (node, component): the smallest node that each node reaches. Nodes without an edge do not occur.

    Alternating large-star and small-star rounds. A hub's neighbourhood is never gathered: its minimum comes from a
    partial aggregate, and the join that follows reads that minimum from a table of its own, so that AQE may split
    the hub's rows. Every round is cut by written tables. It ends when a large-star step moves no edge and no node
    has two edges left, which is exact.
    """
    pairs = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    state = materialize(pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
        # one row for each edge: its larger node, and the smallest neighbour of its smaller one
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved")), "cc-large")
        seen = large.agg(F.count("*").alias("n"), F.count_if("moved").alias("moved")).first()
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        if not seen["moved"] and low2.count() == seen["n"]:
            discard(low, large, low2)
            break
        # (neighbour, minimum) for each further neighbour, and (node, minimum) once
        further = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(further.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(state, low, large, low2)
        state = small
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out._written = state._written
    return out
