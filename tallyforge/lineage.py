"""Tables written to the folder that the driver and all executors share: lineage cuts that survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Where a local session without ``spark.checkpoint.dir``, which can't be set in a running one, keeps its temporary folder.
LOCAL = "tallyforge.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and Spark is local (tests), a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(LOCAL, None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set(LOCAL, base)
    return base.rstrip("/")


def written(df: DataFrame, what: str, partitioned_by: str | None = None) -> DataFrame:
    """``df`` written and read back."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    out = df.write.partitionBy(partitioned_by) if partitioned_by else df.write
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)
