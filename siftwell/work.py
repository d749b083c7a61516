"""Scratch folders that all executors see, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a temporary one if all of Spark runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base and not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or f"file://{tempfile.mkdtemp(prefix='siftwell-')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to a new folder and read it back: cuts lineage, survives lost executors, and all uses see the same rows."""
    path = folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
