"""Tables written to the cluster's shared folder between the steps of a long plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder of our own only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write and read back: what follows does not recompute, and survives a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/docweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
