"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def materialized(df: DataFrame, label: str) -> DataFrame:
    """df, written and read back: later plans start here, and lost executors repeat nothing before it."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    uri = f"{folder.rstrip('/')}/factloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)
