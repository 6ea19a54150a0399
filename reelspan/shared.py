"""Folders that the driver and all executors share, and tables kept there between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; where the setting is missing, a local master gets a temporary one and a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-sinks-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet and read again, so that what follows doesn't compute them anew."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
