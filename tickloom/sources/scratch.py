"""Folders for tables that live as long as a query's result."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="tickloom-streams-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir); only a local session may go without that setting."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/streams/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own and read back: cuts lineage, gives all readers the same rows, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
