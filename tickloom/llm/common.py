"""What the corpus operators share: inputs, staged tables, exact ranks."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="tickloom-")


def shared_dir(spark: SparkSession) -> str:
    """The session's folder in the one that driver and executors share (spark.checkpoint.dir).

    Where that is not set, a local session (all in one process, as in tests) gets a temporary folder; a cluster has no folder to guess.
    """
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/tickloom/{spark.sparkContext.applicationId}"


def free_shuffles(table: DataFrame) -> None:
    """Lets Spark delete the shuffle files behind a staged table, which it does once the driver's garbage collection finds them unused.

    They may be larger than the tables, and nothing reads them again. The session holds its last query until another one has run.
    """
    table.isEmpty()
    table.sparkSession.sparkContext._jvm.System.gc()


def clear_staged(spark: SparkSession) -> None:
    """Deletes what this session has staged; DataFrames that read from it can no longer be used."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """While a table is written, Arrow batches of few rows, as texts may be long; then the session has its own setting again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, str(min(int(own), rows) if int(own) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def staged(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    with small_batches(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads again, as all that was made of them is staged itself."""
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for file in table.inputFiles():
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(file))
            path.getFileSystem(conf).delete(path, False)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what is made of long texts stays small; Spark bounds a batch's bytes."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def row_key() -> Column:
    """A hash of a document's id and text: rows that share an id are told apart, rows that share both are alike in all that is judged."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], salt: list[str], share: int = 2048, merge: bool = False) -> DataFrame:
    """Inner equi-join of ``many``, in which a few keys may hold a large part of all rows, with ``one`` (few rows a key).

    A key with more than one in ``share`` of ``many``'s rows is dealt to parts by a hash of ``salt``, and
    ``one``'s rows of that key are repeated for each part. There are fewer than ``share`` such keys whatever the
    size, so their list is broadcast. ``many`` is read twice: give a staged table. ``merge``: ``one`` grows with the
    corpus, so it is not to be broadcast.
    """
    each = max(1, many.count() // share)
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(each, 64))
    hot = F.broadcast(counts.select(*keys, F.ceil(F.col("_n") / each).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = many.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt), parts).cast("int")).drop("_parts")
    right = one.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    right = right.hint("merge") if merge else right
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def ranked(
    df: DataFrame, keys: list[str], order: list[str], out: str, bucket: Column | None = None, buckets: int = 1024
) -> DataFrame:
    """Gapless rank from 0 within ``keys``, in a fixed order: by bucket, then ``order``.

    Counts of (keys, bucket) give each bucket's start, so no task holds a whole
    key. ``bucket`` must spread a hot key's rows; by default it hashes ``order``.
    """
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)) if bucket is None else bucket)
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy(*keys, "_b").orderBy(*order)
    rows = df.withColumn("_r", F.row_number().over(within)).join(starts, [*keys, "_b"])
    return rows.withColumn(out, F.col("_start") + F.col("_r") - 1).drop("_b", "_r", "_start")
