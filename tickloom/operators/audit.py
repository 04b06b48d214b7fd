"""Hash chains, append-only tables, and pending work."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chains import matched, ranked

GENESIS = "0" * 64


def event_hash(previous: Column, *fields: str) -> Column:
    return F.sha2(F.concat_ws("|", previous, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256)


def chained(rows: DataFrame, by: list[str], order: str, fields: list[str]) -> DataFrame:
    """Adds previous_hash and event_hash in order. Each hash holds the one before, so a chain is sequential;
    chains (``by``) are independent and run side by side. A task streams its chains' sorted rows and keeps the last hash only."""
    text = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"_f{k}") for k, f in enumerate(fields)]
    key = F.to_json(F.struct(*by)).alias("_key")
    # texts and key are made behind the shuffle, which moves the rows alone
    ordered = rows.repartition(*by).sortWithinPartitions(*by, order).select("*", *text, key)
    schema = rows.withColumn("previous_hash", F.lit("")).withColumn("event_hash", F.lit("")).schema
    n = len(rows.columns)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, GENESIS
        for batch in batches:
            before, own = [], []
            columns = [c.to_pylist() for c in batch.columns[n:]]
            for *values, k in zip(*columns):
                last = last if k == key else GENESIS
                key = k
                before.append(last)
                last = hashlib.sha256("|".join([last, *values]).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(before, pa.string()), pa.array(own, pa.string())], [f.name for f in schema])

    return ordered.mapInArrow(chain, schema)


def broken(rows: DataFrame, by: list[str], order: str, fields: list[str]) -> DataFrame:
    """Rows whose hash is not that of their content, or whose previous hash is not the row's before.

    Previous hashes are stored, so a chain is not followed: rows get places, and each meets the one a place before. No task holds a chain.
    """
    placed = ranked(rows, by, [order], "_i")
    before = placed.select(*by, (F.col("_i") + 1).alias("_i"), F.col("event_hash").alias("_before"))
    checked = matched(placed, before, [*by, "_i"], "left").withColumn("_before", F.coalesce("_before", F.lit(GENESIS)))
    return checked.where((F.col("event_hash") != event_hash(F.col("previous_hash"), *fields)) | (F.col("previous_hash") != F.col("_before"))).select(*rows.columns)


def pending(predictions: DataFrame, assessments: DataFrame, key: str, due: str, now: Column) -> DataFrame:
    """Due rows without an assessment."""
    return predictions.where(F.col(due) <= now).join(assessments.select(key), key, "left_anti")


def append_new(new: DataFrame, path: str, key: list[str], content: list[str]) -> int:
    """Appends rows whose key the Parquet table at ``path`` does not hold; a key with other content is an error. Returns the number appended."""
    spark = new.sparkSession
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except Exception as e:  # a table that is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], new.schema)
    same = F.lit(True)
    for c in content:
        same &= F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    clash = new.alias("n").join(old.alias("o"), [F.col(f"n.{k}") == F.col(f"o.{k}") for k in key]).where(~same)
    if not clash.isEmpty():
        raise ValueError("rows with a known identity and other content")
    fresh = new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(new.columns)
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    return n
