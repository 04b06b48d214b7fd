"""Sinks: idempotent appends, datasets with a manifest, bundles and reports with digests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import append_new


def _known(spark: SparkSession, path: str, identity: str) -> bool:
    try:
        return not spark.read.parquet(path).where(F.col("dataset_id") == identity).isEmpty()
    except Exception as e:  # no manifest yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False


def save_dataset(candles: DataFrame, root: str, identity: str, status: str, source: str) -> bool:
    """Writes a dataset's candles, then its manifest row, which makes it visible; False if it is there. Rejected datasets keep the row only."""
    spark = candles.sparkSession
    if _known(spark, f"{root}/manifest", identity):
        return False
    span = candles.agg(F.min("opens_at").alias("starts_at"), F.max("closes_at").alias("ends_at"), F.count(F.lit(1)).alias("n_candles"))
    if status != "REJECTED":
        candles.withColumn("dataset_id", F.lit(identity)).write.mode("overwrite").parquet(f"{root}/candles/dataset={identity}")
    span.select(F.lit(identity).alias("dataset_id"), F.lit(status).alias("status"), F.lit(source).alias("source"), F.current_timestamp().alias("acquired_at"), "starts_at", "ends_at", "n_candles").write.mode("append").parquet(f"{root}/manifest")
    return True


def latest_passed(spark: SparkSession, root: str) -> str | None:
    """The newest dataset of status PASS."""
    rows = spark.read.parquet(f"{root}/manifest").where("status = 'PASS'").orderBy(F.desc("ends_at"), F.desc("acquired_at"), F.desc("dataset_id")).limit(1).collect()
    return rows[0]["dataset_id"] if rows else None


def dataset(spark: SparkSession, root: str, identity: str) -> DataFrame:
    return spark.read.parquet(f"{root}/candles/dataset={identity}")


def save_run(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Writes a run's tables under its id and its manifest row last; repeated writes of a run replace its tables."""
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{root}/{name}/run={run_id}")
    if spark is not None:
        row = spark.createDataFrame([(run_id, sorted(tables))], "run_id string, tables array<string>")
        append_new(row, f"{root}/runs", ["run_id"], ["tables"])


def save_bundle(rows: DataFrame, path: str, meta: dict[str, str]) -> str:
    """Rows as gzip JSON and a digest beside them; other content at the same place is an error. Acquisition times do not count."""
    from .readers import canonical_rows_hash

    spark = rows.sparkSession
    digest = canonical_rows_hash(rows, []).first()["sha256"]
    try:
        if old := spark.read.text(f"{path}/meta").first():
            if json.loads(old[0])["sha256"] != digest:
                raise ValueError("another bundle is there")
            return digest
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    # the digest comes last: rows without one are of a write that was broken off, and are replaced
    rows.write.mode("overwrite").option("compression", "gzip").json(f"{path}/rows")
    spark.createDataFrame([(json.dumps({**meta, "sha256": digest}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return digest


def read_bundle(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A bundle's rows, after their digest has been compared."""
    from .readers import canonical_rows_hash

    rows = spark.read.schema(schema).json(f"{path}/rows")
    if canonical_rows_hash(rows, []).first()["sha256"] != json.loads(spark.read.text(f"{path}/meta").first()[0])["sha256"]:
        raise ValueError("the bundle's digest differs")
    return rows
