"""Registration of queries with their SQL oracle, and the inputs that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def floored(ts: str, seconds: int, offset: int = 0):
    """Start of the bucket of ``seconds`` that holds a timestamp without zone, counted from ``offset`` seconds after midnight 1970."""
    s = F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.timestamp_seconds(F.floor((s - offset) / seconds) * seconds + offset).cast("timestamp_ntz")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events.value; the event type is the series, the day its session."""
    ticks = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    bars = candles.from_ticks(ticks, floored("ts", 3600), ["event_type"])
    return bars.withColumn("session_date", F.col("opens_at").cast("date"))


#: The same bars in SQL; every oracle over bars starts with these expressions.
BARS = """bars AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS opens_at, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, (ts, event_id)) AS close, count(*) AS n_ticks, date_trunc('hour', ts)::DATE AS session_date FROM events GROUP BY 1, 2, 8)"""
ORDERED = BARS + ", s AS (SELECT *, row_number() OVER w AS n, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY opens_at))"


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Rounded for comparison: engines add in other orders. No zero is negative."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})
