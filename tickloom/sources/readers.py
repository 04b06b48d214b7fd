"""Sources: bar files, tick lines, chunked acquisition, contract masters. Bad rows fail; nothing is filled in."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import codes, uuid5
from ..operators.ingest import NAMESPACE, RAW

BARS = """provider_bar_id string, provider_revision int, opens_at timestamp, closes_at timestamp, open decimal(18,6), high decimal(18,6), low decimal(18,6),
    close decimal(18,6), volume decimal(18,6), finalized_at timestamp, source_watermark string"""


class BarSource(Protocol):
    """Anything that gives bars of [start, end) as a DataFrame of ``BARS``."""

    def fetch(self, spark: SparkSession, start: dt.datetime, end: dt.datetime) -> DataFrame: ...


def require(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """Rows as they are; a row for which the condition is not true fails the job when it is read."""
    keep = F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).isNull())
    return rows.where(keep)


def bars_csv(spark: SparkSession, path: str, volume_allowed: bool = False) -> DataFrame:
    """Bars from CSV with a header of exactly the columns of ``BARS`` (any order of files); malformed rows, nulls and wrong orders of prices fail."""
    rows = spark.read.schema(BARS).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    needed = [c for c in rows.columns if c != "volume"]
    ok = F.lit(True)
    for c in needed:
        ok &= F.col(c).isNotNull()
    rows = require(rows, ok, "a bar lacks a value")
    rows = require(rows, (F.col("low") > 0) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")), "a bar's prices are out of order")
    return rows if volume_allowed else require(rows, F.col("volume").isNull(), "an index bar has a volume")


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def dataset_id(hashes: DataFrame) -> Column:
    """Identity of a dataset from its files' hashes in order (use in one aggregation)."""
    return uuid5(NAMESPACE, F.concat_ws("|", F.array_sort(F.collect_list("sha256"))))


def ticks_jsonl(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Raw market events, one JSON object a line; blank lines are skipped, malformed ones fail."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(RAW).option("mode", "FAILFAST").json(path)


def chunks(start: dt.datetime, end: dt.datetime, days: int) -> list[tuple[dt.datetime, dt.datetime]]:
    """[start, end) in pieces of 1 to 30 days."""
    if not 1 <= days <= 30 or start >= end:
        raise ValueError("pieces have 1 to 30 days, and the start lies before the end")
    out, at = [], start
    while at < end:
        out.append((at, min(end, at + dt.timedelta(days=days))))
        at = out[-1][1]
    return out


def acquired(spark: SparkSession, fetch: Callable[[dt.datetime, dt.datetime], list[tuple]], start: dt.datetime, end: dt.datetime, days: int, schema: str) -> DataFrame:
    """Rows of ``fetch`` for every chunk, one task a chunk; equal repeats of a minute merge, different ones fail."""
    pieces = spark.createDataFrame(chunks(start, end, days), "start timestamp, end timestamp")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for a, b in zip(pdf["start"], pdf["end"]):
                yield pd.DataFrame(fetch(a.to_pydatetime(), b.to_pydatetime()), columns=[c.split()[0] for c in schema.split(", ")])

    rows = pieces.repartition(max(1, pieces.count()), "start").mapInPandas(run, schema).distinct()
    n = F.count(F.lit(1)).over(W.partitionBy("opens_at"))
    return require(rows.withColumn("_n", n), F.col("_n") == 1, "two chunks disagree on a minute").drop("_n")


def decoded_ticks(raw: DataFrame, token: str, scale: int) -> DataFrame:
    """Prices from scaled integers and times from epoch milliseconds; another token fails. Sequences of this feed are not contiguous."""
    rows = require(raw, F.col("token") == token, "a tick of another instrument")
    return rows.select(
        "token", F.timestamp_millis("exchange_timestamp").alias("provider_event_time"), (F.col("last_traded_price").cast("decimal(18,6)") / scale).cast("decimal(18,6)").alias("price"),
        F.col("sequence_number").alias("provider_sequence"), F.lit(False).alias("provider_sequence_is_contiguous"),
    )


def decoded_bars(rows: DataFrame, instrument: str) -> DataFrame:
    """Bars with an id from their content; index volume becomes null."""
    text = F.concat_ws("|", F.lit(instrument), F.date_format("opens_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), *[F.format_string("%.6f", F.col(c).cast("double")) for c in ("open", "high", "low", "close")])
    out = rows.withColumn("provider_bar_id", uuid5(NAMESPACE, text)).withColumn("volume", F.lit(None).cast("decimal(18,6)"))
    return require(out, (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") > 0), "a bar's prices are out of order")


def canonical_rows_hash(rows: DataFrame, order: list[str]) -> DataFrame:
    """One SHA-256 of a set of rows: row hashes in groups, then of the groups, so no task holds all rows' text."""
    h = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("h"), *order)
    day = h.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("h"))), 256).alias("h"))
    return day.agg(F.sha2(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"])), 256).alias("sha256"))


def nearest_contracts(master: DataFrame, exchange: str, name: str, today: dt.date) -> DataFrame:
    """For each instrument type the contract that expires first on or after today, ties by symbol. Expiry is text such as 28AUG2026."""
    rows = master.withColumn("expires_on", F.to_date(F.initcap(F.col("expiry")), "ddMMMyyyy"))
    rows = rows.where((F.col("exchange") == exchange) & (F.col("name") == name) & (F.col("expires_on") >= F.lit(today)))
    best = F.min_by(F.struct("token", "symbol", "expires_on"), F.struct("expires_on", "symbol")).alias("c")
    return rows.groupBy("instrument_type").agg(best).select("instrument_type", "c.*")


def derivatives_snapshot(options: DataFrame, keys: list[str]) -> DataFrame:
    """By snapshot: volatility at the money (mean of the options nearest to deltas of a half), the skew of deltas of a quarter, and the put-call ratio of volume."""
    near = lambda kind, delta: F.min_by(F.when(F.col("kind") == kind, F.col("iv")), F.when(F.col("kind") == kind, F.struct(F.abs(F.col("delta") - delta), F.col("strike"))))
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("volume")))
    return options.groupBy(*keys).agg(
        ((near("CE", 0.5) + near("PE", -0.5)) / 2).alias("atm_implied_volatility"), (near("PE", -0.25) - near("CE", 0.25)).alias("delta25_put_call_iv_skew"),
        F.try_divide(total("PE").cast("double"), total("CE").cast("double")).alias("option_volume_put_call_ratio"),
    )


def futures_snapshot(rows: DataFrame) -> DataFrame:
    """Adds the book's imbalance and the basis in hundredths of a percent."""
    buy, sell = F.col("total_buy_quantity").cast("double"), F.col("total_sell_quantity").cast("double")
    return rows.withColumn("futures_book_imbalance", F.try_divide(buy - sell, buy + sell)).withColumn("futures_basis_bps", F.try_divide(F.col("futures_ltp") - F.col("spot_ltp"), F.col("spot_ltp")) * 10000)


def readiness(rows: DataFrame, least_rows: int = 3000, least_sessions: int = 60, least_days: int = 90, least_options: float = 0.80) -> DataFrame:
    """One row of counts of ``features.derivatives`` rows, and the blockers that keep them from research.

    Rows, sessions and the span of days (first and last included) count rows with a complete core; the share of complete options is of the regular rows.
    """
    core, regular = F.col("complete_core"), F.col("regular")
    day = F.when(core, F.col("session_date").cast("date"))
    out = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(regular).alias("n_regular"), F.count_if(core).alias("n_complete"), F.count_distinct(day).alias("n_sessions"),
        F.coalesce(F.date_diff(F.max(day), F.min(day)) + 1, F.lit(0)).alias("span_days"), F.coalesce(F.try_divide(F.count_if("options_complete"), F.count_if(regular)), F.lit(0.0)).alias("options_share"),
    )
    blockers = codes(
        (F.col("n_complete") < least_rows, "DERIVATIVES_COMPLETE_ROW_SUPPORT_TOO_LOW"), (F.col("n_sessions") < least_sessions, "DERIVATIVES_SESSION_SUPPORT_TOO_LOW"),
        (F.col("span_days") < least_days, "DERIVATIVES_CALENDAR_SPAN_TOO_SHORT"), (F.col("options_share") < least_options, "OPTIONS_CONTEXT_COMPLETENESS_TOO_LOW"),
    )
    return out.withColumn("blockers", blockers)
