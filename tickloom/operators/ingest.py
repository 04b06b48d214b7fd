"""Market events: normalisation, identity, validation and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import canonical_hash, codes, uuid5

#: Tolerance for events ahead of arrival, and lateness that warns, in seconds; the namespace of event ids.
FUTURE_SECONDS, LATE_SECONDS = 2, 3
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
WARNINGS = ("LATE_ARRIVAL",)
RAW = """provider string, provider_instrument_id string, event_type string, provider_event_time timestamp, provider_send_time timestamp,
    server_arrival_time timestamp, timestamp_source string, provider_sequence long, provider_sequence_scope string, provider_sequence_is_contiguous boolean,
    connection_epoch string, price decimal(18,6), last_quantity decimal(18,6), cumulative_volume decimal(18,6), bid_price decimal(18,6),
    ask_price decimal(18,6), raw_payload map<string,string>, supersedes_event_id string"""


def normalize(events: DataFrame, instruments: DataFrame) -> DataFrame:
    """Resolves the instrument (null: unknown), folds the provider's case, and picks the event time.

    The time is the provider's, or else the arrival's with code
    ARRIVAL_TIME_FALLBACK. ``instruments``: provider, provider_instrument_id, instrument_id, supports_volume.
    """
    known = instruments.select(F.lower("provider").alias("_p"), F.col("provider_instrument_id").alias("_i"), "instrument_id", "supports_volume")
    rows = events.join(known, (F.lower(F.trim("provider")) == F.col("_p")) & (F.trim("provider_instrument_id") == F.col("_i")), "left").drop("_p", "_i")
    return rows.withColumn("provider", F.lower(F.trim("provider"))).withColumn("event_time", F.coalesce("provider_event_time", "server_arrival_time")).withColumn(
        "quality_codes", F.array_sort(F.array_distinct(codes((F.col("provider_event_time").isNull(), "ARRIVAL_TIME_FALLBACK"))))
    )


def identity(rows: DataFrame) -> DataFrame:
    """Adds dedup_key and event_id: by sequence where there is one, else by time, prices and payload."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sequenced = F.to_json(F.array(F.lit("sequence"), text("provider"), text("instrument_id"), text("provider_sequence_scope"), text("provider_sequence"), text("event_type")))
    content = F.to_json(F.array(F.lit("content"), text("provider"), text("instrument_id"), text("event_type"), text("event_time"), text("price"), text("bid_price"), text("ask_price"), canonical_hash(F.coalesce("raw_payload", F.create_map().cast("map<string,string>")))))
    rows = rows.withColumn("dedup_key", F.when(F.col("provider_sequence").isNotNull(), sequenced).otherwise(content))
    return rows.withColumn("event_id", uuid5(NAMESPACE, F.col("dedup_key")))


def issues() -> Column:
    """Codes of what is wrong with a normalised event, in a fixed order."""
    c = F.col
    heartbeat, sequence, ahead = c("event_type") == "HEARTBEAT", c("provider_sequence"), F.expr(f"interval {FUTURE_SECONDS} seconds")
    late = F.expr(f"interval {LATE_SECONDS} seconds")
    volume = c("last_quantity").isNotNull() | c("cumulative_volume").isNotNull()
    return codes(
        (c("instrument_id").isNull(), "UNKNOWN_INSTRUMENT"), (sequence < 0, "NEGATIVE_SEQUENCE"),
        (sequence.isNotNull() & c("provider_sequence_scope").isNull(), "SEQUENCE_SCOPE_REQUIRED"),
        (sequence.isNull() & c("provider_sequence_scope").isNotNull(), "UNEXPECTED_SEQUENCE_SCOPE"),
        (sequence.isNull() & c("provider_sequence_is_contiguous"), "CONTIGUOUS_SEQUENCE_REQUIRED"),
        (c("event_time") > c("server_arrival_time") + ahead, "EVENT_FROM_FUTURE"), (c("server_arrival_time") > c("event_time") + late, "LATE_ARRIVAL"),
        (~heartbeat & (c("event_type") != "QUOTE") & c("price").isNull(), "PRICE_REQUIRED"), (~heartbeat & (c("price") <= 0), "PRICE_NOT_POSITIVE"),
        ((c("last_quantity") < 0) | (c("cumulative_volume") < 0), "NEGATIVE_QUANTITY"), (volume & ~F.coalesce("supports_volume", F.lit(True)), "VOLUME_NOT_SUPPORTED"),
        (c("bid_price") <= 0, "BID_NOT_POSITIVE"), (c("ask_price") <= 0, "ASK_NOT_POSITIVE"), (c("bid_price") > c("ask_price"), "CROSSED_QUOTE"),
        ((c("event_type") == "CORRECTION") & c("supersedes_event_id").isNull(), "CORRECTION_TARGET_REQUIRED"),
        ((c("event_type") != "CORRECTION") & c("supersedes_event_id").isNotNull(), "UNEXPECTED_CORRECTION_TARGET"),
    )


def route(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Adds issues and status: QUARANTINED with an error, DUPLICATE behind the first valid row of an event_id, else STORED."""
    rows = rows.withColumn("issues", issues())
    bad = F.exists("issues", lambda x: ~x.isin(*WARNINGS))
    w = W.partitionBy("event_id", bad).orderBy(*(order or ["server_arrival_time"]))
    first = F.row_number().over(w) == 1
    return rows.withColumn("status", F.when(bad, F.lit("QUARANTINED")).when(first, F.lit("STORED")).otherwise(F.lit("DUPLICATE")))


def sequence_marks(rows: DataFrame, keys: list[str], sequence: str, order: list[str]) -> DataFrame:
    """Adds mark: OUT_OF_ORDER below the largest sequence accepted before, GAP above it by more than 1, else OK.

    What is out of order does not move the state, so the state is the running maximum.
    """
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    last = F.max(sequence).over(before)
    mark = F.when(last.isNull(), F.lit("OK")).when(F.col(sequence) < last, F.lit("OUT_OF_ORDER")).when(F.col(sequence) > last + 1, F.lit("GAP")).otherwise(F.lit("OK"))
    return rows.withColumn("mark", mark)
