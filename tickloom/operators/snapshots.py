"""Point-in-time snapshots: which bars of several frames were known at an instant, with a checksum of their versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import uuid5
from .asof import tails

#: Namespace of URLs (RFC 4122).
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
#: Bars of the primary frame and of each context that a snapshot names.
PRIMARY_BARS, CONTEXT_BARS = 120, 64


def iso(ts: Column) -> Column:
    """A time in UTC as ISO text; parts of a second only where there are any."""
    t = ts.cast("timestamp")
    whole = F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    return F.concat(whole, F.when(micros > 0, F.format_string(".%06d", micros)).otherwise(F.lit("")), F.lit("+00:00"))


def build(primary: DataFrame, history: DataFrame, contexts: dict[str, DataFrame], by: list[str], extra: Column | None = None, limits: tuple[int, int] = (PRIMARY_BARS, CONTEXT_BARS)) -> DataFrame:
    """A snapshot for each bar of ``primary``: what the latest versions of ``history`` and ``contexts`` were when it closed.

    ``primary`` has by, candle_id, closes_at, source_watermark, data_mode, data_status, and optionally data_as_of and developing_id; the others have by,
    candle_id, closes_at, one version of a bucket each. Adds decision_time, recent_ids, <context>_ids and _id, model_input_ids (primary bars first,
    oldest first), checksum, snapshot_id, blockers and eligible. data_as_of is never before the decision. ``extra``: an array of more
    blockers. Sources other than live and missing contexts block; a snapshot without blockers is eligible.
    """
    has = lambda c: F.col(c) if c in primary.columns else F.lit(None)
    rows = primary.withColumn("decision_time", F.col("closes_at")).withColumn("data_as_of", F.greatest("closes_at", F.coalesce(has("data_as_of").cast(primary.schema["closes_at"].dataType), "closes_at")))
    rows = rows.withColumn("developing_id", has("developing_id").cast("string"))
    rows = tails(rows, history, by, "closes_at", "closes_at", ["candle_id"], limits[0], "_own").withColumn("recent_ids", F.col("_own.candle_id")).drop("_own")
    names = ["recent_ids"]
    for name, bars in contexts.items():
        rows = tails(rows, bars, by, "closes_at", "closes_at", ["candle_id"], limits[1], "_own").withColumn(f"{name}_ids", F.col("_own.candle_id")).drop("_own")
        rows = rows.withColumn(f"{name}_id", F.try_element_at(f"{name}_ids", F.lit(-1)))
        names.append(f"{name}_ids")
    rows = rows.withColumn("model_input_ids", F.concat(*names)).withColumn("checksum", F.sha2(F.array_join("model_input_ids", "|").cast("binary"), 256))
    blocked = [F.when(F.col("data_mode") != "LIVE", F.lit("REPLAY_MODE")), F.when(F.col("data_status") != "LIVE", F.concat(F.lit("DATA_STATUS_"), "data_status"))]
    blocked += [F.when(F.col(f"{name}_id").isNull(), F.lit(f"FINALIZED_{name.upper()}_CONTEXT_UNAVAILABLE")) for name in contexts]
    codes = F.array_compact(F.array(*blocked))
    rows = rows.withColumn("blockers", codes if extra is None else F.array_distinct(F.concat(codes, F.coalesce(extra, F.array().cast("array<string>")))))
    said = F.concat_ws(":", F.lit("snapshot"), *by, iso(F.col("decision_time")), "checksum", "data_mode", "data_status", iso(F.col("data_as_of")), F.coalesce(F.col("source_watermark").cast("string"), F.lit("None")))
    return rows.withColumn("snapshot_id", uuid5(NAMESPACE, said)).withColumn("eligible", F.size("blockers") == 0)


def view_errors(views: DataFrame, by: list[str]) -> DataFrame:
    """Adds errors: why a snapshot and the bars sent with it do not belong together; only views without errors may be published.

    Needs a snapshot's columns, primary_id, ``bars`` (array of structs: candle_id, frame, opens_at, closes_at, status, and by), ``developing`` (such a
    struct or null), and primary_frame.
    """
    ids = F.col("bars.candle_id")
    buckets = F.transform("bars", lambda x: F.struct(x["frame"], x["opens_at"]))
    differs = lambda k: lambda x: ~x[k].eqNullSafe(F.col(k))
    other = F.lit(False)
    for k in by:
        other = other | F.exists("bars", differs(k))
    own = F.get(F.filter("bars", lambda x: x["candle_id"] == F.col("primary_id")), F.lit(0))
    late = F.exists("bars", lambda x: x["closes_at"] > F.col("decision_time"))
    developing = F.col("developing")
    pairs = [
        (F.size(F.array_distinct(ids)) != F.size(ids), "CANDLE_IDS_NOT_UNIQUE"), (F.exists("bars", lambda x: x["status"] != "FINALIZED"), "CANDLE_NOT_FINALIZED"), (other, "INSTRUMENT_MISMATCH"),
        (late, "CANDLE_AFTER_DECISION_TIME"), (F.size(F.array_distinct(buckets)) != F.size(buckets), "SEVERAL_REVISIONS_OF_ONE_BUCKET"),
        (F.size(F.array_except("model_input_ids", ids)) > 0, "CANDLE_REVISIONS_MISSING"), (F.coalesce(own["frame"] != F.col("primary_frame"), F.lit(True)), "PRIMARY_CANDLE_MISSING"),
        (F.coalesce(own["closes_at"] != F.col("decision_time"), F.lit(False)), "DECISION_TIME_IS_NOT_THE_PRIMARY_CLOSE"),
        (F.sha2(F.array_join("model_input_ids", "|").cast("binary"), 256) != F.col("checksum"), "REVISION_CHECKSUM_INVALID"),
        (developing.isNull() & F.col("developing_id").isNotNull(), "DEVELOPING_CANDLE_MISSING"), (F.coalesce(developing["status"] != "DEVELOPING", F.lit(False)), "DEVELOPING_CANDLE_HAS_OTHER_STATUS"),
        (developing.isNotNull() & ~F.coalesce(developing["candle_id"] == F.col("developing_id"), F.lit(False)), "DEVELOPING_CANDLE_MISMATCH"),
        (developing.isNotNull() & F.coalesce(F.array_contains("model_input_ids", developing["candle_id"]), F.lit(False)), "DEVELOPING_CANDLE_IS_AN_INPUT"),
    ]
    return views.withColumn("errors", F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in pairs])))
