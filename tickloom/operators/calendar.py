"""Trading sessions: which day trades when, the phase of an instant, and buckets anchored at the session's open."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the exchange: its clock's offset from UTC in minutes, sessions and auction times of rules by first day.
OFFSET_MINUTES = 330
SESSION_RULES = (("2000-01-01", "09:15", "15:30"), ("2026-08-03", "09:15", "15:15"))
AUCTION_RULES = (("2026-08-03", "15:15", "15:20", "15:30", "15:35"),)


@dataclasses.dataclass(frozen=True)
class Calendar:
    """Holidays, special sessions (day: open, close), session rules and closing-auction rules by their first day."""

    holidays: tuple[str, ...] = ()
    special: tuple[tuple[str, str, str], ...] = ()
    rules: tuple[tuple[str, str, str], ...] = SESSION_RULES
    auctions: tuple[tuple[str, str, str, str, str], ...] = AUCTION_RULES
    verified: tuple[str, str] | None = None

    @classmethod
    def read(cls, text: str) -> Calendar:
        """From the JSON form; days outside the verified range are refused by ``sessions``."""
        x = json.loads(text)
        special = tuple((d, s["open"], s["close"]) for d, s in sorted((x.get("special_sessions") or {}).items()))
        rules = tuple((r["effective_from"], r["open"], r["close"]) for r in x.get("continuous_session_rules") or ()) or SESSION_RULES
        auctions = tuple((r["effective_from"], r["reference_starts"], r["order_entry_starts"], r["matching_starts"], r["matching_ends"]) for r in x.get("closing_auction_rules") or ())
        verified = (x["verified_from"], x["verified_through"]) if x.get("verified_from") else None
        return cls(tuple(x.get("holidays") or ()), special, rules, auctions or AUCTION_RULES, verified)


def sessions(spark: SparkSession, calendar: Calendar, first: dt.date, last: dt.date) -> DataFrame:
    """Rows (session_date, opens_at, closes_at) of trading days, in UTC. A special session beats weekends, holidays and rules."""
    if calendar.verified and not (calendar.verified[0] <= str(first) and str(last) <= calendar.verified[1]):
        raise ValueError(f"the calendar is verified from {calendar.verified[0]} to {calendar.verified[1]} only")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("session_date"))
    day = F.col("session_date")
    rule = F.lit(None).cast("struct<open:string,close:string>")
    pair = lambda o, c: F.struct(F.lit(o).alias("open"), F.lit(c).alias("close"))
    for start, o, c in sorted(calendar.rules):  # the latest rule in force
        rule = F.when(day >= F.lit(start).cast("date"), pair(o, c)).otherwise(rule)
    closed = F.weekday(day) >= 5
    if calendar.holidays:
        closed |= day.cast("string").isin(*calendar.holidays)
    rule = F.when(~closed, rule)
    for d, o, c in calendar.special:
        rule = F.when(day == F.lit(d).cast("date"), pair(o, c)).otherwise(rule)
    at = lambda field: F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.col("r")[field])) - F.expr(f"interval {OFFSET_MINUTES} minutes")
    return days.withColumn("r", rule).where("r is not null").select("session_date", at("open").alias("opens_at"), at("close").alias("closes_at"))


def local_date(ts: Column) -> Column:
    """The exchange's date of a UTC instant."""
    return (ts + F.expr(f"interval {OFFSET_MINUTES} minutes")).cast("date")


def in_session(rows: DataFrame, days: DataFrame, ts: str) -> DataFrame:
    """Adds session_date, session_opens, session_closes; null outside of [open, close). One row a day joins, so days are few against rows."""
    d = days.select("session_date", F.col("opens_at").alias("session_opens"), F.col("closes_at").alias("session_closes"))
    t = F.col(ts).cast("timestamp")
    inside = (local_date(t) == F.col("session_date")) & (t >= F.col("session_opens")) & (t < F.col("session_closes"))
    return rows.join(d, inside, "left")


def bucket(rows: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Adds bucket_opens, bucket_closes, partial: buckets of ``minutes`` counted from the session's open, the last cut at its close."""
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp("session_opens")
    opens = F.timestamp_seconds(F.unix_timestamp("session_opens") + F.floor(seconds / (60 * minutes)) * 60 * minutes)
    rows = rows.withColumn("bucket_opens", opens)
    nominal = F.col("bucket_opens") + F.expr(f"interval {minutes} minutes")
    return rows.withColumn("bucket_closes", F.least(nominal, F.col("session_closes"))).withColumn("partial", F.col("bucket_closes") < nominal)


def expected_minutes(days: DataFrame) -> DataFrame:
    """Rows (session_date, opens_at): every minute that a session should have."""
    last = F.col("closes_at") - F.expr("interval 1 minute")
    return days.select("session_date", F.explode(F.sequence("opens_at", last, F.expr("interval 1 minute"))).alias("opens_at"))


def phase(ts: Column, calendar: Calendar = Calendar()) -> Column:
    """Phase of an instant within its session columns (``in_session``): continuous, three auction phases, or closed. Special sessions have no auction."""
    t = ts.cast("timestamp")
    day = local_date(t)
    clock = lambda hm: F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.lit(hm))) - F.expr(f"interval {OFFSET_MINUTES} minutes")
    trading = F.weekday(day) < 5
    for off in (calendar.holidays, tuple(d for d, _, _ in calendar.special)):
        if off:
            trading &= ~day.cast("string").isin(*off)
    out = F.lit("CLOSED")
    for start, reference, entry, matching, end in sorted(calendar.auctions):  # the latest rule in force alone
        own = F.lit("CLOSED")
        for low, high, name in ((reference, entry, "CLOSING_AUCTION_REFERENCE"), (entry, matching, "CLOSING_AUCTION_ORDER_ENTRY"), (matching, end, "CLOSING_AUCTION_MATCHING")):
            own = F.when((t >= clock(low)) & (t < clock(high)), F.lit(name)).otherwise(own)
        out = F.when(day >= F.lit(start).cast("date"), own).otherwise(out)
    out = F.when(trading, out).otherwise(F.lit("CLOSED"))
    return F.when(F.col("session_opens").isNotNull(), F.lit("CONTINUOUS")).otherwise(out)


AUCTION_REASON = "CLOSING_AUCTION_OBSERVATION_NOT_CONTINUOUS_CANDLE"
UNAUTHORISED = "UNAUTHORISED"


def normalised(
    bars: DataFrame, days: DataFrame, calendar: Calendar, excluded: dict[str, str] | None = None, windows: tuple[tuple[str, str, str, str], ...] = (), ts: str = "opens_at", closes: str = "closes_at"
) -> DataFrame:
    """Adds reason: null for a bar that is a whole minute of its session, else why it goes.

    ``excluded`` names sessions that go as a whole (day: reason), ``windows`` (day, open, close, reason) local times within which a
    bar goes. A bar of the closing auction goes too. Any other bar is ``UNAUTHORISED``. A bar without times is UNAUTHORISED.
    """
    rows = bucket(in_session(bars, days, ts), ts, 1)
    t, end = F.col(ts).cast("timestamp"), F.col(closes).cast("timestamp")
    day = local_date(t)
    clock = lambda d, hm: F.to_timestamp(F.lit(f"{d} {hm}")) - F.expr(f"interval {OFFSET_MINUTES} minutes")
    reason = F.lit(UNAUTHORISED)
    for d, low, high, why in reversed(windows):  # the first window that holds the bar names the reason
        reason = F.when((clock(d, low) <= t) & (end <= clock(d, high)), F.lit(why)).otherwise(reason)
    reason = F.when(phase(F.col(ts), calendar).startswith("CLOSING_AUCTION"), F.lit(AUCTION_REASON)).otherwise(reason)
    reason = F.when((F.col("bucket_opens") == t) & (F.col("bucket_closes") == end), F.lit(None)).otherwise(reason)
    for d, why in (excluded or {}).items():
        reason = F.when(day == F.lit(d).cast("date"), F.lit(why)).otherwise(reason)
    return rows.withColumn("reason", reason).drop("session_date", "session_opens", "session_closes", "bucket_opens", "bucket_closes", "partial")


def continuous(rows: DataFrame, ts: str = "opens_at") -> DataFrame:
    """The bars of ``normalised`` that stay. An unauthorised bar fails the job with its time."""
    message = F.concat(F.lit("an observation outside of the calendar: "), F.coalesce(F.col(ts).cast("string"), F.lit("null")))
    keep = F.when(F.col("reason").eqNullSafe(F.lit(UNAUTHORISED)), F.raise_error(message).isNull()).otherwise(F.col("reason").isNull())
    return rows.where(keep).drop("reason")
