"""Sessions, auctions and minutes: what the calendar's rules, windows and revisions decide."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators import calendar, candles

CALENDAR = calendar.Calendar(
    holidays=("2026-08-12",), special=(("2026-08-13", "09:15", "12:00"),),
    auctions=(("2026-08-03", "15:15", "15:20", "15:30", "15:35"), ("2026-08-10", "15:15", "15:18", "15:21", "15:25")),
)


def utc(day, hour, minute, second=0):
    return dt.datetime(2026, 8, day, hour, minute, second) - dt.timedelta(minutes=calendar.OFFSET_MINUTES)


def days(spark):
    return calendar.sessions(spark, CALENDAR, dt.date(2026, 8, 1), dt.date(2026, 8, 31))


def test_auctions_follow_the_latest_rule_and_spare_special_sessions(spark):
    cases = {
        utc(4, 15, 16): "CLOSING_AUCTION_REFERENCE", utc(4, 15, 33): "CLOSING_AUCTION_MATCHING", utc(11, 15, 19): "CLOSING_AUCTION_ORDER_ENTRY", utc(11, 15, 33): "CLOSED",
        utc(12, 15, 16): "CLOSED", utc(13, 15, 16): "CLOSED", utc(13, 11, 59): "CONTINUOUS", utc(8, 15, 16): "CLOSED", utc(4, 9, 15): "CONTINUOUS", utc(4, 9, 14): "CLOSED",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "ts timestamp_ntz")
    out = calendar.in_session(rows, days(spark), "ts").withColumn("phase", calendar.phase(F.col("ts"), CALENDAR))
    assert {r["ts"]: r["phase"] for r in out.collect()} == cases


def bars(spark, *opens, length=60):
    return spark.createDataFrame([(t, t and t + dt.timedelta(seconds=length)) for t in opens], "opens_at timestamp_ntz, closes_at timestamp_ntz")


def test_bars_go_for_stated_reasons_alone(spark):
    windows = (("2026-08-04", "09:00", "09:15", "PRE_OPEN"), ("2026-08-04", "09:10", "09:15", "SECOND"))
    given = [utc(4, 9, 15), utc(4, 9, 10), utc(4, 9, 14), utc(4, 8, 59), utc(4, 15, 16), utc(5, 10, 0), utc(4, 10, 0, 5), None]
    out = {r["opens_at"]: r["reason"] for r in calendar.normalised(bars(spark, *given), days(spark), CALENDAR, {"2026-08-05": "FEED"}, windows).collect()}
    assert out == dict(zip(given, [None, "PRE_OPEN", "PRE_OPEN", "UNAUTHORISED", calendar.AUCTION_REASON, "FEED", "UNAUTHORISED", "UNAUTHORISED"]))
    long = calendar.normalised(bars(spark, utc(4, 9, 14), utc(4, 9, 16), length=120), days(spark), CALENDAR, None, windows)
    assert [r["reason"] for r in long.collect()] == ["UNAUTHORISED"] * 2


def test_an_unauthorised_bar_fails_the_job(spark):
    rows = lambda *t: calendar.continuous(calendar.normalised(bars(spark, *t), days(spark), CALENDAR))
    assert rows(utc(4, 9, 15), utc(4, 15, 16)).count() == 1 and rows().count() == 0
    with pytest.raises(Exception, match="outside of the calendar"):
        rows(utc(4, 9, 15), utc(4, 20, 0)).count()


def test_provider_revisions_must_grow(spark):
    rows = [("a", 1, 5, "v1"), ("a", 2, 5, "v2"), ("a", 3, 4, "v3"), ("a", 4, 9, "v4"), ("a", 5, None, "v5"), ("a", 6, 10, "v6"), ("b", 1, 1, "w1")]
    df = spark.createDataFrame(rows, "bar string, at int, provider_revision int, id string")
    out = {r["id"]: (r["refused"], r["revision"], r["supersedes"]) for r in candles.ingested(df, ["bar"], ["at"], "provider_revision", "id").collect()}
    assert out == {
        "v1": (False, 1, None), "v2": (True, None, None), "v3": (True, None, None), "v4": (False, 2, "v1"), "v5": (True, None, None), "v6": (False, 3, "v4"), "w1": (False, 1, None),
    }
