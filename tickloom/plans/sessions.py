"""Queries of the exchange's calendar, minute bars and their quality; an event is an observation, its type the instrument."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar, candles, folds, quality
from .registry import BARS, floored, hourly, query, table

BY = ["event_type"]

#: Holidays, a special Saturday and a special weekday, sessions and auctions that change within the tables' month.
CALENDAR = calendar.Calendar(
    holidays=("2024-01-22", "2024-01-26"), special=(("2024-01-18", "09:15", "12:00"), ("2024-01-20", "10:00", "13:30")),
    rules=(("2000-01-01", "09:15", "15:30"), ("2024-01-17", "09:15", "15:15")),
    auctions=(("2024-01-17", "15:15", "15:20", "15:30", "15:35"), ("2024-01-24", "15:15", "15:25", "15:30", "15:40")),
)
EXCLUDED = {"2024-01-11": "FEED_INCOMPLETE"}
#: Around the sessions everything is ignored, but for one evening.
WINDOWS = tuple((f"2024-01-{d:02d}", a, b, why) for d in range(1, 32) for a, b, why in (("00:00", "09:15", "BEFORE_OPEN"), ("12:00", "23:59", "AFTER_CLOSE")) if (d, why) != (9, "AFTER_CLOSE"))

_DAYS = """dd AS (SELECT unnest(generate_series((SELECT min((ts + INTERVAL 330 minutes)::DATE)::TIMESTAMP FROM events), (SELECT max((ts + INTERVAL 330 minutes)::DATE)::TIMESTAMP FROM events), INTERVAL 1 day)) AS d),
    kk AS (SELECT d, CASE WHEN d = TIMESTAMP '2024-01-18' OR d = TIMESTAMP '2024-01-20' THEN 'SPECIAL' WHEN isodow(d) > 5 OR d IN (TIMESTAMP '2024-01-22', TIMESTAMP '2024-01-26') THEN 'OFF' ELSE 'REGULAR' END AS kind FROM dd),
    days AS (SELECT d::DATE AS session_date, kind, d + CASE WHEN d = TIMESTAMP '2024-01-20' THEN INTERVAL 600 minutes ELSE INTERVAL 555 minutes END - INTERVAL 330 minutes AS opens,
      d + CASE WHEN d = TIMESTAMP '2024-01-18' THEN INTERVAL 720 minutes WHEN d = TIMESTAMP '2024-01-20' THEN INTERVAL 810 minutes WHEN d >= TIMESTAMP '2024-01-17' THEN INTERVAL 915 minutes ELSE INTERVAL 930 minutes END - INTERVAL 330 minutes AS closes FROM kk WHERE kind <> 'OFF')"""
#: An observation's session and phase: (l) is its local time, (m) minutes since its local midnight.
_PHASES = _DAYS + """, ev AS (SELECT e.*, l::DATE AS ld, (epoch_us(l) - epoch_us(date_trunc('day', l))) / 60e6 AS m FROM (SELECT *, {ts} + INTERVAL 330 minutes AS l FROM {source}) e),
    ph AS (SELECT ev.*, s.session_date, s.opens, s.closes, CASE WHEN s.session_date IS NOT NULL THEN 'CONTINUOUS' WHEN t.session_date IS NULL OR t.kind = 'SPECIAL' OR ld < DATE '2024-01-17' THEN 'CLOSED'
        WHEN m >= 915 AND m < CASE WHEN ld >= DATE '2024-01-24' THEN 925 ELSE 920 END THEN 'CLOSING_AUCTION_REFERENCE' WHEN m >= 920 AND m < 930 THEN 'CLOSING_AUCTION_ORDER_ENTRY'
        WHEN m >= 930 AND m < CASE WHEN ld >= DATE '2024-01-24' THEN 940 ELSE 935 END THEN 'CLOSING_AUCTION_MATCHING' ELSE 'CLOSED' END AS phase
      FROM ev LEFT JOIN days t ON t.session_date = ld LEFT JOIN days s ON s.session_date = ld AND {ts} >= s.opens AND {ts} < s.closes)"""


def _days(spark, d):
    """Trading days of the events' own range: two dates come to the driver."""
    local = calendar.local_date(F.col("ts").cast("timestamp"))
    first, last = table(spark, d, "events").agg(F.min(local), F.max(local)).first()
    return calendar.sessions(spark, CALENDAR, first, last)


def _plain(rows, *names):
    return rows.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query(f"WITH {_DAYS} SELECT session_date, opens AS opens_at, closes AS closes_at FROM days")
def session_calendar(spark, d):
    """Trading days by special sessions, weekends, holidays and the rule in force."""
    return _plain(_days(spark, d), "opens_at", "closes_at")


@query("WITH " + _PHASES.format(ts="ts", source="events") + """, b AS (SELECT *, opens + INTERVAL 1 hour * floor((epoch(ts) - epoch(opens)) / 3600)::INT AS bucket_opens FROM ph)
    SELECT event_id, session_date, phase, bucket_opens, least(bucket_opens + INTERVAL 1 hour, closes) AS bucket_closes, bucket_opens + INTERVAL 1 hour > closes AS partial FROM b""")
def session_phases(spark, d):
    """Session, market phase and hourly bucket from the session's open of every event."""
    rows = table(spark, d, "events").select("event_id", "ts")
    rows = calendar.bucket(calendar.in_session(rows, _days(spark, d), "ts"), "ts", 60).withColumn("phase", calendar.phase(F.col("ts"), CALENDAR))
    return _plain(rows, "bucket_opens", "bucket_closes").select("event_id", "session_date", "phase", "bucket_opens", "bucket_closes", "partial")


_MINUTES = """mins AS (SELECT event_id, event_type, date_trunc('minute', ts) + CASE WHEN event_id % 61 = 0 THEN INTERVAL 7 seconds ELSE INTERVAL 0 seconds END AS opens_at, date_trunc('minute', ts) + CASE WHEN event_id % 59 = 0 THEN INTERVAL 2 minutes ELSE INTERVAL 1 minute END AS closes_at FROM events)"""


def _minutes(spark, d):
    """Each event as a minute bar; some open late, some are too long."""
    rows = table(spark, d, "events")
    at = floored("ts", 60)
    late, long = F.col("event_id") % 61 == 0, F.col("event_id") % 59 == 0
    return rows.select(
        "event_id", "event_type", (at + F.when(late, F.expr("interval 7 seconds")).otherwise(F.expr("interval 0 seconds"))).alias("opens_at"),
        (at + F.when(long, F.expr("interval 2 minutes")).otherwise(F.expr("interval 1 minute"))).alias("closes_at"),
    )


@query(f"WITH {_MINUTES}, " + _PHASES.format(ts="opens_at", source="mins") + f""", z AS (SELECT *, (epoch_us(closes_at + INTERVAL 330 minutes) - epoch_us(ld::TIMESTAMP)) / 60e6 AS e FROM ph)
    SELECT event_id, CASE WHEN ld = DATE '2024-01-11' THEN 'FEED_INCOMPLETE' WHEN session_date IS NOT NULL AND second(opens_at) = 0 AND closes_at = opens_at + INTERVAL 1 minute THEN NULL
      WHEN phase LIKE 'CLOSING_AUCTION%' THEN '{calendar.AUCTION_REASON}' WHEN ld >= DATE '2024-01-01' AND ld <= DATE '2024-01-31' AND e <= 555 THEN 'BEFORE_OPEN'
      WHEN ld >= DATE '2024-01-01' AND ld <= DATE '2024-01-31' AND ld <> DATE '2024-01-09' AND m >= 720 AND e <= 1439 THEN 'AFTER_CLOSE' ELSE '{calendar.UNAUTHORISED}' END AS reason FROM z""")
def session_normalised(spark, d):
    """Why each minute bar leaves the continuous session, null where it stays."""
    return calendar.normalised(_minutes(spark, d), _days(spark, d), CALENDAR, EXCLUDED, WINDOWS).select("event_id", "reason")


@query(f"""WITH {_DAYS}, x AS (SELECT session_date, unnest(generate_series(opens, closes - INTERVAL 1 minute, INTERVAL 1 minute)) AS opens_at FROM days), o AS (SELECT DISTINCT date_trunc('minute', ts) AS opens_at FROM events),
    j AS (SELECT x.*, o.opens_at IS NOT NULL AS seen FROM x LEFT JOIN o USING (opens_at)), g AS (SELECT session_date, epoch(opens_at)::BIGINT // 60 - row_number() OVER (PARTITION BY session_date ORDER BY opens_at) AS run FROM j WHERE NOT seen),
    r AS (SELECT session_date, max(n) AS longest_gap FROM (SELECT session_date, run, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1)
    SELECT session_date, count(*) AS n_expected, count(*) FILTER (seen) AS n_observed, count(*) FILTER (NOT seen) AS n_missing, round(count(*) FILTER (seen) / count(*)::DOUBLE, 6) AS ratio, coalesce(max(longest_gap), 0) AS longest_gap,
      count(*) FILTER (seen) / count(*)::DOUBLE >= 0.2 AND count(*) FILTER (NOT seen) <= 300 AND coalesce(max(longest_gap), 0) <= 24 AS accepted FROM j LEFT JOIN r USING (session_date) GROUP BY 1""")
def session_minutes(spark, d):
    """Expected and observed minutes of each session, its longest run of missing ones, and whether limits hold."""
    expected = _plain(calendar.expected_minutes(_days(spark, d)), "opens_at")
    observed = table(spark, d, "events").select(floored("ts", 60).alias("opens_at"))
    absent = quality.missing(expected, observed, ["opens_at"]).withColumn("k", F.floor(F.unix_seconds(F.col("opens_at").cast("timestamp")) / 60))
    rows = quality.coverage(expected, observed, "session_date", ["opens_at"]).join(quality.longest_gaps(absent, ["session_date"], "k"), "session_date", "left")
    rows = rows.withColumn("longest_gap", F.coalesce("longest_gap", F.lit(0).cast("long"))).withColumn("worst_missing", F.col("n_missing"))
    return rows.withColumn("accepted", quality.accepted(None, 0.2, 300, 24)).withColumn("ratio", F.round("ratio", 6)).drop("worst_missing")


@query("""WITH v AS (SELECT event_id, event_type, date_trunc('day', ts) AS opens_at, ts, 1 + event_id * 37 % 400 AS provider_revision FROM events),
    r AS (SELECT *, coalesce(provider_revision <= max(provider_revision) OVER w, false) AS refused FROM v WINDOW w AS (PARTITION BY event_type, opens_at ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    k AS (SELECT event_id, row_number() OVER w AS revision, lag(event_id) OVER w AS supersedes FROM r WHERE NOT refused WINDOW w AS (PARTITION BY event_type, opens_at ORDER BY ts, event_id))
    SELECT event_id, refused, revision, supersedes FROM r LEFT JOIN k USING (event_id)""")
def minute_ingest(spark, d):
    """Versions of a day's bar as they arrive; a provider revision that does not grow is refused."""
    rows = table(spark, d, "events").select("event_id", "event_type", "ts", floored("ts", 86400).alias("opens_at"), (F.col("event_id") * 37 % 400 + 1).alias("provider_revision"))
    return candles.ingested(rows, [*BY, "opens_at"], ["ts", "event_id"], "provider_revision", "event_id").select("event_id", "refused", "revision", "supersedes")


@query("""WITH p AS (SELECT event_id, value AS o, value + CASE WHEN event_id % 19 = 0 THEN -1 ELSE 2 END AS h, value - CASE WHEN event_id % 17 = 0 THEN -1 WHEN event_id % 23 = 0 THEN 1000000 ELSE 2 END AS l, value + 1 AS c, event_id % 29 = 0 AS long, event_id % 31 AS rev FROM events)
    SELECT event_id, array_to_string(list_filter([CASE WHEN least(o, h, l, c) <= 0 THEN 'PRICE_NOT_POSITIVE' END, CASE WHEN l > least(o, c) THEN 'LOW_ABOVE_BODY' END, CASE WHEN h < greatest(o, c) THEN 'HIGH_BELOW_BODY' END,
      CASE WHEN long THEN 'NOT_ONE_MINUTE' END, CASE WHEN rev < 1 THEN 'REVISION_BELOW_ONE' END], lambda x: x IS NOT NULL), '|') AS codes FROM p""")
def minute_validation(spark, d):
    """What is wrong with each minute bar, with planted errors of every kind."""
    k = lambda n: F.col("event_id") % n == 0
    rows = table(spark, d, "events").select(
        "event_id", F.col("value").alias("open"), (F.col("value") + F.when(k(19), -1).otherwise(2)).alias("high"), (F.col("value") - F.when(k(17), -1).when(k(23), 1000000).otherwise(2)).alias("low"),
        (F.col("value") + 1).alias("close"), floored("ts", 60).alias("opens_at"), (F.col("event_id") % 31).alias("revision"),
    )
    rows = rows.withColumn("closes_at", F.col("opens_at") + F.when(k(29), F.expr("interval 2 minutes")).otherwise(F.expr("interval 1 minute")))
    return rows.select("event_id", F.concat_ws("|", candles.invalid()).alias("codes"))


#: Faults by series: clicks have none, errors only come late, the rest are misaligned, repeated, outside of the request or the session, or wrongly corrected.
@query("""WITH b AS (SELECT event_type AS series, date_trunc('minute', ts) + CASE WHEN event_type = 'purchase' AND event_id % 61 = 0 THEN INTERVAL 7 seconds WHEN event_type = 'signup' AND event_id % 67 = 0 THEN INTERVAL 40 days ELSE INTERVAL 0 seconds END AS opens_at,
      CASE WHEN event_type = 'view' AND event_id % 97 < 2 THEN event_id // 97 ELSE 1000000000 + event_id END AS bar_id, CASE WHEN event_type = 'view' THEN 1 + event_id % 3 ELSE event_id END AS revision,
      CASE WHEN event_type = 'error' AND event_id % 101 = 0 THEN event_id + 50 ELSE event_id END AS arrival, hour(ts) BETWEEN 4 AND 20 OR event_type <> 'signup' AS inside FROM events),
    r AS (SELECT *, lag(opens_at) OVER (PARTITION BY series ORDER BY arrival, bar_id) AS prior, lag(revision) OVER (PARTITION BY series, opens_at ORDER BY arrival, bar_id) AS pr FROM b),
    t AS (SELECT series, count(*) AS n_bars, count(*) - count(DISTINCT bar_id) AS n_duplicate_ids, count(*) FILTER (pr IS NULL AND opens_at < prior) AS n_out_of_order, count(*) FILTER (opens_at < TIMESTAMP '2024-01-01' OR opens_at >= TIMESTAMP '2024-02-01') AS n_out_of_request,
      count(*) FILTER (second(opens_at) <> 0) AS n_misaligned, count(*) FILTER (NOT inside) AS n_out_of_session, count(*) FILTER (pr >= revision) AS n_invalid_corrections FROM r GROUP BY 1)
    SELECT *, CASE WHEN n_duplicate_ids + n_out_of_request + n_misaligned + n_out_of_session + n_invalid_corrections > 0 THEN 'REJECTED' WHEN n_out_of_order > 0 THEN 'DEGRADED' ELSE 'PASS' END AS status FROM t""")
def batch_inspection(spark, d):
    """Counts of what is wrong with each event type as a batch of bars, and its status."""
    kind, e = F.col("event_type"), F.col("event_id")
    moved = F.when((kind == "purchase") & (e % 61 == 0), F.expr("interval 7 seconds")).when((kind == "signup") & (e % 67 == 0), F.expr("interval 40 days")).otherwise(F.expr("interval 0 seconds"))
    rows = table(spark, d, "events").select(
        kind.alias("series"), (floored("ts", 60) + moved).alias("opens_at"), F.when((kind == "view") & (e % 97 < 2), F.floor(e / 97)).otherwise(e + 1000000000).alias("bar_id"),
        F.when(kind == "view", e % 3 + 1).otherwise(e).alias("revision"), F.when((kind == "error") & (e % 101 == 0), e + 50).otherwise(e).alias("arrival"), (F.hour("ts").between(4, 20) | (kind != "signup")).alias("inside"),
    )
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    return quality.inspect(rows.withColumn("arrival", F.struct("arrival", "bar_id")), F.col("inside"), at("2024-01-01"), at("2024-02-01"))


@query(f"""WITH {BARS}, p AS (SELECT *, CASE WHEN hour(opens_at) % 7 = 0 THEN 'b' ELSE 'a' END AS provider, CASE WHEN n_ticks % 11 <> 0 THEN n_ticks END AS volume, n_ticks % 5 + 1 AS source_revision, opens_at + INTERVAL 1 hour + INTERVAL 1 second * (n_ticks % 4)::INT AS finalized_at, 'w' || n_ticks AS watermark FROM bars)
    SELECT event_type, time_bucket(INTERVAL 2 hours, opens_at)::TIMESTAMP AS opens_at, arg_min(open, opens_at) AS open, max(high) AS high, min(low) AS low, arg_max(close, opens_at) AS close, CASE WHEN count(volume) = count(*) THEN sum(volume)::BIGINT END AS volume,
      CASE WHEN min(provider) = max(provider) THEN min(provider) ELSE '{candles.MIXED}' END AS provider, max(finalized_at) AS finalized_at, max(source_revision) AS source_revision, arg_max(watermark, opens_at) AS watermark FROM p GROUP BY 1, 2 HAVING count(*) = 2""")
def rebuilt_bars(spark, d):
    """Whole two-hour bars with their parts' provider, volume, last finalisation, revision and watermark."""
    n = F.col("n_ticks")
    rows = hourly(spark, d).withColumns({
        "provider": F.when(F.hour("opens_at") % 7 == 0, F.lit("b")).otherwise(F.lit("a")), "volume": F.when(n % 11 != 0, n), "source_revision": n % 5 + 1,
        "finalized_at": F.col("opens_at") + F.expr("interval 1 hour") + F.expr("make_dt_interval(0, 0, 0, n_ticks % 4)"), "watermark": F.concat(F.lit("w"), n.cast("string")),
    })
    return candles.coarser(rows, floored("opens_at", 7200), 2, BY)


_LIFE = {
    "side": "case when event_id % 2 = 0 then 'BUY' else 'SELL' end", "entry_low": "100 - event_id % 7", "entry_high": "103 - event_id % 5", "stop": "case when event_id % 2 = 0 then 60 + event_id % 11 else 140 - event_id % 11 end",
    "target": "case when event_id % 2 = 0 then 130 + event_id % 13 else 70 - event_id % 13 end", "low": "value - 5", "high": "value + 5 + event_id % 83",
}


@query("WITH i AS (SELECT event_id, hour(ts) >= 20 AS late, " + ", ".join(f"{e} AS {n}" for n, e in _LIFE.items()) + """ FROM events),
    t AS (SELECT *, CASE WHEN side = 'BUY' THEN low <= stop ELSE high >= stop END AS s, CASE WHEN side = 'BUY' THEN high >= target ELSE low <= target END AS g FROM i)
    SELECT event_id, CASE WHEN late THEN 'EXPIRED' WHEN s AND g THEN 'INVALIDATED' WHEN s THEN 'STOPPED' WHEN g THEN 'TARGET' WHEN low <= entry_high AND high >= entry_low THEN 'ENTERED' ELSE 'WAITING' END AS state FROM t""")
def signal_lifecycle(spark, d):
    """What a signal becomes at a bar; signals expire at eight in the evening."""
    rows = table(spark, d, "events")
    rows = rows.select("event_id", F.col("ts").alias("at"), (F.date_trunc("day", "ts") + F.expr("interval 20 hours")).cast("timestamp_ntz").alias("expires_at"), *[F.expr(e).alias(n) for n, e in _LIFE.items()])
    return rows.select("event_id", folds.lifecycle(rows).alias("state"))
