"""Queries of labels with all their reasons, event families, and assessments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candles, outcomes
from .bars import BY
from .decisions import _ATR, _with_atr
from .registry import floored, query, table

_LABELS = _ATR + """, b1 AS (SELECT *, CASE WHEN atr > 0 THEN close + 0.4::DOUBLE * atr END AS up, CASE WHEN atr > 0 THEN close - 0.4::DOUBLE * atr END AS dn, opens_at + INTERVAL 1 hour AS closes_at, CASE WHEN hour(opens_at) BETWEEN 2 AND 21 THEN session_date::TIMESTAMP + INTERVAL 22 hours END AS ends FROM a),
    fine AS (SELECT event_type, time_bucket(INTERVAL 20 minutes, ts)::TIMESTAMP AS tm, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2),
    tc AS (SELECT x.event_type, x.opens_at, count(y.opens_at) AS k, min(y.opens_at) FILTER (y.high >= x.up OR y.low <= x.dn) AS touch FROM b1 x LEFT JOIN bars y ON y.event_type = x.event_type AND y.opens_at > x.opens_at AND y.opens_at <= x.opens_at + INTERVAL 4 hours GROUP BY 1, 2),
    u AS (SELECT b1.*, k, CASE WHEN atr IS NULL OR atr <= 0 THEN 'ATR_AT_DECISION_UNAVAILABLE' WHEN ends IS NULL OR closes_at + INTERVAL 4 hours > ends THEN 'OUTCOME_WINDOW_CROSSES_SESSION_CLOSE' WHEN k < 4 THEN 'INCOMPLETE_FUTURE_5M_WINDOW' END AS out, touch FROM b1 JOIN tc USING (event_type, opens_at)),
    v AS (SELECT u.*, y.high >= up AS hu, y.low <= dn AS hd FROM u LEFT JOIN bars y ON y.event_type = u.event_type AND y.opens_at = u.touch AND u.out IS NULL),
    m AS (SELECT v.event_type, v.opens_at, count(*) AS n_fine, min(tm) FILTER (f.high >= up) AS mu, min(tm) FILTER (f.low <= dn) AS md FROM v JOIN fine f ON f.event_type = v.event_type AND f.tm >= touch AND f.tm < touch + INTERVAL 1 hour WHERE hu AND hd GROUP BY 1, 2),
    z AS (SELECT v.*, coalesce(n_fine = 3 AND mu IS DISTINCT FROM md, false) AS known, mu, md FROM v LEFT JOIN m USING (event_type, opens_at)),
    o AS (SELECT *, CASE WHEN out IS NOT NULL THEN NULL WHEN touch IS NULL THEN 'NEITHER' WHEN hu AND hd THEN CASE WHEN NOT known THEN 'AMBIGUOUS' WHEN md IS NULL OR mu < md THEN 'UP' ELSE 'DOWN' END WHEN hu THEN 'UP' ELSE 'DOWN' END AS outcome FROM z)
    SELECT event_type, opens_at, outcome, CASE WHEN outcome = 'AMBIGUOUS' THEN 'AMBIGUOUS_INTRABAR_ORDER' ELSE out END AS reason, coalesce(outcome <> 'AMBIGUOUS', false) AS eligible, CASE WHEN out IS NULL AND touch IS NOT NULL THEN CASE WHEN hu AND hd AND known THEN least(coalesce(mu, md), coalesce(md, mu)) + INTERVAL 20 minutes ELSE touch + INTERVAL 1 hour END END AS first_touch_at FROM o"""


@query(_LABELS)
def first_touch_labels(spark, d):
    """Labels of hourly bars in sessions from 2 to 22 o'clock, four bars ahead, bars that touch both barriers resolved by 20 minutes."""
    hour = F.hour("opens_at")
    bars = _with_atr(spark, d).withColumn("closes_at", F.col("opens_at") + F.expr("interval 1 hour")).withColumn("candle_id", F.concat_ws("|", "event_type", F.col("opens_at").cast("string")))
    closes = F.col("session_date").cast("timestamp_ntz") + F.expr("interval 22 hours")
    bars = bars.withColumn("session_closes", F.when(hour.between(2, 21), closes))
    finer = candles.from_ticks(table(spark, d, "events"), floored("ts", 1200), ["event_type"]).withColumnRenamed("opens_at", "at")
    out = outcomes.first_touch_labels(bars, finer, BY, "atr", 0.4, 0.4, 4, 3600, 1200)
    return out.select(*BY, "opens_at", "outcome", "reason", "eligible", "first_touch_at")


#: Features of an event from its numbers, in steps that meet the families' limits.
_FEATURES = {
    "swing_low_liquidity_sweep": "(event_id % 5) / cast(4 as double)", "swing_high_liquidity_sweep": "(event_id % 7) / cast(6 as double)", "break_of_structure_up": "(event_id % 3) / cast(2 as double)", "break_of_structure_down": "((event_id + 1) % 4) / cast(4 as double)",
    "range_compression_3_to_12": "((event_id * 7) % 16) / cast(10 as double)", "close_location": "((event_id * 13) % 11) / cast(10 as double)", "body_efficiency": "(((event_id * 13) % 11) - 5) / cast(8 as double)", "structure_score": "((event_id * 3) % 5 - 2) / cast(2 as double)",
    "distance_ema20_atr": "((event_id * 11) % 9 - 4) / cast(10 as double)",
}


def _families_sql() -> str:
    lagged = ", ".join(f"CASE WHEN lag(day) OVER w = day THEN lag({c}) OVER w END AS p_{c}" for c in outcomes.LAGGED)
    tests = ", ".join(f"CASE WHEN {c} THEN '{side}:{name}' END" for name, sides in outcomes.FAMILIES.items() for side, c in zip(("LONG", "SHORT"), sides))
    listed = ", ".join(f"{e} AS {n}" for n, e in _FEATURES.items())
    return f"""WITH i AS (SELECT event_id, event_type, ts, ts::DATE AS day, {listed} FROM events), l AS (SELECT *, {lagged} FROM i WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
        f AS (SELECT event_id, list_filter([{tests}], lambda x: x IS NOT NULL) AS found FROM l), g AS (SELECT *, len(list_distinct([x[1:4] for x in found])) AS sides FROM f)
        SELECT event_id, CASE WHEN sides > 1 THEN 'CONFLICTING_DIRECTION_WAIT' WHEN sides = 0 THEN 'NO_EVENT' ELSE found[1] END AS diagnostic FROM g"""


@query(_families_sql())
def event_families(spark, d):
    """The four families over features of events' numbers."""
    rows = table(spark, d, "events").select("event_id", "event_type", "ts", F.col("ts").cast("date").alias("day"), *[F.expr(e).alias(n) for n, e in _FEATURES.items()])
    return outcomes.event_families(rows, ["event_type"], "day", ["ts", "event_id"]).select("event_id", "diagnostic")


@query("""WITH i AS (SELECT event_id, event_id % 10 = 3 AS long, event_id % 10 = 7 AS short, (event_id % 4) / 10.0 AS ne, (1 - (event_id % 4) / 10.0) * ((event_id * 37) % 101) / 100.0 AS up FROM events)
    SELECT event_id, (long OR short)::INT AS opportunity, long::INT AS long_when_opportunity, CASE WHEN up >= 0.6::DOUBLE AND up - (1 - ne - up) >= 0.15::DOUBLE THEN 'BUY' WHEN 1 - ne - up >= 0.6::DOUBLE AND (1 - ne - up) - up >= 0.15::DOUBLE THEN 'SELL' END AS plain_direction FROM i""")
def conditional_labels(spark, d):
    """Opportunities and directions of events, and the older rule on their probabilities."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select(k, (k % 10 == 3).alias("long"), (k % 10 == 7).alias("short"), ((k % 4) / F.lit(10.0)).alias("ne"))
    rows = rows.withColumn("up", (1 - F.col("ne")) * ((k * 37) % 101) / F.lit(100.0)).withColumn("down", 1 - F.col("ne") - F.col("up"))
    rows = outcomes.conditional_labels(rows, "long", "short").withColumn("plain_direction", outcomes.plain_direction(F.col("down"), F.col("ne"), F.col("up")))
    return rows.select("event_id", "opportunity", "long_when_opportunity", "plain_direction")
