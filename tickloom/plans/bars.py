"""Queries over bars: candles, revisions, coverage, and windowed features."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import ratio
from ..operators import candles, features, quality
from ..operators import recurrence as R
from .registry import BARS, ORDERED, floored, hourly, query, rounded, table

BY, AT = ["event_type"], "opens_at"


def series():
    return W.partitionBy("event_type").orderBy("opens_at")


@query(f"WITH {BARS} SELECT event_type, opens_at, open, high, low, close, n_ticks FROM bars")
def candles_1h(spark, d):
    return hourly(spark, d).drop("session_date")


@query(f"""WITH {BARS} SELECT event_type, time_bucket(INTERVAL 4 hours, opens_at)::TIMESTAMP AS opens_at, arg_min(open, opens_at) AS open, max(high) AS high, min(low) AS low, arg_max(close, opens_at) AS close
    FROM bars GROUP BY 1, 2 HAVING count(*) = 4""")
def candles_4h_complete(spark, d):
    return candles.coarser(hourly(spark, d), floored("opens_at", 14400), 4, BY).select(*BY, "opens_at", "open", "high", "low", "close")


@query("""SELECT event_type, time_bucket(INTERVAL 1 hour, ts, INTERVAL 45 minutes)::TIMESTAMP AS opens_at, count(*) AS n_ticks, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2""")
def candles_anchored(spark, d):
    """Buckets that start at a quarter to the hour, as a session's do."""
    ticks = table(spark, d, "events")
    return candles.from_ticks(ticks, floored("ts", 3600, 2700), BY).select(*BY, "opens_at", "n_ticks", "high", "low")


@query("""SELECT event_type, event_id, date_trunc('day', ts)::TIMESTAMP AS opens_at, first_value(value) OVER w AS open, max(value) OVER w AS high, min(value) OVER w AS low, value AS close, row_number() OVER w AS revision
    FROM events WINDOW w AS (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def developing_candle(spark, d):
    return candles.developing(table(spark, d, "events").select("event_type", "ts", "event_id", "value"), floored("ts", 86400), BY)


@query("""SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_revision(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return candles.latest(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("""SELECT o_custkey, o_orderkey, row_number() OVER w AS revision, lag(o_orderkey) OVER w AS supersedes FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def revision_chain(spark, d):
    return candles.revisions(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").drop("o_orderdate")


@query("""SELECT o_orderkey AS dataset_id, o_orderdate AS ends_at FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""")
def latest_dataset(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1)
    return rows.select(F.col("o_orderkey").alias("dataset_id"), F.col("o_orderdate").alias("ends_at"))


@query(f"""WITH {BARS} SELECT event_type, opens_at, close FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY opens_at DESC) AS n FROM bars)
    WHERE n <= CASE event_type WHEN 'click' THEN 75 WHEN 'view' THEN 25 ELSE 12 END""")
def chart_tails(spark, d):
    limit = F.when(F.col("event_type") == "click", 75).when(F.col("event_type") == "view", 25).otherwise(12)
    return candles.tails(hourly(spark, d), BY, F.desc("opens_at"), limit).select(*BY, "opens_at", "close")


@query("""WITH v AS (SELECT event_type, event_id, ts, value, time_bucket(INTERVAL 1 day, ts)::TIMESTAMP AS bucket, date_trunc('hour', ts)::TIMESTAMP AS part,
      row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS revision FROM events WHERE event_type = 'error'),
    moments AS (SELECT DISTINCT event_type, bucket, ts AS as_of FROM v),
    k AS (SELECT a.event_type, a.bucket, a.as_of, v.part, max(v.revision) AS revision, arg_max(v.value, v.revision) AS value FROM moments a JOIN v ON v.event_type = a.event_type AND v.bucket = a.bucket AND v.ts <= a.as_of GROUP BY 1, 2, 3, 4),
    b AS (SELECT event_type, bucket, as_of, count(*) AS n, arg_min(value, part) AS open, max(value) AS high, min(value) AS low, arg_max(value, part) AS close FROM k GROUP BY 1, 2, 3)
    SELECT event_type, bucket AS opens_at, as_of, open, high, low, close, row_number() OVER (PARTITION BY event_type, bucket ORDER BY as_of) AS revision FROM b WHERE n = 12""")
def correction_propagation(spark, d):
    """Every tick corrects its hour; a day's bar gets a revision whenever its (here twelve) hours are there and one changes."""
    ticks = table(spark, d, "events").where("event_type = 'error'").select("event_type", "event_id", "ts", F.col("value").alias("open"))
    part = floored("ts", 3600)
    w = W.partitionBy("event_type", "opens_at").orderBy("arrived_at", "event_id")
    parts = ticks.select("event_type", "event_id", F.col("ts").alias("arrived_at"), part.alias("opens_at"), "open").withColumn("revision", F.row_number().over(w))
    parts = parts.select("*", *[F.col("open").alias(c) for c in ("high", "low", "close")])
    out = candles.propagate(parts, floored("opens_at", 86400), 12, BY)
    return out.select(*BY, "opens_at", "as_of", "open", "high", "low", "close", "revision")


@query("""WITH e AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29 23:45', INTERVAL 15 minutes)) AS opens_at), o AS (SELECT DISTINCT time_bucket(INTERVAL 15 minutes, ts)::TIMESTAMP AS opens_at FROM events)
    SELECT e.opens_at FROM e ANTI JOIN o ON e.opens_at = o.opens_at""")
def expected_minus_observed(spark, d):
    return quality.missing(_expected(spark), _observed(spark, d), ["opens_at"])


def _expected(spark):
    return spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-29 23:45:00', interval 15 minutes)) AS opens_at")


def _observed(spark, d):
    return table(spark, d, "events").select(floored("ts", 900).alias("opens_at")).distinct()


_COVER = """e AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29 23:45', INTERVAL 15 minutes)) AS opens_at), o AS (SELECT DISTINCT time_bucket(INTERVAL 15 minutes, ts)::TIMESTAMP AS opens_at FROM events),
    j AS (SELECT e.opens_at, e.opens_at::DATE AS session_date, o.opens_at IS NOT NULL AS seen FROM e LEFT JOIN o ON e.opens_at = o.opens_at)"""


@query(f"WITH {_COVER} SELECT session_date, count(*) AS n_expected, count(*) FILTER (seen) AS n_observed, count(*) FILTER (NOT seen) AS n_missing, count(*) FILTER (seen) / count(*)::DOUBLE AS ratio FROM j GROUP BY 1")
def coverage_by_day(spark, d):
    expected = _expected(spark).withColumn("session_date", F.col("opens_at").cast("date"))
    return quality.coverage(expected, _observed(spark, d), "session_date", ["opens_at"])


@query(f"""WITH {_COVER}, m AS (SELECT session_date, epoch(opens_at)::BIGINT // 900 - row_number() OVER (PARTITION BY session_date ORDER BY opens_at) AS run FROM j WHERE NOT seen), r AS (SELECT session_date, run, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT session_date, max(n) AS longest_gap FROM r GROUP BY 1""")
def longest_gap(spark, d):
    absent = quality.missing(_expected(spark), _observed(spark, d), ["opens_at"])
    absent = absent.select(F.col("opens_at").cast("date").alias("session_date"), F.floor(F.unix_seconds(F.col("opens_at").cast("timestamp")) / 900).alias("k"))
    return quality.longest_gaps(absent, ["session_date"], "k")


@query(f"WITH {_COVER} SELECT session_date, count(*) FILTER (NOT seen) AS n_missing FROM j GROUP BY 1 HAVING n_missing > 0 ORDER BY n_missing DESC, session_date LIMIT 20")
def worst_sessions(spark, d):
    rows = coverage_by_day(spark, d).where("n_missing > 0")
    return rows.orderBy(F.desc("n_missing"), "session_date").limit(20).select("session_date", "n_missing")


@query(f"""WITH {BARS} SELECT event_type, opens_at, coalesce(lag(session_date) OVER w = session_date AND lag(opens_at) OVER w + INTERVAL 1 hour <> opens_at, false) AS gap FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)""")
def gap_flags(spark, d):
    return _features(spark, d, ["gap"]).select(*BY, "opens_at", F.coalesce("gap", F.lit(False)).alias("gap"))


@query(f"""WITH {BARS}, w AS (SELECT * FROM bars) SELECT event_type, opens_at, round(CASE WHEN lag(close, 1) OVER v <> 0 THEN close / lag(close, 1) OVER v - 1 END, 6) AS return_1, round(CASE WHEN lag(close, 5) OVER v <> 0 THEN close / lag(close, 5) OVER v - 1 END, 6) AS return_5,
    round(CASE WHEN lag(close, 12) OVER v <> 0 THEN close / lag(close, 12) OVER v - 1 END, 6) AS roc_12, round(CASE WHEN close > 0 AND lag(close) OVER v > 0 THEN ln(close / lag(close) OVER v) END, 6) AS log_return_1 FROM w WINDOW v AS (PARTITION BY event_type ORDER BY opens_at)""")
def returns_log(spark, d):
    return _features(spark, d, ["return_1", "return_5", "roc_12", "log_return_1"])


def _features(spark, d, columns, digits=6):
    rows = hourly(spark, d).withColumn("closes_at", F.col("opens_at") + F.expr("interval 1 hour"))
    day = F.col("session_date").cast("timestamp")
    rows = rows.withColumn("session_opens", day).withColumn("session_closes", day + F.expr("interval 24 hours"))
    out = features.windowed(rows, BY).select(*BY, "opens_at", *columns)
    return rounded(out, [c for c, t in out.dtypes if t == "double"], digits)


@query(f"""WITH {BARS} SELECT event_type, opens_at, round(CASE WHEN close <> 0 THEN (high - low) / close END, 6) AS range_pct, round(CASE WHEN open <> 0 THEN (close - open) / open END, 6) AS body_pct,
    round(CASE WHEN open <> 0 THEN (high - greatest(open, close)) / open END, 6) AS upper_wick_pct, round(CASE WHEN open <> 0 THEN (least(open, close) - low) / open END, 6) AS lower_wick_pct FROM bars""")
def wicks_body(spark, d):
    return _features(spark, d, ["range_pct", "body_pct", "upper_wick_pct", "lower_wick_pct"])


@query(f"""WITH {ORDERED} SELECT event_type, opens_at, round(CASE WHEN n >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END, 6) AS sma_20, round(CASE WHEN n >= 50 THEN avg(close) OVER (w ROWS 49 PRECEDING) END, 6) AS sma_50
    FROM s WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)""")
def sma_20_50(spark, d):
    return _features(spark, d, ["sma_20", "sma_50"])


@query(f"""WITH {ORDERED}, m AS (SELECT *, avg(close) OVER (w ROWS 19 PRECEDING) AS a, stddev_pop(close) OVER (w ROWS 19 PRECEDING) AS sd FROM s WINDOW w AS (PARTITION BY event_type ORDER BY opens_at))
    SELECT event_type, opens_at, round(CASE WHEN n >= 20 AND sd > 1e-12 THEN (close - a) / sd END, 6) AS bollinger_z_20 FROM m""")
def bollinger_z(spark, d):
    return _features(spark, d, ["bollinger_z_20"])


@query(f"""WITH {ORDERED}, r AS (SELECT *, CASE WHEN pc <> 0 THEN close / pc - 1 END AS ret FROM s) SELECT event_type, opens_at, round(CASE WHEN n >= 21 THEN stddev_pop(ret) OVER (PARTITION BY event_type ORDER BY opens_at ROWS 19 PRECEDING) END, 5) AS rolling_vol_20 FROM r""")
def rolling_vol(spark, d):
    return _features(spark, d, ["rolling_vol_20"], 5)


@query(f"""WITH {ORDERED} SELECT event_type, opens_at, CASE WHEN n > 20 THEN close > max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS breakout_up_20, CASE WHEN n > 20 THEN close < min(low) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS breakout_down_20
    FROM s WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)""")
def breakout_20(spark, d):
    return _features(spark, d, ["breakout_up_20", "breakout_down_20"])


def _recursive(first: str, step: str, columns: str, source: str = "s") -> str:
    """A recursion over row numbers within a series: ``first`` at n = 1, ``step`` from (p) the previous state and (x) the row."""
    return f"""rec AS (SELECT x.event_type, x.n, x.opens_at, {first} FROM {source} x WHERE x.n = 1
        UNION ALL SELECT x.event_type, x.n, x.opens_at, {step} FROM rec p JOIN {source} x ON x.event_type = p.event_type AND x.n = p.n + 1) SELECT event_type, opens_at, {columns} FROM rec"""


def _ema_sql(n: int) -> str:
    a = 2 / (n + 1)
    return f"WITH RECURSIVE {ORDERED}, " + _recursive("x.close AS total, CAST(NULL AS DOUBLE) AS y", f"p.total + x.close, CASE WHEN x.n = {n} THEN (p.total + x.close) / {n} WHEN x.n > {n} THEN {a!r} * x.close + (1 - {a!r}) * p.y END", f"round(y, 6) AS ema_{n}")


@query(_ema_sql(20))
def ema_20(spark, d):
    return rounded(R.ema(hourly(spark, d), F.col("close"), 20, BY, AT, "ema_20"), ["ema_20"]).select(*BY, AT, "ema_20")


@query(_ema_sql(50))
def ema_50(spark, d):
    return rounded(R.ema(hourly(spark, d), F.col("close"), 50, BY, AT, "ema_50"), ["ema_50"]).select(*BY, AT, "ema_50")


_TR = "t AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM s)"


@query(f"WITH RECURSIVE {ORDERED}, {_TR}, " + _recursive("x.tr AS total, CAST(NULL AS DOUBLE) AS y", "p.total + x.tr, CASE WHEN x.n = 14 THEN (p.total + x.tr) / 14 WHEN x.n > 14 THEN (p.y * 13 + x.tr) / 14 END", "round(y, 6) AS atr_14", "t"))
def atr_14(spark, d):
    return rounded(R.atr(hourly(spark, d), 14, BY, AT, "atr_14"), ["atr_14"]).select(*BY, AT, "atr_14")


@query(f"WITH RECURSIVE {ORDERED}, t AS (SELECT *, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS down FROM s), " + _recursive(
    "CAST(0 AS DOUBLE) AS su, CAST(0 AS DOUBLE) AS sd, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l",
    "p.su + x.up, p.sd + x.down, CASE WHEN x.n = 15 THEN (p.su + x.up) / 14 WHEN x.n > 15 THEN (p.g * 13 + x.up) / 14 END, CASE WHEN x.n = 15 THEN (p.sd + x.down) / 14 WHEN x.n > 15 THEN (p.l * 13 + x.down) / 14 END",
    "round(CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + g / l) END, 5) AS rsi_14", "t"))
def rsi_14(spark, d):
    return rounded(R.rsi(hourly(spark, d), "close", 14, BY, AT, "rsi_14"), ["rsi_14"], 5).select(*BY, AT, "rsi_14")


@query(f"WITH RECURSIVE {ORDERED}, t AS (SELECT *, CASE WHEN pc IS NULL THEN 0 ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, coalesce(high - lag(high) OVER w, 0) AS u, coalesce(lag(low) OVER w - low, 0) AS v FROM s WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)), "
    "t2 AS (SELECT *, CASE WHEN u > v AND u > 0 THEN u ELSE 0 END AS pm, CASE WHEN v > u AND v > 0 THEN v ELSE 0 END AS mm FROM t), "
    + """rec AS (SELECT x.event_type, x.n, x.opens_at, x.tr AS st, x.pm AS sp, x.mm AS sm, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c FROM t2 x WHERE x.n = 1
      UNION ALL SELECT x.event_type, x.n, x.opens_at, p.st + x.tr, p.sp + x.pm, p.sm + x.mm, CASE WHEN x.n = 14 THEN (p.st + x.tr) / 14 WHEN x.n > 14 THEN (p.a * 13 + x.tr) / 14 ELSE 0 END,
        CASE WHEN x.n = 14 THEN (p.sp + x.pm) / 14 WHEN x.n > 14 THEN (p.b * 13 + x.pm) / 14 ELSE 0 END, CASE WHEN x.n = 14 THEN (p.sm + x.mm) / 14 WHEN x.n > 14 THEN (p.c * 13 + x.mm) / 14 ELSE 0 END
      FROM rec p JOIN t2 x ON x.event_type = p.event_type AND x.n = p.n + 1),
    d AS (SELECT event_type, n, opens_at, CASE WHEN a > 1e-12 THEN (b - c) / a ELSE 0 END AS spread, CASE WHEN a > 1e-12 AND b + c > 0 THEN abs(b - c) / (b + c) ELSE 0 END AS dx FROM rec),
    rec2 AS (SELECT x.*, x.dx AS s, CAST(0 AS DOUBLE) AS adx FROM d x WHERE x.n = 1 UNION ALL SELECT x.*, p.s + x.dx, CASE WHEN x.n = 14 THEN (p.s + x.dx) / 14 WHEN x.n > 14 THEN (p.adx * 13 + x.dx) / 14 ELSE 0 END
      FROM rec2 p JOIN d x ON x.event_type = p.event_type AND x.n = p.n + 1) SELECT event_type, opens_at, round(adx, 5) AS adx, round(spread, 5) AS di_spread FROM rec2""")
def adx_14(spark, d):
    return rounded(R.adx(hourly(spark, d), 14, BY, AT), ["adx", "di_spread"], 5).select(*BY, AT, "adx", "di_spread")


@query(f"WITH RECURSIVE {ORDERED}, " + _recursive("x.close AS total, CAST(0 AS DOUBLE) AS f, CAST(0 AS DOUBLE) AS sl, CAST(0 AS DOUBLE) AS sg",
    f"""p.total + x.close, CASE WHEN x.n = 12 THEN (p.total + x.close) / 12 WHEN x.n > 12 THEN {2 / 13!r} * x.close + (1 - {2 / 13!r}) * p.f ELSE 0 END,
       CASE WHEN x.n = 26 THEN (p.total + x.close) / 26 WHEN x.n > 26 THEN {2 / 27!r} * x.close + (1 - {2 / 27!r}) * p.sl ELSE 0 END,
       0.2 * ((CASE WHEN x.n = 12 THEN (p.total + x.close) / 12 WHEN x.n > 12 THEN {2 / 13!r} * x.close + (1 - {2 / 13!r}) * p.f ELSE 0 END)
       - (CASE WHEN x.n = 26 THEN (p.total + x.close) / 26 WHEN x.n > 26 THEN {2 / 27!r} * x.close + (1 - {2 / 27!r}) * p.sl ELSE 0 END)) + 0.8 * p.sg""", "round(f - sl - sg, 5) AS macd"))  # fmt: skip
def macd(spark, d):
    return rounded(R.macd(hourly(spark, d), BY, AT), ["macd"], 5).select(*BY, AT, "macd")


_RESEARCH = """WITH {ordered}, a AS (SELECT *, round(CASE WHEN n >= 14 THEN avg(high - low) OVER (w ROWS 13 PRECEDING) END, 6) AS atr, CASE WHEN n >= 10 THEN regr_slope(close, n::DOUBLE) OVER (w ROWS 9 PRECEDING) ELSE 0 END AS s10, CASE WHEN n >= 20 THEN regr_slope(close, n::DOUBLE) OVER (w ROWS 19 PRECEDING) ELSE 0 END AS s20,
      coalesce(min(low) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), low) AS sup20, coalesce(max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), high) AS res20, coalesce(min(low) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), low) AS sup50, coalesce(max(high) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), high) AS res50,
      lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close, 3) OVER w AS c3, first_value(open) OVER w AS o0, first_value(session_date) OVER w AS d0, sign(close - open) AS sg FROM s WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)),
    dd AS (SELECT event_type, session_date, max(high) AS h, min(low) AS l, arg_max(close, opens_at) AS c FROM bars GROUP BY 1, 2), de AS (SELECT event_type, session_date, lag(h) OVER w AS yh, lag(l) OVER w AS yl, lag(c) OVER w AS yc FROM dd WINDOW w AS (PARTITION BY event_type ORDER BY session_date)),
    b AS (SELECT a.*, CASE WHEN session_date = d0 THEN o0 ELSE yh END AS yh, CASE WHEN session_date = d0 THEN o0 ELSE yl END AS yl, CASE WHEN session_date = d0 THEN o0 ELSE yc END AS yc, row_number() OVER v - 1 AS pos, first_value(open) OVER v AS so FROM a JOIN de USING (event_type, session_date) WINDOW v AS (PARTITION BY event_type, session_date ORDER BY opens_at)),
    c AS (SELECT *, max(CASE WHEN pos < 6 THEN high END) OVER v AS oh, min(CASE WHEN pos < 6 THEN low END) OVER v AS ol, greatest(atr, 1e-12) AS u, greatest(high - low, 1e-12) AS span, abs(close - open) AS body, high - greatest(open, close) AS up, least(open, close) - low AS dn, n - row_number() OVER (PARTITION BY event_type, sg ORDER BY n) AS run FROM b WINDOW v AS (PARTITION BY event_type, session_date ORDER BY opens_at)),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type, sg, run ORDER BY n) AS streak FROM c)""".format(ordered=ORDERED)


@query(_RESEARCH + """ SELECT event_type, opens_at, round(s10 / u, 5) + 0 AS slope_10_atr, round(s20 / u, 5) + 0 AS slope_20_atr, round((close - sup20) / u, 5) + 0 AS support_distance_20_atr, round((res20 - close) / u, 5) + 0 AS resistance_distance_20_atr, round((close - sup50) / u, 5) + 0 AS support_distance_50_atr, round((res50 - close) / u, 5) + 0 AS resistance_distance_50_atr,
    round((close - so) / u, 5) + 0 AS session_return_atr, round((so - yc) / u, 5) + 0 AS opening_gap_atr, (pos >= 5)::INT::DOUBLE AS opening_range_ready, round(greatest(-2, least(3, CASE WHEN pos >= 5 THEN (close - ol) / greatest(oh - ol, 1e-12) ELSE 0.5 END)), 5) + 0 AS opening_range_position,
    round((yh - close) / u, 5) + 0 AS previous_high_distance_atr, round((close - yl) / u, 5) + 0 AS previous_low_distance_atr, round((close - yc) / u, 5) + 0 AS previous_close_distance_atr, (body / span <= 0.1)::INT::DOUBLE AS doji, (dn >= 2 * greatest(body, span * 0.05) AND up <= body)::INT::DOUBLE AS hammer,
    (up >= 2 * greatest(body, span * 0.05) AND dn <= body)::INT::DOUBLE AS shooting_star, coalesce(pc < po AND close > open AND open <= pc AND close >= po, false)::INT::DOUBLE AS bullish_engulfing, coalesce(pc > po AND close < open AND open >= pc AND close <= po, false)::INT::DOUBLE AS bearish_engulfing,
    coalesce(high <= ph AND low >= pl, false)::INT::DOUBLE AS inside_bar, coalesce(high >= ph AND low <= pl, false)::INT::DOUBLE AS outside_bar, round(coalesce((close - c3) / u, 0), 5) + 0 AS three_bar_return_atr, (sg * least(6, streak))::DOUBLE AS consecutive_direction FROM r WHERE atr IS NOT NULL""")
def research_features(spark, d):
    """The 22 research features that are no recursive means, in simple means of ranges."""
    rows = hourly(spark, d).withColumn("atr_14", F.round(features.framed(F.avg(F.col("high") - F.col("low")), 14, series()), 6))
    out = features.research(rows, BY).where("atr_14 is not null")
    names = [n for n in features.RESEARCH if not n.startswith(("macd", "adx", "di_"))]
    return rounded(out.select(*BY, AT, *[F.col(f"research_v3__{n}").alias(n) for n in names]), names, 5)


_STRUCTURAL = """WITH {bars}, p AS (SELECT *, row_number() OVER w AS n, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr, CASE WHEN lag(high, 2) OVER w > lag(high, 4) OVER w AND lag(high, 2) OVER w > lag(high, 3) OVER w AND lag(high, 2) OVER w > lag(high, 1) OVER w AND lag(high, 2) OVER w > high THEN lag(high, 2) OVER w END AS ph,
      CASE WHEN lag(low, 2) OVER w < lag(low, 4) OVER w AND lag(low, 2) OVER w < lag(low, 3) OVER w AND lag(low, 2) OVER w < lag(low, 1) OVER w AND lag(low, 2) OVER w < low THEN lag(low, 2) OVER w END AS pl FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)),
    q AS (SELECT *, list(ph) FILTER (ph IS NOT NULL) OVER (v ROWS 78 PRECEDING) AS hs, list(pl) FILTER (pl IS NOT NULL) OVER (v ROWS 78 PRECEDING) AS ls, greatest(avg(tr) OVER (v ROWS 13 PRECEDING), 1e-12) AS a, avg(high - low) OVER (v ROWS 2 PRECEDING) AS r3, greatest(avg(high - low) OVER (v ROWS 11 PRECEDING), 1e-12) AS r12, greatest(high - low, 1e-12) AS span FROM p WINDOW v AS (PARTITION BY event_type ORDER BY opens_at)),
    z AS (SELECT *, coalesce((hs[-1] - hs[-2]) / a, 0) AS hp, coalesce((ls[-1] - ls[-2]) / a, 0) AS lp FROM q)""".format(bars=BARS)


@query(_STRUCTURAL + """ SELECT event_type, opens_at, round(coalesce((close - hs[-1]) / a, 0), 5) + 0 AS confirmed_swing_high_distance_atr, round(coalesce((close - ls[-1]) / a, 0), 5) + 0 AS confirmed_swing_low_distance_atr, round(hp, 5) + 0 AS swing_high_progression_atr, round(lp, 5) + 0 AS swing_low_progression_atr,
    (CASE WHEN hp > 0 AND lp > 0 THEN 1 WHEN hp < 0 AND lp < 0 THEN -1 ELSE 0 END)::DOUBLE AS structure_score, coalesce(close > hs[-1] + 0.05 * a, false)::INT::DOUBLE AS break_of_structure_up, coalesce(close < ls[-1] - 0.05 * a, false)::INT::DOUBLE AS break_of_structure_down, coalesce(low < ls[-1] AND ls[-1] < close, false)::INT::DOUBLE AS swing_low_liquidity_sweep,
    coalesce(high > hs[-1] AND hs[-1] > close, false)::INT::DOUBLE AS swing_high_liquidity_sweep, round(r3 / r12, 5) + 0 AS range_compression_3_to_12, round((close - low) / span, 5) + 0 AS close_location, round((close - open) / span, 5) + 0 AS body_efficiency FROM z""")
def structural_features(spark, d):
    """The 12 features of confirmed swings."""
    out = features.structural(hourly(spark, d), BY)
    return rounded(out.select(*BY, AT, *[F.col(f"price_action__{n}").alias(n) for n in features.STRUCTURAL]), list(features.STRUCTURAL), 5)


@query(f"""WITH {BARS}, d AS (SELECT event_type, session_date, max(high) AS h, min(low) AS l, arg_max(close, opens_at) AS c FROM bars GROUP BY 1, 2),
    e AS (SELECT *, lag(h) OVER w AS previous_high, lag(l) OVER w AS previous_low, lag(c) OVER w AS previous_close FROM d WINDOW w AS (PARTITION BY event_type ORDER BY session_date)),
    r AS (SELECT *, row_number() OVER w - 1 AS position, first_value(open) OVER w AS session_open FROM bars WINDOW w AS (PARTITION BY event_type, session_date ORDER BY opens_at)),
    q AS (SELECT *, max(CASE WHEN position < 6 THEN high END) OVER w AS opening_high, min(CASE WHEN position < 6 THEN low END) OVER w AS opening_low FROM r WINDOW w AS (PARTITION BY event_type, session_date ORDER BY opens_at))
    SELECT event_type, opens_at, session_open, opening_high, opening_low, position >= 5 AS opening_ready, previous_high, previous_low, round(CASE WHEN coalesce(previous_close, session_open) <> 0 THEN session_open / coalesce(previous_close, session_open) - 1 END, 6) AS opening_gap
    FROM q JOIN e USING (event_type, session_date)""")
def daily_state(spark, d):
    out = features.daily_state(hourly(spark, d), BY)
    return rounded(out, ["opening_gap"]).select(*BY, AT, "session_open", "opening_high", "opening_low", "opening_ready", "previous_high", "previous_low", "opening_gap")


_PIV = """p AS (SELECT *, CASE WHEN lag(high, 2) OVER w > lag(high, 4) OVER w AND lag(high, 2) OVER w > lag(high, 3) OVER w AND lag(high, 2) OVER w > lag(high, 1) OVER w AND lag(high, 2) OVER w > high THEN lag(high, 2) OVER w END AS ph,
      CASE WHEN lag(low, 2) OVER w < lag(low, 4) OVER w AND lag(low, 2) OVER w < lag(low, 3) OVER w AND lag(low, 2) OVER w < lag(low, 1) OVER w AND lag(low, 2) OVER w < low THEN lag(low, 2) OVER w END AS pl FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)),
    q AS (SELECT *, list(ph) FILTER (ph IS NOT NULL) OVER v AS hs, list(pl) FILTER (pl IS NOT NULL) OVER v AS ls FROM p WINDOW v AS (PARTITION BY event_type ORDER BY opens_at ROWS 78 PRECEDING))"""


@query(f"""WITH {BARS}, {_PIV} SELECT event_type, opens_at, hs[-1] AS pivot_high_1, hs[-2] AS pivot_high_2, ls[-1] AS pivot_low_1, ls[-2] AS pivot_low_2,
    CASE WHEN hs[-2] IS NULL OR ls[-2] IS NULL THEN 'UNAVAILABLE' WHEN hs[-1] > hs[-2] AND ls[-1] > ls[-2] THEN 'BULLISH' WHEN hs[-1] < hs[-2] AND ls[-1] < ls[-2] THEN 'BEARISH' ELSE 'TRANSITION' END AS structure FROM q""")
def pivots(spark, d):
    return features.pivots(hourly(spark, d), BY).select(*BY, AT, "pivot_high_1", "pivot_high_2", "pivot_low_1", "pivot_low_2", "structure")


@query(f"""WITH {BARS}, p AS (SELECT *, lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc, abs(close - open) AS body, high - greatest(open, close) AS up, least(open, close) - low AS dn FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY opens_at))
    SELECT event_type, opens_at, body <= 0.10 * (high - low) AS doji, dn >= 2 * body AND up <= body AS hammer, up >= 2 * body AND dn <= body AS shooting_star, close > open AND pc < po AND close >= po AND open <= pc AS bullish_engulfing,
    close < open AND pc > po AND close <= po AND open >= pc AS bearish_engulfing, high < ph AND low > pl AS inside_bar, high > ph AND low < pl AS outside_bar FROM p""")
def patterns(spark, d):
    rows = features.structure(R.atr(hourly(spark, d), 14, BY, AT, "atr_14"), BY)
    return rows.select(*BY, AT, "doji", "hammer", "shooting_star", "bullish_engulfing", "bearish_engulfing", "inside_bar", "outside_bar")


@query(f"""WITH {BARS}, g AS (SELECT *, sign(close - open) AS sg, row_number() OVER w - row_number() OVER (PARTITION BY event_type, sign(close - open) ORDER BY opens_at) AS run FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY opens_at))
    SELECT event_type, opens_at, (CASE WHEN sg = 0 THEN 0 ELSE sg * least(6, row_number() OVER (PARTITION BY event_type, sg, run ORDER BY opens_at)) END)::DOUBLE AS consecutive_direction FROM g""")
def run_length(spark, d):
    return features.structure(R.atr(hourly(spark, d), 14, BY, AT, "atr_14"), BY).select(*BY, AT, "consecutive_direction")


def _ema_step(n: int, p: str) -> str:
    a = 2 / (n + 1)
    return f"CASE WHEN x.n = {n} THEN (p.total + x.close) / {n} WHEN x.n > {n} THEN {a!r} * x.close + (1 - {a!r}) * p.{p} END"


_BASE_MEANS = f"WITH RECURSIVE {ORDERED}, t AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS down FROM s), " + f"""
    rec AS (SELECT x.event_type, x.n, x.close AS total, x.tr AS ttr, 0::DOUBLE AS su, 0::DOUBLE AS sd, NULL::DOUBLE AS e20, NULL::DOUBLE AS e50, NULL::DOUBLE AS atr, NULL::DOUBLE AS g, NULL::DOUBLE AS l FROM t x WHERE x.n = 1
      UNION ALL SELECT x.event_type, x.n, p.total + x.close, p.ttr + x.tr, p.su + x.up, p.sd + x.down, {_ema_step(20, "e20")}, {_ema_step(50, "e50")}, CASE WHEN x.n = 14 THEN (p.ttr + x.tr) / 14 WHEN x.n > 14 THEN (p.atr * 13 + x.tr) / 14 END,
        CASE WHEN x.n = 15 THEN (p.su + x.up) / 14 WHEN x.n > 15 THEN (p.g * 13 + x.up) / 14 END, CASE WHEN x.n = 15 THEN (p.sd + x.down) / 14 WHEN x.n > 15 THEN (p.l * 13 + x.down) / 14 END
      FROM rec p JOIN t x ON x.event_type = p.event_type AND x.n = p.n + 1)"""
_BASE_ROWS = _BASE_MEANS + """, j AS (SELECT t.*, rec.e20 AS ema_20, rec.e50 AS ema_50, rec.atr AS atr_14, CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + g / l) END AS rsi_14 FROM t JOIN rec USING (event_type, n)),
    k AS (SELECT *, CASE WHEN pc <> 0 THEN close / pc - 1 END AS return_1, CASE WHEN lag(close, 5) OVER w <> 0 THEN close / lag(close, 5) OVER w - 1 END AS return_5, CASE WHEN lag(close, 12) OVER w <> 0 THEN close / lag(close, 12) OVER w - 1 END AS roc_12, CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END AS log_return_1,
      CASE WHEN n >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS sma_20, CASE WHEN n >= 50 THEN avg(close) OVER (w ROWS 49 PRECEDING) END AS sma_50, stddev_pop(close) OVER (w ROWS 19 PRECEDING) AS sd,
      CASE WHEN n > 20 THEN close > max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS breakout_up_20, CASE WHEN n > 20 THEN close < min(low) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS breakout_down_20,
      lag(session_date) OVER w = session_date AND lag(opens_at) OVER w + INTERVAL 1 hour <> opens_at AS gap FROM j WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)),
    f AS (SELECT event_type, opens_at, n, gap, return_1, return_5, return_5 AS roc_5, roc_12, log_return_1, CASE WHEN close <> 0 THEN (high - low) / close END AS range_pct, CASE WHEN open <> 0 THEN (close - open) / open END AS body_pct, CASE WHEN open <> 0 THEN (high - greatest(open, close)) / open END AS upper_wick_pct,
      CASE WHEN open <> 0 THEN (least(open, close) - low) / open END AS lower_wick_pct, sma_20, sma_50, ema_20, ema_50, atr_14, CASE WHEN close <> 0 THEN atr_14 / close END AS atr_pct, rsi_14, CASE WHEN n >= 21 THEN stddev_pop(return_1) OVER (w ROWS 19 PRECEDING) END AS rolling_vol_20,
      CASE WHEN n >= 20 AND sd > 1e-12 THEN (close - sma_20) / sd END AS bollinger_z_20, CASE WHEN atr_14 <> 0 THEN (close - ema_20) / atr_14 END AS distance_ema20_atr, CASE WHEN atr_14 <> 0 THEN (high - low) / atr_14 END AS range_atr, ema_20 > ema_50 AS trend_ema20_above_ema50, breakout_up_20, breakout_down_20,
      epoch(opens_at - session_date::TIMESTAMP) / 60 AS minute_of_session, (86400 - 3600 - epoch(opens_at - session_date::TIMESTAMP)) / 60 AS minutes_to_session_close, (isodow(session_date) - 1)::INT AS day_of_week FROM k WINDOW w AS (PARTITION BY event_type ORDER BY opens_at))"""
_FLAGS = ("trend_ema20_above_ema50", "breakout_up_20", "breakout_down_20", "day_of_week")
_SHOWN = ", ".join(n if n in _FLAGS else f"round({n}, 5) + 0 AS {n}" for n in features.BASE)


@query(_BASE_ROWS + f""" SELECT event_type, opens_at, {_SHOWN}, gap, concat_ws('|', CASE WHEN n < 50 THEN 'INSUFFICIENT_HISTORY:' || n || '/50' END, CASE WHEN max(coalesce(gap, false)::INT) OVER (PARTITION BY event_type ORDER BY opens_at ROWS 49 PRECEDING) = 1 THEN 'INTRADAY_GAP_IN_FEATURE_WINDOW' END,
    CASE WHEN {" OR ".join(f"{n} IS NULL" for n in features.BASE)} THEN 'FEATURE_WARMUP_INCOMPLETE' END) AS blockers FROM f""")
def base_features(spark, d):
    """All base features with readiness blockers."""
    rows = hourly(spark, d).withColumn("closes_at", F.col("opens_at") + F.expr("interval 1 hour"))
    day = F.col("session_date").cast("timestamp")
    rows = rows.withColumn("session_opens", day).withColumn("session_closes", day + F.expr("interval 24 hours"))
    out = features.readiness(features.base(rows, BY), BY).withColumn("blockers", F.concat_ws("|", "blockers"))
    return rounded(out.select(*BY, AT, *features.BASE, "gap", "blockers"), [n for n in features.BASE if n not in _FLAGS], 5)


_CONTEXT = ("return_1", "return_3", "return_12", "range_pct", "close_location", "atr_pct", "vol_12", "vol_48", "ema_8_21_atr", "ema_20_50_atr", "trend", "rsi", "return_z48")
_SHARES = ("close_location", "rsi")  # shares of whole cents, which fewer digits would leave on the edge
_SAFE = "CASE WHEN abs({b}) > 1e-12 THEN ({a}) / {b} ELSE 0 END"
_CONTEXT_SQL = f"WITH RECURSIVE {ORDERED}, rec AS (SELECT x.event_type, x.n, " + ", ".join(f"x.close AS e{k}" for k in (8, 20, 21, 50)) + " FROM s x WHERE x.n = 1 UNION ALL SELECT x.event_type, x.n, " + ", ".join(f"{2 / (k + 1)!r} * x.close + {1 - 2 / (k + 1)!r} * p.e{k}" for k in (8, 20, 21, 50)) + """ FROM rec p JOIN s x ON x.event_type = p.event_type AND x.n = p.n + 1),
    t AS (SELECT s.*, e8, e20, e21, e50, coalesce(close - pc, 0) AS dc, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, coalesce(CASE WHEN pc <> 0 THEN close / pc - 1 END, 0) AS return_1 FROM s JOIN rec USING (event_type, n)),
    a AS (SELECT *, avg(tr) OVER (w ROWS 13 PRECEDING) AS atr, sum(greatest(dc, 0)) OVER (w ROWS 13 PRECEDING) AS gain, sum(greatest(-dc, 0)) OVER (w ROWS 13 PRECEDING) AS loss, lag(close, 3) OVER w AS c3, lag(close, 12) OVER w AS c12, stddev_pop(return_1) OVER (w ROWS 11 PRECEDING) AS vol_12,
      stddev_pop(return_1) OVER (w ROWS 47 PRECEDING) AS vol_48, avg(return_1) OVER (w ROWS 47 PRECEDING) AS m48, greatest(high - low, 1e-12) AS span FROM t WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)),
    f AS (SELECT *, coalesce(CASE WHEN c3 <> 0 THEN close / c3 - 1 END, 0) AS return_3, coalesce(CASE WHEN c12 <> 0 THEN close / c12 - 1 END, 0) AS return_12, span / greatest(close, 1e-12) AS range_pct, (close - low) / span AS close_location, """ + _SAFE.format(a="atr", b="close") + " AS atr_pct, " + _SAFE.format(a="e8 - e21", b="atr") + " AS ema_8_21_atr, " + _SAFE.format(a="e20 - e50", b="atr") + """ AS ema_20_50_atr,
      CASE WHEN e8 - e21 > 1e-12 THEN 1 WHEN e8 - e21 < -1e-12 THEN -1 ELSE 0 END::DOUBLE AS trend, coalesce(CASE WHEN gain + loss <> 0 THEN gain / (gain + loss) END, 0.5) AS rsi, """ + _SAFE.format(a="return_1 - m48", b="vol_48") + " AS return_z48 FROM a)"


@query(_CONTEXT_SQL + " SELECT event_type, opens_at, open, high, low, close, n_ticks, session_date, " + ", ".join(f"round({n}, {9 if n in _SHARES else 5}) + 0 AS context_{n}" for n in _CONTEXT) + " FROM f")
def context_features(spark, d):
    out = rounded(features.context(hourly(spark, d), BY), [f"context_{n}" for n in _CONTEXT if n not in _SHARES], 5)
    return rounded(out, [f"context_{n}" for n in _SHARES], 9)


@query("""WITH e AS (SELECT *, lag(value) OVER w AS pv, lag(event_type) OVER w AS pt, lag(ts) OVER w AS pts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    f AS (SELECT *, coalesce(pt = event_type AND pts::DATE = ts::DATE AND epoch(ts - pts) > 0 AND epoch(ts - pts) <= 86400, false) AS ok FROM e)
    SELECT event_id, ok AS comparable, round(CASE WHEN ok THEN value - pv END, 6) AS value_change FROM f""")
def basis_changes(spark, d):
    """Changes within a user's day and event type (the contract's part), null across them."""
    rows = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("day", F.col("ts").cast("date"))
    out = features.changes(rows, ["user_id"], "ts", "event_type", "day", ["value"], minutes=1440)
    return rounded(out, ["value_change"]).select("event_id", "comparable", "value_change")
