"""Queries that put the operators together: price action, paper trades, gates, and an experiment."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import candles, features, folds, labels, models, price_action, tracking
from ..operators import recurrence as R
from ..sources.scratch import staged
from .bars import AT, BY
from .registry import BARS, hourly, query, rounded, table


def _structured(spark, d):
    rows = R.atr(hourly(spark, d), 14, BY, AT, "atr_14")
    rows = R.ema(R.ema(rows, F.col("close"), 20, BY, AT, "ema_20"), F.col("close"), 50, BY, AT, "ema_50")
    return features.pivots(features.daily_state(features.structure(rows, BY), BY), BY)


#: Hourly bars with simple means of ranges and closes for the recursive ones (ranges times a number that leaves no ties to round), three trends, and input blockers on some hours.
_TREND = "CASE WHEN n < 20 OR {f} IS NULL THEN 'UNAVAILABLE' WHEN {s} IS NULL THEN CASE WHEN close > {f} THEN 'BULLISH' WHEN close < {f} THEN 'BEARISH' ELSE 'MIXED' END WHEN close > {f} AND {f} > {s} THEN 'BULLISH' WHEN close < {f} AND {f} < {s} THEN 'BEARISH' ELSE 'MIXED' END"
_MEANS = ((20, 50), (10, 30), (30, 80))


def _analysed(spark, d):
    w = W.partitionBy(*BY).orderBy(AT)
    n = F.row_number().over(w)
    mean = lambda k: features.framed(F.avg("close"), k, w)
    rows = hourly(spark, d).withColumn("atr_14", F.round(features.framed(F.avg(F.col("high") - F.col("low")), 14, w), 6) * 1.0000001237)
    for name, (fast, slow) in zip(("trend_5m", "trend_15m", "trend_1h"), _MEANS):
        rows = rows.withColumn(name, price_action.trend(F.col("close"), mean(fast), mean(slow), n))
    rows = features.daily_state(rows, BY).withColumn("live", F.when(F.hour(AT) == 3, F.lit("STALE")).otherwise(F.lit("LIVE"))).withColumn("bars", F.row_number().over(w)).withColumn("developing", F.lit(False))
    rows = rows.withColumn("input_blockers", price_action.input_blockers("live", "bars", "bars", "bars", "developing"))
    return price_action.analyse(rows, BY)


def _analysis_sql() -> str:
    """The same by lists and joins, from the rules as they are stated."""
    trends = ", ".join(f"{_TREND.format(f=f'm{f}', s=f'm{s}')} AS {name}" for name, (f, s) in zip(("trend_5m", "trend_15m", "trend_1h"), _MEANS))
    means = ", ".join(f"CASE WHEN n >= {k} THEN avg(close) OVER (w ROWS {k - 1} PRECEDING) END AS m{k}" for k in sorted({x for p in _MEANS for x in p}))
    around = lambda c, op: " AND ".join(f"lag({c}, 2) OVER w {op} {f'lag({c}, {k}) OVER w' if k else c}" for k in (4, 3, 1, 0))
    items = [
        *[("{t} = 'BULLISH'".format(t=t), k, False) for t, k in (("trend_5m", 12), ("trend_15m", 16), ("trend_1h", 20))], *[("{t} = 'BEARISH'".format(t=t), -k, False) for t, k in (("trend_5m", 12), ("trend_15m", 16), ("trend_1h", 20))],
        ("structure = 'HIGHER_HIGHS_HIGHER_LOWS'", 18, False), ("structure = 'LOWER_HIGHS_LOWER_LOWS'", -18, False), ("close > hs[-1] + 0.05 * atr", 22, True), ("close < ls[-1] - 0.05 * atr", -22, True),
        ("low < ls[-1] AND close > ls[-1]", 14, True), ("high > hs[-1] AND close < hs[-1]", -14, True), ("position >= 5 AND close > oh + 0.05 * atr", 12, True), ("position >= 5 AND close < ol - 0.05 * atr", -12, True),
        ("close > previous_high + 0.05 * atr", 12, True), ("close < previous_low - 0.05 * atr", -12, True), ("wide AND close > open", 8, True), ("wide AND NOT close > open", -8, True),
        ("list_contains(patterns, 'BULLISH_ENGULFING')", 8, True), ("list_contains(patterns, 'BEARISH_ENGULFING')", -8, True), ("list_contains(patterns, 'HAMMER_REJECTION')", 6, True), ("list_contains(patterns, 'SHOOTING_STAR_REJECTION')", -6, True),
    ]
    total = " + ".join(f"CASE WHEN {c} THEN {k} ELSE 0 END" for c, k, _ in items)
    fires = lambda up: " OR ".join(f"coalesce({c}, false)" for c, k, t in items if t and (k > 0) == up)
    near = "coalesce(abs({x} - {p}[-1]) <= 0.35 * atr, false)"
    return f"""WITH {BARS}, x0 AS (SELECT *, row_number() OVER w AS n, lag(open) OVER w AS po, lag(high) OVER w AS pvh, lag(low) OVER w AS pvl, lag(close) OVER w AS pc, CASE WHEN {around('high', '>')} THEN lag(high, 2) OVER w END AS ph, CASE WHEN {around('low', '<')} THEN lag(low, 2) OVER w END AS pl
        FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)),
      x1 AS (SELECT *, round(CASE WHEN n >= 14 THEN avg(high - low) OVER (w ROWS 13 PRECEDING) END, 6) * 1.0000001237::DOUBLE AS atr, {means}, list(ph) FILTER (ph IS NOT NULL) OVER (w ROWS 115 PRECEDING) AS hs0, list(pl) FILTER (pl IS NOT NULL) OVER (w ROWS 115 PRECEDING) AS ls0 FROM x0 WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)),
      dd AS (SELECT event_type, session_date, max(high) AS h, min(low) AS l, arg_max(close, opens_at) AS c FROM bars GROUP BY 1, 2), de AS (SELECT event_type, session_date, lag(h) OVER w AS previous_high, lag(l) OVER w AS previous_low, lag(c) OVER w AS previous_close FROM dd WINDOW w AS (PARTITION BY event_type ORDER BY session_date)),
      x2 AS (SELECT x1.*, coalesce(hs0[-8:], []) AS hs, coalesce(ls0[-8:], []) AS ls, row_number() OVER v - 1 AS position, previous_high, previous_low, previous_close, {trends} FROM x1 JOIN de USING (event_type, session_date) WINDOW v AS (PARTITION BY event_type, session_date ORDER BY opens_at)),
      x3 AS (SELECT *, max(CASE WHEN position < 6 THEN high END) OVER v AS oh, min(CASE WHEN position < 6 THEN low END) OVER v AS ol, greatest(high - low, 0.01) AS span, abs(close - open) AS body, high - greatest(open, close) AS up, least(open, close) - low AS dn,
        CASE WHEN len(hs) < 2 OR len(ls) < 2 THEN 'UNCONFIRMED' WHEN hs[-1] > hs[-2] AND ls[-1] > ls[-2] THEN 'HIGHER_HIGHS_HIGHER_LOWS' WHEN hs[-1] <= hs[-2] AND ls[-1] <= ls[-2] THEN 'LOWER_HIGHS_LOWER_LOWS' ELSE 'RANGE_OR_TRANSITION' END AS structure FROM x2 WINDOW v AS (PARTITION BY event_type, session_date ORDER BY opens_at)),
      x4 AS (SELECT *, body / span >= 0.65 AND span >= 1.1 * atr AS wide, list_filter([CASE WHEN close > open AND pc < po AND open <= pc AND close >= po THEN 'BULLISH_ENGULFING' END, CASE WHEN close < open AND pc > po AND open >= pc AND close <= po THEN 'BEARISH_ENGULFING' END, CASE WHEN n > 1 AND body / span <= 0.15 THEN 'DOJI_INDECISION' END,
        CASE WHEN n > 1 AND dn >= greatest(2 * body, 0.45 * span) AND up <= 0.2 * span AND {near.format(x='low', p='ls')} THEN 'HAMMER_REJECTION' END, CASE WHEN n > 1 AND up >= greatest(2 * body, 0.45 * span) AND dn <= 0.2 * span AND {near.format(x='high', p='hs')} THEN 'SHOOTING_STAR_REJECTION' END,
        CASE WHEN high < pvh AND low > pvl THEN 'INSIDE_BAR_COMPRESSION' END, CASE WHEN high > pvh AND low < pvl THEN 'OUTSIDE_BAR_EXPANSION' END], lambda x: x IS NOT NULL) AS patterns FROM x3),
      x5 AS (SELECT *, CASE WHEN atr > 0 THEN greatest(-100, least(100, {total})) ELSE 0 END AS score, ({fires(True)}) AS buys, ({fires(False)}) AS sells, hour(opens_at) <> 3 AND n >= 50 AS free FROM x4),
      x6 AS (SELECT *, CASE WHEN NOT coalesce(atr > 0, false) THEN 'UNAVAILABLE' WHEN score >= 25 THEN 'BULLISH' WHEN score <= -25 THEN 'BEARISH' ELSE 'NEUTRAL' END AS bias, CASE WHEN NOT coalesce(atr > 0, false) THEN 'UNAVAILABLE' WHEN abs(score) >= 70 THEN 'STRONG' WHEN abs(score) >= 45 THEN 'MODERATE' WHEN abs(score) >= 25 THEN 'WEAK' ELSE 'NO_EDGE' END AS grade,
        CASE WHEN NOT coalesce(atr > 0, false) THEN 'UNAVAILABLE' WHEN free AND score >= 55 AND buys THEN 'BUY_TRIGGER' WHEN free AND score <= -55 AND sells THEN 'SELL_TRIGGER' WHEN score >= 35 THEN 'BULLISH_WATCH' WHEN score <= -35 THEN 'BEARISH_WATCH' ELSE 'WAIT' END AS setup0,
        CASE WHEN n > 14 THEN list_sort(list(CASE WHEN n > 14 THEN atr END) FILTER (n > 14) OVER (PARTITION BY event_type ORDER BY opens_at ROWS 19 PRECEDING)) END AS past FROM x5)"""


@query(_analysis_sql() + """ SELECT event_type, opens_at, trend_5m, trend_15m, trend_1h, structure, array_to_string(patterns, '|') AS patterns, score::INT AS score, bias, grade,
    CASE WHEN n < 35 THEN 'UNAVAILABLE' WHEN past[len(past) // 2 + 1] <= 0 THEN 'NORMAL' WHEN atr / past[len(past) // 2 + 1] >= 1.25 THEN 'EXPANDING' WHEN atr / past[len(past) // 2 + 1] <= 0.8 THEN 'COMPRESSED' ELSE 'NORMAL' END AS regime FROM x6""")
def price_action_evidence(spark, d):
    """Trends of three frames, structure, patterns, weighted evidence, bias, grade, and the regime of volatility at every bar."""
    return _analysed(spark, d).select(*BY, AT, "trend_5m", "trend_15m", "trend_1h", "structure", F.concat_ws("|", "patterns").alias("patterns"), "score", "bias", "grade", "regime")


_LEVELS = """, c AS (SELECT event_type, opens_at, close, greatest(0.18 * atr, 0.01) AS tol, unnest(list_concat([{'p': x, 'k': 0, 'kind': 'SWING_LOW', 'w': 2} for x in ls], [{'p': x, 'k': 1, 'kind': 'SWING_HIGH', 'w': 2} for x in hs],
      [x for x in [CASE WHEN position >= 5 THEN {'p': oh, 'k': 2, 'kind': 'OPENING_RANGE_HIGH', 'w': 3} END, CASE WHEN position >= 5 THEN {'p': ol, 'k': 3, 'kind': 'OPENING_RANGE_LOW', 'w': 3} END, CASE WHEN previous_high IS NOT NULL THEN {'p': previous_high, 'k': 4, 'kind': 'PREVIOUS_DAY_HIGH', 'w': 3} END,
        CASE WHEN previous_low IS NOT NULL THEN {'p': previous_low, 'k': 5, 'kind': 'PREVIOUS_DAY_LOW', 'w': 3} END, CASE WHEN previous_close IS NOT NULL THEN {'p': previous_close, 'k': 6, 'kind': 'PREVIOUS_DAY_CLOSE', 'w': 2} END] if x IS NOT NULL])) AS x FROM x6 WHERE atr > 0),
    o AS (SELECT event_type, opens_at, close, tol, x.p AS p, x.w AS w, x.kind AS kind, x.k AS k, row_number() OVER (PARTITION BY event_type, opens_at ORDER BY x.p, x.k) AS i FROM c),
    r AS (SELECT event_type, opens_at, close, tol, p, w, kind, k, i, 1 AS cluster, p AS s, 1 AS m FROM o WHERE i = 1 UNION ALL
      SELECT o.event_type, o.opens_at, o.close, o.tol, o.p, o.w, o.kind, o.k, o.i, CASE WHEN abs(r.s / r.m - o.p) <= o.tol THEN r.cluster ELSE r.cluster + 1 END, CASE WHEN abs(r.s / r.m - o.p) <= o.tol THEN r.s + o.p ELSE o.p END, CASE WHEN abs(r.s / r.m - o.p) <= o.tol THEN r.m + 1 ELSE 1 END
      FROM r JOIN o ON o.event_type = r.event_type AND o.opens_at = r.opens_at AND o.i = r.i + 1),
    l AS (SELECT event_type, opens_at, any_value(close) AS close, sum(p * w) / sum(w) AS price, arg_min(kind, (-w, i)) AS kind, least(5, sum(w)) AS strength, count(*) AS touches FROM r GROUP BY event_type, opens_at, cluster),
    lv AS (SELECT event_type, opens_at, max(price) FILTER (price <= close) AS support, arg_max(kind, price) FILTER (price <= close) AS support_kind, arg_max(strength, price) FILTER (price <= close) AS support_strength, arg_max(touches, price) FILTER (price <= close) AS support_touches,
      min(price) FILTER (price > close) AS resistance, arg_min(kind, price) FILTER (price > close) AS resistance_kind, count(*) FILTER (price <= close) AS below, count(*) FILTER (price > close) AS above FROM l GROUP BY 1, 2)"""


@query(_analysis_sql().replace("WITH bars", "WITH RECURSIVE bars", 1) + _LEVELS + """ SELECT x6.event_type, x6.opens_at, round(support, 6) AS support, support_kind, support_strength::INT AS support_strength, support_touches::INT AS support_touches, round(resistance, 6) AS resistance, resistance_kind,
    least(3, coalesce(below, 0))::INT AS n_supports, least(3, coalesce(above, 0))::INT AS n_resistances FROM x6 LEFT JOIN lv USING (event_type, opens_at)""")
def price_action_levels(spark, d):
    """The nearest of at most three levels on each side of the close."""
    s, r = (F.try_element_at(x, F.lit(1)) for x in ("supports", "resistances"))
    out = _analysed(spark, d).select(
        *BY, AT, s["price"].alias("support"), s["kind"].alias("support_kind"), s["strength"].alias("support_strength"), s["touches"].alias("support_touches"), r["price"].alias("resistance"), r["kind"].alias("resistance_kind"),
        F.size("supports").alias("n_supports"), F.size("resistances").alias("n_resistances"),
    )
    return rounded(out, ["support", "resistance"])


_PLAN = """, p0 AS (SELECT x6.*, support, resistance, CASE bias WHEN 'BULLISH' THEN 1 WHEN 'BEARISH' THEN -1 END AS side FROM x6 LEFT JOIN lv USING (event_type, opens_at)),
    p1 AS (SELECT *, CASE WHEN setup0 IN ('BUY_TRIGGER', 'SELL_TRIGGER') THEN close WHEN side > 0 THEN greatest(close, coalesce(hs[-1], high) + 0.05 * atr) WHEN side < 0 THEN least(close, coalesce(ls[-1], low) - 0.05 * atr) END AS t, CASE WHEN side > 0 THEN support ELSE resistance END AS own, CASE WHEN side > 0 THEN resistance ELSE support END AS other FROM p0),
    p2 AS (SELECT *, CASE WHEN side IS NULL THEN NULL WHEN own IS NULL THEN atr ELSE greatest(0.65 * atr, side * (t - own) + 0.05 * atr) END AS risk FROM p1),
    p3 AS (SELECT *, list_filter([CASE WHEN risk > 1.5 * atr THEN 'STRUCTURE_STOP_EXCEEDS_1.5_ATR' END, CASE WHEN side * (other - t) > 0 AND side * (other - t) < risk THEN 'NEAREST_OPPOSING_LEVEL_INSIDE_1R' END], lambda x: x IS NOT NULL) AS b FROM p2)"""


@query(_analysis_sql().replace("WITH bars", "WITH RECURSIVE bars", 1) + _LEVELS + _PLAN + """ SELECT event_type, opens_at, CASE WHEN len(b) > 0 AND setup0 = 'BUY_TRIGGER' THEN 'BULLISH_WATCH' WHEN len(b) > 0 AND setup0 = 'SELL_TRIGGER' THEN 'BEARISH_WATCH' ELSE setup0 END AS setup,
    round(t, 5) AS trigger, round(risk, 5) AS risk, round(t - side * risk, 5) AS stop, round(t + side * 1.25 * risk, 5) AS target_1, round(t + side * 3 * risk, 5) AS target_3, round(t - 0.05 * atr, 5) AS entry_low, array_to_string(b, '|') AS plan_blockers FROM p3""")
def price_action_plan(spark, d):
    """Setup and conditional plan at every bar."""
    out = _analysed(spark, d).select(*BY, AT, "setup", "trigger", "risk", "stop", "target_1", "target_3", "entry_low", F.concat_ws("|", "plan_blockers").alias("plan_blockers"))
    return rounded(out, ["trigger", "risk", "stop", "target_1", "target_3", "entry_low"], 5)


#: Two logistic and two boosted models, measured by the prior. A step of the boosted ones is worth twice as much as one that divides by the second derivative, so 0.015 stands for 0.03.
STUDY = models.Study(
    (
        models.Candidate("prior", "prior"), models.Candidate("logistic", "logistic"), models.Candidate("elastic_net", "elastic_net", (("mix", 0.25),)),
        models.Candidate("boosted_shallow", "boosted", (("rounds", 160), ("depth", 3), ("rate", 0.015), ("leaf", 50))), models.Candidate("boosted_medium", "boosted", (("rounds", 200), ("depth", 4), ("rate", 0.015), ("leaf", 40))),
    ),
    (0, 1), 2, 3, (4,), (0.3, 0.4, 0.5),
)


@query()
def walk_forward_study(spark, d):
    """Boosted and logistic models of whether a long trade pays, chosen, calibrated and diagnosed on later folds."""
    rows = _structured(spark, d).where("atr_14 is not null").withColumn("trend_strength", F.try_divide(F.col("ema_20") - F.col("ema_50"), F.col("atr_14")))
    rows = labels.trade_path(rows, BY, AT, "atr_14", 1).withColumn("label", (F.col("net_points") > 0).cast("double"))
    names = ["trend_strength", "slope_10_atr", "support_20_atr", "resistance_20_atr", "close_location", "range_compression"]
    rows = rows.dropna(subset=names).withColumn("label_end", F.col(AT) + F.expr("interval 13 hours"))
    rows = rows.select(*BY, AT, "label_end", "label", "r_multiple", *names, F.unix_micros(F.col(AT).cast("timestamp")).alias("start_us"))
    # folds read the rows several times, and every fit plans anew: neither is to hold the plan of the features
    rows = staged(rows.withColumn("end_us", F.col("start_us") + 12 * 3600000000), "samples")
    out = staged(folds.walk_forward(rows, BY, AT, "label_end", 5, 60, 3600.0), "folds")  # read by every fit
    return models.run_study(out, STUDY, names, "start_us", "end_us")


@query("""WITH t AS (SELECT event_id AS trade_id, event_id % 2 = 0 AS buy, value - 1 AS el, value + 1 AS eh, value - CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * 25 AS stop, value + CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * 40 AS target, ts AS opened_at, ts + INTERVAL 6 hours AS expires_at FROM events WHERE event_type = 'purchase'),
    b AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS tm, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1),
    m AS (SELECT t.trade_id, b.tm, b.low <= t.eh AND b.high >= t.el AS zone, CASE WHEN buy THEN b.low <= t.stop ELSE b.high >= t.stop END AS s, CASE WHEN buy THEN b.high >= t.target ELSE b.low <= t.target END AS g FROM t JOIN b ON b.tm >= t.opened_at AND b.tm < t.expires_at),
    f AS (SELECT trade_id, min(tm) AS filled_at FROM m WHERE zone GROUP BY 1), e AS (SELECT m.trade_id, min(tm) AS ended_at, arg_min(s, tm) AS s, arg_min(g, tm) AS g FROM m JOIN f ON f.trade_id = m.trade_id AND m.tm >= f.filled_at WHERE s OR g GROUP BY 1),
    x AS (SELECT trade_id, min_by(b.close, b.tm) AS last, min_by(b.low, b.tm) AS ll, min_by(b.high, b.tm) AS lh FROM t JOIN b ON b.tm >= t.expires_at GROUP BY 1),
    a AS (SELECT t.*, filled_at, ended_at, last, CASE WHEN ended_at IS NOT NULL THEN s WHEN buy THEN ll <= stop ELSE lh >= stop END AS s, CASE WHEN ended_at IS NOT NULL THEN g WHEN buy THEN lh >= target ELSE ll <= target END AS g
      FROM t LEFT JOIN f USING (trade_id) LEFT JOIN e USING (trade_id) LEFT JOIN x USING (trade_id)),
    z AS (SELECT *, CASE WHEN filled_at IS NULL THEN CASE WHEN last IS NULL THEN 'WAITING' ELSE 'EXPIRED' END WHEN coalesce(ended_at = filled_at, false) OR (s AND g) THEN 'INVALIDATED' WHEN s THEN 'STOP_HIT' WHEN g THEN 'TARGET_1_HIT' WHEN last IS NOT NULL THEN 'EXPIRED' ELSE 'OPEN' END AS state FROM a)
    SELECT trade_id, state, round(CASE WHEN buy THEN 1 ELSE -1 END * (CASE WHEN state = 'STOP_HIT' THEN stop WHEN state = 'TARGET_1_HIT' THEN target WHEN state = 'EXPIRED' AND filled_at IS NOT NULL THEN last END - CASE WHEN buy THEN eh ELSE el END), 6) + 0 AS points FROM z""")
def paper_trades(spark, d):
    """Every purchase as a trade, long or short, over hourly bars."""
    e = table(spark, d, "events")
    bars = candles.from_ticks(e, F.date_trunc("hour", "ts").cast("timestamp_ntz"), []).select(F.lit("all").alias("series"), F.col("opens_at").alias("at"), "high", "low", "close")
    buy = F.col("event_id") % 2 == 0
    sign = F.when(buy, 1).otherwise(-1)
    t = e.where("event_type = 'purchase'").select(
        F.lit("all").alias("series"), F.col("event_id").alias("trade_id"), F.when(buy, F.lit("BUY")).otherwise(F.lit("SELL")).alias("side"), (F.col("value") - 1).alias("entry_low"), (F.col("value") + 1).alias("entry_high"),
        (F.col("value") - sign * 25).alias("stop"), (F.col("value") + sign * 40).alias("target"), F.col("ts").alias("opened_at"), (F.col("ts") + F.expr("interval 6 hours")).alias("expires_at"),
    )
    return rounded(tracking.paper_trades(t, bars, ["series"]).select("trade_id", "state", "points"), ["points"])


@query("""WITH c AS (SELECT event_type, user_id % 20 AS component, CASE WHEN value > 150 THEN 2 WHEN value > 100 THEN 1 ELSE 0 END AS r FROM events) SELECT event_type, component, CASE max(r) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status,
    count(*) FILTER (r = 0) AS n_pass, count(*) FILTER (r = 1) AS n_warn, count(*) FILTER (r = 2) AS n_fail FROM c GROUP BY 1, 2""")
def monitoring(spark, d):
    status = F.when(F.col("value") > 150, F.lit("FAIL")).when(F.col("value") > 100, F.lit("WARN")).otherwise(F.lit("PASS"))
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 20).alias("component"), status.alias("status"))
    return tracking.monitoring(rows, ["event_type", "component"])


@query("""SELECT event_id, coalesce(sum((value <= 100)::INT) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 AND epoch(ts)::BIGINT - epoch(lag(ts) OVER w)::BIGINT < 86400, false) AS open FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def circuit_breaker(spark, d):
    rows = table(spark, d, "events").withColumn("ok", F.col("value") > 100)
    return tracking.circuit_breaker(rows, ["user_id"], "ts", "ok", 3, 86400, ("event_id",)).select("event_id", "open")


@query(f"""WITH {BARS}, b AS (SELECT event_type, opens_at, 1 AS src, close, n_ticks::BIGINT AS revision FROM bars UNION ALL SELECT event_type, opens_at, 2, high, 2 FROM bars) SELECT event_type, opens_at, close FROM (SELECT *, row_number() OVER (PARTITION BY event_type, opens_at ORDER BY revision DESC, src DESC) AS n FROM b) WHERE n = 1""")
def merge_candles(spark, d):
    """Two sets of bars in one: the larger revision wins, the second set on ties."""
    a = hourly(spark, d)
    x, y = a.select(*BY, AT, F.lit(1).alias("src"), "close", F.col("n_ticks").alias("revision")), a.select(*BY, AT, F.lit(2).alias("src"), F.col("high").alias("close"), F.lit(2).cast("long").alias("revision"))
    return candles.latest(x.unionByName(y), [*BY, AT], [F.desc("revision"), F.desc("src")]).select(*BY, AT, "close")
