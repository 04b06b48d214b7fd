"""Queries over what is known at one instant: live-plan candidates, and snapshots of several frames."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import candidates, candles, shadow, snapshots
from ..sources.scratch import scratch
from ..streaming import live as L
from ..streaming import pipelines as S
from .bars import BY
from .registry import BARS, floored, hourly, query, rounded, table
from .streams import _ticks
from .studies import _LEVELS, _PLAN, _TREND, _analysis_sql


def frame(spark, d, hours: int):
    """Bars of some hours of events.value, from what hours there are."""
    bars = hourly(spark, d)
    out = bars.groupBy(*BY, floored("opens_at", hours * 3600).alias("_o")).agg(
        F.min_by("open", "opens_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "opens_at").alias("close"), F.max("n_ticks").alias("revision"),
    )
    return out.withColumnRenamed("_o", "opens_at").withColumn("closes_at", F.col("opens_at") + F.make_dt_interval(hours=F.lit(hours)))


def _live(spark, d):
    bars = frame(spark, d, 1).withColumn("session_date", F.col("opens_at").cast("date"))
    bars = bars.withColumn("live", F.when(F.hour("opens_at") == 3, F.lit("STALE")).otherwise(F.lit("LIVE"))).withColumn("developing", F.lit(False))
    whole = (F.hour(F.min("opens_at")) == 0) & (F.hour(F.max("opens_at")) == 23)
    rows = candidates.analysed(bars, {"trend_15m": frame(spark, d, 2), "trend_1h": frame(spark, d, 4)}, BY, whole)
    finer = bars.select(*BY, F.col("opens_at").alias("at"), "open", "high", "low", "close")
    return candidates.live_plans(candidates.with_paths(rows, finer, BY, "opens_at", "closes_at", 6, 3600))


def _ema(n: int, values: str) -> str:
    """An exponential mean of a list as it is stated: the mean of the first ``n``, then value after value."""
    return f"CASE WHEN len({values}) >= {n} THEN list_reduce(list_concat([list_avg({values}[1:{n}])], {values}[{n + 1}:]), lambda p, q: {2 / (n + 1)!r}::DOUBLE * q + {1 - 2 / (n + 1)!r}::DOUBLE * p) END"


def _frame_sql(hours: int) -> str:
    bucket = f"time_bucket(INTERVAL {hours} hours, opens_at)::TIMESTAMP"
    return f"""(SELECT event_type, {bucket} AS opens_at, {bucket} + INTERVAL {hours} hours AS closes_at, arg_min(open, opens_at) AS open, max(high) AS high, min(low) AS low, arg_max(close, opens_at) AS close, max(n_ticks) AS revision FROM bars GROUP BY 1, 2, 3)"""


def _seen(source: str, limit: int, name: str) -> str:
    listed = f"(SELECT *, list(close) OVER w AS cl FROM {source} WINDOW w AS (PARTITION BY event_type ORDER BY opens_at ROWS {limit - 1} PRECEDING))"
    means = f"(SELECT *, {_ema(20, 'cl')} AS f, {_ema(50, 'cl')} AS s, len(cl) AS n FROM {listed})"
    return f"(SELECT event_type, opens_at, closes_at, n AS n_{name}, {_TREND.format(f='f', s='s')} AS {name} FROM {means})"


_ATR_LIST = "list_concat([hl[1]], trl[2:])"
_FB = f"""f1 AS (SELECT b.*, p.trend_5m, p.n_trend_5m FROM bars b JOIN {_seen(_frame_sql(1), 750, 'trend_5m')} p USING (event_type, opens_at)),
    c15 AS {_seen(_frame_sql(2), 250, 'trend_15m')}, c60 AS {_seen(_frame_sql(4), 120, 'trend_1h')},
    f2 AS (SELECT f1.*, coalesce(c15.trend_15m, 'UNAVAILABLE') AS trend_15m, coalesce(c15.n_trend_15m, 0) AS n15 FROM f1 ASOF LEFT JOIN c15 ON f1.event_type = c15.event_type AND f1.opens_at + INTERVAL 1 hour >= c15.closes_at),
    f3 AS (SELECT f2.*, coalesce(c60.trend_1h, 'UNAVAILABLE') AS trend_1h, coalesce(c60.n_trend_1h, 0) AS n60 FROM f2 ASOF LEFT JOIN c60 ON f2.event_type = c60.event_type AND f2.opens_at + INTERVAL 1 hour >= c60.closes_at),
    f4 AS (SELECT *, high - low AS own, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM f3 WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)),
    f5 AS (SELECT * EXCLUDE (own, tr), list(own) OVER w AS hl, list(tr) OVER w AS trl FROM f4 WINDOW w AS (PARTITION BY event_type ORDER BY opens_at ROWS 749 PRECEDING)),
    fb AS (SELECT * EXCLUDE (hl, trl), CASE WHEN len(trl) >= 14 THEN list_reduce(list_concat([list_avg({_ATR_LIST}[1:14])], {_ATR_LIST}[15:]), lambda p, q: (p * 13 + q) / 14) END AS atr0 FROM f5)"""


def _live_sql() -> str:
    out = _analysis_sql().replace("WITH bars", "WITH RECURSIVE bars", 1)
    swaps = {
        ", x0 AS": f", {_FB}, x0 AS", "FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)),\n      x1": "FROM fb WINDOW w AS (PARTITION BY event_type ORDER BY opens_at)),\n      x1",
        "round(CASE WHEN n >= 14 THEN avg(high - low) OVER (w ROWS 13 PRECEDING) END, 6) * 1.0000001237::DOUBLE AS atr": "atr0 AS atr",
        "max(high) AS h, min(low) AS l, arg_max(close, opens_at) AS c FROM bars GROUP BY 1, 2": "CASE WHEN ok THEN h END AS h, CASE WHEN ok THEN l END AS l, CASE WHEN ok THEN c END AS c FROM (SELECT event_type, session_date, hour(min(opens_at)) = 0 AND hour(max(opens_at)) = 23 AS ok, max(high) AS h, min(low) AS l, arg_max(close, opens_at) AS c FROM bars GROUP BY 1, 2)",
        "hour(opens_at) <> 3 AND n >= 50 AS free": "hour(opens_at) <> 3 AND n >= 50 AND n15 >= 20 AND n60 >= 20 AS free",
    }
    start = out.index("CASE WHEN n < 20 OR")
    out = out[:start] + out[start:].replace(out[start : out.index(" FROM x1 JOIN de")], "1 AS _seen", 1)
    for old, new in swaps.items():
        assert old in out, old
        out = out.replace(old, new, 1)
    return out + _LEVELS + _PLAN


_STATE = "CASE WHEN len(b) > 0 AND setup0 = 'BUY_TRIGGER' THEN 'BULLISH_WATCH' WHEN len(b) > 0 AND setup0 = 'SELL_TRIGGER' THEN 'BEARISH_WATCH' ELSE setup0 END"
#: The plans that fired, their six bars, and a recursive play of each policy, bar after bar.
_PLAYED = f"""{_live_sql()}, st AS (SELECT *, {_STATE} AS setup FROM p3),
    q0 AS (SELECT s.event_type, s.opens_at, s.setup, s.side AS sd, s.score, s.grade, s.atr, s.t, s.risk, s.t - s.side * s.risk AS stop0, s.t + s.side * 1.25 * s.risk AS t1, s.t + s.side * 2 * s.risk AS t2, s.t + s.side * 3 * s.risk AS t3,
      s.t - 0.05 * s.atr AS el, s.t + 0.05 * s.atr AS eh, (SELECT count(*) FROM bars m WHERE m.event_type = s.event_type AND m.opens_at > s.opens_at AND m.opens_at <= s.opens_at + INTERVAL 6 hours) AS k FROM st s WHERE s.setup IN ('BUY_TRIGGER', 'SELL_TRIGGER')),
    pol AS (SELECT * FROM (VALUES ('FULL_TARGET1', 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, false), ('SCALE_50_30_20_STATIC_STOP', 0.5::DOUBLE, 0.3::DOUBLE, 0.2::DOUBLE, false), ('SCALE_50_30_20_PROTECTED', 0.5::DOUBLE, 0.3::DOUBLE, 0.2::DOUBLE, true)) v(policy, a1, a2, a3, protect)),
    play AS (SELECT q0.*, pol.*, 0 AS i, NULL::VARCHAR AS status, NULL::DOUBLE AS entry, stop0 AS stp, 1.0::DOUBLE AS rest, 0.0::DOUBLE AS gained, 0 AS top, NULL::INT AS leaves, NULL::DOUBLE AS last FROM q0, pol WHERE k = 6
      UNION ALL SELECT p.* EXCLUDE (i, status, entry, stp, rest, gained, top, leaves, last), p.i + 1,
        CASE WHEN p.status IS NOT NULL THEN p.status WHEN p.entry IS NULL AND NOT e.crossed THEN NULL WHEN p.entry IS NULL AND e.gap THEN 'MISSED_GAP_BEYOND_ENTRY_ZONE' WHEN f.hit THEN CASE WHEN p.top = 0 THEN 'STOPPED' ELSE 'STOPPED_AFTER_TARGET' END
          WHEN g.n >= CASE WHEN a2 > 0 THEN 3 ELSE 1 END THEN 'TARGET' || g.n || '_REACHED' END,
        CASE WHEN p.status IS NOT NULL THEN p.entry WHEN p.entry IS NULL AND (NOT e.crossed OR e.gap) THEN NULL ELSE f.en END,
        CASE WHEN p.status IS NULL AND f.live AND NOT f.hit AND g.n > p.top AND protect THEN CASE WHEN g.n >= 2 THEN t1 ELSE t END ELSE p.stp END,
        CASE WHEN p.status IS NOT NULL OR NOT f.live THEN p.rest WHEN f.hit THEN 0 ELSE p.rest - CASE WHEN g.n >= 1 AND p.top < 1 THEN a1 ELSE 0 END - CASE WHEN g.n >= 2 AND p.top < 2 THEN a2 ELSE 0 END - CASE WHEN g.n >= 3 AND p.top < 3 THEN a3 ELSE 0 END END,
        CASE WHEN p.status IS NOT NULL OR NOT f.live THEN p.gained WHEN f.hit THEN p.gained + p.rest * sd * (p.stp - sd * 0.5::DOUBLE - f.en) ELSE p.gained + CASE WHEN g.n >= 1 AND p.top < 1 THEN a1 * sd * (t1 - sd * 0.5::DOUBLE - f.en) ELSE 0 END
          + CASE WHEN g.n >= 2 AND p.top < 2 THEN a2 * sd * (t2 - sd * 0.5::DOUBLE - f.en) ELSE 0 END + CASE WHEN g.n >= 3 AND p.top < 3 THEN a3 * sd * (t3 - sd * 0.5::DOUBLE - f.en) ELSE 0 END END,
        CASE WHEN p.status IS NOT NULL OR NOT f.live OR f.hit THEN p.top ELSE g.n END,
        CASE WHEN p.status IS NULL AND f.live AND (f.hit OR g.n >= CASE WHEN a2 > 0 THEN 3 ELSE 1 END) THEN p.i + 1 ELSE p.leaves END, m.close
      FROM play p JOIN bars m ON m.event_type = p.event_type AND m.opens_at = p.opens_at + to_hours(p.i + 1),
        LATERAL (SELECT CASE WHEN sd > 0 THEN m.high >= p.t ELSE m.low <= p.t END AS crossed, CASE WHEN sd > 0 THEN m.open > eh ELSE m.open < el END AS gap) e,
        LATERAL (SELECT p.entry IS NOT NULL OR (e.crossed AND NOT e.gap) AS live, coalesce(p.entry, CASE WHEN sd > 0 THEN greatest(m.open, p.t) ELSE least(m.open, p.t) END + sd * 0.5::DOUBLE) AS en, CASE WHEN sd > 0 THEN m.low <= p.stp ELSE m.high >= p.stp END AS hit) f,
        LATERAL (SELECT CASE WHEN sd > 0 THEN m.high >= t1 ELSE m.low <= t1 END AS h1, CASE WHEN sd > 0 THEN m.high >= t2 ELSE m.low <= t2 END AS h2, CASE WHEN sd > 0 THEN m.high >= t3 ELSE m.low <= t3 END AS h3) h,
        LATERAL (SELECT CASE WHEN a2 = 0 THEN CASE WHEN p.top < 1 AND h1 THEN 1 ELSE p.top END WHEN p.top = 0 THEN CASE WHEN NOT h1 THEN 0 WHEN NOT h2 THEN 1 WHEN NOT h3 THEN 2 ELSE 3 END WHEN p.top = 1 THEN CASE WHEN NOT h2 THEN 1 WHEN NOT h3 THEN 2 ELSE 3 END WHEN p.top = 2 THEN CASE WHEN h3 THEN 3 ELSE 2 END ELSE p.top END AS n) g
      WHERE p.i < 6),
    fin AS (SELECT *, coalesce(status, CASE WHEN entry IS NULL THEN 'NOT_TRIGGERED' ELSE 'EXPIRED' END) AS final, CASE WHEN entry IS NULL THEN 0 ELSE gained + CASE WHEN status IS NULL THEN rest * sd * (last - sd * 0.5::DOUBLE - entry) ELSE 0 END END AS net FROM play WHERE i = 6)"""


@query(_PLAYED + """ SELECT event_type, opens_at, policy, CASE WHEN sd > 0 THEN 'BUY' ELSE 'SELL' END AS direction, score::INT AS score, grade, round(risk / atr, 6) AS risk_atr, final AS status, coalesce(leaves, 6) AS exit_bar, round(net, 6) + 0 AS net_points, round(net / risk, 6) + 0 AS r_multiple
    FROM fin WHERE final NOT IN ('NOT_TRIGGERED', 'MISSED_GAP_BEYOND_ENTRY_ZONE')""")
def live_plan_candidates(spark, d):
    """Plans that fired at an hourly bar, seen with contexts of two and four hours, over the next six bars: a row for each of three policies."""
    out, _ = _live(spark, d)
    out = out.select(*BY, "opens_at", "policy", F.when(F.col("side") > 0, F.lit("BUY")).otherwise(F.lit("SELL")).alias("direction"), "score", "grade", "risk_atr", "status", "exit_bar", "net_points", "r_multiple")
    return rounded(out, ["risk_atr", "net_points", "r_multiple"])


@query(_PLAYED + """, cd AS (SELECT 'SETUP_' || setup AS code FROM st WHERE setup NOT IN ('BUY_TRIGGER', 'SELL_TRIGGER') UNION ALL SELECT 'INCOMPLETE_MINUTE_WINDOW' FROM q0 WHERE k < 6 UNION ALL SELECT final FROM fin WHERE policy = 'FULL_TARGET1' AND final IN ('NOT_TRIGGERED', 'MISSED_GAP_BEYOND_ENTRY_ZONE'))
    SELECT code, count(*) AS n FROM cd GROUP BY 1""")
def live_plan_exclusions(spark, d):
    """Why bars are no candidates."""
    _, excluded = _live(spark, d)
    return excluded.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _named(spark, d, hours: int):
    bars = frame(spark, d, hours)
    hour = (F.unix_seconds(F.col("opens_at").cast("timestamp")) / 3600).cast("long").cast("string")
    return bars.withColumn("candle_id", F.concat_ws("|", "event_type", F.lit(f"{hours}h"), hour, F.col("revision").cast("string")))


def _named_sql(hours: int) -> str:
    return f"(SELECT *, event_type || '|{hours}h|' || (epoch(opens_at) / 3600)::BIGINT || '|' || revision AS candle_id FROM {_frame_sql(hours)})"


def _listed(hours: int, most: int) -> str:
    return f"(SELECT event_type, closes_at, candle_id, list(candle_id) OVER (PARTITION BY event_type ORDER BY closes_at ROWS {most - 1} PRECEDING) AS ids FROM {_named_sql(hours)})"


@query(f"""WITH {BARS}, p AS {_listed(1, 120)}, a AS {_listed(4, 64)}, b AS {_listed(24, 64)}, x AS (SELECT p.*, a.candle_id AS c4, a.ids AS i4 FROM p ASOF LEFT JOIN a ON p.event_type = a.event_type AND p.closes_at >= a.closes_at),
    y AS (SELECT x.*, b.candle_id AS c24, b.ids AS i24, list_concat(x.ids, coalesce(x.i4, []), coalesce(b.ids, [])) AS inputs, CASE WHEN hour(x.closes_at) = 5 THEN 'STALE' ELSE 'LIVE' END AS status, CASE WHEN hour(x.closes_at) = 7 THEN 'REPLAY' ELSE 'LIVE' END AS mode FROM x ASOF LEFT JOIN b ON x.event_type = b.event_type AND x.closes_at >= b.closes_at),
    z AS (SELECT *, list_filter([CASE WHEN mode <> 'LIVE' THEN 'REPLAY_MODE' END, CASE WHEN status <> 'LIVE' THEN 'DATA_STATUS_' || status END, CASE WHEN c4 IS NULL THEN 'FINALIZED_4H_CONTEXT_UNAVAILABLE' END, CASE WHEN c24 IS NULL THEN 'FINALIZED_24H_CONTEXT_UNAVAILABLE' END], lambda v: v IS NOT NULL) AS blocked FROM y)
    SELECT event_type, candle_id, closes_at AS decision_time, c4 AS context_4h, c24 AS context_24h, len(ids)::INT AS n_recent, len(inputs)::INT AS n_inputs, sha256(array_to_string(inputs, '|')) AS checksum, array_to_string(blocked, '|') AS blockers, len(blocked) = 0 AS eligible FROM z""")
def market_snapshots(spark, d):
    """A snapshot at the end of every hourly bar, with contexts of four hours and a day."""
    primary, hour = _named(spark, d, 1), F.hour("closes_at")
    rows = primary.select("event_type", "candle_id", "closes_at", F.col("closes_at").alias("source_watermark"), F.when(hour == 7, F.lit("REPLAY")).otherwise(F.lit("LIVE")).alias("data_mode"), F.when(hour == 5, F.lit("STALE")).otherwise(F.lit("LIVE")).alias("data_status"))
    out = snapshots.build(rows, primary, {"4h": _named(spark, d, 4), "24h": _named(spark, d, 24)}, BY)
    return out.select(
        *BY, "candle_id", "decision_time", F.col("4h_id").alias("context_4h"), F.col("24h_id").alias("context_24h"), F.size("recent_ids").alias("n_recent"), F.size("model_input_ids").alias("n_inputs"),
        "checksum", F.concat_ws("|", "blockers").alias("blockers"), "eligible",
    )


def _read_again(rows):
    """Every event as a minute that four polls read: some come corrected, some of these in their old version again."""
    poll = rows.withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    version = F.when((F.col("k") >= 2) & (F.col("event_id") % 7 == 0) & ~((F.col("k") == 3) & (F.col("event_id") % 14 == 0)), F.lit("b")).otherwise(F.lit("a"))
    arrived = F.col("ts") + F.make_dt_interval(mins=F.col("k") * 5)
    return poll.select("event_type", "event_id", F.col("ts").alias("opens_at"), arrived.alias("arrived_at"), F.concat(F.col("event_id").cast("string"), version).alias("fingerprint"), "k")


@query("""WITH p AS (SELECT event_type, event_id, ts AS opens_at, unnest([0, 1, 2, 3]) AS k FROM events), v AS (SELECT *, event_id || CASE WHEN k >= 2 AND event_id % 7 = 0 AND NOT (k = 3 AND event_id % 14 = 0) THEN 'b' ELSE 'a' END AS fingerprint FROM p),
    f AS (SELECT *, row_number() OVER (PARTITION BY event_type, opens_at, fingerprint ORDER BY k) = 1 AS fresh FROM v), g AS (SELECT *, sum(fresh::INT) OVER w AS revision, max(CASE WHEN fresh THEN k END) OVER w AS newest FROM f WINDOW w AS (PARTITION BY event_type, opens_at ORDER BY k)),
    c AS (SELECT g.*, n.fingerprint AS now FROM g JOIN v n ON n.event_type = g.event_type AND n.opens_at = g.opens_at AND n.k = g.newest)
    SELECT event_id, k, CASE WHEN fresh THEN CASE WHEN revision = 1 THEN 'NEW' ELSE 'CORRECTION' END WHEN fingerprint = now THEN 'UNCHANGED' ELSE 'REJECTED' END AS action, revision::BIGINT AS revision FROM c""")
def stream_finalised_minutes(spark, d):
    """Minutes that polls read again, as a keyed stream; events without a type or a time are of no minute."""
    stream = L.finalised(_read_again(_ticks(spark, d).where("event_type is not null and ts is not null")), "event_type")
    with L.keyed_state(spark):
        return S.completed(stream.select("event_id", "k", "action", "revision"), scratch(spark, "minutes"))


@query("""WITH m AS (SELECT event_type, ts::DATE AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n_ticks FROM events WHERE hour(ts) <> 15 GROUP BY 1, 2),
    a AS (SELECT event_type, ts::DATE AS day, count(*) AS n_auction, max(ts) AS last_auction FROM events WHERE hour(ts) = 15 GROUP BY 1, 2) SELECT event_type, day::VARCHAR AS day, open, high, low, close, n_ticks, coalesce(n_auction, 0) AS n_auction, last_auction FROM m LEFT JOIN a USING (event_type, day)""")
def stream_auction_aside(spark, d):
    """Ticks of one hour never reach the bars; they are counted beside."""
    path = scratch(spark, "auction")
    stream = _ticks(spark, d).select("event_type", "event_id", "ts", "value", F.col("ts").cast("date").cast("string").alias("day"))
    L.ran(stream, L.diverted(path, F.hour("ts") == 15, {"n_auction": F.count(F.lit(1)), "last_auction": F.max("ts")}, ["event_type", "day"]), f"{path}/checkpoint")
    read = lambda name: spark.read.option("recursiveFileLookup", True).parquet(f"{path}/{name}")
    bars = candles.from_ticks(read("main"), F.col("day"), ["event_type"]).withColumnRenamed("opens_at", "day")
    aside = read("aside").groupBy("event_type", "day").agg(F.sum("n_auction").alias("n_auction"), F.max("last_auction").cast("timestamp_ntz").alias("last_auction"))
    return bars.join(aside, ["event_type", "day"], "left").fillna(0, ["n_auction"])


#: A shadow model's and policy's numbers; their files are written and read back, so their hashes are asked.
_MODEL = {
    "shadow_only": True, "approved_for_live_inference": False, "feature_names": ["f1", "f2"], "scaler_mean": [20.0, 10.0], "scaler_scale": [30.0, 6.0], "classes": ["DOWN", "NEITHER", "UP"],
    "coefficients": [[0.9, -0.7], [-0.4, -0.2], [-0.3, 0.8]], "intercepts": [0.1, -0.3, 0.0], "temperature": 1.25,
}
_POLICY = {
    "shadow_only": True, "approved_for_live_inference": False, "shadow_candidate_directions_enabled": True, "deployment_prior": {"DOWN": 0.33, "NEITHER": 0.31, "UP": 0.36},
    "thresholds": {"score_source": "RAW_MODEL_SCORE", "activation_score": 0.45, "minimum_class_margin": 0.04, "maximum_neither_score": 0.4, "minimum_prior_lift": 0.02},
}


def _logit(k: int) -> str:
    (a, b), c = _MODEL["coefficients"][k], _MODEL["intercepts"][k]
    return f"exp({c}::DOUBLE + (value - 20) / 30 * {a}::DOUBLE + ((user_id % 20) - 10) / 6 * {b}::DOUBLE)"


@query(f"""WITH e AS (SELECT event_id, value, CASE WHEN event_id % 17 = 0 THEN 'EVENT_RISK' WHEN event_id % 13 = 0 THEN 'SHADOW_REQUIRES_LIVE_DATA_MODE' WHEN event_id % 11 = 0 THEN 'SHADOW_DATA_STATUS_STALE' WHEN event_id % 19 = 0 THEN 'FEATURES_NOT_READY' WHEN event_id % 23 = 0 THEN 'SHADOW_ATR_UNAVAILABLE' ELSE 'SHADOW_PREDICTION_RECORDED' END AS reason,
      {_logit(0)} AS a, {_logit(1)} AS b, {_logit(2)} AS c FROM events), p AS (SELECT *, a / (a + b + c) AS dn, b / (a + b + c) AS ne, c / (a + b + c) AS up FROM e),
    t AS (SELECT *, greatest(dn, up) AS own, least(dn, up) AS other, pow(dn, 0.8) + pow(ne, 0.8) + pow(up, 0.8) AS whole FROM p), o AS (SELECT *, reason = 'SHADOW_PREDICTION_RECORDED' AS made, ne <= 0.4 AND own >= 0.45 AND own - greatest(other, ne) >= 0.04 AND own - CASE WHEN up >= dn THEN 0.36 ELSE 0.33 END >= 0.02 AS ok FROM t)
    SELECT event_id, reason, CASE WHEN made THEN CASE WHEN NOT ok THEN 'WAIT' WHEN up >= dn THEN 'BUY' ELSE 'SELL' END END AS direction, round(CASE WHEN made THEN up END, 9) AS p_up, round(CASE WHEN made THEN pow(up, 0.8) / whole END, 9) AS calibrated_up, round(CASE WHEN made THEN value + 3 END, 6) AS up_barrier FROM o""")
def shadow_predictions(spark, d):
    """Every event as a snapshot of a shadow model, whose numbers come from files that their hashes prove."""
    k = F.col("event_id")
    lost = F.lit(None)
    rows = table(spark, d, "events").select(
        k, k.cast("string").alias("snapshot_id"), F.lit("c").alias("checksum"), F.col("ts").alias("decision_time"), F.when(k % 13 == 0, F.lit("REPLAY")).otherwise(F.lit("LIVE")).alias("data_mode"),
        F.when(k % 11 == 0, F.lit("STALE")).otherwise(F.lit("LIVE")).alias("data_status"), F.when(k % 17 == 0, F.array(F.lit("EVENT_RISK"))).otherwise(F.array().cast("array<string>")).alias("blockers"),
        F.col("value").alias("close"), F.when(k % 23 == 0, lost).otherwise(F.lit(2.0)).alias("atr_14"), F.when(k % 19 == 0, lost).otherwise(F.col("value")).alias("f1"), (F.col("user_id") % 20).cast("double").alias("f2"),
    )
    loaded = []
    for artifact in (_MODEL, _POLICY):
        path = scratch(spark, "artifact")
        spark.createDataFrame([(json.dumps(shadow.signed(artifact)),)], "value string").coalesce(1).write.text(path)
        loaded.append(shadow.load(spark, path))
    out = shadow.predict(rows, *loaded).select("event_id", "reason", "direction", "p_up", "calibrated_up", "up_barrier")
    return rounded(rounded(out, ["p_up", "calibrated_up"], 9), ["up_barrier"])
