"""Queries over replayed policies: an active signal, and the grid of policies over one set of trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, labels, replay
from .decisions import _ATR, _path_sql, _with_atr
from .formulas import _CTX, _given, _sql
from .registry import query, rounded, table

#: Predictions of an event: most pass the thresholds, so that signals meet others that are still active.
_REPLAY = _CTX | {
    "p_neither": "(event_id % 4) / cast(10 as double)", "p_up": "(1 - (event_id % 4) / cast(10 as double)) * ((event_id * 37) % 101) / cast(100 as double)",
    "p_down": "(1 - (event_id % 4) / cast(10 as double)) * (100 - (event_id * 37) % 101) / cast(100 as double)",
}
del _REPLAY["active_side"]
_GATES = ", ".join(f"CASE WHEN NOT {c} THEN '{code}' END" for code, c in folds.HARD_GATES)


@query(f"""WITH RECURSIVE i AS (SELECT event_id, event_type, ts, {_sql(_REPLAY)} FROM events),
    g AS (SELECT *, len(list_filter([CASE WHEN data_status <> 'LIVE' THEN 'DATA_NOT_LIVE_' || data_status END, {_GATES}, CASE WHEN reference_close IS NULL THEN 'x' END, CASE WHEN NOT atr > 0 THEN 'x' END], lambda x: x IS NOT NULL)) AS n_gates,
      p_up >= p_down AS buy, greatest(p_up, p_down) AS own, least(p_up, p_down) AS other FROM i),
    m AS (SELECT *, own - greatest(other, p_neither) AS margin, own - 0.75::DOUBLE * other AS ev, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM g),
    f AS (SELECT *, CASE WHEN buy THEN 'BUY' ELSE 'SELL' END AS side, n_gates = 0 AND own >= 0.6::DOUBLE AND margin >= 0.15::DOUBLE AND p_neither <= 0.45::DOUBLE AND ev >= 0.15::DOUBLE AS free, ts + INTERVAL 12 hours AS expires_at FROM m),
    r AS (SELECT event_type, n, event_id, NULL::VARCHAR AS before, CASE WHEN free THEN side END AS act, CASE WHEN free THEN expires_at END AS until, free AS emits FROM f WHERE n = 1
      UNION ALL SELECT f.event_type, f.n, f.event_id, a.before, CASE WHEN a.emits THEN f.side ELSE a.before END, CASE WHEN a.emits THEN f.expires_at ELSE a.until END, a.emits
      FROM r JOIN f ON f.event_type = r.event_type AND f.n = r.n + 1, LATERAL (SELECT CASE WHEN f.ts < r.until THEN r.act END AS before, CASE WHEN f.ts < r.until THEN r.until END AS until, f.free AND (r.act IS NULL OR f.ts >= r.until OR r.act = f.side) AS emits) a)
    SELECT event_id, r.before AS active_side, CASE WHEN emits THEN side ELSE 'WAIT' END AS decision, expires_at, n_gates = 0 AND before IS NOT NULL AND before <> side AND (own < 0.72::DOUBLE OR margin < 0.25::DOUBLE) AS weak_reversal,
      n_gates = 0 AND before IS NOT NULL AND before <> side AS conflict, round(CASE WHEN emits THEN reference_close - CASE WHEN buy THEN 1 ELSE -1 END * 3.0 END, 6) AS stop FROM r JOIN f USING (event_type, n, event_id)""")
def policy_replay(spark, d):
    """Every event a prediction of its type's series; a signal stays active for twelve hourly bars."""
    rows = _given(table(spark, d, "events"), _REPLAY, ["event_id", "event_type", "ts"]).withColumn("gates", folds.hard_gates())
    out = replay.policy_replay(rows, ["event_type"], "ts", "event_id", bar_minutes=60)
    has = lambda code: F.array_contains("blockers", code)
    weak, conflict = has("HYSTERESIS_REVERSAL_THRESHOLD_NOT_MET"), has("CONFLICTING_ACTIVE_SIGNAL_MUST_INVALIDATE_FIRST")
    return rounded(out.select("event_id", "active_side", "decision", "expires_at", weak.alias("weak_reversal"), conflict.alias("conflict"), "stop"), ["stop"])


#: A bar's raw scores by its hour; the calibrated ones are drawn to a third.
_U, _N = "((h * 37) % 101) / cast(100 as double)", "((h * 13) % 6) / cast(10 as double)"
_SHRUNK = "0.8 * {} + 0.2 / 3"


def _scores(rows):
    h = (F.unix_seconds(F.col("opens_at").cast("timestamp")) / 3600).cast("long")
    rows = rows.withColumn("h", h).withColumn("u", F.expr(_U)).withColumn("neither", F.expr(_N))
    raw = {"down": (1 - F.col("neither")) * (1 - F.col("u")), "neither": F.col("neither"), "up": (1 - F.col("neither")) * F.col("u")}
    one = lambda f: F.struct(*[f(c).alias(n) for n, c in raw.items()])
    scores = F.create_map(F.lit("RAW_MODEL_SCORE"), one(lambda c: c), F.lit("CALIBRATED_PROBABILITY"), one(lambda c: F.lit(0.8) * c + F.lit(0.2 / 3)))
    return rows.withColumn("scores", scores).withColumn("prior", F.struct(F.lit(0.33).alias("down"), F.lit(0.36).alias("up")))


def samples(spark, d):
    """Hourly bars as samples of the grid: a decision at the bar's end, its scores, and both directions' paths of twelve bars."""
    bars = _with_atr(spark, d).select("event_type", "opens_at", "atr", "open", "high", "low", "close")
    bars = bars.withColumn("at", F.col("opens_at") + F.expr("interval 1 hour"))
    out = _scores(bars.select("event_type", "opens_at", "at", "atr"))
    for side, name in ((1, "BUY"), (-1, "SELL")):
        path = labels.trade_path(bars, ["event_type"], "opens_at", "atr", side, slippage=0.5)
        leaves = F.col("at") + F.make_dt_interval(hours=F.col("exit_bar"))
        numbers = [F.round("net_points", 9).alias("net_points"), F.round(F.col("net_points") / (0.75 * F.col("atr")), 9).alias("r_multiple")]
        path = path.select("event_type", "opens_at", F.struct(leaves.alias("exit_at"), "exit_reason", *numbers).alias(name))
        out = out.join(path, ["event_type", "opens_at"], "left")
    paths = F.create_map(F.lit("BUY"), F.col("BUY"), F.lit("SELL"), F.col("SELL"))
    return out.withColumn("paths", F.when(F.col("atr") > 0, paths)).drop("BUY", "SELL", "h", "u", "neither")


def _values(name: str) -> str:
    values = ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in replay.GRID[name])
    return f"(SELECT unnest([{values}]) AS {name}, generate_subscripts([{values}], 1) - 1 AS _{name})"


_PLACE = "0"
for _name, _own in replay.GRID.items():
    _PLACE = f"({_PLACE} * {len(_own)} + _{_name})"
_GRID = f"""{_ATR}, l AS ({_path_sql(1)}), sh AS ({_path_sql(-1)}), b0 AS (SELECT event_type, opens_at, atr, opens_at + INTERVAL 1 hour AS t, (epoch(opens_at) / 3600)::BIGINT AS h FROM a),
    b1 AS (SELECT *, {_U} AS u, {_N} AS neither, row_number() OVER (PARTITION BY event_type ORDER BY t) - 1 AS place FROM b0), b2 AS (SELECT *, (1 - neither) * (1 - u) AS down, (1 - neither) * u AS up FROM b1),
    pol AS (SELECT {_PLACE} AS policy, source, activation, margin, neither AS most, lift FROM {" CROSS JOIN ".join(_values(n) for n in replay.GRID)}),
    sc AS (SELECT event_type, opens_at, atr, t, place, 'RAW_MODEL_SCORE' AS source, down, neither, up FROM b2
      UNION ALL SELECT event_type, opens_at, atr, t, place, 'CALIBRATED_PROBABILITY', 0.8::DOUBLE * down + (0.2::DOUBLE / 3), 0.8::DOUBLE * neither + (0.2::DOUBLE / 3), 0.8::DOUBLE * up + (0.2::DOUBLE / 3) FROM b2),
    di AS (SELECT *, up >= down AS buy, greatest(up, down) AS own, least(up, down) AS other FROM sc),
    offered AS (SELECT policy, di.* FROM di JOIN pol ON pol.source = di.source AND own >= activation AND own - greatest(other, neither) >= margin AND neither <= most AND own - CASE WHEN buy THEN 0.36::DOUBLE ELSE 0.33::DOUBLE END >= lift),
    paths AS (SELECT o.policy, o.event_type, o.t, o.place, o.buy, CASE WHEN buy THEN l.exit_reason ELSE sh.exit_reason END AS reason, CASE WHEN buy THEN l.exit_bar ELSE sh.exit_bar END AS k, CASE WHEN buy THEN l.net_points ELSE sh.net_points END AS points, o.atr
      FROM offered o LEFT JOIN l USING (event_type, opens_at) LEFT JOIN sh USING (event_type, opens_at)),
    pl AS (SELECT *, t + to_hours(k::INT) AS leaves, round(points / (0.75::DOUBLE * atr), 9) AS r, row_number() OVER (PARTITION BY policy, event_type ORDER BY t) AS n FROM paths WHERE atr > 0 AND reason IS NOT NULL),
    rec2 AS (SELECT policy, event_type, n, t, place, leaves AS until, true AS taken FROM pl WHERE n = 1 UNION ALL SELECT p.policy, p.event_type, p.n, p.t, p.place, CASE WHEN p.t >= x.until THEN p.leaves ELSE x.until END, p.t >= x.until
      FROM rec2 x JOIN pl p ON p.policy = x.policy AND p.event_type = x.event_type AND p.n = x.n + 1),
    tr AS (SELECT pl.* FROM pl JOIN rec2 USING (policy, event_type, n) WHERE taken), act AS (SELECT tr.policy, count(*) AS n_active FROM tr JOIN b1 ON b1.event_type = tr.event_type AND b1.t > tr.t AND b1.t < tr.leaves GROUP BY 1),
    lost AS (SELECT p.policy, count(*) FILTER (coalesce(p.atr, 0) <= 0) AS n_no_input, count(*) FILTER (p.atr > 0) AS n_no_path FROM paths p WHERE (p.reason IS NULL OR coalesce(p.atr, 0) <= 0) AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.policy = p.policy AND tr.event_type = p.event_type AND tr.t < p.t AND p.t < tr.leaves) GROUP BY 1),
    cum AS (SELECT *, sum(r) OVER (PARTITION BY policy ORDER BY t, event_type) AS c FROM tr), dd AS (SELECT policy, max(peak - c) AS max_drawdown FROM (SELECT policy, c, greatest(0, max(c) OVER (PARTITION BY policy ORDER BY t, event_type)) AS peak FROM cum) GROUP BY 1),
    agg AS (SELECT policy, count(*) AS n_trades, count(*) FILTER (buy) AS n_buy, count(*) FILTER (NOT buy) AS n_sell, count(*) FILTER (reason = 'TARGET') AS n_target, count(*) FILTER (reason = 'STOP') AS n_stop, count(*) FILTER (reason = 'HORIZON') AS n_horizon,
      avg((points > 0)::INT) AS win_rate, sum(points) AS net_points, avg(r) AS mean_r, CASE WHEN count(*) > 1 THEN avg(r) - 1.96 * stddev_samp(r) / sqrt(count(*)) END AS mean_r_lower, sum(points) FILTER (points > 0) / -sum(points) FILTER (points < 0) AS profit_factor FROM tr GROUP BY 1),
    met AS (SELECT pol.policy, pol.source, pol.activation, pol.margin, most AS neither, pol.lift, coalesce(n_trades, 0) AS n_trades, coalesce(n_buy, 0) AS n_buy, coalesce(n_sell, 0) AS n_sell, coalesce(n_target, 0) AS n_target, coalesce(n_stop, 0) AS n_stop, coalesce(n_horizon, 0) AS n_horizon,
      round(win_rate, 6) AS win_rate, round(coalesce(net_points, 0), 9) + 0 AS net_points, round(mean_r, 6) + 0 AS mean_r, round(mean_r_lower, 6) + 0 AS mean_r_lower, round(profit_factor, 6) AS profit_factor, round(coalesce(max_drawdown, 0), 6) + 0 AS max_drawdown,
      coalesce(n_active, 0)::BIGINT AS n_active, coalesce(n_no_input, 0) AS n_no_input, coalesce(n_no_path, 0) AS n_no_path FROM pol LEFT JOIN agg USING (policy) LEFT JOIN act USING (policy) LEFT JOIN lost USING (policy) LEFT JOIN dd USING (policy))"""


@query(_GRID + """ SELECT *, (SELECT count(*) FROM b1) - n_trades - n_active - n_no_input - n_no_path AS n_wait, concat_ws('|', CASE WHEN n_trades < 30 THEN 'SELECTION_TRADE_COUNT_TOO_LOW' END, CASE WHEN n_buy < 5 THEN 'SELECTION_BUY_SUPPORT_TOO_LOW' END,
      CASE WHEN n_sell < 5 THEN 'SELECTION_SELL_SUPPORT_TOO_LOW' END, CASE WHEN mean_r > 0 THEN NULL ELSE 'SELECTION_AVERAGE_R_NOT_POSITIVE' END, CASE WHEN profit_factor > 1 THEN NULL ELSE 'SELECTION_PROFIT_FACTOR_NOT_ABOVE_ONE' END,
      CASE WHEN mean_r_lower > -0.1 THEN NULL ELSE 'SELECTION_DOWNSIDE_CONFIDENCE_GATE_FAILED' END) AS blockers FROM met""")
def policy_grid(spark, d):
    """All 432 policies over hourly bars in one plan: trades, waits, metrics and blockers."""
    _, out = replay.replay_grid(samples(spark, d), ["event_type"], "at", "opens_at")
    out = rounded(rounded(out, ["win_rate", "mean_r", "mean_r_lower", "profit_factor", "max_drawdown"]), ["net_points"], 9)
    return out.withColumn("blockers", F.concat_ws("|", replay.policy_blockers("SELECTION"))).drop("n_decisions", "coverage")
