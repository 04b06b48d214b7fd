"""Queries of feature formulas, gates, samples and imports over rows whose inputs plain expressions give, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import calibration, datasets, features, folds, tracking
from ..sources import readers
from .registry import BARS, hourly, query, rounded, table


def _given(rows, columns: dict[str, str], keep: list[str]):
    """``rows`` with columns by SQL expressions that DuckDB reads alike."""
    return rows.select(*keep, *[F.expr(e).alias(n) for n, e in columns.items()])


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in columns.items())


LINE = ["l_orderkey", "l_linenumber"]
_FRAME = {
    "ema_20": "l_extendedprice / 997 + {f}", "ema_50": "l_quantity + {f}", "atr_14": "l_tax * 10", "trend_ema20_above_ema50": "l_extendedprice / 997 > l_quantity + {f}", "roc_5": "l_discount - 0.05",
    "breakout_up_20": "l_linenumber = {f} + 1", "breakout_down_20": "l_linenumber = {f} + 4", "rsi_14": "l_quantity * 2 - {f}", "atr_pct": "l_tax * ({f} + 1)", "rolling_vol_20": "l_discount * ({f} + 1)",
    "range_atr": "l_quantity / (10 * {f} + 5)", "distance_ema20_atr": "l_discount - 0.04 - 0.01 * {f}",
}
_FRAMES = {f"{frame}__{n}": e.format(f=k) for k, frame in enumerate(features.FRAMES) for n, e in _FRAME.items()} | {
    "primary_5m__minute_of_session": "l_linenumber * 50 - 60", "primary_5m__minutes_to_session_close": "300 - l_linenumber * 50", "primary_5m__lower_wick_pct": "l_tax",
    "primary_5m__upper_wick_pct": "l_discount", "primary_5m__body_pct": "l_discount - 0.03", "primary_5m__return_1": "l_tax - 0.04",
}


def _enhanced_sql() -> str:
    p, q, r = features.FRAMES
    c = lambda frame, n: f'i."{frame}__{n}"::DOUBLE'
    safe = lambda a, b: f"CASE WHEN abs({b}) > 1e-12 THEN ({a}) / ({b}) ELSE 0 END"
    clipped = lambda n, a, b: f"greatest(0, least(10, {safe(c(a, n), c(b, n))}))"
    mean = lambda xs: f"(({') + ('.join(xs)})) / {len(xs)}"
    strength = {x: safe(f"{c(x, 'ema_20')} - {c(x, 'ema_50')}", c(x, "atr_14")) for x in (p, q, r)}
    align = mean([f"CASE WHEN {c(x, 'trend_ema20_above_ema50')} >= 0.5 THEN 1 ELSE -1 END" for x in (p, q, r)])
    moved = mean([f"sign({c(x, 'roc_5')})" for x in (p, q, r)])
    minute, left = f"greatest(0, {c(p, 'minute_of_session')})", f"greatest(0, {c(p, 'minutes_to_session_close')})"
    progress = f"CASE WHEN {minute} + {left} > 0 THEN {minute} / ({minute} + {left}) ELSE 0 END"
    out = {
        "trend_strength_5m": strength[p], "trend_strength_15m": strength[q], "trend_strength_1h": strength[r], "trend_alignment": align, "momentum_alignment": moved,
        "breakout_vote": mean([f"{c(x, 'breakout_up_20')} - {c(x, 'breakout_down_20')}" for x in (p, q, r)]),
        **{f"rsi_centered_{n}": f"({c(x, 'rsi_14')} - 50) / 50" for n, x in zip(("5m", "15m", "1h"), (p, q, r))}, "rsi_5m_minus_1h": f"({c(p, 'rsi_14')} - {c(r, 'rsi_14')}) / 100",
        "atr_pct_5m_to_15m": clipped("atr_pct", p, q), "atr_pct_15m_to_1h": clipped("atr_pct", q, r), "volatility_5m_to_15m": clipped("rolling_vol_20", p, q),
        "range_expansion_5m_vs_15m": clipped("range_atr", p, q), "ema_distance_concordance": mean([f"sign({c(x, 'distance_ema20_atr')})" for x in (p, q, r)]),
        "wick_imbalance_5m": f"{c(p, 'lower_wick_pct')} - {c(p, 'upper_wick_pct')}", "body_momentum_concordance_5m": mean([f"sign({c(p, x)})" for x in ("body_pct", "return_1", "roc_5")]),
        "session_progress": progress, "session_progress_sin": f"sin(pi() * ({progress}))", "session_progress_cos": f"cos(pi() * ({progress}))",
        "trend_momentum_interaction": f"({align}) * ({moved})", "volatility_trend_interaction": f"{c(p, 'atr_pct')} * ({strength[p]})",
    }
    return f"WITH i AS (SELECT l_orderkey, l_linenumber, {_sql(_FRAMES)} FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({e}, 6) + 0 AS enhanced__{n}" for n, e in out.items()) + " FROM i"


@query(_enhanced_sql())
def enhanced_features(spark, d):
    """The 22 combinations of three frames, over lineitem's numbers as base features."""
    out = features.enhanced(_given(table(spark, d, "lineitem"), _FRAMES, LINE))
    names = [c for c in out.columns if c.startswith("enhanced__")]
    return rounded(out, names).select(*LINE, *names)


_CROSS = {
    "bank__context_return_1": "l_discount - 0.03", "bank__context_return_3": "l_discount * 2 - 0.1", "bank__context_ema_8_21_atr": "l_tax - 0.04", "vix__context_return_1": "l_tax - 0.02",
    "vix__context_return_z48": "l_quantity / 10 - 2", "main__context_return_1": "l_tax - 0.05", "main__context_return_3": "l_discount - l_tax", "main__context_trend": "sign(l_linenumber - 3)",
}


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber, {_sql(_CROSS)} FROM lineitem) SELECT l_orderkey, l_linenumber, round(bank__context_return_1 - main__context_return_1, 6) + 0 AS cross__bank_minus_main_return_1,
    round(bank__context_return_3 - main__context_return_3, 6) + 0 AS cross__bank_minus_main_return_3, round(CASE WHEN abs(bank__context_ema_8_21_atr) > 1e-12 THEN sign(bank__context_ema_8_21_atr) ELSE 0 END * main__context_trend, 6) + 0 AS cross__bank_main_trend_agreement,
    round(vix__context_return_1 * main__context_return_1, 6) + 0 AS cross__vix_return_times_main_return, round(abs(vix__context_return_z48), 6) + 0 AS cross__vix_shock_abs, round(-vix__context_return_z48 - main__context_trend, 6) + 0 AS cross__risk_off_score FROM i""")
def cross_features(spark, d):
    out = features.cross(_given(table(spark, d, "lineitem"), _CROSS, LINE), "bank", "vix", "main")
    names = [c for c in out.columns if c.startswith("cross__")]
    return rounded(out, names).select(*LINE, *names)


_SNAP = {
    "futures_symbol": "event_type", "session_date": "cast(ts as date)", "regular": "hour(ts) between 8 and 17", "spot_ltp": "value - 5", "futures_ltp": "value", "futures_basis_bps": "value / 7",
    "futures_book_imbalance": "value / 300 - 0.2", "futures_volume": "value * 3", "futures_open_interest": "value - 10", "provider_put_call_ratio": "case when event_id % 11 <> 0 then value / 90 end",
    "atm_implied_volatility": "value / 500", "delta25_put_call_iv_skew": "value / 900", "option_volume_put_call_ratio": "value / 80",
}
_DERIV = f"""i AS (SELECT event_id, user_id, ts, {_sql(_SNAP)} FROM events), w AS (SELECT *, lag(ts) OVER v AS pts, lag(futures_symbol) OVER v AS pfs, lag(session_date) OVER v AS psd, {", ".join(f"lag({c}) OVER v AS p_{c}" for c in list(_SNAP)[3:])} FROM i WINDOW v AS (PARTITION BY user_id ORDER BY ts)),
    c AS (SELECT *, coalesce(psd = session_date AND pfs = futures_symbol AND epoch_us(ts) > epoch_us(pts) AND epoch_us(ts) - epoch_us(pts) <= 10 * 3600000000, false) AS comparable FROM w),
    f AS (SELECT event_id, session_date, regular, comparable, {", ".join(f"CASE WHEN comparable AND p_{x} > 0 THEN {x} / p_{x} - 1 END AS {n}" for x, n in (("spot_ltp", "spot_return_1"), ("futures_ltp", "futures_return_1"), ("futures_open_interest", "open_interest_change_pct")))},
      {", ".join(f"{x} AS {n}, CASE WHEN comparable THEN {x} - p_{x} END AS {m}" for x, n, m in (("futures_basis_bps", "basis_bps", "basis_change_bps"), ("futures_book_imbalance", "book_imbalance", "book_imbalance_change"), ("provider_put_call_ratio", "provider_pcr", "provider_pcr_change"), ("atm_implied_volatility", "atm_iv", "atm_iv_change"), ("delta25_put_call_iv_skew", "delta25_iv_skew", "delta25_iv_skew_change")))},
      CASE WHEN comparable THEN ln(1 + greatest(futures_volume - p_futures_volume, 0)) END AS volume_delta_log1p, option_volume_put_call_ratio AS option_volume_pcr FROM c),
    g AS (SELECT *, regular AND comparable AND {" AND ".join(f"{n} IS NOT NULL" for n in features.DERIVATIVES[:8])} AS complete_core, regular AND {" AND ".join(f"{n} IS NOT NULL" for n in features.DERIVATIVES[8:])} AS options_complete FROM f)"""


def _derivatives(spark, d):
    rows = _given(table(spark, d, "events"), _SNAP, ["event_id", "user_id", "ts"])
    return features.derivatives(rows, ["user_id"], "ts", minutes=600)


@query(f"WITH {_DERIV} SELECT event_id, comparable, complete_core, options_complete, " + ", ".join(f"round({n}, 6) + 0 AS derivatives__{n}" for n in features.DERIVATIVES) + " FROM g")
def derivatives_features(spark, d):
    """Snapshots of a user's day; the event type is the contract."""
    names = [f"derivatives__{n}" for n in features.DERIVATIVES]
    return rounded(_derivatives(spark, d), names).select("event_id", "comparable", "complete_core", "options_complete", *names)


@query(f"""WITH {_DERIV}, a AS (SELECT count(*) AS n, count(*) FILTER (regular) AS n_regular, count(*) FILTER (complete_core) AS n_complete, count(DISTINCT session_date) FILTER (complete_core) AS n_sessions,
    coalesce(date_diff('day', min(session_date) FILTER (complete_core), max(session_date) FILTER (complete_core)) + 1, 0) AS span_days, round(count(*) FILTER (options_complete) / count(*) FILTER (regular)::DOUBLE, 6) AS options_share FROM g)
    SELECT n, n_regular, n_complete, n_sessions, span_days::INT AS span_days, options_share, concat_ws('|', CASE WHEN n_complete < 3000 THEN 'DERIVATIVES_COMPLETE_ROW_SUPPORT_TOO_LOW' END, CASE WHEN n_sessions < 60 THEN 'DERIVATIVES_SESSION_SUPPORT_TOO_LOW' END,
    CASE WHEN span_days < 90 THEN 'DERIVATIVES_CALENDAR_SPAN_TOO_SHORT' END, CASE WHEN options_share < 0.8 THEN 'OPTIONS_CONTEXT_COMPLETENESS_TOO_LOW' END) AS blockers FROM a""")
def derivatives_readiness(spark, d):
    return rounded(readers.readiness(_derivatives(spark, d)), ["options_share"]).withColumn("blockers", F.concat_ws("|", "blockers"))


#: A signal's inputs from an event's numbers: probabilities, gates, an active side.
_CTX = {
    "p_down": "(1 + event_id % 7) / (3.0 + event_id % 7 + event_id % 5 + event_id % 11)", "p_neither": "(1 + event_id % 5) / (3.0 + event_id % 7 + event_id % 5 + event_id % 11)", "p_up": "(1 + event_id % 11) / (3.0 + event_id % 7 + event_id % 5 + event_id % 11)",
    "data_status": "case when event_id % 13 = 0 then 'STALE' else 'LIVE' end", **{c: f"event_id % {k} <> 0" for k, (_, c) in zip((17, 19, 23, 29, 31, 37, 41, 43), folds.HARD_GATES)},
    "reference_close": "case when event_id % 47 <> 0 then value end", "atr": "case when event_id % 53 <> 0 then 4.0 else 0.0 end", "active_side": "case event_id % 3 when 0 then 'BUY' when 1 then 'SELL' end",
}
_GATES = f"""i AS (SELECT event_id, {_sql(_CTX)} FROM events), g AS (SELECT *, list_filter([CASE WHEN data_status <> 'LIVE' THEN 'DATA_NOT_LIVE_' || data_status END, {", ".join(f"CASE WHEN NOT {c} THEN '{code}' END" for code, c in folds.HARD_GATES)},
    CASE WHEN reference_close IS NULL THEN 'REFERENCE_PRICE_UNAVAILABLE' END, CASE WHEN NOT atr > 0 THEN 'ATR_UNAVAILABLE' END], lambda x: x IS NOT NULL) AS gates FROM i)"""


def _context(spark, d):
    return _given(table(spark, d, "events"), _CTX, ["event_id"]).withColumn("gates", folds.hard_gates())


@query(f"WITH {_GATES} SELECT event_id, array_to_string(gates, '|') AS gates FROM g")
def hard_gates(spark, d):
    return _context(spark, d).select("event_id", F.concat_ws("|", "gates").alias("gates"))


_SIGNALS = f"""{_GATES}, s AS (SELECT *, p_up >= p_down AS buy, greatest(p_up, p_down) AS own, least(p_up, p_down) AS other FROM g), m AS (SELECT *, own - greatest(other, p_neither) AS margin, own - 0.75 * other AS ev, active_side IS NOT NULL AND active_side <> CASE WHEN buy THEN 'BUY' ELSE 'SELL' END AS turned FROM s),
    b AS (SELECT *, CASE WHEN len(gates) > 0 THEN gates ELSE list_filter([CASE WHEN own < 0.6 THEN 'PROBABILITY_THRESHOLD_NOT_MET' END, CASE WHEN margin < 0.15 THEN 'CLASS_MARGIN_THRESHOLD_NOT_MET' END, CASE WHEN p_neither > 0.45 THEN 'NEITHER_PROBABILITY_TOO_HIGH' END,
      CASE WHEN ev < 0.15 THEN 'EXPECTED_VALUE_GATE_FAILED' END, CASE WHEN turned AND (own < 0.72 OR margin < 0.25) THEN 'HYSTERESIS_REVERSAL_THRESHOLD_NOT_MET' END, CASE WHEN turned THEN 'CONFLICTING_ACTIVE_SIGNAL_MUST_INVALIDATE_FIRST' END], lambda x: x IS NOT NULL) END AS blockers FROM m)"""


@query(f"""WITH {_SIGNALS} SELECT event_id, CASE WHEN len(blockers) > 0 THEN 'WAIT' WHEN buy THEN 'BUY' ELSE 'SELL' END AS decision, array_to_string(blockers, '|') AS blockers, round(CASE WHEN len(blockers) = 0 THEN ev END, 6) AS expected_atr,
    round(CASE WHEN len(blockers) = 0 THEN reference_close - CASE WHEN buy THEN 1 ELSE -1 END * 3.0 END, 6) AS stop, round(CASE WHEN len(blockers) = 0 THEN reference_close + CASE WHEN buy THEN 1 ELSE -1 END * 4.0 END, 6) AS target_1 FROM b""")
def signal_policy(spark, d):
    out = folds.signal(_context(spark, d))
    return rounded(out.select("event_id", "decision", F.concat_ws("|", "blockers").alias("blockers"), "expected_atr", "stop", "target_1"), ["expected_atr", "stop", "target_1"])


@query(f"WITH {_SIGNALS} SELECT reason, count(*) AS n FROM (SELECT unnest(blockers) AS reason FROM b) GROUP BY 1")
def wait_counts(spark, d):
    return folds.signal(_context(spark, d)).select(F.explode("blockers").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_REL = {
    "market_data_mode": "case when o_orderkey % 5 = 0 then 'demo' else 'live' end", "provider": "case when o_orderkey % 7 <> 0 then 'feed' end", "data_status": "case when o_orderkey % 3 = 0 then 'STALE' else 'LIVE' end",
    "analysis_snapshot": "o_orderkey % 4", "chart_snapshot": "o_orderkey % 8", "analysis_checksum": "'a'", "chart_checksum": "case when o_orderkey % 9 = 0 then 'b' else 'a' end", "release_id": "case when o_orderkey % 6 <> 0 then o_orderkey end",
    "model_sha256": "case when o_orderkey % 11 <> 0 then 'm' end", "manifest_model_sha256": "'m'", "calibration_sha256": "'c'", "manifest_calibration_sha256": "case when o_orderkey % 10 = 0 then 'd' else 'c' end", "feature_set": "'f1'",
    "manifest_feature_set": "case when o_orderkey % 13 = 0 then 'f0' else 'f1' end", "label_set": "'l'", "manifest_label_set": "case when o_orderkey % 14 = 0 then 'k' else 'l' end", "policy_version": "2", "manifest_policy_version": "case when o_orderkey % 15 = 0 then 1 else 2 end",
    "calibration_ece": "(o_orderkey % 16) / 250.0", "positive_brier_skill": "o_orderkey % 17 <> 0", "analysis_versions": "case when o_orderkey % 2 = 0 then 'v' end", "manifest_versions": "case when o_orderkey % 18 = 0 then 'w' else 'v' end",
    "drift_passed": "case when o_orderkey % 19 = 0 then null else o_orderkey % 20 <> 0 end", "kill_switch": "o_orderkey % 21 = 0",
}


@query(f"""WITH i AS (SELECT o_orderkey, {_sql(_REL)} FROM orders), b AS (SELECT o_orderkey, list_filter([CASE WHEN market_data_mode <> 'live' OR provider IS NULL THEN 'LICENSED_LIVE_PROVIDER_NOT_CONFIGURED' END, CASE WHEN data_status <> 'LIVE' THEN 'CANONICAL_MARKET_DATA_NOT_LIVE' END,
    CASE WHEN analysis_snapshot <> chart_snapshot OR analysis_checksum <> chart_checksum THEN 'CHART_MODEL_SNAPSHOT_NOT_SYNCHRONIZED' END, CASE WHEN release_id IS NULL THEN 'APPROVED_RELEASE_MANIFEST_MISSING' END,
    CASE WHEN release_id IS NOT NULL AND model_sha256 IS DISTINCT FROM manifest_model_sha256 THEN 'MODEL_ARTIFACT_MISSING_OR_HASH_MISMATCH' END, CASE WHEN release_id IS NOT NULL AND calibration_sha256 <> manifest_calibration_sha256 THEN 'CALIBRATION_ARTIFACT_MISSING_OR_HASH_MISMATCH' END,
    CASE WHEN release_id IS NOT NULL AND feature_set <> manifest_feature_set THEN 'FEATURE_ARTIFACT_INCOMPATIBLE' END, CASE WHEN release_id IS NOT NULL AND label_set <> manifest_label_set THEN 'LABEL_ARTIFACT_INCOMPATIBLE' END,
    CASE WHEN release_id IS NOT NULL AND policy_version <> manifest_policy_version THEN 'SIGNAL_POLICY_ARTIFACT_INCOMPATIBLE' END, CASE WHEN release_id IS NOT NULL AND (calibration_ece > 0.05 OR NOT positive_brier_skill) THEN 'CALIBRATION_RELEASE_GATE_FAILED' END,
    CASE WHEN release_id IS NOT NULL AND analysis_versions <> manifest_versions THEN 'LIVE_ANALYSIS_ARTIFACT_MISMATCH' END, CASE WHEN drift_passed IS NULL THEN 'DRIFT_REFERENCE_EVIDENCE_MISSING' END, CASE WHEN NOT drift_passed THEN 'DRIFT_THRESHOLD_BREACHED' END,
    CASE WHEN kill_switch THEN 'LIVE_SIGNAL_KILL_SWITCH_ACTIVE' END], lambda x: x IS NOT NULL) AS b FROM i) SELECT o_orderkey, array_to_string(b, '|') AS blockers, len(b) = 0 AS released FROM b""")
def release_gate(spark, d):
    """The gate's fourteen codes over every order as a release."""
    out = tracking.release_gate(_given(table(spark, d, "orders"), _REL, ["o_orderkey"]))
    return out.select("o_orderkey", F.concat_ws("|", "blockers").alias("blockers"), "released")


_BAR = {"bar_id": "l_orderkey * 10 + l_linenumber - case when l_linenumber = 5 then 1 else 0 end", "series": "l_orderkey", "arrival": "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey", "revision": "case when l_partkey % 50 = 0 then 7 else l_linenumber end", "supersedes": "case when l_suppkey % 40 = 0 then null when l_linenumber > 1 then l_orderkey * 10 + l_linenumber - 1 end"}
_STORE = f"""i AS (SELECT {_sql(_BAR)} FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY arrival) AS k, lag(bar_id) OVER (PARTITION BY series ORDER BY arrival) AS before, row_number() OVER (PARTITION BY bar_id ORDER BY arrival) AS again FROM i),
    e AS (SELECT *, list_filter([CASE WHEN again > 1 THEN 'BAR_ALREADY_STORED' END, CASE WHEN revision <> k THEN 'UNEXPECTED_REVISION' END, CASE WHEN k > 1 AND supersedes IS DISTINCT FROM before THEN 'CORRECTION_MUST_SUPERSEDE_THE_PRIOR_REVISION' END, CASE WHEN k = 1 AND supersedes IS NOT NULL THEN 'INITIAL_BAR_CANNOT_SUPERSEDE' END], lambda x: x IS NOT NULL) AS errors FROM n)"""


def _store(spark, d):
    return datasets.store_errors(_given(table(spark, d, "lineitem"), _BAR, []), ["series"])


@query(f"WITH {_STORE} SELECT series, arrival, bar_id, array_to_string(errors, '|') AS errors FROM e")
def store_invariants(spark, d):
    """What an append-only store refuses: an order's lines as revisions of one bar."""
    return _store(spark, d).select("series", "arrival", "bar_id", F.concat_ws("|", "errors").alias("errors"))


@query(f"WITH {_STORE} SELECT series AS dataset, count(*) AS n, count(*) FILTER (len(errors) > 0) AS n_errors, CASE WHEN count(*) FILTER (len(errors) > 0) > 0 THEN 'REJECTED' ELSE 'PASS' END AS status, CASE WHEN count(*) FILTER (len(errors) > 0) > 0 THEN 0 ELSE count(*) END AS n_stored FROM e GROUP BY 1")
def import_datasets(spark, d):
    """One bad row rejects its whole dataset."""
    kept, counts = datasets.imported(_store(spark, d), "series")
    stored = kept.groupBy("series").agg(F.count(F.lit(1)).alias("n_stored"))
    return counts.join(stored, "series", "left").select(F.col("series").alias("dataset"), "n", "n_errors", "status", F.coalesce("n_stored", F.lit(0)).alias("n_stored"))


_PRIMARY = "event_id AS bar_id, ts AS decision_time, user_id, value > 20 AS ready, CASE WHEN event_id % 17 <> 0 THEN value END AS v"


def _frame(spark, d, kind: str):
    rows = table(spark, d, "events").where(F.col("event_type") == kind)
    return rows.select("user_id", F.col("ts").alias("decision_time"), F.col("event_id").alias("bar_id"), (F.col("value") > 20).alias("ready"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("v"))


@query(f"""WITH p AS (SELECT {_PRIMARY} FROM events WHERE event_type = 'click'), q AS (SELECT {_PRIMARY} FROM events WHERE event_type = 'view'), r AS (SELECT {_PRIMARY} FROM events WHERE event_type = 'purchase'),
    l AS (SELECT event_id AS bar_id, event_id % 5 <> 0 AS eligible, CASE event_id % 4 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' WHEN 2 THEN 'NEITHER' ELSE 'AMBIGUOUS' END AS outcome, CASE WHEN event_id % 5 = 0 THEN 'AMBIGUOUS_TOUCH' END AS why FROM events WHERE event_id % 23 <> 0),
    a AS (SELECT p.*, q.bar_id AS b15, q.ready AS r15, q.v AS v15 FROM p ASOF LEFT JOIN q ON p.user_id = q.user_id AND p.decision_time >= q.decision_time), b AS (SELECT a.*, r.bar_id AS b1, r.ready AS r1, r.v AS v1 FROM a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.decision_time >= r.decision_time)
    SELECT b.bar_id, outcome, CASE WHEN NOT coalesce(eligible AND outcome IN ('UP', 'DOWN', 'NEITHER'), false) THEN coalesce(why, 'LABEL_NOT_TRAINING_ELIGIBLE') WHEN NOT b.ready THEN 'PRIMARY_5M_FEATURES_NOT_READY' WHEN NOT coalesce(r15, false) THEN 'FINALIZED_15M_FEATURES_NOT_READY'
      WHEN NOT coalesce(r1, false) THEN 'FINALIZED_1H_FEATURES_NOT_READY' WHEN b.v IS NULL OR v15 IS NULL OR v1 IS NULL THEN 'NULL_FEATURE_VALUE' END AS reason, sha256(concat_ws('|', b.bar_id, b15, b1)) AS input_checksum FROM b LEFT JOIN l ON b.bar_id = l.bar_id""")
def training_samples(spark, d):
    """Clicks as samples, with the views and purchases known by then, and the reason for each that is left out."""
    k = F.col("event_id")
    outcome = F.when(k % 4 == 0, F.lit("UP")).when(k % 4 == 1, F.lit("DOWN")).when(k % 4 == 2, F.lit("NEITHER")).otherwise(F.lit("AMBIGUOUS"))
    labels = table(spark, d, "events").where("event_id % 23 <> 0").select(k.alias("bar_id"), k.alias("label_id"), (k % 5 != 0).alias("eligible"), outcome.alias("outcome"), F.when(k % 5 == 0, F.lit("AMBIGUOUS_TOUCH")).alias("reason"))
    out = datasets.assemble(_frame(spark, d, "click"), labels, _frame(spark, d, "view"), _frame(spark, d, "purchase"), ["user_id"], ["v"])
    return out.select("bar_id", "outcome", "reason", "input_checksum")


@query(f"""WITH {BARS}, n AS (SELECT event_type, opens_at AS at_, close, row_number() OVER (PARTITION BY event_type ORDER BY opens_at) - 1 AS i FROM bars), s AS (SELECT at_ FROM n WHERE event_type = 'click'), b AS (SELECT * FROM n WHERE event_type = 'view'), v AS (SELECT * FROM n WHERE event_type = 'purchase'), m AS (SELECT * FROM n WHERE event_type = 'error')
    SELECT s.at_ AS decision_time, b.close AS bank__close, v.close AS vix__close, m.close AS main__close, CASE WHEN b.i IS NULL OR v.i IS NULL THEN 'CONTEXT_5M_EXACT_CLOSE_MISSING' WHEN b.i < 50 OR v.i < 50 THEN 'CONTEXT_WARMUP_INCOMPLETE' WHEN m.i IS NULL OR m.i < 3 THEN 'MAIN_ALIGNMENT_MISSING' END AS reason
    FROM s LEFT JOIN b USING (at_) LEFT JOIN v USING (at_) LEFT JOIN m USING (at_)""")
def exact_context(spark, d):
    """Other series' bars at the very time of each click bar, with reasons where they are not there."""
    bars = hourly(spark, d).withColumn("index", F.row_number().over(W.partitionBy("event_type").orderBy("opens_at")) - 1)
    own = lambda kind: bars.where(F.col("event_type") == kind).select(F.col("opens_at").alias("closes_at"), "index", "close")
    samples = own("click").select(F.col("closes_at").alias("decision_time"))
    out = datasets.exact_context(samples, {"bank": own("view"), "vix": own("purchase")}, own("error"), [])
    return out.select("decision_time", "bank__close", "vix__close", "main__close", "reason")


_CAL = """p AS (SELECT event_id, ts, (user_id % 5)::INT AS fold_index, (1 + event_id % 7) / (3.0 + event_id % 7 + event_id % 5 + event_id % 11) AS p0, (1 + event_id % 5) / (3.0 + event_id % 7 + event_id % 5 + event_id % 11) AS p1, (1 + event_id % 11) / (3.0 + event_id % 7 + event_id % 5 + event_id % 11) AS p2,
      CASE WHEN event_id * 7919 % 101 < 101.0 * (1 + event_id % 7) / (3 + event_id % 7 + event_id % 5 + event_id % 11) THEN 'DOWN' WHEN event_id * 7919 % 101 < 101.0 * (2 + event_id % 7 + event_id % 5) / (3 + event_id % 7 + event_id % 5 + event_id % 11) THEN 'NEITHER' ELSE 'UP' END AS actual FROM events),
    o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM p), f AS (SELECT * FROM o WHERE i < floor(n * 0.6)), e0 AS (SELECT * FROM o WHERE i >= floor(n * 0.6)),
    t AS (SELECT *, exp(ln(p0) / 1.25) AS a, exp(ln(p1) / 1.25) AS b, exp(ln(p2) / 1.25) AS c FROM e0), e AS (SELECT *, a / (a + b + c) AS q0, b / (a + b + c) AS q1, c / (a + b + c) AS q2, (SELECT avg((actual = 'DOWN')::INT) FROM f) AS s0, (SELECT avg((actual = 'NEITHER')::INT) FROM f) AS s1, (SELECT avg((actual = 'UP')::INT) FROM f) AS s2 FROM t),
    m AS (SELECT *, (q0 - (actual = 'DOWN')::INT) ** 2 + (q1 - (actual = 'NEITHER')::INT) ** 2 + (q2 - (actual = 'UP')::INT) ** 2 AS br, (s0 - (actual = 'DOWN')::INT) ** 2 + (s1 - (actual = 'NEITHER')::INT) ** 2 + (s2 - (actual = 'UP')::INT) ** 2 AS bp, (p0 - (actual = 'DOWN')::INT) ** 2 + (p1 - (actual = 'NEITHER')::INT) ** 2 + (p2 - (actual = 'UP')::INT) ** 2 AS bw,
      -ln(CASE actual WHEN 'DOWN' THEN q0 WHEN 'NEITHER' THEN q1 ELSE q2 END) AS ll, -ln(CASE actual WHEN 'DOWN' THEN p0 WHEN 'NEITHER' THEN p1 ELSE p2 END) AS lw, greatest(q0, q1, q2) AS top, (CASE WHEN q0 >= q1 AND q0 >= q2 THEN 'DOWN' WHEN q1 >= q2 THEN 'NEITHER' ELSE 'UP' END = actual)::INT AS hit FROM e),
    bn AS (SELECT least(floor(top * 10), 9)::INT AS bin, count(*) AS k, abs(avg(top) - avg(hit)) AS d FROM m GROUP BY 1), bf AS (SELECT fold_index, least(floor(top * 10), 9)::INT AS bin, count(*) AS k, abs(avg(top) - avg(hit)) AS d FROM m GROUP BY 1, 2),
    sl AS (SELECT m.fold_index, count(*) AS n, 1 - avg(br) / avg(bp) AS skill FROM m GROUP BY 1), se AS (SELECT fold_index, sum(k * d) / sum(k) AS ece FROM bf GROUP BY 1),
    w AS (SELECT (SELECT count(*) FROM f) AS n_fit, count(*) AS n_evaluation, (SELECT sum(k * d) / sum(k) FROM bn) AS ece, avg(br) AS brier, avg(ll) AS log_loss, 1 - avg(br) / avg(bp) AS brier_skill, avg(bw) AS bw, avg(lw) AS lw, least(count(*) FILTER (actual = 'DOWN'), count(*) FILTER (actual = 'NEITHER'), count(*) FILTER (actual = 'UP')) AS le,
      (SELECT least(count(*) FILTER (actual = 'DOWN'), count(*) FILTER (actual = 'NEITHER'), count(*) FILTER (actual = 'UP')) FROM f) AS lf, (SELECT count(*) FROM bn WHERE k >= 30) AS nb, (SELECT count(*) FROM sl JOIN se USING (fold_index) WHERE n < 50 OR ece > 0.1 OR skill < -0.1) AS bad FROM m)"""


@query(f"""WITH {_CAL} SELECT n_fit, n_evaluation, round(ece, 6) AS ece, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(brier_skill, 6) + 0 AS brier_skill, nb AS n_bins, bad AS n_failed, concat_ws('|', CASE WHEN n_fit + n_evaluation < 500 THEN 'INSUFFICIENT_TOTAL_OOS_PREDICTIONS' END,
    CASE WHEN lf < 50 THEN 'INSUFFICIENT_CALIBRATION_FIT_CLASS_SUPPORT' END, CASE WHEN le < 30 THEN 'INSUFFICIENT_UNTOUCHED_EVALUATION_CLASS_SUPPORT' END, CASE WHEN ece > 0.05 THEN 'ECE_RELEASE_GATE_FAILED' END, CASE WHEN brier_skill <= 0 THEN 'BRIER_SKILL_RELEASE_GATE_FAILED' END,
    CASE WHEN brier > bw OR log_loss > lw THEN 'CALIBRATION_DEGRADATION_GATE_FAILED' END, CASE WHEN nb < 2 THEN 'INSUFFICIENT_DISPLAY_PROBABILITY_BIN_SUPPORT' END, CASE WHEN bad > 0 THEN 'CHRONOLOGICAL_SLICE_STABILITY_GATE_FAILED' END) AS blockers FROM w""")
def calibration_release(spark, d):
    """A temperature of 1.25 judged on the later rows (the fitted one has no SQL)."""
    k = F.col("event_id")
    total = 3.0 + k % 7 + k % 5 + k % 11
    draw = k * 7919 % 101
    rows = table(spark, d, "events").select(
        "event_id", "ts", (F.col("user_id") % 5).cast("int").alias("fold_index"), ((1 + k % 7) / total).alias("p_down"), ((1 + k % 5) / total).alias("p_neither"), ((1 + k % 11) / total).alias("p_up"),
        F.when(draw < 101.0 * (1 + k % 7) / total, F.lit("DOWN")).when(draw < 101.0 * (2 + k % 7 + k % 5) / total, F.lit("NEITHER")).otherwise(F.lit("UP")).alias("actual"),
    )
    out = calibration.released(rows, ["ts", "event_id"], ["p_down", "p_neither", "p_up"], temperature=1.25)
    out = rounded(out, ["ece", "brier", "log_loss", "brier_skill"]).withColumn("n_bins", F.size("supported_bins").cast("long")).withColumn("n_failed", F.size("failed_slices").cast("long"))
    return out.select("n_fit", "n_evaluation", "ece", "brier", "log_loss", "brier_skill", "n_bins", "n_failed", F.concat_ws("|", "blockers").alias("blockers"))
