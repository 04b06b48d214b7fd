"""Paper trades, monitoring, and gates: each failed condition has a code, and any code blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import codes
from .asof import first_from, interval_join


def paper_trades(trades: DataFrame, bars: DataFrame, keys: list[str], width: int = 3600) -> DataFrame:
    """Outcome of trades (trade_id, side, entry_low, entry_high, stop, target, opened_at, expires_at) over finished bars (at, high, low, close).

    A bar before ``expires_at`` that meets the entry zone fills at its worse edge; where that bar also touches stop or
    target, their order is unknown and the trade is invalid. Later the first bar that touches stop or target ends it,
    both in one bar make it invalid; the first bar at or after ``expires_at`` still counts for these, and then ends the
    trade at its close. Unfilled trades expire at nothing. A trade with no such bar yet is WAITING or OPEN. Trades meet the bars
    by time bins of ``width`` seconds, and first touches are minima of bar times, so no task holds a series or a trade's bars.
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    buy = F.col("side") == "BUY"
    own = [*keys, "trade_id", "side", "entry_low", "entry_high", "stop", "target"]
    # bars before the expiry, with the trade's numbers beside each
    spans = trades.select(*own, seconds("opened_at").alias("_o"), seconds("expires_at").alias("_x"))
    rows = interval_join(spans, bars.select(*keys, "high", "low", "at", seconds("at").alias("_b")), keys, F.col("_o"), F.col("_x"), "_b", width)
    zone = (F.col("low") <= F.col("entry_high")) & (F.col("high") >= F.col("entry_low"))
    touches = lambda high, low: (F.when(buy, low <= F.col("stop")).otherwise(high >= F.col("stop")), F.when(buy, high >= F.col("target")).otherwise(low <= F.col("target")))
    stop, target = touches(F.col("high"), F.col("low"))
    rows = rows.select(*keys, "trade_id", "at", zone.alias("zone"), stop.alias("_s"), target.alias("_t"))
    fills = rows.where("zone").groupBy("trade_id").agg(F.min("at").alias("filled_at"))
    ends = rows.join(fills, "trade_id").where("at >= filled_at and (_s or _t)")
    ends = ends.groupBy("trade_id").agg(F.min(F.struct("at", "_s", "_t")).alias("e")).select("trade_id", F.col("e.at").alias("ended_at"), "e._s", "e._t")
    out = first_from(trades, bars, keys, "expires_at", "at", ["high", "low", "close"], "_last")
    out = out.join(fills, "trade_id", "left").join(ends, "trade_id", "left")
    early, over = F.col("ended_at").isNotNull(), F.col("_last").isNotNull()
    late_stop, late_target = touches(F.col("_last.high"), F.col("_last.low"))
    stopped, reached = F.when(early, F.col("_s")).otherwise(late_stop & over), F.when(early, F.col("_t")).otherwise(late_target & over)
    out = out.withColumn("_s", F.coalesce(stopped, F.lit(False))).withColumn("_t", F.coalesce(reached, F.lit(False)))
    unfilled, same = F.col("filled_at").isNull(), F.coalesce(F.col("ended_at") == F.col("filled_at"), F.lit(False))
    state = (
        F.when(unfilled, F.when(over, F.lit("EXPIRED")).otherwise(F.lit("WAITING"))).when(same | (F.col("_s") & F.col("_t")), F.lit("INVALIDATED"))
        .when(F.col("_s"), F.lit("STOP_HIT")).when(F.col("_t"), F.lit("TARGET_1_HIT")).when(over, F.lit("EXPIRED")).otherwise(F.lit("OPEN"))
    )
    entry = F.when(buy, F.col("entry_high")).otherwise(F.col("entry_low"))
    out = out.withColumn("state", state)
    exit_ = (
        F.when(F.col("state") == "STOP_HIT", F.col("stop")).when(F.col("state") == "TARGET_1_HIT", F.col("target"))
        .when((F.col("state") == "EXPIRED") & ~unfilled, F.col("_last.close"))
    )
    return out.withColumn("points", F.when(buy, exit_ - entry).otherwise(entry - exit_)).drop("_last", "ended_at", "_s", "_t")


def minute_outcomes(predictions: DataFrame, minutes: DataFrame, keys: list[str], size: float = 1.5, horizon: int = 60) -> DataFrame:
    """Outcome of predictions (made_at, close, atr) by the next ``horizon`` minutes: UP, DOWN, NEITHER, AMBIGUOUS in one minute, UNASSESSABLE where minutes lack."""
    end = F.col("made_at") + F.expr(f"interval {horizon} minutes")
    rows = predictions.join(minutes, keys).where((F.col("at") >= F.col("made_at")) & (F.col("at") < end))
    up, down = F.col("high") >= F.col("close") + size * F.col("atr"), F.col("low") <= F.col("close") - size * F.col("atr")
    found = rows.groupBy("prediction_id").agg(F.min(F.when(up, F.col("at"))).alias("up_at"), F.min(F.when(down, F.col("at"))).alias("down_at"), F.count_distinct("at").alias("n"))
    out = predictions.join(found, "prediction_id", "left")
    return out.withColumn(
        "outcome",
        F.when(F.coalesce("n", F.lit(0)) < horizon, F.lit("UNASSESSABLE")).when(F.col("up_at") == F.col("down_at"), F.lit("AMBIGUOUS")).when(F.col("up_at").isNull() & F.col("down_at").isNull(), F.lit("NEITHER"))
        .when(F.col("down_at").isNull() | (F.col("up_at") < F.col("down_at")), F.lit("UP")).otherwise(F.lit("DOWN")),
    ).drop("n", "up_at", "down_at")


def monitoring(checks: DataFrame, by: list[str]) -> DataFrame:
    """The worst status of checks (name, status) and how many have each."""
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    out = checks.groupBy(*by).agg(F.max(rank).alias("_r"), *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "WARN", "FAIL")])
    return out.withColumn("status", F.element_at(F.array(*map(F.lit, ("PASS", "WARN", "FAIL"))), F.col("_r") + 1)).drop("_r")


def gate(rows: DataFrame, conditions: dict[str, Column], out: str = "blockers") -> DataFrame:
    """Adds the codes of unmet conditions (an unknown one is unmet) and released: none is left."""
    blockers = codes(*[(~F.coalesce(c, F.lit(False)), name) for name, c in conditions.items()])
    return rows.withColumn(out, blockers).withColumn("released", F.size(out) == 0)


def circuit_breaker(calls: DataFrame, by: list[str], order: str, ok: str, limit: int = 3, seconds: int = 60, tie: tuple[str, ...] = ()) -> DataFrame:
    """Adds open: ``limit`` failures in a row lie right behind, the last less than ``seconds`` ago.

    Times count in whole seconds, to the nearest (halves to the even one); ``tie`` orders calls of one time.
    """
    w = W.partitionBy(*by).orderBy(order, *tie)
    failed = F.sum(1 - F.col(ok).cast("int")).over(w.rowsBetween(-limit, -1)) == limit
    at = F.rint(F.unix_micros(F.col(order).cast("timestamp")) / 1e6)
    recent = at - F.lag(at).over(w) < seconds
    return calls.withColumn("open", F.coalesce(failed & recent, F.lit(False)))


#: The release gate's codes, in order, and the condition that each needs; the largest calibration error.
RELEASE_ECE = 0.05
RELEASE = (
    ("LICENSED_LIVE_PROVIDER_NOT_CONFIGURED", "market_data_mode = 'live' and provider is not null"), ("CANONICAL_MARKET_DATA_NOT_LIVE", "data_status = 'LIVE'"),
    ("CHART_MODEL_SNAPSHOT_NOT_SYNCHRONIZED", "analysis_snapshot = chart_snapshot and analysis_checksum = chart_checksum"), ("APPROVED_RELEASE_MANIFEST_MISSING", "release_id is not null"),
    ("MODEL_ARTIFACT_MISSING_OR_HASH_MISMATCH", "model_sha256 = manifest_model_sha256"), ("CALIBRATION_ARTIFACT_MISSING_OR_HASH_MISMATCH", "calibration_sha256 = manifest_calibration_sha256"),
    ("FEATURE_ARTIFACT_INCOMPATIBLE", "feature_set = manifest_feature_set"), ("LABEL_ARTIFACT_INCOMPATIBLE", "label_set = manifest_label_set"), ("SIGNAL_POLICY_ARTIFACT_INCOMPATIBLE", "policy_version = manifest_policy_version"),
    ("CALIBRATION_RELEASE_GATE_FAILED", f"calibration_ece <= {RELEASE_ECE} and positive_brier_skill"), ("LIVE_ANALYSIS_ARTIFACT_MISMATCH", "analysis_versions is null or analysis_versions = manifest_versions"),
    ("DRIFT_REFERENCE_EVIDENCE_MISSING", "drift_passed is not null"), ("DRIFT_THRESHOLD_BREACHED", "coalesce(drift_passed, true)"), ("LIVE_SIGNAL_KILL_SWITCH_ACTIVE", "not kill_switch"),
)


def release_gate(rows: DataFrame) -> DataFrame:
    """Adds blockers and released by the conditions of ``RELEASE``. Without a manifest what compares with it is not asked; an unknown condition blocks."""
    own = slice(4, 11)  # those of the manifest
    names = [n for n, _ in RELEASE]
    conditions = {n: F.expr(c) if n not in names[own] else F.col("release_id").isNull() | F.expr(c) for n, c in RELEASE}
    return gate(rows, conditions)
