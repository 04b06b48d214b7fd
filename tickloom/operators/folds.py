"""Walk-forward splits with purge and embargo, session weights, candidate choice, and policies."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import codes
from .chains import matched, ranked


def walk_forward(rows: DataFrame, by: list[str], order: str, label_end: str, folds: int, test_rows: int, gap_seconds: float) -> DataFrame:
    """Rows (fold_index, role, *rows): the last ``folds`` * ``test_rows`` rows in test blocks; training rows are those whose label ended ``gap_seconds`` before the block's start."""
    w = W.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("_i", F.row_number().over(w) - 1)
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else rows.agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(n, by) if by else rows.crossJoin(F.broadcast(n))  # one row
    rows = rows.withColumn("_fold", F.floor((F.col("_i") - (F.col("_n") - folds * test_rows)) / test_rows).cast("int"))
    test = rows.where("_fold >= 0")
    starts = test.groupBy(*by, F.col("_fold").alias("fold_index")).agg(F.min(order).alias("_start"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    train = rows.join(F.broadcast(starts), by) if by else rows.crossJoin(F.broadcast(starts))  # a few rows: one a fold
    train = train.where(seconds(label_end) <= seconds("_start") - gap_seconds)
    keep = [c for c in rows.columns if not c.startswith("_")]
    return train.select("fold_index", F.lit("train").alias("role"), *keep).unionByName(test.select(F.col("_fold").alias("fold_index"), F.lit("test").alias("role"), *keep))


def session_weights(rows: DataFrame, session: str) -> DataFrame:
    """Adds weight: the same total for every session, mean 1."""
    counts = rows.groupBy(session).agg(F.count(F.lit(1)).alias("_k"))
    total = counts.agg(F.sum("_k").alias("_n"), F.count(F.lit(1)).alias("_s"))
    return rows.join(counts, session).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_n") / F.col("_s") / F.col("_k")).drop("_k", "_n", "_s")


def best_candidate(metrics: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """The candidate that comes first by ``order`` (smaller is better), then by name."""
    return metrics.groupBy(*by).agg(F.min_by(name, F.struct(*order, name)).alias(name))


#: Least places of a block of ``causal_percentile``.
BLOCK = 1 << 15


def _below(x: np.ndarray) -> np.ndarray:
    """How many elements before each one are less than it: halves of blocks of 2, 4, 8, ... are compared in order of value."""
    n = len(x)
    order = np.lexsort((-np.arange(n), x))  # of equal ones the later first, which so counts none of them
    out = np.zeros(n, "i8")
    for level in range(max(n - 1, 0).bit_length()):
        at = order[np.argsort(order >> (level + 1), kind="stable")]
        right = (at >> level & 1).astype(bool)
        before = np.cumsum(~right) - ((at >> (level + 1)) << level)  # of the left half of its own block
        out[at[right]] += before[right]
    return out


def causal_percentile(rows: DataFrame, by: list[str], order: str | list[str], value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Share of earlier rows of the series whose value is this row's or less; null on the first. A null value counts for none and has none.

    Rows have two places in their series, in time and by (value, time), so what counts is earlier and lower in both. Blocks of places
    divide the rows both ways: a task counts within a block of time, another within a block of values, and the rest are whole
    cells of blocks, summed along both. No task holds a series; cells are as many as rows at most.
    """
    columns, size = rows.columns, rows.count()
    block = max(block, math.isqrt(size))
    placed = ranked(rows, by, [order] if isinstance(order, str) else list(order), "_i", size=size)
    placed = ranked(placed, by, [F.col(value).asc_nulls_last(), F.col("_i")], "_r", size=size)
    placed = placed.withColumn("_t", F.floor(F.col("_i") / block)).withColumn("_u", F.floor(F.col("_r") / block))

    def counted(along: str, of: str, name: str):
        def count(t: pa.Table) -> pa.Table:
            t = t.sort_by(along)
            return t.append_column(name, pa.array(_below(t.column(of).to_numpy())))

        return count

    with_ = lambda df, name: T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    found = placed.groupBy(*by, "_t").applyInArrow(counted("_i", "_r", "_n"), with_(placed, "_n"))
    found = found.groupBy(*by, "_u").applyInArrow(counted("_r", "_t", "_k"), with_(found, "_k"))
    cells = placed.groupBy(*by, "_t", "_u").agg(F.count(F.lit(1)).alias("_c"))
    most = placed.groupBy(*by).agg(F.max("_t").alias("_m"))
    every = most.select(*by, "_m", F.explode(F.sequence(F.lit(0).cast("long"), "_m")).alias("_t")).select(*by, "_t", F.explode(F.sequence(F.lit(0).cast("long"), "_m")).alias("_u"), F.lit(0).cast("long").alias("_c"))
    cells = cells.unionByName(every).groupBy(*by, "_t", "_u").agg(F.sum("_c").alias("_c"))
    for along, across in (("_t", "_u"), ("_u", "_t")):  # as many rows as blocks in a window
        cells = cells.withColumn("_c", F.coalesce(F.sum("_c").over(W.partitionBy(*by, across).orderBy(along).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    found = matched(found, cells, [*by, "_t", "_u"])
    count = F.when(F.col(value).isNull(), F.lit(0)).otherwise(F.col("_n") + F.col("_k") + F.col("_c"))
    return found.select(*columns, F.try_divide(count, F.col("_i")).alias(out))


def reference_percentile(rows: DataFrame, reference: DataFrame, value: str, out: str, ranges: int = 64) -> DataFrame:
    """Share of reference values that are this row's or less.

    Distinct values of both sides are sorted within ``ranges`` of value whose bounds come from approximate percentiles; counts of
    the ranges before give each range's start, so no task sorts all values.
    """
    total = reference.count()
    a = reference.select(F.col(value).alias("_v"), F.lit(1).alias("_k"))
    both = a.unionByName(rows.select(F.col(value).alias("_v"), F.lit(0).alias("_k"))).groupBy("_v").agg(F.sum("_k").alias("_k"))
    cuts = both.agg(F.percentile_approx("_v", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    # the number of cuts below a value, by halving
    cuts = sorted(set(cuts))
    both = both.withColumn("_b", _position(F.col("_v"), cuts))
    starts = both.groupBy("_b").agg(F.sum("_k").alias("_s")).withColumn("_s", F.coalesce(F.sum("_s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    ordered = both.withColumn("_n", F.sum("_k").over(W.partitionBy("_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))).join(starts, "_b")
    share = F.try_divide((F.col("_n") + F.col("_s")).cast("double"), F.lit(float(total)))
    return rows.join(ordered.select(F.col("_v").alias(value), share.alias(out)), value)


def _position(x: Column, cuts: list[float]) -> Column:
    """How many of the sorted ``cuts`` are below ``x``: a binary tree of comparisons."""

    def between(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(x > cuts[m], between(m + 1, b)).otherwise(between(a, m))

    return between(0, len(cuts))


def regime_baseline(rows: DataFrame, value: str, effects: dict[str, list[str]], shrink: float = 50.0, clip_at: float = 2.0) -> DataFrame:
    """Adds baseline: the mean plus each effect's shrunken mean difference, within +-``clip_at``.

    ``effects``: name to grouping columns. An effect of n rows counts n / (n + ``shrink``).
    """
    mean = rows.agg(F.avg(value).alias("_mean"))
    out = rows.crossJoin(F.broadcast(mean))  # one row
    total = F.col("_mean")
    for name, keys in effects.items():
        e = out.groupBy(*keys).agg((F.sum(F.col(value) - F.col("_mean")) / (F.count(F.lit(1)) + shrink)).alias(f"_{name}"))
        out = out.join(e, keys, "left")
        total = total + F.coalesce(F.col(f"_{name}"), F.lit(0.0))
    return out.withColumn("baseline", F.greatest(F.least(total, F.lit(clip_at)), F.lit(-clip_at))).drop("_mean", *[f"_{n}" for n in effects])


#: Fixed values of the signal policy: thresholds, and distances in ranges (atr).
POLICY = {
    "probability": 0.60, "margin": 0.15, "neither": 0.45, "expected_atr": 0.15, "reversal_probability": 0.72, "reversal_margin": 0.25, "reward_risk": 1.25,
    "entry_atr": 0.10, "stop_atr": 0.75, "target_atr": (1.0, 1.5, 2.0), "expiry_bars": 12,
}
#: Codes of the hard gates and the boolean columns that they ask for; DATA_NOT_LIVE_ carries the state.
HARD_GATES = (
    ("SNAPSHOT_REVISION_MISMATCH", "snapshot_synced"), ("PRIMARY_CANDLE_NOT_FINALIZED", "finalized_primary"), ("FINALIZED_15M_CONTEXT_MISSING", "finalized_15m"),
    ("FINALIZED_1H_CONTEXT_MISSING", "finalized_1h"), ("FEATURE_SNAPSHOT_NOT_READY", "feature_ready"), ("CALIBRATION_RELEASE_GATE_NOT_PASSED", "calibration_released"),
    ("PROBABILITY_BIN_NOT_SUPPORTED", "bin_supported"), ("EVENT_RISK_GATE_ACTIVE", "event_risk_clear"),
)


def hard_gates() -> Column:
    """Array of the codes of the hard gates that are not passed (data_status, the columns of ``HARD_GATES``, reference_close, atr); unknown is not passed."""
    said = F.coalesce("data_status", F.lit("UNKNOWN"))
    pairs = [F.when(said != "LIVE", F.concat(F.lit("DATA_NOT_LIVE_"), said))]
    pairs += [F.when(~F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in HARD_GATES]
    pairs += [F.when(F.col("reference_close").isNull(), F.lit("REFERENCE_PRICE_UNAVAILABLE")), F.when(~F.coalesce(F.col("atr") > 0, F.lit(False)), F.lit("ATR_UNAVAILABLE"))]
    return F.array_compact(F.array(*pairs))


def signal(rows: DataFrame, p: dict = POLICY) -> DataFrame:
    """Adds side, margin, expected_atr, blockers, decision (BUY, SELL, WAIT) and the levels of a signal.

    Needs p_down, p_neither, p_up, gates (array of codes: ``hard_gates``), active_side (null: none), reference_close and atr. While a
    gate is not passed nothing else is asked. Equal probabilities count as BUY. A signal against an active one always
    waits, as that must be invalidated first; below the thresholds of a reversal it also says so. Reward over risk is asked last.
    """
    up, down, neither = F.col("p_up"), F.col("p_down"), F.col("p_neither")
    buy = up >= down
    own, other = F.when(buy, up).otherwise(down), F.when(buy, down).otherwise(up)
    rows = rows.withColumn("side", F.when(buy, F.lit("BUY")).otherwise(F.lit("SELL"))).withColumn("margin", own - F.greatest(other, neither)).withColumn("expected_atr", own - p["stop_atr"] * other)
    turned = F.coalesce(F.col("active_side") != F.col("side"), F.lit(False))
    asked = codes(
        (own < p["probability"], "PROBABILITY_THRESHOLD_NOT_MET"), (F.col("margin") < p["margin"], "CLASS_MARGIN_THRESHOLD_NOT_MET"), (neither > p["neither"], "NEITHER_PROBABILITY_TOO_HIGH"),
        (F.col("expected_atr") < p["expected_atr"], "EXPECTED_VALUE_GATE_FAILED"), (turned & ((own < p["reversal_probability"]) | (F.col("margin") < p["reversal_margin"])), "HYSTERESIS_REVERSAL_THRESHOLD_NOT_MET"),
        (turned, "CONFLICTING_ACTIVE_SIGNAL_MUST_INVALIDATE_FIRST"),
    )
    poor = F.lit(p["target_atr"][0] / p["stop_atr"] < p["reward_risk"])
    rows = rows.withColumn("blockers", F.when(F.size("gates") > 0, F.col("gates")).otherwise(asked))
    rows = rows.withColumn("blockers", F.when((F.size("blockers") == 0) & poor, F.array(F.lit("RISK_REWARD_GATE_FAILED"))).otherwise(F.col("blockers")))
    free, sign, c, a = F.size("blockers") == 0, F.when(buy, 1).otherwise(-1), F.col("reference_close"), F.col("atr")
    rows = rows.withColumn("decision", F.when(free, F.col("side")).otherwise(F.lit("WAIT"))).withColumn("expected_atr", F.when(free, F.col("expected_atr")))
    places = {"entry_low": c - p["entry_atr"] * a, "entry_high": c + p["entry_atr"] * a, "stop": c - sign * p["stop_atr"] * a} | {f"target_{k}": c + sign * x * a for k, x in enumerate(p["target_atr"], 1)}
    return rows.withColumns({n: F.when(free, x) for n, x in places.items()})


def lifecycle(rows: DataFrame) -> Column:
    """State of a signal at a bar (side, entry_low, entry_high, stop, target, expires_at, at, high, low): expiry before touches, stop and target in one bar invalidate."""
    buy = F.col("side") == "BUY"
    stop = F.when(buy, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    target = F.when(buy, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    return F.when(F.col("at") >= F.col("expires_at"), F.lit("EXPIRED")).when(stop & target, F.lit("INVALIDATED")).when(stop, F.lit("STOPPED")).when(target, F.lit("TARGET")).when((F.col("low") <= F.col("entry_high")) & (F.col("high") >= F.col("entry_low")), F.lit("ENTERED")).otherwise(F.lit("WAITING"))
