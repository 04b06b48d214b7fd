"""Labels with all their reasons, event families, and small outcome tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import uuid5
from .asof import interval_join
from .snapshots import NAMESPACE


def definition_hash(definition: dict) -> str:
    """The identity of a label's definition: the hash of its canonical JSON."""
    return hashlib.sha256(json.dumps(definition, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def first_touch_labels(
    bars: DataFrame, minutes: DataFrame, by: list[str], atr: str, up: float = 1.0, down: float = 1.0, horizon: int = 12, step: int = 300, minute: int = 60, dataset: str = "",
) -> DataFrame:
    """Adds outcome, reason, eligible, first_touch_at, window_ends_at, the barriers and label_id to bars (candle_id, opens_at, closes_at, session_closes, high, low, close).

    Reasons in the order asked: ATR_AT_DECISION_UNAVAILABLE, OUTCOME_WINDOW_CROSSES_SESSION_CLOSE (also outside of a session),
    INCOMPLETE_FUTURE_5M_WINDOW (one of the ``horizon`` bars of ``step`` seconds is missing), AMBIGUOUS_INTRABAR_ORDER. The first bar that touches a
    barrier decides; one that touches both is resolved by its ``minutes`` (at, high, low; ``minute`` seconds each), if all are there and the first of
    them that touches does not touch both. Excluded bars have no outcome, ambiguous ones AMBIGUOUS; neither is eligible.
    """
    name = definition_hash({"up": up, "down": down, "horizon": horizon, "step": step})
    w = W.partitionBy(*by).orderBy("opens_at").rowsBetween(1, horizon)
    bar = F.struct("opens_at", "closes_at", F.col("high").alias("h"), F.col("low").alias("l"))
    rows = bars.withColumn("_next", F.collect_list(bar).over(w)).withColumn("window_ends_at", F.col("closes_at") + F.make_dt_interval(secs=F.lit(horizon * step)))
    good = F.coalesce(F.col(atr) > 0, F.lit(False))
    rows = rows.withColumn("up_barrier", F.when(good, F.col("close") + up * F.col(atr))).withColumn("down_barrier", F.when(good, F.col("close") - down * F.col(atr)))
    # whole: the k-th next bar opens k steps after the close
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    on_time = F.transform("_next", lambda x, i: seconds(x["opens_at"]) == seconds(F.col("closes_at")) + i * step)
    whole = (F.size("_next") == horizon) & F.forall(on_time, lambda x: x)
    crosses = F.coalesce(F.col("window_ends_at") > F.col("session_closes"), F.lit(True))
    reason = F.when(~good, F.lit("ATR_AT_DECISION_UNAVAILABLE")).when(crosses, F.lit("OUTCOME_WINDOW_CROSSES_SESSION_CLOSE")).when(~whole, F.lit("INCOMPLETE_FUTURE_5M_WINDOW"))
    rows = rows.withColumn("reason", reason)
    touched = F.get(F.filter("_next", lambda x: (x["h"] >= F.col("up_barrier")) | (x["l"] <= F.col("down_barrier"))), F.lit(0))
    rows = rows.withColumn("_touch", F.when(F.col("reason").isNull(), touched)).drop("_next")
    above, below = F.col("_touch.h") >= F.col("up_barrier"), F.col("_touch.l") <= F.col("down_barrier")
    # only bars that touch both meet their minutes
    both = rows.where(above & below).select(*by, "candle_id", "up_barrier", "down_barrier", seconds(F.col("_touch.opens_at")).alias("_o"))
    finer = minutes.select(*by, F.col("at").alias("_time"), F.col("high").alias("_h"), F.col("low").alias("_l"), seconds(F.col("at")).alias("_m"))
    met = interval_join(both, finer, by, F.col("_o"), F.col("_o") + step, "_m", step)
    on_grid = F.pmod(F.col("_m") - F.col("_o"), F.lit(minute)) == 0
    first = lambda c: F.min(F.when(c, F.col("_time")))
    found = met.where(on_grid).groupBy(*by, "candle_id").agg(
        F.count_distinct("_time").alias("_n"), first(F.col("_h") >= F.col("up_barrier")).alias("_up"), first(F.col("_l") <= F.col("down_barrier")).alias("_down"),
    )
    rows = rows.join(found, [*by, "candle_id"], "left")
    known = (F.col("_n") == step // minute) & ~F.coalesce(F.col("_up") == F.col("_down"), F.lit(False)) & (F.col("_up").isNotNull() | F.col("_down").isNotNull())
    rises = F.coalesce(F.col("_up") < F.col("_down"), F.col("_down").isNull())
    both_ = above & below
    outcome = (
        F.when(F.col("reason").isNotNull(), F.lit(None)).when(F.col("_touch").isNull(), F.lit("NEITHER"))
        .when(both_ & F.coalesce(known, F.lit(False)), F.when(rises, F.lit("UP")).otherwise(F.lit("DOWN"))).when(both_, F.lit("AMBIGUOUS")).when(above, F.lit("UP")).otherwise(F.lit("DOWN"))
    )
    rows = rows.withColumn("outcome", outcome)
    minute_end = F.least("_up", "_down") + F.make_dt_interval(secs=F.lit(minute))
    at = F.when(both_ & F.coalesce(known, F.lit(False)), minute_end).otherwise(F.col("_touch.closes_at"))
    rows = rows.withColumn("first_touch_at", at).withColumn("reason", F.when(F.col("outcome") == "AMBIGUOUS", F.lit("AMBIGUOUS_INTRABAR_ORDER")).otherwise(F.col("reason")))
    rows = rows.withColumn("eligible", F.col("reason").isNull())
    said = F.concat_ws(":", F.lit("label"), F.lit(dataset), F.col("candle_id").cast("string"), F.lit(name))
    return rows.withColumn("label_id", uuid5(NAMESPACE, said)).drop("_touch", "_n", "_up", "_down")


#: Families in order of priority, and what each asks of a row for either direction; ``p_`` is the row before it in the session.
FAMILIES: dict[str, tuple[str, str]] = {
    "LIQUIDITY_SWEEP_REVERSAL": (
        "swing_low_liquidity_sweep >= 0.5 and close_location >= 0.60 and body_efficiency >= 0.10",
        "swing_high_liquidity_sweep >= 0.5 and close_location <= 0.40 and body_efficiency <= -0.10",
    ),
    "CONFIRMED_STRUCTURE_BREAK": (
        "break_of_structure_up >= 0.5 and p_break_of_structure_up < 0.5 and close_location >= 0.60 and body_efficiency >= 0.15",
        "break_of_structure_down >= 0.5 and p_break_of_structure_down < 0.5 and close_location <= 0.40 and body_efficiency <= -0.15",
    ),
    "COMPRESSION_EXPANSION": (
        "p_range_compression_3_to_12 <= 0.75 and range_compression_3_to_12 >= 1.05 and close_location >= 0.70 and body_efficiency >= 0.40",
        "p_range_compression_3_to_12 <= 0.75 and range_compression_3_to_12 >= 1.05 and close_location <= 0.30 and body_efficiency <= -0.40",
    ),
    "TREND_EMA_RECLAIM": (
        "p_distance_ema20_atr <= -0.15 and distance_ema20_atr >= 0 and structure_score >= 0.5 and close_location >= 0.60 and body_efficiency >= 0.15",
        "p_distance_ema20_atr >= 0.15 and distance_ema20_atr <= 0 and structure_score <= -0.5 and close_location <= 0.40 and body_efficiency <= -0.15",
    ),
}
LAGGED = ("break_of_structure_up", "break_of_structure_down", "range_compression_3_to_12", "distance_ema20_atr")


def event_families(rows: DataFrame, by: list[str], session: str, order: list[str], families: dict[str, tuple[str, str]] = FAMILIES) -> DataFrame:
    """Adds direction, setup and diagnostic of rows with the families' features.

    Families ask the row, and the row before it if that is of the same session. Rows of which families of both directions hold wait
    (CONFLICTING_DIRECTION_WAIT), those of none are NO_EVENT; else the first family counts, and the diagnostic names direction and setup.
    """
    w = W.partitionBy(*by).orderBy(*order)
    same = F.lag(session).over(w) == F.col(session)
    lagged = {f"p_{c}": F.when(same, F.lag(c).over(w)) for c in LAGGED}
    own = rows.columns
    rows = rows.withColumns(lagged)
    found = []
    for name, sides in families.items():
        found += [F.when(F.expr(c), F.struct(F.lit(side).alias("direction"), F.lit(name).alias("setup"))) for side, c in zip(("LONG", "SHORT"), sides)]
    rows = rows.withColumn("_e", F.array_compact(F.array(*found)))
    sides = F.size(F.array_distinct("_e.direction"))
    first = F.when(sides == 1, F.get("_e", F.lit(0)))
    said = F.when(sides > 1, F.lit("CONFLICTING_DIRECTION_WAIT")).when(sides == 0, F.lit("NO_EVENT")).otherwise(F.concat(first["direction"], F.lit(":"), first["setup"]))
    return rows.select(*own, first["direction"].alias("direction"), first["setup"].alias("setup"), said.alias("diagnostic"))


def conditional_labels(rows: DataFrame, long: str, short: str) -> DataFrame:
    """Adds opportunity (one side has won) and long_when_opportunity, as 0 or 1. Both sides cannot win: such a row is an error."""
    a, b = F.coalesce(F.col(long), F.lit(False)), F.coalesce(F.col(short), F.lit(False))
    one = F.when(a & b, F.raise_error(F.lit("two successful sides"))).otherwise((a | b).cast("int"))
    return rows.withColumn("opportunity", one.cast("int")).withColumn("long_when_opportunity", a.cast("int"))


def replay_assessments(predictions: DataFrame) -> DataFrame:
    """Rows (assessment_id, prediction_id, label_id, assessed_at, actual_outcome, predicted_outcome, correct), one a prediction (with its label's window_ends_at)."""
    said = F.concat_ws(":", F.lit("replay-assessment"), F.col("prediction_id").cast("string"), F.col("label_id").cast("string"))
    return predictions.select(
        uuid5(NAMESPACE, said).alias("assessment_id"), "prediction_id", "label_id", F.col("window_ends_at").alias("assessed_at"), "actual_outcome", "predicted_outcome",
        F.col("actual_outcome").eqNullSafe(F.col("predicted_outcome")).alias("correct"),
    )


def plain_direction(down: Column, neither: Column, up: Column) -> Column:
    """The older rule: BUY or SELL from 0.60 on and 0.15 ahead of the other side, nothing above 0.45 of neither."""
    return F.when(neither > 0.45, F.lit(None)).when((up >= 0.60) & (up - down >= 0.15), F.lit("BUY")).when((down >= 0.60) & (down - up >= 0.15), F.lit("SELL"))
