"""Live plans replayed: the analysis that each moment's bounded history gives, and the paths of its plan under execution policies."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import staged
from . import features, price_action
from . import recurrence as R
from .asof import asof_join, interval_join

#: Bars that an analysis sees: of the primary frame and of the two contexts.
LIMITS = {"trend_5m": 750, "trend_15m": 250, "trend_1h": 120}


@dataclasses.dataclass(frozen=True)
class Execution:
    """Shares that leave at three targets, whether the stop then goes to the trigger and to the first target, points lost each way."""

    name: str
    shares: tuple[float, float, float]
    protect_1: bool = False
    protect_2: bool = False
    slippage: float = 0.5


#: Fixed values.
EXECUTIONS = (
    Execution("FULL_TARGET1", (1.0, 0.0, 0.0)),
    Execution("SCALE_50_30_20_STATIC_STOP", (0.5, 0.3, 0.2)),
    Execution("SCALE_50_30_20_PROTECTED", (0.5, 0.3, 0.2), True, True),
)


def trended(bars: DataFrame, by: list[str], order: str, limit: int, out: str) -> DataFrame:
    """Adds the trend by exponential means over the last ``limit`` bars, and how many bars it has seen (``n_`` and the name)."""
    rows = R.bounded_ema(R.bounded_ema(bars, F.col("close"), 20, limit, by, order, "_fast"), F.col("close"), 50, limit, by, order, "_slow")
    n = F.least(F.row_number().over(W.partitionBy(*by).orderBy(order)), F.lit(limit))
    return rows.withColumn(f"n_{out}", n).withColumn(out, price_action.trend(F.col("close"), F.col("_fast"), F.col("_slow"), F.col(f"n_{out}"))).drop("_fast", "_slow")


def analysed(primary: DataFrame, contexts: dict[str, DataFrame], by: list[str], whole_session: Column, limits: dict[str, int] = LIMITS) -> DataFrame:
    """``price_action.analyse`` of every primary bar (opens_at, closes_at, open, high, low, close, session_date, live, developing).

    What it sees of the contexts are the last bars that had closed by then; all means see only as many bars as ``limits`` has.
    ``whole_session``: an aggregate over a session's bars that tells whether its extremes may count on the next one.
    """
    rows = trended(R.bounded_atr(primary, 14, limits["trend_5m"], by, "opens_at", "atr_14"), by, "opens_at", limits["trend_5m"], "trend_5m")
    for name, bars in contexts.items():
        known = trended(bars, by, "opens_at", limits[name], name).select(*by, "closes_at", name, f"n_{name}")
        rows = asof_join(rows, known, by, "closes_at", "closes_at", [name, f"n_{name}"])
        rows = rows.withColumn(name, F.coalesce(name, F.lit("UNAVAILABLE"))).withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    days = primary.groupBy(*by, "session_date").agg(whole_session.alias("_whole"))
    days = days.withColumn("previous_whole", F.coalesce(F.lag("_whole").over(W.partitionBy(*by).orderBy("session_date")), F.lit(False))).drop("_whole")
    rows = features.daily_state(rows, by).join(days, [*by, "session_date"])
    rows = rows.withColumn("input_blockers", price_action.input_blockers("live", "n_trend_5m", "n_trend_15m", "n_trend_1h", "developing"))
    return price_action.analyse(rows, by)


def with_paths(rows: DataFrame, minutes: DataFrame, by: list[str], key: str, start: str, n: int, step: int = 60) -> DataFrame:
    """Adds path: the ``n`` finer bars (at, open, high, low, close) of ``step`` seconds from ``start`` on, null where one is missing.

    Windows meet the bars by time bins of their own length.
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    own = rows.select(*by, key, seconds(start).alias("_a"))
    finer = minutes.select(*by, "at", "open", "high", "low", "close", seconds("at").alias("_m"))
    met = interval_join(own, finer, by, F.col("_a"), F.col("_a") + n * step, "_m", n * step)
    bar = F.struct("at", F.col("open").cast("double").alias("o"), F.col("high").cast("double").alias("h"), F.col("low").cast("double").alias("l"), F.col("close").cast("double").alias("c"))
    paths = met.where(F.pmod(F.col("_m") - F.col("_a"), F.lit(step)) == 0).groupBy(*by, key).agg(F.sort_array(F.collect_list(bar)).alias("path"))
    return rows.join(paths.where(F.size("path") == n), [*by, key], "left")


def _let(x: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(x), f)[0]


def executed(plans: DataFrame, policy: Execution) -> DataFrame:
    """Plays plans (side 1 or -1, trigger, entry_low, entry_high, stop, target_1 to target_3, risk, path) bar by bar: adds status, exit_bar, net_points, r_multiple.

    An open beyond the entry zone when the trigger is crossed is missed. In a bar the stop counts first; then targets in
    order, each for its share. A stop that a target moves holds from the next bar on. What is left at the end leaves at the last close.
    """
    side, trigger = F.col("side"), F.col("trigger").cast("double")
    targets = [F.col(f"target_{k}").cast("double") for k in (1, 2, 3)]
    last = max(k for k, share in enumerate(policy.shares, 1) if share > 0)
    none = F.lit(None).cast("double")

    def state(status, entry, stop, left, gained, top, bar, leaves) -> Column:
        kinds = ("string", "double", "double", "double", "double", "int", "int", "int")
        names = ("status", "entry", "stop", "left", "gained", "top", "bar", "leaves")
        return F.struct(*[c.cast(t).alias(n) for c, t, n in zip((status, entry, stop, left, gained, top, bar, leaves), kinds, names)])

    def gain(share: Column, level: Column, entry: Column) -> Column:
        return share * side * (level - side * policy.slippage - entry)

    def bar(a: Column, x: Column) -> Column:
        crossed = F.when(side > 0, x["h"] >= trigger).otherwise(x["l"] <= trigger)
        gap = F.when(side > 0, x["o"] > F.col("entry_high")).otherwise(x["o"] < F.col("entry_low"))
        fill = F.when(side > 0, F.greatest(x["o"], trigger)).otherwise(F.least(x["o"], trigger)) + side * policy.slippage
        now, fresh, going = a["bar"] + 1, a["entry"].isNull(), F.lit(None)
        waiting = state(going, none, a["stop"], a["left"], a["gained"], a["top"], now, F.lit(None))
        missed = state(F.lit("MISSED_GAP_BEYOND_ENTRY_ZONE"), none, a["stop"], a["left"], a["gained"], a["top"], now, F.lit(None))
        return F.when(a["status"].isNotNull(), a).when(fresh & ~crossed, waiting).when(fresh & gap, missed).otherwise(_let(F.coalesce(a["entry"], fill), lambda entry: inside(a, x, entry, now)))

    def inside(a: Column, x: Column, entry: Column, now: Column) -> Column:
        hit = F.when(side > 0, x["l"] <= a["stop"]).otherwise(x["h"] >= a["stop"])
        name = F.when(a["top"] == 0, F.lit("STOPPED")).otherwise(F.lit("STOPPED_AFTER_TARGET"))
        stopped = state(name, entry, a["stop"], F.lit(0.0), a["gained"] + gain(a["left"], a["stop"], entry), a["top"], now, now)
        return F.when(hit, stopped).otherwise(_let(reached(a, x), lambda top: gone_on(a, x, entry, now, top)))

    def reached(a: Column, x: Column) -> Column:
        top = a["top"]
        for k, share in enumerate(policy.shares, 1):
            if share > 0:
                touched = F.when(side > 0, x["h"] >= targets[k - 1]).otherwise(x["l"] <= targets[k - 1])
                top = F.when((a["top"] < k) & (top == k - 1) & touched, F.lit(k)).otherwise(top)
        return top

    def gone_on(a: Column, x: Column, entry: Column, now: Column, top: Column) -> Column:
        gained, left = a["gained"], a["left"]
        for k, share in enumerate(policy.shares, 1):
            new = (a["top"] < k) & (top >= k)
            gained = gained + F.when(new, gain(F.lit(share), targets[k - 1], entry)).otherwise(F.lit(0.0))
            left = left - F.when(new, F.lit(share)).otherwise(F.lit(0.0))
        stop, more = a["stop"], top > a["top"]
        if policy.protect_1:
            stop = F.when(more & (top >= 1), trigger).otherwise(stop)
        if policy.protect_2:
            stop = F.when(more & (top >= 2), targets[0]).otherwise(stop)
        done = F.when(top >= last, F.concat(F.lit("TARGET"), top.cast("string"), F.lit("_REACHED")))
        return state(done, entry, stop, left, gained, top, now, F.when(top >= last, now))

    begin = state(F.lit(None), none, F.col("stop"), F.lit(1.0), F.lit(0.0), F.lit(0), F.lit(0), F.lit(None))
    rows = plans.withColumn("_a", F.aggregate("path", begin, bar))
    a, close = F.col("_a"), F.element_at("path", -1)["c"]
    open_ = a["status"].isNull() & a["entry"].isNotNull()
    status = F.coalesce(a["status"], F.when(a["entry"].isNull(), F.lit("NOT_TRIGGERED")).otherwise(F.lit("EXPIRED")))
    net = F.when(a["entry"].isNull(), F.lit(0.0)).otherwise(a["gained"] + F.when(open_, gain(a["left"], close, a["entry"])).otherwise(F.lit(0.0)))
    leaves = F.when(open_, F.size("path")).otherwise(a["leaves"])
    return rows.withColumn("status", status).withColumn("exit_bar", leaves).withColumn("net_points", net).withColumn("r_multiple", net / F.col("risk")).drop("_a")


def live_plans(rows: DataFrame, executions: tuple[Execution, ...] = EXECUTIONS) -> tuple[DataFrame, DataFrame]:
    """(candidates, excluded) of analysed rows ``with_paths``: a row for each candidate and policy, and a row with a code for each bar that is none.

    A bar is one if its setup has fired, its plan and path are whole, and the plan's entry is reached (which no policy changes). Codes in the order asked:
    SETUP_ and the state, TRADE_PLAN_UNAVAILABLE, INCOMPLETE_MINUTE_WINDOW, the status of a plan without entry, ATR_UNAVAILABLE.
    """
    fired = F.col("setup").isin("BUY_TRIGGER", "SELL_TRIGGER")
    rows = rows.withColumn("side", F.when(F.col("setup") == "BUY_TRIGGER", 1).when(F.col("setup") == "SELL_TRIGGER", -1))
    code = F.when(~fired, F.concat(F.lit("SETUP_"), "setup")).when(F.col("trigger").isNull() | F.col("risk").isNull(), F.lit("TRADE_PLAN_UNAVAILABLE")).when(F.col("path").isNull(), F.lit("INCOMPLETE_MINUTE_WINDOW"))
    rows = staged(rows.withColumn("code", code), "analysed")  # read once for each policy
    played = executed(rows.where("code is null"), executions[0])
    entered = F.col("status").isin("NOT_TRIGGERED", "MISSED_GAP_BEYOND_ENTRY_ZONE")
    late = F.when(entered, F.col("status")).when(~F.coalesce(F.col("atr_14") > 0, F.lit(False)), F.lit("ATR_UNAVAILABLE"))
    played = played.withColumn("code", late)
    excluded = rows.where("code is not null").unionByName(played.where("code is not null").select(*rows.columns))
    kept = played.where("code is null").select(*rows.drop("code").columns)
    out = None
    for policy in executions:
        own = executed(kept, policy).withColumn("policy", F.lit(policy.name))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("risk_atr", F.col("risk") / F.col("atr_14")), excluded
