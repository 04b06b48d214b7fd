"""What followed a decision: barrier labels, trade paths, and choices that do not overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chains import non_overlapping  # noqa: F401


def first_touch(bars: DataFrame, by: list[str], order: str, atr: str, size: float = 1.0, horizon: int = 12, complete: Column | None = None) -> DataFrame:
    """Adds outcome UP, DOWN, NEITHER, AMBIGUOUS (both barriers in one bar) or null, its reason, and bars_to_touch.

    Barriers lie ``size`` ranges above and below the close; the first of the next
    ``horizon`` bars whose high or low reaches one decides. ``complete`` tells of a bar
    whether it follows the one before without a gap.
    """
    w = W.partitionBy(*by).orderBy(order).rowsBetween(1, horizon)
    step = F.col("_whole") if complete is not None else F.lit(True)
    rows = bars.withColumn("_whole", F.lit(True) if complete is None else complete)
    rows = rows.withColumn("_next", F.collect_list(F.struct(F.col("high").alias("h"), F.col("low").alias("l"), step.alias("w"))).over(w))
    rows = rows.withColumn("upper", F.col("close") + size * F.col(atr)).withColumn("lower", F.col("close") - size * F.col(atr))
    rows = rows.withColumn("_touch", F.expr("get(filter(transform(_next, (x, i) -> struct(i + 1 as i, x.h >= upper as up, x.l <= lower as down)), t -> t.up or t.down), 0)"))
    reason = F.when(F.col(atr).isNull(), F.lit("ATR_AT_DECISION_UNAVAILABLE")).when((F.size("_next") < horizon) | F.exists("_next", lambda x: ~x["w"]), F.lit("INCOMPLETE_FUTURE_WINDOW")).when(F.col("_touch.up") & F.col("_touch.down"), F.lit("AMBIGUOUS_TOUCH"))
    rows = rows.withColumn("reason", reason)
    outcome = F.when(F.col("reason") == "AMBIGUOUS_TOUCH", F.lit("AMBIGUOUS")).when(F.col("reason").isNull(), F.when(F.col("_touch").isNull(), F.lit("NEITHER")).when(F.col("_touch.up"), F.lit("UP")).otherwise(F.lit("DOWN")))
    return rows.withColumn("outcome", outcome).withColumn("bars_to_touch", F.when(F.col("outcome").isin("UP", "DOWN"), F.col("_touch.i"))).drop("_whole", "_next", "_touch")


def resolve_by_minutes(ambiguous: DataFrame, minutes: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome of bars that touched both barriers, by their minutes (bar_opens, opens_at, high, low): UP, DOWN, or AMBIGUOUS within one minute."""
    rows = ambiguous.join(minutes.withColumnRenamed("high", "_h").withColumnRenamed("low", "_l"), [*keys, "bar_opens"])
    up, down = F.min(F.when(F.col("_h") >= F.col("upper"), F.col("opens_at"))), F.min(F.when(F.col("_l") <= F.col("lower"), F.col("opens_at")))
    out = rows.groupBy(*keys, "bar_opens").agg(up.alias("up_at"), down.alias("down_at"))
    return out.withColumn("outcome", F.when(F.col("down_at").isNull() | (F.col("up_at") < F.col("down_at")), F.lit("UP")).when(F.col("up_at").isNull() | (F.col("down_at") < F.col("up_at")), F.lit("DOWN")).otherwise(F.lit("AMBIGUOUS")))


def trade_path(bars: DataFrame, by: list[str], order: str, atr: str, side: int, target: float = 1.0, stop: float = 0.75, horizon: int = 12, slippage: float = 0.0) -> DataFrame:
    """The trade entered at the next bar's open: exit_reason STOP (first, also where both are reached), TARGET or HORIZON, exit_bar, net_points, r_multiple.

    ``side``: 1 long, -1 short. Entry and exit lose ``slippage`` each. Rows without a
    full horizon or without ``atr`` are left out.
    """
    w = W.partitionBy(*by).orderBy(order).rowsBetween(1, horizon)
    rows = bars.withColumn("_next", F.collect_list(F.struct(F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"))).over(w))
    rows = rows.where((F.size("_next") == horizon) & (F.col(atr) > 0)).withColumn("entry", F.col("_next")[0]["o"])
    rows = rows.withColumn("target", F.col("entry") + side * target * F.col(atr)).withColumn("stop", F.col("entry") - side * stop * F.col(atr))
    far, near = ("h", "l") if side > 0 else ("l", "h")
    hit = lambda field, level, above: f"get(filter(transform(_next, (x, i) -> if(x.{field} {'>=' if above else '<='} {level}, i + 1, null)), i -> i is not null), 0)"
    rows = rows.withColumn("_t", F.expr(hit(far, "target", side > 0))).withColumn("_s", F.expr(hit(near, "stop", side < 0)))
    stopped = F.col("_s").isNotNull() & (F.col("_t").isNull() | (F.col("_s") <= F.col("_t")))
    rows = rows.withColumn("exit_reason", F.when(stopped, F.lit("STOP")).when(F.col("_t").isNotNull(), F.lit("TARGET")).otherwise(F.lit("HORIZON")))
    rows = rows.withColumn("exit_bar", F.when(stopped, F.col("_s")).otherwise(F.coalesce("_t", F.lit(horizon))))
    out = F.when(stopped, F.col("stop")).when(F.col("_t").isNotNull(), F.col("target")).otherwise(F.col("_next")[horizon - 1]["c"])
    rows = rows.withColumn("exit", out).withColumn("net_points", side * (F.col("exit") - F.col("entry")) - 2 * slippage)
    return rows.withColumn("r_multiple", F.col("net_points") / (stop * F.col(atr))).withColumn("direction", F.lit("LONG" if side > 0 else "SHORT")).drop("_next", "_t", "_s")


def events(rows: DataFrame, by: list[str], session: str, order: str, setups: dict[str, tuple[Column, int]]) -> DataFrame:
    """Adds setups (those that begin at this row: true now, not at the previous row of the session) and direction; opposite directions wait, order gives priority."""
    w = W.partitionBy(*by, session).orderBy(order)
    rows = rows.withColumns({f"_s{k}": F.coalesce(c, F.lit(False)) for k, (c, _) in enumerate(setups.values())})
    new = [F.when(F.col(f"_s{k}") & ~F.coalesce(F.lag(f"_s{k}").over(w), F.lit(False)), F.struct(F.lit(n).alias("setup"), F.lit(d).alias("direction"))) for k, (n, (_, d)) in enumerate(setups.items())]
    rows = rows.withColumn("_found", F.array_compact(F.array(*new))).drop(*[f"_s{k}" for k in range(len(setups))])
    sides = F.array_distinct("_found.direction")
    rows = rows.withColumn("setup", F.when(F.size(sides) == 1, F.get("_found", 0)["setup"])).withColumn("direction", F.when(F.size(sides) == 1, F.get("_found", 0)["direction"]))
    return rows.withColumn("wait_reason", F.when(F.size("_found") == 0, F.lit("NO_EVENT")).when(F.size(sides) > 1, F.lit("CONFLICTING_DIRECTIONS"))).drop("_found")


#: Three ways to leave a position in parts: shares at targets of so many risks, and where the stop goes after each.
SCALE_OUT = {"single": ((1.0, 1.25),), "halves": ((0.5, 1.25), (0.5, 2.0)), "thirds": ((1 / 3, 1.25), (1 / 3, 2.0), (1 / 3, 3.0))}


def replay_plan(plans: DataFrame, policy: str, slippage: float = 0.0) -> DataFrame:
    """Plays plans (side, trigger, zone, risk, path: array of o, h, l, c) bar by bar: r_multiple, state, exit_bar.

    The trigger must be crossed before the path's end; an open beyond the zone is missed. The
    stop counts first in a bar; reached targets close their share in order, and the stop moves to
    the entry from the bar after the first target. The rest leaves at the last close.
    """
    parts = SCALE_OUT[policy]
    targets = F.array(*[F.struct(F.lit(share).alias("share"), F.lit(at).alias("at")) for share, at in parts])
    rows = plans.withColumn("_targets", targets)
    step = """aggregate(path,
        named_struct('state', 'WAITING', 'entry', cast(null as double), 'stop', cast(null as double), 'done', 0, 'open', 1D, 'r', 0D, 'bar', 0, 'exit_bar', cast(null as int)),
        (a, x) -> case
          when a.state = 'WAITING' and side * (x.o - trigger) > zone then named_struct('state', 'MISSED', 'entry', a.entry, 'stop', a.stop, 'done', 0, 'open', 0D, 'r', 0D, 'bar', a.bar + 1, 'exit_bar', a.bar + 1)
          when a.state = 'WAITING' and not (if(side > 0, x.h >= trigger, x.l <= trigger)) then named_struct('state', 'WAITING', 'entry', a.entry, 'stop', a.stop, 'done', 0, 'open', 1D, 'r', 0D, 'bar', a.bar + 1, 'exit_bar', a.exit_bar)
          when a.state in ('MISSED', 'CLOSED') then a
          else {open} end)"""
    entry = f"coalesce(a.entry, if(side > 0, greatest(x.o, trigger), least(x.o, trigger)) + side * {slippage}D)"
    stop = f"coalesce(a.stop, {entry} - side * risk)"
    hit = f"if(side > 0, x.l <= {stop}, x.h >= {stop})"
    reached = f"size(filter(_targets, (t, i) -> i >= a.done and if(side > 0, x.h >= {entry} + risk * t.at, x.l <= {entry} - risk * t.at)))"
    gained = f"aggregate(slice(_targets, a.done + 1, {reached}), 0D, (s, t) -> s + t.share * t.at)"
    closed = f"aggregate(slice(_targets, a.done + 1, {reached}), 0D, (s, t) -> s + t.share)"
    open_ = f"""case when {hit} then named_struct('state', 'CLOSED', 'entry', {entry}, 'stop', {stop}, 'done', a.done, 'open', 0D, 'r', a.r + a.open * (side * ({stop} - {entry}) - {slippage}D) / risk, 'bar', a.bar + 1, 'exit_bar', a.bar + 1)
        when a.done + {reached} >= size(_targets) then named_struct('state', 'CLOSED', 'entry', {entry}, 'stop', {stop}, 'done', size(_targets), 'open', 0D, 'r', a.r + {gained}, 'bar', a.bar + 1, 'exit_bar', a.bar + 1)
        else named_struct('state', 'OPEN', 'entry', {entry}, 'stop', if(a.done + {reached} > 0, {entry}, {stop}), 'done', a.done + {reached}, 'open', a.open - {closed}, 'r', a.r + {gained}, 'bar', a.bar + 1, 'exit_bar', a.exit_bar) end"""
    rows = rows.withColumn("_a", F.expr(step.format(open=open_)))
    last = F.element_at("path", -1)["c"]
    left = F.when(F.col("_a.state") == "OPEN", F.col("_a.open") * (F.col("side") * (last - F.col("_a.entry")) - slippage) / F.col("risk")).otherwise(F.lit(0.0))
    state = F.when(F.col("_a.state") == "OPEN", F.lit("HORIZON")).when(F.col("_a.state") == "WAITING", F.lit("NOT_TRIGGERED")).otherwise(F.col("_a.state"))
    return rows.withColumn("r_multiple", F.col("_a.r") + left).withColumn("state", state).withColumn("exit_bar", F.coalesce("_a.exit_bar", F.size("path"))).drop("_a", "_targets")
