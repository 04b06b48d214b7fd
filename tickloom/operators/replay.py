"""Policies replayed over a history: signals that stay active until they expire, and grids of policies over one set of trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import codes
from . import chains, folds


def confidence_bin(p: Column) -> Column:
    """The tenth of 0 to 1 that holds a probability, as text."""
    k = F.least(F.floor(p * 10), F.lit(9)).cast("double")
    return F.concat(F.format_string("%.1f", k / 10), F.lit("-"), F.format_string("%.1f", (k + 1) / 10))


def policy_replay(rows: DataFrame, by: list[str], at: str, tie: str, bar_minutes: int = 5, policy: dict = folds.POLICY, block: int = chains.BLOCK) -> DataFrame:
    """Adds active_side, expires_at and what ``folds.signal`` decides of predictions in order of (``at``, ``tie``), a series each.

    A signal is active until ``expiry_bars`` bars after it. While it is, one of its own side renews it and one of the other
    side waits. Needs what ``folds.signal`` needs but for active_side; rows without a time are left out.
    """
    until = F.col(at) + F.expr(f"interval {policy['expiry_bars'] * bar_minutes} minutes")
    free = folds.signal(rows.withColumn("active_side", F.lit(None).cast("string")), policy)
    free = free.select(*rows.columns, F.when(F.col("decision") != "WAIT", F.col("decision")).alias("_free"), until.alias("expires_at"))
    out = chains.emitted(free, by, at, tie, "_free", "expires_at", block)
    return folds.signal(out, policy).drop("_free", "emitted", "active_until")


#: Fixed values of the grid: the scores that a policy reads, and its thresholds.
GRID = {
    "source": ("RAW_MODEL_SCORE", "CALIBRATED_PROBABILITY"),
    "activation": (0.38, 0.40, 0.425, 0.45, 0.475, 0.50),
    "margin": (0.02, 0.04, 0.06, 0.08),
    "neither": (0.35, 0.40, 0.45),
    "lift": (0.00, 0.02, 0.04),
}
#: Least trades, and least trades of a direction, of the selection and of the evaluation.
LEAST = {"SELECTION": (30, 5), "EVALUATION": (20, 3)}


def policies(spark: SparkSession, grid: dict = GRID) -> DataFrame:
    """The grid's policies with their place in it; as many rows as the grid has, whatever the data."""
    out = spark.range(1)
    for name, values in grid.items():
        out = out.select("*", F.posexplode(F.array(*map(F.lit, values))).alias(f"_{name}", name))
    place = F.lit(0)
    for name, values in grid.items():
        place = place * len(values) + F.col(f"_{name}")
    return out.select(place.cast("long").alias("policy"), *grid)


def offers(rows: DataFrame, grid: dict = GRID) -> DataFrame:
    """``rows`` once for each policy of the grid that gives them a direction: adds ``policy``, its place in the grid, and direction (BUY or SELL).

    Needs ``scores``, a map of source to a struct (down, neither, up), and ``prior``, a struct (down, up), which are left out. Each
    threshold leaves an array of those values that the row meets, so no row meets a policy in vain and there is no join.
    """
    keep = [c for c in rows.columns if c not in ("scores", "prior")]
    one = F.array(*[F.struct(F.lit(i).alias("i"), F.try_element_at("scores", F.lit(name)).alias("s")) for i, name in enumerate(grid["source"])])
    out = rows.select(*keep, "prior", F.inline(F.filter(one, lambda x: x["s"].isNotNull()))).withColumnRenamed("i", "policy")
    up, down, neither = F.col("s.up"), F.col("s.down"), F.col("s.neither")
    buy = up >= down
    own, other = F.when(buy, up).otherwise(down), F.when(buy, down).otherwise(up)
    before = F.when(buy, F.col("prior.up")).otherwise(F.col("prior.down"))
    asked = {"activation": own, "margin": own - F.greatest(other, neither), "neither": -neither, "lift": own - before}
    out = out.select(*keep, "policy", F.when(buy, F.lit("BUY")).otherwise(F.lit("SELL")).alias("direction"), *[x.alias(f"_{n}") for n, x in asked.items()])
    for name in asked:
        least = [-v if name == "neither" else v for v in grid[name]]
        met = F.array(*[F.when(F.col(f"_{name}") >= v, F.lit(i)) for i, v in enumerate(least)])
        out = out.withColumn("_i", F.explode(F.array_compact(met))).withColumn("policy", F.col("policy") * len(least) + F.col("_i"))
    return out.withColumn("policy", F.col("policy").cast("long")).select(*keep, "policy", "direction")


def replay_grid(rows: DataFrame, by: list[str], at: str, tie: str, grid: dict = GRID, block: int = chains.BLOCK) -> tuple[DataFrame, DataFrame]:
    """(trades, metrics): what each policy of the grid takes of ``rows``, and a row of metrics a policy.

    ``rows`` have ``scores`` and ``prior`` (``offers``), and ``paths``: a map of direction to a struct (exit_at,
    exit_reason, net_points, r_multiple), null where the path is not whole, the map null where there is no entry or range. In order of (``at``,
    ``tie``) a policy takes a row if the trade before it in the series has left; all policies' chains are followed in one plan.
    Waits: rows under an open trade, without a direction, without an input, without a whole path.
    """
    spark, key = rows.sparkSession, ["policy", *by]
    rows = chains.staged(rows.withColumn("_at", chains.number(rows, at)), "samples")
    n, width = rows.count(), chains.bin_width(rows, "_at")
    ends = [F.unix_micros(F.try_element_at("paths", F.lit(side))["exit_at"].cast("timestamp")).alias(side) for side in ("BUY", "SELL")]
    narrow = rows.select(*by, tie, "_at", "scores", "prior", F.col("paths").isNotNull().alias("_input"), *ends)
    offered = offers(narrow, grid).withColumn("_exit", F.when(F.col("direction") == "BUY", F.col("BUY")).otherwise(F.col("SELL"))).drop("BUY", "SELL")
    offered = chains.staged(offered, "offers")
    played = offered.where(F.col("_exit").isNotNull()).select(*key, tie, "_at", "_exit", "direction")
    taken = chains.staged(chains.non_overlapping(played, key, "_at", "_exit", block=block).where("taken").drop("taken"), "trades")
    # samples under an open trade: those that start before it leaves, less those up to it
    place = chains.placed(rows.select(*by, tie, "_at"), by, ["_at", tie], "_place", width).select(*by, tie, "_place")
    asked = rows.select(*by, F.col("_at").alias("_m"), F.lit(True).alias("_here"))
    asked = asked.unionByName(taken.select(*by, F.col("_exit").alias("_m"), F.lit(False).alias("_here")).distinct()).withColumn("_at", F.col("_m"))
    before = chains.counted_before(asked, by, "_at", "_m", "_before", width, also="_here").where("not _here").select(*by, F.col("_m").alias("_exit"), "_before")
    covered = taken.join(before, [*by, "_exit"]).join(place, [*by, tie])
    covered = covered.groupBy("policy").agg(F.sum(F.col("_before") - F.col("_place") - 1).alias("n_active"))
    # offers without a whole path wait for that, unless a trade is open
    marks = offered.where(F.col("_exit").isNull()).select(*key, tie, "_at", "_exit", "_input")
    marks = marks.unionByName(taken.select(*key, tie, "_at", "_exit", F.lit(True).alias("_input")))
    marks = chains.last_before(marks, key, ["_at", tie], F.col("_exit"), "_open", width)
    lost = marks.where(F.col("_exit").isNull() & ~F.coalesce(F.col("_at") < F.col("_open"), F.lit(False)))
    lost = lost.groupBy("policy").agg(F.count_if(~F.col("_input")).alias("n_no_input"), F.count_if("_input").alias("n_no_path"))
    path = F.element_at("paths", F.col("direction"))
    trades = taken.join(rows.select(*by, tie, at, "paths"), [*by, tie])
    trades = trades.select(*key, tie, at, "direction", *[path[c].alias(c) for c in ("exit_at", "exit_reason", "net_points", "r_multiple")])
    out = policies(spark, grid)
    for t in (policy_metrics(trades, at, [*by, tie]), covered, lost):
        out = out.join(t, "policy", "left")
    counts = ("n_trades", "n_buy", "n_sell", "n_target", "n_stop", "n_horizon", "n_active", "n_no_input", "n_no_path")
    out = out.fillna(0, list(counts)).fillna(0.0, ["net_points", "max_drawdown"]).withColumn("n_decisions", F.lit(n))
    wait = F.col("n_decisions") - F.col("n_trades") - F.col("n_active") - F.col("n_no_input") - F.col("n_no_path")
    return trades, out.withColumn("n_wait", wait).withColumn("coverage", F.try_divide(F.col("n_trades"), F.col("n_decisions")))


def policy_metrics(trades: DataFrame, at: str, ties: list[str]) -> DataFrame:
    """A row of metrics for each policy that has trades, pooled over series in order of time.

    The lower bound of the mean needs two trades, the profit factor wins and losses. The largest drawdown is made of sums of days:
    a day's own course, set upon what the days before add up to and the peak that they reached.
    """
    day = F.to_date(at).alias("_day")
    w = W.partitionBy("policy", "_day").orderBy(at, *ties)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    rows = trades.select("*", day).withColumn("_cum", F.sum("r_multiple").over(run)).withColumn("_high", F.max("_cum").over(run))
    days = rows.groupBy("policy", "_day").agg(F.sum("r_multiple").alias("_sum"), F.max("_cum").alias("_top"))
    past = W.partitionBy("policy").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)  # a row a day
    days = days.withColumn("_base", F.coalesce(F.sum("_sum").over(past), F.lit(0.0)))
    days = days.withColumn("_peak", F.greatest(F.coalesce(F.max(F.col("_base") + F.col("_top")).over(past), F.lit(0.0)), F.lit(0.0)))
    rows = rows.join(days.select("policy", "_day", "_base", "_peak"), ["policy", "_day"])
    fall = F.greatest(F.col("_peak"), F.col("_base") + F.col("_high")) - F.col("_base") - F.col("_cum")
    won, lost = F.sum(F.when(F.col("net_points") > 0, F.col("net_points"))), -F.sum(F.when(F.col("net_points") < 0, F.col("net_points")))
    n, mean = F.count(F.lit(1)), F.avg("r_multiple")
    reason = lambda r: F.count_if(F.col("exit_reason") == r)
    return rows.groupBy("policy").agg(
        n.alias("n_trades"), F.count_if(F.col("direction") == "BUY").alias("n_buy"), F.count_if(F.col("direction") == "SELL").alias("n_sell"),
        reason("TARGET").alias("n_target"), reason("STOP").alias("n_stop"), reason("HORIZON").alias("n_horizon"),
        F.avg((F.col("net_points") > 0).cast("double")).alias("win_rate"), F.sum("net_points").alias("net_points"), mean.alias("mean_r"),
        F.when(n > 1, mean - 1.96 * F.stddev_samp("r_multiple") / F.sqrt(n)).alias("mean_r_lower"), F.try_divide(won, lost).alias("profit_factor"),
        F.greatest(F.max(fall), F.lit(0.0)).alias("max_drawdown"),
    )


def policy_blockers(stage: str) -> Column:
    """Codes that keep a policy's metrics from passing a stage (SELECTION or EVALUATION)."""
    least, each = LEAST[stage]
    unknown = lambda bad: F.coalesce(bad, F.lit(True))
    pairs = [
        (F.col("n_trades") < least, "TRADE_COUNT_TOO_LOW"), (F.col("n_buy") < each, "BUY_SUPPORT_TOO_LOW"), (F.col("n_sell") < each, "SELL_SUPPORT_TOO_LOW"),
        (unknown(F.col("mean_r") <= 0), "AVERAGE_R_NOT_POSITIVE"), (unknown(F.col("profit_factor") <= 1.0), "PROFIT_FACTOR_NOT_ABOVE_ONE"),
    ]
    if stage == "SELECTION":
        pairs.append((unknown(F.col("mean_r_lower") <= -0.10), "DOWNSIDE_CONFIDENCE_GATE_FAILED"))
    return codes(*[(c, f"{stage}_{code}") for c, code in pairs])


def leader(metrics: DataFrame) -> DataFrame:
    """The one policy of a grid's metrics that leads: among those without selection blockers, or among all where none is.

    Order: lower bound of the mean, profit factor, trades, mean, then the grid's own; unknown and zero bounds and means count as -999. Numbers are
    compared to nine digits, so that policies with the same trades are equal.
    """
    rated = metrics.withColumn("blockers", policy_blockers("SELECTION"))
    worst = lambda c: F.coalesce(F.nullif(F.round(c, 9), F.lit(0.0)), F.lit(-999.0))
    order = [F.size("blockers") == 0, worst("mean_r_lower"), F.coalesce(F.round("profit_factor", 9), F.lit(0.0)), F.col("n_trades"), worst("mean_r"), -F.col("policy")]
    return rated.orderBy(*[c.desc() for c in order]).limit(1)


def select_policy(selection: DataFrame, evaluation: DataFrame, by: list[str], at: str, tie: str, grid: dict = GRID, block: int = chains.BLOCK) -> DataFrame:
    """One row: the policy that leads the grid on ``selection``, its metrics on ``evaluation``, both stages' blockers, and how many passed.

    Both are rows of ``replay_grid``; only the chosen policy is replayed on the second. ``mode`` is WAIT_ONLY unless both stages pass.
    """
    _, metrics = replay_grid(selection, by, at, tie, grid, block)
    metrics = chains.staged(metrics, "grid")
    best = leader(metrics).first()
    own = {name: (best[name],) for name in grid}
    _, final = replay_grid(evaluation, by, at, tie, own, block)
    passing = metrics.where(F.size(policy_blockers("SELECTION")) == 0).count()
    out = final.drop("policy").withColumn("evaluation_blockers", policy_blockers("EVALUATION"))
    out = out.withColumn("policy", F.lit(best["policy"])).withColumn("selection_blockers", F.array(*map(F.lit, best["blockers"])).cast("array<string>"))
    free = (F.size("evaluation_blockers") == 0) & (F.size("selection_blockers") == 0)
    return out.withColumn("n_passing", F.lit(passing)).withColumn("mode", F.when(free, F.lit("SHADOW_CANDIDATES")).otherwise(F.lit("WAIT_ONLY")))
