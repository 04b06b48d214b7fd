"""Measures of predictions and trades, as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import clip

CLASSES = ("DOWN", "NEITHER", "UP")


def argmax(columns: list[str], names: tuple[str, ...] = CLASSES) -> Column:
    """Name of the largest column, the first on ties."""
    values = F.array(*[F.col(c) for c in columns])
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(values, F.array_max(values)).cast("int"))


def class_metrics(rows: DataFrame, by: list[str], columns: list[str], actual: str = "actual", names: tuple[str, ...] = CLASSES) -> DataFrame:
    """Accuracy, balanced accuracy over classes that occur, Brier score over all classes, and log loss."""
    hit = (argmax(columns, names) == F.col(actual)).cast("double")
    brier = sum(F.pow(F.col(c) - (F.col(actual) == n).cast("double"), 2) for c, n in zip(columns, names))
    own = F.lit(None).cast("double")
    for c, n in zip(columns, names):
        own = F.when(F.col(actual) == n, F.col(c)).otherwise(own)
    rows = rows.select("*", hit.alias("_hit"), brier.alias("_brier"), (-F.ln(F.greatest(own, F.lit(1e-12)))).alias("_loss"))
    recall = [F.avg(F.when(F.col(actual) == n, F.col("_hit"))) for n in names]
    present = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in recall), F.lit(0))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("accuracy"), (sum((F.coalesce(r, F.lit(0.0)) for r in recall), F.lit(0.0)) / present).alias("balanced_accuracy"),
        F.avg("_brier").alias("brier"), F.avg("_loss").alias("log_loss"), *[r.alias(f"recall_{n.lower()}") for r, n in zip(recall, names)],
        *[F.count_if(F.col(actual) == n).alias(f"support_{n.lower()}") for n in names],
    )


def calibration_bins(rows: DataFrame, by: list[str], confidence: str, hit: str, bins: int = 10) -> DataFrame:
    """Counts and means by bin of confidence; bins are closed below, the last on both sides."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(hit).cast("double")).alias("hit_rate"))


def calibration_error(bins: DataFrame, by: list[str]) -> DataFrame:
    """Expected calibration error from ``calibration_bins``."""
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("hit_rate"))) / F.sum("n")).alias("ece"))


def average_ranks(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Adds the rank from 1, the mean rank where values tie: counts by value, then a running sum over distinct values."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn(out, before + (F.col("_n") + 1) / 2).drop("_n")
    return rows.join(counts, [*by, value])


def binary_metrics(rows: DataFrame, by: list[str], score: str, actual: str) -> DataFrame:
    """Brier score, log loss, area under the ROC curve (mean ranks on ties), average precision, and the score's deviation."""
    p, y = clip(F.col(score), 1e-9, 1 - 1e-9), F.col(actual).cast("double")
    loss = -(y * F.ln(p) + (1 - y) * F.ln(1 - p))
    plain = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(score) - y, 2)).alias("brier"), F.avg(loss).alias("log_loss"), F.stddev_pop(score).alias("score_sd"))
    levels = rows.groupBy(*by, score).agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum(y).alias("hits"))
    up, down = W.partitionBy(*by).orderBy(score), W.partitionBy(*by).orderBy(F.desc(score))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    levels = levels.select(
        "*", zero(F.sum("k").over(up.rowsBetween(W.unboundedPreceding, -1))).alias("below"),
        (F.sum("hits").over(down.rowsBetween(W.unboundedPreceding, 0)) / F.sum("k").over(down.rowsBetween(W.unboundedPreceding, 0))).alias("precision"),
    )
    pos, neg = F.sum("hits"), F.sum(F.col("k") - F.col("hits"))
    auc = F.try_divide(F.sum(F.col("hits") * (F.col("below") + (F.col("k") + 1) / 2)) - pos * (pos + 1) / 2, pos * neg)
    curve = levels.groupBy(*by).agg(auc.alias("auc"), F.try_divide(F.sum(F.col("hits") * F.col("precision")), pos).alias("average_precision"))
    return plain.join(curve, by) if by else plain.crossJoin(curve)  # one row each


def rank_correlation(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Spearman's correlation with mean ranks; 0 where one side is constant."""
    ranks = average_ranks(average_ranks(rows, by, a, "_a"), by, b, "_b")
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.corr("_a", "_b"), F.lit(0.0)).alias("spearman"))


def deciles(rows: DataFrame, by: list[str], score: str, value: str) -> DataFrame:
    d = F.least(F.floor(F.col(score) * 10), F.lit(9)).cast("int")
    return rows.groupBy(*by, d.alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"))


def trade_metrics(trades: DataFrame, by: list[str], order: str, points: str = "net_points", r: str = "r_multiple") -> DataFrame:
    """Counts, win rate, profit factor (null unless both wins and losses), largest drawdown from a peak of at least 0, longest losing run, and a normal lower bound of the mean."""
    w = W.partitionBy(*by).orderBy(order)
    rows = trades.withColumn("_cum", F.sum(r).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_win", F.col(points) > 0)
    rows = rows.withColumn("_peak", F.greatest(F.max("_cum").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)))
    rows = rows.withColumn("_run", F.sum(F.col("_win").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_streak", F.count_if(~F.col("_win")).over(W.partitionBy(*by, "_run")))
    won, lost = F.sum(F.when(F.col(points) > 0, F.col(points))), -F.sum(F.when(F.col(points) < 0, F.col(points)))
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        n.alias("n_trades"), F.count_if("_win").alias("n_wins"), F.avg(F.col("_win").cast("double")).alias("win_rate"), F.sum(points).alias("net_points"),
        F.avg(r).alias("mean_r"), F.try_divide(won, lost).alias("profit_factor"), F.max(F.col("_peak") - F.col("_cum")).alias("max_drawdown"),
        F.max("_streak").alias("max_consecutive_losses"), (F.avg(r) - 1.96 * F.coalesce(F.stddev_samp(r), F.lit(0.0)) / F.sqrt(n)).alias("mean_r_lower"),
    )


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's interval of a share; nulls without cases."""
    p = F.try_divide(hits, n)
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    divisor = 1 + z * z / n
    return F.when(n > 0, F.greatest(F.lit(0.0), (middle - half) / divisor)), F.when(n > 0, F.least(F.lit(1.0), (middle + half) / divisor))


def session_bootstrap(sessions: DataFrame, by: list[str], session: str, total: str, count: str, draws: int = 1000, seed: int = 1701, levels: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    """Quantiles of the mean over resampled sessions, from a sum and a count for each session.

    Each draw weights a session by a Poisson(1) number from the MD5 of seed, draw, keys and session, so draws need
    no sample list and every task makes its own. Below two sessions: null.
    """
    draw = F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")
    rows = sessions.select("*", draw)
    digest = F.md5(F.concat_ws("|", F.lit(seed), "draw", *[F.col(c).cast("string") for c in (*by, session)]))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    weight, below, k = F.lit(0), math.exp(-1), 0
    edges, term = [], math.exp(-1)
    while below < 1 - 1e-12 and k < 18:
        edges.append(below)
        k += 1
        term /= k
        below += term
    for e in edges:
        weight += F.when(u >= e, 1).otherwise(0)
    rows = rows.withColumn("_w", weight)
    means = rows.groupBy(*by, "draw").agg(F.try_divide(F.sum(F.col("_w") * F.col(total)), F.sum(F.col("_w") * F.col(count))).alias("mean"), F.count(F.lit(1)).alias("n"))
    cut = F.percentile("mean", F.array(*map(F.lit, levels)))
    out = means.groupBy(*by).agg(F.max("n").alias("n_sessions"), cut.alias("_q"))
    return out.select(*by, "n_sessions", *[F.when(F.col("n_sessions") >= 2, F.col("_q")[i]).alias(f"q_{str(q).replace('0.', '')}") for i, q in enumerate(levels)])


def stability(expected: DataFrame, actual: DataFrame, on: list[str], count: str, edge: float = 1e-12) -> DataFrame:
    """Population stability index and Jensen-Shannon divergence (natural logarithm) of two histograms."""
    a, b = expected.select(*on, F.col(count).cast("double").alias("_a")), actual.select(*on, F.col(count).cast("double").alias("_b"))
    rows = a.join(b, on, "full_outer").fillna(0.0, ["_a", "_b"])
    total = rows.agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"))
    rows = rows.crossJoin(F.broadcast(total))  # one row of totals
    p, q = F.greatest(F.col("_a") / F.col("_ta"), F.lit(edge)), F.greatest(F.col("_b") / F.col("_tb"), F.lit(edge))
    m = (p + q) / 2
    return rows.agg(F.sum((q - p) * F.ln(q / p)).alias("psi"), F.sum(p * F.ln(p / m) / 2 + q * F.ln(q / m) / 2).alias("jsd"))
