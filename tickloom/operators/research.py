"""Reports of research folds: exact quantiles, regression skill, conformal bounds, pooled incremental reports, benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import chains, metrics
from .folds import _position


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], ranges: int = 64) -> DataFrame:
    """Rows (*by, q_0, q_1, ...): exact quantiles with linear interpolation between neighbours, nulls left out.

    Equal values are counted first; distinct values are sorted within ``ranges`` of value (bounds by approximate percentiles),
    and the counts of the ranges before give their ranks, so that neither a hot value nor a whole group meets in one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = counts.agg(F.percentile_approx("_v", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    counts = counts.withColumn("_b", _position(F.col("_v"), sorted(set(cuts))))
    own = counts.groupBy(*by, "_b").agg(F.sum("_n").alias("_k"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    whole = W.partitionBy(*by)
    own = own.select(*by, "_b", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_s"), F.sum("_k").over(whole).alias("_all"))
    within = W.partitionBy(*by, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("_c", F.sum("_n").over(within)).join(own, [*by, "_b"])
    last, first = F.col("_s") + F.col("_c"), F.col("_s") + F.col("_c") - F.col("_n")
    out = []
    for k, q in enumerate(shares):
        at = (F.col("_all") - 1) * q
        low = F.max(F.when((first <= F.floor(at)) & (F.floor(at) < last), F.col("_v")))
        high = F.max(F.when((first <= F.ceil(at)) & (F.ceil(at) < last), F.col("_v")))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(f"q_{k}"))
    return ranked.groupBy(*by).agg(*out)


def regression_report(rows: DataFrame, by: list[str], actual: str, predicted: str, baseline: str) -> DataFrame:
    """Counts, means, deviation of predictions, absolute and squared errors, their skill against a baseline, and Spearman's correlation.

    Skill is 1 - mse / baseline's mse, and -1 where the baseline is exact.
    """
    a, p, b = (F.col(c) for c in (actual, predicted, baseline))
    plain = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("actual_mean"), F.avg(p).alias("predicted_mean"), F.stddev_pop(p).alias("predicted_sd"),
        F.avg(F.abs(a - p)).alias("mae"), F.avg(F.pow(a - p, 2)).alias("mse"), F.avg(F.pow(a - b, 2)).alias("baseline_mse"),
    )
    skill = F.when(F.col("baseline_mse") > 0, 1 - F.col("mse") / F.col("baseline_mse")).otherwise(F.lit(-1.0))
    ranks = metrics.rank_correlation(rows, by, actual, predicted).select(*by, "spearman")
    return plain.withColumn("mse_skill", skill).join(ranks, by)


def conformal(rows: DataFrame, by: list[str], fold: str, fit_fold: int, check_fold: int, actual: str, predicted: str, share: float = 0.20, gate: tuple[float, float] = (0.70, 0.95)) -> tuple[DataFrame, DataFrame]:
    """(bounded, report): ``rows`` with lower, the prediction plus the ``share`` quantile of the residuals of ``fit_fold``, and how often it held.

    The report has for each of ``by`` the correction, the cases and the coverage of ``check_fold``, and a code where coverage lies outside
    ``gate``. Without residuals lower and coverage are null, and the code is there.
    """
    residual = rows.where(F.col(fold) == fit_fold).withColumn("_r", F.col(actual) - F.col(predicted))
    shift = quantiles(residual, by, "_r", [share]).withColumnRenamed("q_0", "correction")
    bounded = rows.join(shift, by, "left").withColumn("lower", F.col(predicted) + F.col("correction"))
    held = bounded.where(F.col(fold) == check_fold)
    report = held.groupBy(*by).agg(F.max("correction").alias("correction"), F.count(F.lit(1)).alias("n"), F.avg((F.col(actual) >= F.col("lower")).cast("double")).alias("coverage"))
    bad = ~F.coalesce(F.col("coverage").between(*gate), F.lit(False))
    return bounded.drop("correction"), report.withColumn("blockers", F.array_compact(F.array(F.when(bad, F.lit("CONFORMAL_COVERAGE_OUTSIDE_GATE")))))


def incremental_report(rows: DataFrame, by: list[str], actual: str, baseline: str, incremental: str, train_mean: str, top: float = 0.2) -> DataFrame:
    """A row for each of ``by`` (a fold): what a prediction adds to a baseline.

    Skill of baseline + incremental against the baseline, skill of the baseline against the training mean, Spearman's correlation of
    the increment with what the baseline leaves, its deviation, and the mean of what is left in the cohort whose increment
    reaches the 1 - ``top`` quantile (all that tie with it are in).
    """
    rows = rows.withColumn("_total", F.col(baseline) + F.col(incremental)).withColumn("_left", F.col(actual) - F.col(baseline))
    model = regression_report(rows, by, actual, "_total", baseline).select(*by, "n", "mse_skill")
    mean = F.when(F.avg(F.pow(F.col(actual) - F.col(train_mean), 2)) > 0, 1 - F.avg(F.pow("_left", 2)) / F.avg(F.pow(F.col(actual) - F.col(train_mean), 2))).otherwise(F.lit(-1.0))
    plain = rows.groupBy(*by).agg(mean.alias("baseline_skill"), F.stddev_pop(incremental).alias("incremental_sd"))
    ranks = metrics.rank_correlation(rows, by, "_left", incremental).select(*by, "spearman")
    cut = quantiles(rows, by, incremental, [1.0 - top])
    cohort = rows.join(cut, by).where(F.col(incremental) >= F.col("q_0")).groupBy(*by).agg(F.count(F.lit(1)).alias("top_support"), F.avg("_left").alias("top_excess"))
    out = model
    for t in (plain, ranks, cohort):
        out = out.join(t, by)
    return out


def pooled(reports: DataFrame, by: list[str], columns: list[str], weight: str = "n") -> DataFrame:
    """Means of reports' columns, weighted by their cases."""
    return reports.groupBy(*by).agg(*[(F.sum(F.col(weight) * F.col(c)) / F.sum(weight)).alias(c) for c in columns])


#: What a benchmark asks of a sample, LONG first.
BENCHMARKS: dict[str, tuple[str, str]] = {
    "WAIT": ("false", "false"),
    "ALWAYS_LONG": ("true", "false"),
    "ALWAYS_SHORT": ("false", "true"),
    "TECHNICAL_TREND": ("slope_10_atr > 0.10 and adx_14 >= 0.20", "slope_10_atr < -0.10 and adx_14 >= 0.20"),
    "CAUSAL_TIME_REGIME": ("long_baseline > greatest(0, short_baseline)", "short_baseline > greatest(0, long_baseline)"),
}


def benchmark_suite(rows: DataFrame, by: list[str], at: str, tie: str, session: str, benchmarks: dict[str, tuple[str, str]] = BENCHMARKS) -> tuple[DataFrame, DataFrame]:
    """(report, daily): what fixed rules would have made of the same samples, a row a benchmark, and their totals by session.

    ``rows`` have the columns that the rules ask for, and ``paths``: a map of LONG and SHORT to a struct (exit_at, r_multiple). A rule takes a
    sample if the path before it in the series has ended. A benchmark without trades has nulls for means.
    """
    samples = chains.staged(rows.withColumn("_at", chains.number(rows, at)), "samples")
    n = samples.count()
    asked = []
    for name, (long, short) in benchmarks.items():
        side = F.when(F.expr(long), F.lit("LONG")).when(F.expr(short), F.lit("SHORT"))
        asked.append(F.when(side.isNotNull(), F.struct(F.lit(name).alias("benchmark"), side.alias("direction"))))
    chosen = samples.select(*by, tie, "_at", F.col(session).alias("_day"), "paths", F.inline(F.array_compact(F.array(*asked))))
    path = F.try_element_at("paths", F.col("direction"))
    chosen = chosen.select(*by, tie, "_at", "_day", "benchmark", "direction", F.unix_micros(path["exit_at"].cast("timestamp")).alias("_exit"), path["r_multiple"].alias("r"))
    taken = chains.non_overlapping(chosen.where(F.col("_exit").isNotNull()), ["benchmark", *by], "_at", "_exit").where("taken")
    report = taken.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("n_trades"), F.count_if(F.col("direction") == "LONG").alias("n_buy"), F.count_if(F.col("direction") == "SHORT").alias("n_sell"), F.avg("r").alias("mean_r"), F.sum("r").alias("total_r"),
    )
    names = rows.sparkSession.createDataFrame([(b,) for b in benchmarks], "benchmark string")
    report = names.join(report, "benchmark", "left").fillna(0, ["n_trades", "n_buy", "n_sell"]).fillna(0.0, ["total_r"])
    daily = taken.groupBy("benchmark", F.col("_day").alias(session)).agg(F.sum("r").alias("total_r"))
    return report.withColumn("coverage", F.try_divide(F.col("n_trades"), F.lit(n))), daily

