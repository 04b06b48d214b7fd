"""Queries of research reports: conformal bounds, pooled folds, benchmarks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import research
from .registry import ORDERED, hourly, query, rounded, table
from .replays import _GRID, samples

#: Events as predictions of folds: many residuals and increments tie.
_ROWS = {
    "fold": "event_id % 4", "actual": "round(value)", "predicted": "cast((event_id * 7) % 23 + user_id % 5 as double)", "baseline": "cast(user_id % 6 as double) * 3",
    "incremental": "((event_id * 7) % 11) / cast(4 as double)", "train_mean": "cast(20 as double)",
}
_I = "i AS (SELECT event_id, event_type, " + ", ".join(f"{e} AS {n}" for n, e in _ROWS.items()) + " FROM events)"


def _rows(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", *[F.expr(e).alias(n) for n, e in _ROWS.items()])


@query(f"""WITH {_I}, c AS (SELECT event_type, quantile_cont(actual - predicted, 0.2) AS correction FROM i WHERE fold = 2 GROUP BY 1), j AS (SELECT i.*, correction, predicted + correction AS lower FROM i JOIN c USING (event_type) WHERE fold = 3)
    SELECT event_type, round(max(correction), 9) + 0 AS correction, count(*) AS n, round(avg((actual >= lower)::INT), 9) AS coverage, CASE WHEN avg((actual >= lower)::INT) BETWEEN 0.7 AND 0.95 THEN '' ELSE 'CONFORMAL_COVERAGE_OUTSIDE_GATE' END AS blockers FROM j GROUP BY 1""")
def conformal_coverage(spark, d):
    """Lower bounds by the fifth of residuals of one fold, and how often they hold on the next."""
    _, report = research.conformal(_rows(spark, d), ["event_type"], "fold", 2, 3, "actual", "predicted")
    return rounded(report.withColumn("blockers", F.concat_ws("|", "blockers")), ["correction", "coverage"], 9)


_FOLDS = f"""{_I}, k AS (SELECT *, actual - baseline AS rest, baseline + incremental AS total FROM i),
    m AS (SELECT fold, count(*) AS n, 1 - avg((actual - total) ** 2) / avg(rest ** 2) AS mse_skill, 1 - avg(rest ** 2) / avg((actual - train_mean) ** 2) AS baseline_skill, stddev_pop(incremental) AS incremental_sd, quantile_cont(incremental, 0.8) AS cut FROM k GROUP BY 1),
    a AS (SELECT fold, rank() OVER (PARTITION BY fold ORDER BY rest) + (count(*) OVER (PARTITION BY fold, rest) - 1) / 2 AS x, rank() OVER (PARTITION BY fold ORDER BY incremental) + (count(*) OVER (PARTITION BY fold, incremental) - 1) / 2 AS y FROM k),
    s AS (SELECT fold, corr(x, y) AS spearman FROM a GROUP BY 1), t AS (SELECT fold, count(*) AS top_support, avg(rest) AS top_excess FROM k JOIN m USING (fold) WHERE incremental >= cut GROUP BY 1), f AS (SELECT * FROM m JOIN s USING (fold) JOIN t USING (fold))"""
_MEASURES = ["mse_skill", "baseline_skill", "spearman", "incremental_sd", "top_excess"]


@query(f"WITH {_FOLDS} SELECT fold, n, top_support, {', '.join(f'round({c}, 9) + 0 AS {c}' for c in _MEASURES)} FROM f")
def incremental_folds(spark, d):
    """What a prediction adds to a baseline, by fold, with the top fifth's cohort."""
    out = research.incremental_report(_rows(spark, d), ["fold"], "actual", "baseline", "incremental", "train_mean")
    return rounded(out.select("fold", "n", "top_support", *_MEASURES), _MEASURES, 9)


@query(f"WITH {_FOLDS} SELECT {', '.join(f'round(sum(n * {c}) / sum(n), 9) + 0 AS {c}' for c in _MEASURES)} FROM f")
def incremental_pooled(spark, d):
    """The folds' reports weighted by their cases."""
    out = research.incremental_report(_rows(spark, d), ["fold"], "actual", "baseline", "incremental", "train_mean")
    return rounded(research.pooled(out, [], _MEASURES), _MEASURES, 9)


_LONG, _SHORT = "(((h * 11) % 9) - 4) / cast(10 as double)", "(((h * 5) % 7) - 3) / cast(10 as double)"


def _benchmarks(spark, d):
    w = W.partitionBy("event_type").orderBy("opens_at")
    slope = hourly(spark, d).select("event_type", "opens_at", F.round((F.col("close") - F.lag("close", 10).over(w)) / 10, 9).alias("slope"))
    rows = samples(spark, d).join(slope, ["event_type", "opens_at"])
    rows = rows.withColumn("h", (F.unix_seconds(F.col("opens_at").cast("timestamp")) / 3600).cast("long"))
    rows = rows.withColumn("slope_10_atr", F.col("slope") / F.col("atr")).withColumn("adx_14", F.expr("((h * 7) % 10) / cast(20 as double)"))
    rows = rows.withColumn("long_baseline", F.expr(_LONG)).withColumn("short_baseline", F.expr(_SHORT)).withColumn("day", F.col("opens_at").cast("date").cast("string"))
    paths = F.create_map(F.lit("LONG"), F.try_element_at("paths", F.lit("BUY")), F.lit("SHORT"), F.try_element_at("paths", F.lit("SELL")))
    return research.benchmark_suite(rows.withColumn("paths", paths), ["event_type"], "at", "opens_at", "day")


_SUITE = _GRID.split(", b1 AS")[0].replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + f""", lags AS (SELECT event_type, opens_at, round((close - lag(close, 10) OVER (PARTITION BY event_type ORDER BY opens_at)) / 10, 9) AS slope FROM bars),
    z0 AS (SELECT b0.*, slope / atr AS sl, ((h * 7) % 10) / 20.0 AS adx, {_LONG} AS lb, {_SHORT} AS sb FROM b0 JOIN lags USING (event_type, opens_at)),
    z1 AS (SELECT 'ALWAYS_LONG' AS benchmark, *, 1 AS sd FROM z0 UNION ALL SELECT 'ALWAYS_SHORT', *, -1 FROM z0 UNION ALL SELECT 'TECHNICAL_TREND', *, CASE WHEN sl > 0.1 AND adx >= 0.2 THEN 1 WHEN sl < -0.1 AND adx >= 0.2 THEN -1 END FROM z0
      UNION ALL SELECT 'CAUSAL_TIME_REGIME', *, CASE WHEN lb > greatest(0, sb) THEN 1 WHEN sb > greatest(0, lb) THEN -1 END FROM z0),
    z2 AS (SELECT z1.*, CASE WHEN sd > 0 THEN l.exit_bar ELSE sh.exit_bar END AS k, round(CASE WHEN sd > 0 THEN l.net_points ELSE sh.net_points END / (0.75::DOUBLE * atr), 9) AS r FROM z1 LEFT JOIN l USING (event_type, opens_at) LEFT JOIN sh USING (event_type, opens_at) WHERE sd IS NOT NULL),
    z3 AS (SELECT *, row_number() OVER (PARTITION BY benchmark, event_type ORDER BY t) AS n FROM z2 WHERE k IS NOT NULL AND atr > 0),
    z4 AS (SELECT benchmark, event_type, n, t + to_hours(k::INT) AS until, true AS taken FROM z3 WHERE n = 1 UNION ALL SELECT z3.benchmark, z3.event_type, z3.n, CASE WHEN z3.t >= z4.until THEN z3.t + to_hours(z3.k::INT) ELSE z4.until END, z3.t >= z4.until
      FROM z4 JOIN z3 ON z3.benchmark = z4.benchmark AND z3.event_type = z4.event_type AND z3.n = z4.n + 1), z5 AS (SELECT z3.* FROM z3 JOIN z4 USING (benchmark, event_type, n) WHERE taken)"""


@query(_SUITE + """ SELECT benchmark, count(n) AS n_trades, count(*) FILTER (sd > 0) AS n_buy, count(*) FILTER (sd < 0) AS n_sell, round(avg(r), 6) + 0 AS mean_r, round(coalesce(sum(r), 0), 6) + 0 AS total_r, round(count(n) / (SELECT count(*) FROM z0), 9) AS coverage
    FROM (SELECT unnest(['WAIT', 'ALWAYS_LONG', 'ALWAYS_SHORT', 'TECHNICAL_TREND', 'CAUSAL_TIME_REGIME']) AS benchmark) LEFT JOIN z5 USING (benchmark) GROUP BY 1""")
def benchmark_suite(spark, d):
    """Five fixed rules over the samples of hourly bars."""
    report, _ = _benchmarks(spark, d)
    return rounded(rounded(report, ["mean_r", "total_r"]), ["coverage"], 9)


@query(_SUITE + " SELECT benchmark, opens_at::DATE::VARCHAR AS day, round(sum(r), 6) + 0 AS total_r FROM z5 GROUP BY 1, 2")
def benchmark_days(spark, d):
    """Their totals by day."""
    _, daily = _benchmarks(spark, d)
    return rounded(daily, ["total_r"])
