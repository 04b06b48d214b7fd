"""Probability calibration: fits on grouped counts or bounded folds, applied as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clip, logit, sigmoid
from ..sources.scratch import staged
from . import chains, metrics


def tempered(columns: list[str], temperature: float | Column, edge: float = 1e-12) -> list[Column]:
    """Softmax of the probabilities' logarithms over the temperature."""
    logs = [F.ln(clip(F.col(c), edge, 1.0)) / temperature for c in columns]
    top = F.greatest(*logs)
    powers = [F.exp(x - top) for x in logs]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def fit_temperature(rows: DataFrame, columns: list[str], actual: str, names: tuple[str, ...], low: float = 0.05, high: float = 20.0, rounds: int = 4, grid: int = 33) -> float:
    """The temperature of least log loss: a grid of logarithms in one aggregation, refined around its best ``rounds`` times.

    Rows of the same probabilities and outcome count once, with their number; all rounds read these counts with their logarithms, staged.
    """
    a, b = math.log(low), math.log(high)
    best = 1.0
    logs = [F.ln(clip(F.col(c), 1e-12, 1.0)) for c in columns]
    own = F.lit(None).cast("double")
    for x, name in zip(logs, names):
        own = F.when(F.col(actual) == name, x).otherwise(own)
    counts = rows.groupBy(*columns, actual).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("n", own.alias("own"), F.greatest(*logs).alias("top"), *[x.alias(f"l{k}") for k, x in enumerate(logs)])
    counts = staged(counts, "counts")
    for _ in range(rounds):
        ts = np.exp(np.linspace(a, b, grid)).tolist()
        tried = counts.select("*", F.posexplode(F.array(*map(F.lit, ts))).alias("k", "t"))
        total = sum((F.exp((F.col(f"l{k}") - F.col("top")) / F.col("t")) for k in range(len(columns))), F.lit(0.0))
        # an outcome without a name has no loss, as one of no probability has the greatest
        loss = -F.ln(F.greatest(F.exp((F.col("own") - F.col("top")) / F.col("t")) / total, F.lit(1e-12)))
        losses = tried.select("k", "n", loss.alias("loss")).groupBy("k").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
        found = losses.agg(F.min_by("k", F.struct("loss", "k"))).first()[0]
        if found is None:
            return 1.0
        best, step = ts[found], (b - a) / (grid - 1)
        a, b = math.log(best) - step, math.log(best) + step
    return best


#: What releases a calibration.
GATE = {
    "fit_share": 0.60, "total": 500, "fit_class": 50, "evaluation_class": 30, "bin": 30, "bins": 2, "ece": 0.05, "skill": 0.0, "slice_ece": 0.10, "slice_skill": -0.10, "slice": 50,
}


def released(rows: DataFrame, order: list[str], columns: list[str], actual: str = "actual", fold: str = "fold_index", temperature: float | None = None, gate: dict = GATE) -> DataFrame:
    """Fits a temperature on the first ``fit_share`` of rows by ``order`` (unless one is given) and judges it on the rest: one row.

    temperature, n_fit, n_evaluation, ece, brier, log_loss, brier_skill (over the fit's class shares), supported_bins, failed_slices, blockers. Every
    fold of the evaluation is a slice with limits of its own; one with too few rows fails.
    """
    names, n = metrics.CLASSES, rows.count()
    at = int(n * gate["fit_share"])
    cut = chains.ranked(rows.select(*order), [], order, "_i", size=n).where(F.col("_i") == at).select(*order).first()
    if cut is None or not at:
        raise ValueError("a calibration needs rows to fit and rows to judge")
    kinds = dict(rows.dtypes)
    later = F.struct(*order) >= F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, cut)])
    fit, rest = rows.where(~later), rows.where(later)
    temperature = fit_temperature(fit, columns, actual, names) if temperature is None else temperature
    shares = fit.agg(*[F.count_if(F.col(actual) == c).alias(c) for c in names], F.count(F.lit(1)).alias("n")).first()
    made, prior = [f"_t{k}" for k in range(len(names))], [f"_p{k}" for k in range(len(names))]
    rest = rest.select("*", *[x.alias(m) for x, m in zip(tempered(columns, temperature), made)], *[F.lit(shares[c] / shares["n"]).alias(p) for c, p in zip(names, prior)])
    rest = rest.withColumn("_top", F.greatest(*made)).withColumn("_right", metrics.argmax(made) == F.col(actual))

    def measured(by: list[str]) -> list:
        own, base = metrics.class_metrics(rest, by, made, actual), metrics.class_metrics(rest, by, prior, actual)
        error = metrics.calibration_error(metrics.calibration_bins(rest, by, "_top", "_right"), by)
        out = own.select(*by, "n", "brier", "log_loss", *[f"support_{c.lower()}" for c in names])
        if by:
            return out.join(base.select(*by, F.col("brier").alias("_base")), by).join(error, by).collect()  # a row a fold
        return out.crossJoin(base.select(F.col("brier").alias("_base"))).crossJoin(error).collect()  # one row each

    (whole,), slices = measured([]), measured([fold])
    raw = metrics.class_metrics(rest, [], columns, actual).first()
    bins = sorted(r["bin"] for r in metrics.calibration_bins(rest, [], "_top", "_right").where(F.col("n") >= gate["bin"]).collect())
    skill = 1 - whole["brier"] / whole["_base"]
    failed = sorted(r[fold] for r in slices if r["n"] < gate["slice"] or r["ece"] > gate["slice_ece"] or 1 - r["brier"] / r["_base"] < gate["slice_skill"])
    found = {
        "INSUFFICIENT_TOTAL_OOS_PREDICTIONS": n < gate["total"], "INSUFFICIENT_CALIBRATION_FIT_CLASS_SUPPORT": any(shares[c] < gate["fit_class"] for c in names),
        "INSUFFICIENT_UNTOUCHED_EVALUATION_CLASS_SUPPORT": any(whole[f"support_{c.lower()}"] < gate["evaluation_class"] for c in names), "ECE_RELEASE_GATE_FAILED": whole["ece"] > gate["ece"],
        "BRIER_SKILL_RELEASE_GATE_FAILED": skill <= gate["skill"], "CALIBRATION_DEGRADATION_GATE_FAILED": whole["brier"] > raw["brier"] or whole["log_loss"] > raw["log_loss"],
        "INSUFFICIENT_DISPLAY_PROBABILITY_BIN_SUPPORT": len(bins) < gate["bins"], "CHRONOLOGICAL_SLICE_STABILITY_GATE_FAILED": bool(failed) or not slices,
    }
    row = (
        float(temperature), shares["n"], whole["n"], whole["ece"], whole["brier"], whole["log_loss"], skill,
        [f"{b / 10:.1f}-{(b + 1) / 10:.1f}" for b in bins], [int(f) for f in failed], [code for code, bad in found.items() if bad],
    )
    schema = "temperature double, n_fit long, n_evaluation long, ece double, brier double, log_loss double, brier_skill double, supported_bins array<string>, failed_slices array<int>, blockers array<string>"
    return rows.sparkSession.createDataFrame([row], schema)


def vector_scaled(columns: list[str], weights: list[float], shifts: list[float], edge: float = 1e-12) -> list[Column]:
    """Softmax of each class's own weight times its probability's logarithm plus its own shift."""
    logs = [F.ln(clip(F.col(c), edge, 1.0)) * w + b for c, w, b in zip(columns, weights, shifts)]
    top = F.greatest(*logs)
    powers = [F.exp(x - top) for x in logs]
    return [p / sum(powers[1:], powers[0]) for p in powers]


def fit_vector(rows: DataFrame, columns: list[str], actual: str, names: tuple[str, ...], ridge: float = 1e-3, rounds: int = 25) -> tuple[list[float], list[float]]:
    """Weights and shifts of ``vector_scaled`` of least log loss, drawn to 1 and 0 by ``ridge`` a row: Newton's method, an aggregation a round."""
    k = len(columns)
    x = rows.select(*[F.ln(clip(F.col(c), 1e-12, 1.0)).alias(f"l{i}") for i, c in enumerate(columns)], *[(F.col(actual) == c).cast("double").alias(f"y{i}") for i, c in enumerate(names)])
    at, rest = np.r_[np.ones(k), np.zeros(k)], np.r_[np.ones(k), np.zeros(k)]
    for _ in range(rounds):
        logs = [F.col(f"l{i}") * float(at[i]) + float(at[k + i]) for i in range(k)]
        top = F.greatest(*logs)
        p = x.select("*", *[F.exp(v - top).alias(f"e{i}") for i, v in enumerate(logs)])
        p = p.select("*", *[(F.col(f"e{i}") / sum((F.col(f"e{j}") for j in range(k)), F.lit(0.0))).alias(f"p{i}") for i in range(k)])
        part = [F.col(f"l{i}") for i in range(k)] + [F.lit(1.0)] * k  # what a parameter multiplies
        slope = [F.sum((F.col(f"p{i % k}") - F.col(f"y{i % k}")) * part[i]).alias(f"g{i}") for i in range(2 * k)]
        bend = [F.sum(F.col(f"p{i % k}") * (float(i % k == j % k) - F.col(f"p{j % k}")) * part[i] * part[j]).alias(f"h{i}_{j}") for i in range(2 * k) for j in range(i, 2 * k)]
        r = p.agg(F.count(F.lit(1)).alias("n"), *slope, *bend).first()
        if not r["n"]:
            break
        g = np.array([r[f"g{i}"] for i in range(2 * k)]) + ridge * r["n"] * (at - rest)
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(2 * k)] for i in range(2 * k)]) + ridge * r["n"] * np.eye(2 * k)
        step = np.linalg.solve(h, g)
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return at[:k].tolist(), at[k:].tolist()


def shrunk(p: Column, prior: float, weight: float) -> Column:
    """Mix of a probability and the prior."""
    return (1 - weight) * p + weight * prior


def fit_shrinkage(rows: DataFrame, p: str, y: str, prior: float, steps: int = 101) -> float:
    """The weight in [0, 1] of least Brier score: its minimum in closed form, rounded to the grid of ``steps``."""
    d, e = F.lit(prior) - F.col(p), F.col(y).cast("double") - F.col(p)
    r = rows.agg(F.sum(d * e).alias("a"), F.sum(d * d).alias("b")).first()
    if not r or not r["b"]:
        return 0.0
    return round(min(1.0, max(0.0, r["a"] / r["b"])) * (steps - 1)) / (steps - 1)


def fit_platt(rows: DataFrame, columns: list[Column], y: str, ridge: float = 1e-6, rounds: int = 25) -> list[float]:
    """Logistic weights of ``columns`` and a constant by Newton's method: each round is one aggregation of a gradient and a Hessian."""
    x = [*columns, F.lit(1.0)]
    n, w = len(x), np.zeros(len(x))
    rows = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], F.col(y).cast("double").alias("y"))
    for _ in range(rounds):
        z = sum((F.col(f"x{i}") * float(w[i]) for i in range(n)), F.lit(0.0))
        p = sigmoid(z)
        gradient = [F.sum((p - F.col("y")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(n)]
        hessian = [F.sum(p * (1 - p) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)]
        r = rows.agg(*gradient, *hessian).first()
        if r is None or r["g0"] is None:
            return w.tolist()
        g, h = np.array([r[f"g{i}"] for i in range(n)]) + ridge * w, np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) + ridge * np.eye(n)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w.tolist()


def platt(p: str, weights: list[float]) -> Column:
    return sigmoid(logit(F.col(p)) * weights[0] + weights[1])


def beta(p: str, weights: list[float]) -> Column:
    q = clip(F.col(p), 1e-9, 1 - 1e-9)
    return sigmoid(F.ln(q) * weights[0] - F.ln(1 - q) * weights[1] + weights[2])


def fit_isotonic(rows: DataFrame, p: str, y: str, steps: int = 1000) -> list[tuple[float, float]]:
    """Pooled steps (score, share) of a monotone fit to counts in ``steps`` bins of the score, so the driver sees a bounded table."""
    b = F.least(F.floor(F.col(p) * steps), F.lit(steps - 1)).cast("int")
    counts = rows.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("x"), F.sum(F.col(y).cast("double")).alias("s")).orderBy("b").collect()
    pools: list[list[float]] = []
    for r in counts:
        pools.append([r["x"] * r["n"], r["n"], r["s"]])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last)]
    return [(x / n, s / n) for x, n, s in pools]


def isotonic(p: Column, pools: list[tuple[float, float]]) -> Column:
    """Lines between the pools' centres, level outside."""
    if not pools:
        return p
    out = F.lit(pools[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(pools, pools[1:]))):
        out = F.when(p <= x1, y0 + (p - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)).otherwise(out)
    return F.when(p <= pools[0][0], F.lit(pools[0][1])).otherwise(out)
