"""Candidate models in pyspark.ml, and one experiment template for all studies."""

from __future__ import annotations

import dataclasses
import functools
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import codes
from ..sources.scratch import staged
from . import calibration, labels, metrics

SEED = 1701


@dataclasses.dataclass(frozen=True)
class Candidate:
    """A model: ``kind`` one of prior, logistic, elastic_net, boosted, ridge, boosted_regression, trees.

    Options: l2 and mix of linear models; rounds, depth, rate, leaf (least rows) and bins of boosted ones; trees and depth.
    """

    name: str
    kind: str
    options: tuple[tuple[str, float], ...] = ()


def _stages(candidate: Candidate, features: list[str], label: str, weight: str | None):
    o = dict(candidate.options)
    common = {"featuresCol": "_x", "labelCol": label, "predictionCol": "_prediction"} | ({"weightCol": weight} if weight else {})
    classes = common | {"rawPredictionCol": "_raw", "probabilityCol": "_probability"}
    boosting = {"maxIter": int(o.get("rounds", 20)), "maxDepth": int(o.get("depth", 3)), "stepSize": o.get("rate", 0.1), "minInstancesPerNode": int(o.get("leaf", 1)), "maxBins": int(o.get("bins", 255)), "seed": SEED}
    model = {
        "logistic": lambda: LogisticRegression(**classes, regParam=o.get("l2", 1e-3)), "elastic_net": lambda: LogisticRegression(**classes, regParam=o.get("l2", 1e-3), elasticNetParam=o.get("mix", 0.5)),
        "boosted": lambda: GBTClassifier(**common, **boosting).setRawPredictionCol("_raw").setProbabilityCol("_probability"), "ridge": lambda: LinearRegression(**common, regParam=o.get("l2", 1e-3), solver="normal"),
        "boosted_regression": lambda: GBTRegressor(**common, **boosting), "trees": lambda: RandomForestRegressor(**common, numTrees=int(o.get("trees", 30)), maxDepth=int(o.get("depth", 5)), seed=SEED),
    }[candidate.kind]()
    return [VectorAssembler(inputCols=features, outputCol="_raw_x", handleInvalid="error"), StandardScaler(inputCol="_raw_x", outputCol="_x", withMean=True), model]


def predicted(train: DataFrame, test: DataFrame, candidate: Candidate, features: list[str], label: str = "label", weight: str | None = None) -> DataFrame:
    """``test`` with score: the probability of label 1, or the regression's value."""
    if candidate.kind == "prior":
        w = F.col(weight) if weight else F.lit(1.0)
        share = train.agg(F.try_divide(F.sum(w * F.col(label)), F.sum(w))).first()[0]
        return test.withColumn("score", F.lit(float(share or 0.0)))
    out = Pipeline(stages=_stages(candidate, features, label, weight)).fit(train).transform(test)
    score = vector_to_array("_probability")[1] if "_probability" in out.columns else F.col("_prediction")
    return out.select(*test.columns, score.alias("score"))


def walk(folded: DataFrame, fits: list[tuple[Candidate, int]], features: list[str], label: str = "label", weight: str | None = None, parallel: int = 4) -> list[DataFrame]:
    """For each candidate and fold the predictions of the fold's test rows (rows of ``folds.walk_forward``), fitted on its own training rows.

    Fits are Spark jobs over a fold's rows; ``parallel`` of them run side by side. Predictions are staged, so the driver keeps no model and
    later plans hold none.
    """

    def one(fit: tuple[Candidate, int]) -> DataFrame:
        rows = folded.where(F.col("fold_index") == fit[1])
        return staged(predicted(rows.where("role = 'train'"), rows.where("role = 'test'"), fit[0], features, label, weight), "predictions")

    with ThreadPool(max(1, min(parallel, len(fits)))) as pool:
        return pool.map(inheritable_thread_target(folded.sparkSession)(one), fits)


@dataclasses.dataclass(frozen=True)
class Study:
    """Roles of folds and the policy grid of an experiment."""

    candidates: tuple[Candidate, ...]
    select: tuple[int, ...]
    calibrate: int
    policy: int
    diagnose: tuple[int, ...]
    thresholds: tuple[float, ...] = (0.5, 0.55, 0.6)
    least_trades: int = 5


def run_study(folded: DataFrame, study: Study, features: list[str], start: str, end: str, r: str = "r_multiple", label: str = "label", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Select on some folds, calibrate on the next, choose a policy on another, diagnose on the last: one report row.

    The best candidate has the least (Brier, log loss) on the selection folds. A prior is what models are measured by: it is chosen only where
    there is no other candidate, and a model that is no better than it is blocked. The policy is the threshold of the largest mean ``r`` of trades
    that do not overlap, among those with enough trades. The report never releases anything: released is false.
    """
    spark = folded.sparkSession
    fits = [(c, k) for c in study.candidates for k in study.select]
    scored = None
    for (c, _), p in zip(fits, walk(folded, fits, features, label)):
        p = p.select(F.lit(c.name).alias("name"), "score", label)
        scored = p if scored is None else scored.unionByName(p)
    table = {r["name"]: r for r in metrics.binary_metrics(scored, ["name"], "score", label).collect()}  # a row a candidate
    prior = next((table[c.name]["brier"] for c in study.candidates if c.kind == "prior" and c.name in table), None)
    chosen = min((c for c in study.candidates if c.name in table), key=lambda c: (c.kind == "prior", table[c.name]["brier"], table[c.name]["log_loss"], c.name))
    best = table[chosen.name]
    unskilled = chosen.kind == "prior" or (prior is not None and best["brier"] >= prior)
    later = [study.calibrate, study.policy, *study.diagnose]
    predictions = dict(zip(later, walk(folded, [(chosen, k) for k in later], features, label)))
    fit = predictions[study.calibrate]
    pools = calibration.fit_isotonic(fit.withColumn("score", F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0))), "score", label)

    def trades(indexes: list[int], thresholds: tuple[float, ...]) -> DataFrame:
        rows = functools.reduce(DataFrame.unionByName, [predictions[k] for k in indexes]).withColumn("p", calibration.isotonic(F.col("score"), pools))
        rows = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where("p >= threshold")
        return labels.non_overlapping(rows, ["threshold", *by], start, end).where("taken")

    means = trades([study.policy], study.thresholds).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean_r")).where(F.col("n") >= study.least_trades)
    policy = means.orderBy(F.desc("mean_r"), "threshold").limit(1).collect()
    if not policy:
        blockers = ["NO_VIABLE_POLICY", *(["NO_SKILL_OVER_PRIOR"] if unskilled else [])]
        schema = "candidate string, brier double, prior_brier double, threshold double, n_trades long, mean_r double, blockers array<string>, released boolean"
        return spark.createDataFrame([(chosen.name, best["brier"], prior, None, 0, None, blockers, False)], schema)
    final = trades(list(study.diagnose), (policy[0]["threshold"],)).agg(F.count(F.lit(1)).alias("n_trades"), F.avg(r).alias("mean_r"))
    out = final.select(F.lit(chosen.name).alias("candidate"), F.lit(best["brier"]).alias("brier"), F.lit(prior).cast("double").alias("prior_brier"), F.lit(policy[0]["threshold"]).alias("threshold"), "n_trades", "mean_r")
    blockers = codes((F.col("n_trades") < study.least_trades, "TOO_FEW_TRADES"), (F.coalesce("mean_r", F.lit(0.0)) <= 0, "NO_POSITIVE_EXPECTATION"), (F.lit(unskilled), "NO_SKILL_OVER_PRIOR"))
    return out.withColumn("blockers", blockers).withColumn("released", F.lit(False))


def with_design(rows: DataFrame, features: list[str]) -> DataFrame:
    """Both sides stacked: side 1 and -1, and each feature times the side."""
    out = rows.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    return out.withColumns({f"{f}__side": F.col(f) * F.col("side") for f in features})
