"""Shadow inference: a model's numbers from a file that its hash proves, applied as column expressions, and outcomes when they are due."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import uuid5
from .snapshots import NAMESPACE
from .tracking import minute_outcomes

CLASSES = ("DOWN", "NEITHER", "UP")
#: Barriers in ranges, and minutes until an outcome is due.
BARRIER, HORIZON = 1.5, 60


def signed(artifact: dict) -> dict:
    """The artifact with the hash of its canonical JSON."""
    body = {k: v for k, v in artifact.items() if k != "sha256"}
    return {**body, "sha256": hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()}


def load(spark: SparkSession, path: str, expected: str | None = None) -> dict:
    """A JSON artifact from any path that Spark reads. Its own hash, and the ``expected`` one if given, must hold, and it must be shadow only."""
    artifact = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if signed(artifact)["sha256"] != artifact.get("sha256") or (expected and artifact["sha256"] != expected):
        raise ValueError(f"artifact hash mismatch: {path}")
    if artifact.get("shadow_only") is not True or artifact.get("approved_for_live_inference") is not False:
        raise ValueError(f"artifact is not shadow only: {path}")
    if "coefficients" in artifact:
        names, rows = artifact["feature_names"], artifact["coefficients"]
        sizes = {len(names), len(artifact["scaler_mean"]), len(artifact["scaler_scale"]), *map(len, rows)}
        if len(sizes) != 1 or min(artifact["scaler_scale"]) <= 0 or sorted(artifact["classes"]) != sorted(CLASSES) or len(rows) != len(artifact["classes"]):
            raise ValueError(f"model numbers are invalid: {path}")
    return artifact


def probabilities(model: dict) -> dict[str, Column]:
    """Softmax of the linear scores of standardised features, by class; null where a feature is."""
    logits = {}
    for name, weights, shift in zip(model["classes"], model["coefficients"], model["intercepts"]):
        total = F.lit(float(shift))
        for feature, w, mean, scale in zip(model["feature_names"], weights, model["scaler_mean"], model["scaler_scale"]):
            total = total + (F.col(feature).cast("double") - float(mean)) / float(scale) * float(w)
        logits[name] = total
    top = F.when(_all(logits), F.greatest(*logits.values()))
    parts = {n: F.exp(x - top) for n, x in logits.items()}
    whole = sum(parts.values(), F.lit(0.0))
    return {n: parts[n] / whole for n in CLASSES}


def _all(columns: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in columns.values():
        out = out & c.isNotNull()
    return out


def tempered(p: dict[str, Column], temperature: float) -> dict[str, Column]:
    """Probabilities whose logarithms are divided by ``temperature``."""
    parts = {n: F.pow(F.greatest(c, F.lit(1e-12)), 1 / temperature) for n, c in p.items()}
    whole = sum(parts.values(), F.lit(0.0))
    return {n: c / whole for n, c in parts.items()}


def direction(policy: dict, raw: dict[str, Column], calibrated: dict[str, Column]) -> Column:
    """BUY, SELL or WAIT by the policy's thresholds against the deployment prior; ties of up and down count as BUY."""
    if not policy["shadow_candidate_directions_enabled"]:
        return F.lit("WAIT")
    t, prior = policy["thresholds"], policy["deployment_prior"]
    p = raw if t["score_source"] == "RAW_MODEL_SCORE" else calibrated
    buy = p["UP"] >= p["DOWN"]
    own, other = F.when(buy, p["UP"]).otherwise(p["DOWN"]), F.when(buy, p["DOWN"]).otherwise(p["UP"])
    lift = own - F.when(buy, F.lit(float(prior["UP"]))).otherwise(F.lit(float(prior["DOWN"])))
    ok = (p["NEITHER"] <= t["maximum_neither_score"]) & (own >= t["activation_score"]) & (own - F.greatest(other, p["NEITHER"]) >= t["minimum_class_margin"]) & (lift >= t["minimum_prior_lift"])
    return F.when(ok & buy, F.lit("BUY")).when(ok, F.lit("SELL")).otherwise(F.lit("WAIT"))


def predict(snapshots: DataFrame, model: dict, policy: dict) -> DataFrame:
    """Predictions of snapshots (snapshot_id, checksum, decision_time, data_mode, data_status, blockers, close, atr_14 and the model's features).

    Adds reason. Only rows with reason SHADOW_PREDICTION_RECORDED have a prediction: prediction_id, p_ and calibrated_ probabilities, direction,
    barriers, outcome_due_at; the others say what kept them: the first blocker, the mode, the state, a missing feature or range.
    """
    raw = probabilities(model)
    rows = snapshots.withColumns({f"p_{n.lower()}": c for n, c in raw.items()})
    raw = {n: F.col(f"p_{n.lower()}") for n in CLASSES}
    rows = rows.withColumns({f"calibrated_{n.lower()}": c for n, c in tempered(raw, float(model.get("temperature", 1.0))).items()})
    calibrated = {n: F.col(f"calibrated_{n.lower()}") for n in CLASSES}
    kept = (
        F.when(F.size("blockers") > 0, F.get("blockers", F.lit(0))).when(F.col("data_mode") != "LIVE", F.lit("SHADOW_REQUIRES_LIVE_DATA_MODE"))
        .when(F.col("data_status") != "LIVE", F.concat(F.lit("SHADOW_DATA_STATUS_"), "data_status")).when(raw["UP"].isNull(), F.lit("FEATURES_NOT_READY"))
        .when(F.col("atr_14").isNull(), F.lit("SHADOW_ATR_UNAVAILABLE")).otherwise(F.lit("SHADOW_PREDICTION_RECORDED"))
    )
    said = F.concat_ws(":", F.lit("shadow-prediction"), "snapshot_id", "checksum", F.lit(model["sha256"]), F.lit(policy["sha256"]))
    rows = rows.withColumn("reason", kept).withColumn("direction", direction(policy, raw, calibrated)).withColumn("prediction_id", uuid5(NAMESPACE, said))
    rows = rows.withColumn("up_barrier", F.col("close") + BARRIER * F.col("atr_14")).withColumn("down_barrier", F.col("close") - BARRIER * F.col("atr_14"))
    rows = rows.withColumn("outcome_due_at", F.col("decision_time") + F.expr(f"interval {HORIZON} minutes"))
    made = F.col("reason") == "SHADOW_PREDICTION_RECORDED"
    new = ["prediction_id", "direction", "up_barrier", "down_barrier", "outcome_due_at", *[f"{k}_{n.lower()}" for k in ("p", "calibrated") for n in CLASSES]]
    return rows.withColumns({c: F.when(made, F.col(c)) for c in new})


def assess_due(predictions: DataFrame, assessed: DataFrame, minutes: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Assessments of predictions that are due at ``now`` and have none: the first barrier that their minutes touch, UNASSESSABLE where minutes lack."""
    due = predictions.where(F.col("prediction_id").isNotNull() & (F.col("outcome_due_at") <= now)).dropDuplicates(["prediction_id"])
    due = due.join(assessed.select("prediction_id"), "prediction_id", "left_anti")
    asked = due.select("prediction_id", *keys, F.col("decision_time").alias("made_at"), "close", F.col("atr_14").alias("atr"))
    out = minute_outcomes(asked, minutes, keys, BARRIER, HORIZON)
    quality = F.when(F.col("outcome") == "UNASSESSABLE", F.lit("MISSING_MINUTE_WINDOW")).otherwise(F.lit("ASSESSED"))
    said = F.concat(F.lit("shadow-assessment:"), "prediction_id", F.lit(":1p5-atr-60m-v1"))
    return out.select("prediction_id", *keys, "made_at", "outcome", quality.alias("quality"), uuid5(NAMESPACE, said).alias("assessment_id"))
