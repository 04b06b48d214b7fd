"""Small outcome tables."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest

from tickloom.operators import outcomes


def test_assessments_of_replayed_predictions(spark):
    at = dt.datetime(2026, 8, 24, 4, 0)
    rows = [("p1", "l1", at, "UP", "UP"), ("p2", "l2", at, "DOWN", "UP"), ("p3", "l3", at, None, "UP")]
    df = spark.createDataFrame(rows, "prediction_id string, label_id string, window_ends_at timestamp, actual_outcome string, predicted_outcome string")
    got = {r["prediction_id"]: r for r in outcomes.replay_assessments(df).collect()}
    assert {k: r["correct"] for k, r in got.items()} == {"p1": True, "p2": False, "p3": False}
    assert got["p1"]["assessment_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "replay-assessment:p1:l1")) and got["p1"]["assessed_at"] == at


def test_two_successful_sides_are_an_error(spark):
    df = spark.createDataFrame([(True, False), (None, True), (False, None)], "long boolean, short boolean")
    assert [(r["opportunity"], r["long_when_opportunity"]) for r in outcomes.conditional_labels(df, "long", "short").collect()] == [(1, 1), (1, 0), (0, 0)]
    with pytest.raises(Exception, match="two successful sides"):
        outcomes.conditional_labels(spark.createDataFrame([(True, True)], "long boolean, short boolean"), "long", "short").collect()
