"""Findings of the fourth review, each with a small case that showed it."""

from __future__ import annotations

import dataclasses

import duckdb
import numpy as np
import pandas as pd
import pytest

from tickloom import catalog
from tickloom.operators import models
from tickloom.plans import studies
from tickloom.streaming import live


def both(spark, tmp_path, name, events):
    """Rows of a query and of its SQL over a table of events that SQL makes."""
    con = duckdb.connect()
    path = f"{tmp_path}/events.parquet"
    con.sql(f"COPY ({events}) TO '{path}' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    return order(got), order(want.fetchall())


def test_events_of_one_minute_are_compared_with_each_other(spark, tmp_path):
    # three series: many events of a type at one time, some alone, some twice, some without an id, a type or a time
    rows = """SELECT CASE WHEN i % 29 = 0 THEN NULL ELSE i - i % 37 // 36 END AS event_id, CASE WHEN i % 31 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00.25' + INTERVAL 17 minutes * (CASE WHEN i < 250 THEN i * i % 40 ELSE i END) END AS ts, i % 5 AS user_id,
      CASE WHEN i % 23 <> 0 THEN ['error', 'view', 'click'][1 + i % 3] END AS event_type, i / 2 AS value, '{"k": 1}' AS props FROM (SELECT unnest(range(300))::BIGINT AS i)"""
    got, want = both(spark, tmp_path, "stream_finalised_minutes", rows)
    assert got == want and len(got) > 2000 and {r[2] for r in got} == {"NEW", "CORRECTION", "UNCHANGED", "REJECTED"}


class Handle:
    """State of one key outside of Spark."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        pass

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def test_many_versions_of_a_minute_are_counted_in_the_task():
    minutes = live.Minutes(3_600_000, 3_600_000)
    minutes.init(Handle())
    at = pd.Timestamp("2024-01-01")
    polls = pd.DataFrame([(at, at + pd.Timedelta(minutes=k), f"v{i}") for k in range(2) for i in range(20)], columns=["opens_at", "arrived_at", "fingerprint"])
    out = pd.concat(minutes.handleInputRows(("x", 0), iter([polls.iloc[::-1]]), Handle()))
    assert len(out) == 20 + 20 * 2 and set(out["revision"]) == {20}  # and not 40 * 20
    assert out.groupby("action")["_times"].sum().to_dict() == {"CORRECTION": 400, "UNCHANGED": 20, "REJECTED": 380}


@pytest.mark.parametrize("held", [True, False])
def test_boosted_models_take_part_and_the_prior_is_their_measure(spark, held):
    # a trade pays where the signs of two features agree, which no line tells; or where one is positive, and later where it is not
    draw = np.random.default_rng(5)
    rows = []
    for fold in range(5):
        for role, n in (("train", 400), ("test", 120)):
            for i, (a, b) in enumerate(draw.normal(size=(n, 2))):
                pays = (a * b > 0 if held else (a > 0) == (role == "train")) if draw.random() < 0.9 else draw.random() < 0.5
                start = (fold * 1000 + i) * 3_600_000_000
                rows.append((fold, role, "x", float(a), float(b), float(pays), 1.0 if pays else -1.0, start, start + 1))
    folded = spark.createDataFrame(rows, "fold_index int, role string, event_type string, a double, b double, label double, r_multiple double, start_us long, end_us long").coalesce(2).cache()
    short = lambda c: dataclasses.replace(c, options=tuple((k, 8 if k == "rounds" else 0.1 if k == "rate" else v) for k, v in c.options))
    study = dataclasses.replace(studies.STUDY, candidates=tuple(map(short, studies.STUDY.candidates)))
    assert [c.kind for c in study.candidates] == ["prior", "logistic", "elastic_net", "boosted", "boosted"]
    out = models.run_study(folded, study, ["a", "b"], "start_us", "end_us").first()
    assert out["candidate"] != "prior" and out["prior_brier"] == pytest.approx(0.25, abs=0.01)
    assert (out["candidate"].startswith("boosted"), out["brier"] < 0.2, "NO_SKILL_OVER_PRIOR" in out["blockers"]) == ((True, True, False) if held else (False, False, True))
    folded.unpersist()
