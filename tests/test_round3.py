"""Findings of the third review, each with a small case that showed it."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom import catalog
from tickloom.llm import ominhash
from tickloom.operators import audit, calibration, chains, folds, tracking
from tickloom.streaming import live

DAY = dt.datetime(2024, 1, 1)


def events(spark, path, rows):
    """A folder with a table of events (event_id, ts, user_id, event_type, value) in one file."""
    made = spark.createDataFrame([(*r, "{}") for r in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    made.toPandas().to_parquet(f"{path}/events.parquet", coerce_timestamps="us", index=False)
    return str(path)


def oracle(path, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return con.sql(catalog.oracle_sql()[name])


def test_circuit_breaker_rounds_seconds_as_its_sql_does(spark, tmp_path):
    rows = [(u * 10 + k, DAY + dt.timedelta(seconds=k, microseconds=600_000), u, "error", 1.0) for u in range(4) for k in range(3)]
    # a day, and a little more or less, behind the last failure
    rows += [(u * 10 + 9, DAY + dt.timedelta(days=1, seconds=2, microseconds=600_000 + x), u, "error", 1.0) for u, x in enumerate((-200_000, 200_000, -500_000, 99_999))]
    path = events(spark, tmp_path, rows)
    got = sorted((r["event_id"], r["open"]) for r in catalog.queries()["circuit_breaker"](spark, path).collect())
    assert got == sorted(oracle(path, "circuit_breaker").fetchall()) and {o for _, o in got} == {True, False}


def test_circuit_breaker_orders_calls_of_one_time(spark):
    rows = [(i, DAY, i > 2) for i in range(6)]
    df = spark.createDataFrame(rows[::-1], "i int, t timestamp, ok boolean").withColumn("k", F.lit(1)).repartition(3, "i")
    out = tracking.circuit_breaker(df, ["k"], "t", "ok", tie=("i",)).orderBy("i").collect()
    assert [r["open"] for r in out] == [False, False, False, True, False, False]


class Handle:
    """State of one key outside of Spark, which counts what is asked of it."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def test_many_minutes_cost_one_read_and_one_write_of_state():
    handle, minutes = Handle(), live.Minutes(3_600_000, 3_600_000)
    minutes.init(handle)
    start = pd.Timestamp("2024-01-01")
    polls = lambda version, k: pd.DataFrame({"opens_at": [start + pd.Timedelta(seconds=s) for s in range(1000)], "arrived_at": start + pd.Timedelta(hours=k), "fingerprint": version})
    step = lambda *frames: pd.concat(minutes.handleInputRows(("x", start.value // 3_600_000_000_000), iter(frames), handle))
    out = step(polls("b", 2), polls("a", 1))  # parts of a key's rows come in any order
    assert out.groupby(["fingerprint", "action"])["revision"].agg(["size", "max"]).to_dict("index") == {("a", "NEW"): {"size": 1000, "max": 1}, ("b", "CORRECTION"): {"size": 1000, "max": 2}}
    assert set(step(polls("a", 3))["action"]) == {"REJECTED"} and set(step(polls("b", 4))["action"]) == {"UNCHANGED"}
    assert handle.calls <= 4 and handle.timers == [start.value // 1_000_000 + 2 * 3_600_000]


def test_finalised_minutes_of_several_spans(spark, tmp_path):
    rows = [(i, DAY + dt.timedelta(minutes=17 * i), i % 3, "ab"[i % 2], float(i)) for i in range(200)]
    path = events(spark, tmp_path, rows)
    got = sorted(tuple(r) for r in catalog.queries()["stream_finalised_minutes"](spark, path).collect())
    assert got == sorted(oracle(path, "stream_finalised_minutes").fetchall()) and len(got) == 800


def test_below_counts_earlier_and_less():
    x = np.random.default_rng(1).integers(0, 50, 777)
    assert folds._below(x).tolist() == [int((x[:i] < v).sum()) for i, v in enumerate(x)] and folds._below(x[:0]).tolist() == [] and folds._below(x[:1]).tolist() == [0]


def test_causal_percentiles_of_one_series_in_many_blocks(spark):
    values = [None if i % 41 == 0 else float(i * 7919 % 23) for i in range(500)]
    made = [(k, i, v) for k in ("a", None) for i, v in enumerate(values)]
    df = spark.createDataFrame(made, "k string, i int, v double").repartition(3)
    out = folds.causal_percentile(df, ["k"], "i", "v", "p", block=16).collect()
    for r in out:
        i, known = r["i"], [x for x in values[: r["i"]] if x is not None and values[r["i"]] is not None]
        assert r["p"] == (None if i == 0 else pytest.approx(sum(x <= values[i] for x in known) / i))
    assert len(out) == len(made)


def test_causal_percentile_follows_time_before_ids(spark, tmp_path):
    rows = [(i, DAY + dt.timedelta(hours=-i), 1, "error", float(i * 37 % 11)) for i in range(60)]
    path = events(spark, tmp_path, rows)
    got = sorted(tuple(r) for r in catalog.queries()["causal_percentile"](spark, path).collect())
    assert [(e, None if p is None else round(p, 6)) for e, p in got] == sorted(oracle(path, "causal_percentile").fetchall())


def test_places_by_ranges(spark):
    rows = spark.createDataFrame([(k, i * 7 % 100) for k in ("a", "b", None) for i in range(100)], "k string, v int").repartition(5)
    out = chains.ranked(rows, ["k"], ["v"], "i", part_rows=17).collect()
    assert len(out) == 300 and all(r["i"] == r["v"] for r in out)
    assert sorted(r["i"] for r in chains.ranked(rows, [], ["k", "v"], "i", part_rows=17).collect()) == list(range(300))


def test_temperatures_count_equal_rows_once(spark, monkeypatch):
    staged, sizes = calibration.staged, []
    monkeypatch.setattr(calibration, "staged", lambda df, name: sizes.append(df.count()) or staged(df, name))
    rows = spark.range(3000).select(F.lit(0.5).alias("a"), F.lit(0.3).alias("b"), F.lit(0.2).alias("c"), F.when(F.col("id") % 10 < 6, "A").when(F.col("id") % 10 < 8, "B").otherwise("C").alias("y"))
    t = calibration.fit_temperature(rows, ["a", "b", "c"], "y", ("A", "B", "C"))
    loss = lambda t: -sum(w * np.log(p ** (1 / t) / sum(q ** (1 / t) for q in (0.5, 0.3, 0.2))) for w, p in ((0.6, 0.5), (0.2, 0.3), (0.2, 0.2)))
    assert sizes == [3] and loss(t) <= min(loss(t * 1.001), loss(t / 1.001))


def test_release_finds_its_cut_without_the_driver(spark, monkeypatch):
    asked, ranked = [], chains.ranked
    monkeypatch.setattr(chains, "ranked", lambda *a, **k: asked.append(a[3]) or ranked(*a, **k, part_rows=100))
    p = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("t"), *[p[k].alias(c) for k, c in enumerate(("p_down", "p_neither", "p_up"))], F.when(F.col("id") % 3 == 0, "DOWN").when(F.col("id") % 3 == 1, "NEITHER").otherwise("UP").alias("actual"), (F.col("id") % 2).cast("int").alias("fold_index"))
    out = calibration.released(rows, ["t"], ["p_down", "p_neither", "p_up"], temperature=1.0).first()
    assert (out["n_fit"], out["n_evaluation"], asked) == (600, 400, ["_i"])


def test_broken_links_without_a_window_over_the_chain(spark):
    rows = spark.createDataFrame([(k, i, f"e{i}") for k in ("x", "y") for i in range(50)], "c string, n int, e string")
    good = audit.chained(rows, ["c"], "n", ["n", "e"])
    found = audit.broken(good, ["c"], "n", ["n", "e"])
    assert found.count() == 0 and "Window" not in found._jdf.queryExecution().executedPlan().toString().replace("WindowGroupLimit", "").split("_first")[0]
    lost = good.where("not (c = 'y' and n = 20)")
    assert [(r["c"], r["n"]) for r in audit.broken(lost, ["c"], "n", ["n", "e"]).collect()] == [("y", 21)]


@pytest.mark.parametrize("part", [7, 256])
def test_no_similar_pair_of_a_bucket_is_left_out(spark, monkeypatch, part):
    monkeypatch.setattr(ominhash, "PART", part)
    draw = np.random.default_rng(3)
    texts, shared = [], draw.integers(0, 1 << 32, 30)
    for _ in range(30):  # pairs of near texts around a passage that all share; a few are shorter than a gram
        own = np.concatenate([shared, draw.integers(0, 1 << 32, int(draw.integers(0, 60)))])
        near = own.copy()
        near[draw.integers(0, len(own), int(len(own) * 0.25 * draw.random()) + 1)] = draw.integers(0, 1 << 32)
        texts += [own.astype("<u4"), near.astype("<u4")]
    texts += [shared[a:b].astype("<u4") for a, b in ((0, 2), (0, 1), (0, 0), (1, 30))]
    words = spark.createDataFrame([(i, len(t), bytearray(t.astype("<u4").tobytes())) for i, t in enumerate(texts)], "id long, n_words long, words binary")
    waiting = words.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("bucket"), "id")
    labels = spark.createDataFrame([(5, 2), (2, 2)], "id long, root long")
    got = {tuple(r) for r in ominhash.remaining(waiting, labels, words, 3, 0.8).collect()}
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if (a, b) != (2, 5) and ominhash.similar(texts[a], texts[b], 0.8)}
    assert want <= got and len(want) >= 20 and (2, 5) not in got and len(got) < len(texts) ** 2 / 3
