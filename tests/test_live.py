"""Live streams against their batch forms: restarts, late rows, side output, publications by a manual clock, snapshots, shadow predictions."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import shadow, snapshots
from tickloom.streaming import live
from tickloom.streaming import pipelines as S

START = dt.datetime(2026, 8, 24, 4, 0)
POLLED = "instrument string, opens_at timestamp, arrived_at timestamp, fingerprint string, close double"


def polls(n=40):
    """Every five minutes the last fifteen are read again; some come back corrected, some in an old version."""
    rows = []
    for poll in range(5, n + 1, 5):
        for m in range(max(0, poll - 15), poll):
            version = "b" if m % 7 == 0 and poll - m > 5 else "a"
            version = "a" if m % 14 == 0 and poll - m > 10 else version
            rows.append(("x", START + dt.timedelta(minutes=m), START + dt.timedelta(minutes=poll), f"{m}{version}", float(m)))
    return rows


def expected(rows):
    """Actions and revisions of rows in order of arrival."""
    seen, current, out = {}, {}, []
    for _, opens, arrived, f, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        own = seen.setdefault(opens, set())
        if current.get(opens, (None, 0))[0] == f:
            action = "UNCHANGED"
        elif f in own:
            action = "REJECTED"
        else:
            action = "CORRECTION" if opens in current else "NEW"
            current[opens] = (f, current.get(opens, (None, 0))[1] + 1)
            own.add(f)
        out.append((opens, arrived, f, action, current[opens][1]))
    return sorted(out)


def test_finalisation_equals_its_batch_and_restarts(spark, tmp_path):
    rows = polls()
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")

    def run(own):
        spark.createDataFrame(own, POLLED).coalesce(1).write.mode("append").parquet(source)
        stream = live.finalised(S.files(spark, source, POLLED), "instrument")
        with live.keyed_state(spark):
            live.ran(stream, lambda b, k: b.write.mode("overwrite").parquet(f"{sink}/{k}"), str(tmp_path / "ck"))

    half = [r for r in rows if r[2] <= START + dt.timedelta(minutes=20)]
    run(half)
    run([r for r in rows if r not in half])  # a new query goes on with the state of the first
    read = lambda: spark.read.option("recursiveFileLookup", True).parquet(sink)
    got = sorted((r["opens_at"], r["arrived_at"], r["fingerprint"], r["action"], r["revision"]) for r in read().collect())
    assert got == expected(rows)
    assert {r[3] for r in got} == {"NEW", "CORRECTION", "UNCHANGED", "REJECTED"}
    run([("x", START + dt.timedelta(hours=5), START + dt.timedelta(hours=5), "far", 1.0)])  # the watermark moves on
    run([("x", START, START + dt.timedelta(hours=6), "0c", 1.0)])
    assert [r["action"] for r in read().where("fingerprint = '0c'").collect()] in (["LATE"], [])
    assert "spark.sql.streaming.stateStore.providerClass" not in dict(spark.sparkContext.getConf().getAll())


class Clock:
    """A handle and timer values with one key's state, for processors outside of Spark."""

    def __init__(self):
        self.now, self.timers, self.values = 0, [], {}

    def getValueState(self, name, schema):  # noqa: N802
        clock = self

        class Value:
            def exists(self):
                return name in clock.values

            def get(self):
                return clock.values[name]

            def update(self, v):
                clock.values[name] = v

            def clear(self):
                clock.values.pop(name, None)

        return Value()

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def test_publications_by_a_manual_clock():
    clock, p, out = Clock(), live.Publications(250), []
    p.init(clock)

    def send(now, *signatures):
        clock.now = now
        for at in [t for t in clock.timers if t <= now]:
            clock.timers.remove(at)
            clock.now = at
            out.extend((at, f.iloc[0]["signature"]) for f in p.handleExpiredTimer(("k",), clock, None))
        clock.now = now
        if signatures:
            rows = pd.DataFrame({"at": range(len(signatures)), "signature": signatures, "payload": signatures})
            out.extend((now, f.iloc[0]["signature"]) for f in p.handleInputRows(("k",), iter([rows]), clock))

    send(0, "a")  # at once
    send(100, "b")
    send(200, "c", "d")  # too soon: the last one waits
    send(300)
    send(320, "d")  # unchanged
    send(600, "d")
    send(900, "e")
    send(1000, "f")
    send(1010, "e")  # back to what is published: nothing to say
    send(2000)
    assert out == [(0, "a"), (250, "d"), (900, "e")]


def test_publications_in_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(f"k{k % 3}", START + dt.timedelta(seconds=k), f"s{k}", f"p{k}") for k in range(30)]
    schema = "view string, at timestamp, signature string, payload string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    got = []
    with live.keyed_state(spark):
        stream = live.published(S.files(spark, source, schema), "view").writeStream
        q = stream.foreachBatch(lambda b, k: got.extend((r["view"], r["signature"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for _ in range(120):  # timers of processing time never end by themselves
            if len(got) >= 3 or not q.isActive:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert q.exception() is None and sorted(got) == [("k0", "s27"), ("k1", "s28"), ("k2", "s29")]


def test_side_output_counts_once(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        rows = [("x", part * 10 + k, (part * 10 + k) % 4 == 0) for k in range(10)]
        spark.createDataFrame(rows, "s string, id long, auction boolean").coalesce(1).write.mode("append").parquet(source)
    write = live.diverted(sink, F.col("auction"), {"n": F.count(F.lit(1)), "last": F.max("id")}, ["s"])
    stream = S.files(spark, source, "s string, id long, auction boolean", most_files=1)
    live.ran(stream, write, str(tmp_path / "ck"))
    write(spark.createDataFrame([("x", 0, True), ("x", 1, None)], "s string, id long, auction boolean"), 99)
    write(spark.createDataFrame([("x", 0, True), ("x", 1, None)], "s string, id long, auction boolean"), 99)  # run again
    read = lambda name: spark.read.option("recursiveFileLookup", True).parquet(f"{sink}/{name}")
    aside = read("aside").agg(F.sum("n").alias("n"), F.max("last").alias("last")).first()
    assert (aside["n"], aside["last"]) == (8 + 1, 28)
    assert sorted(r["id"] for r in read("main").collect()) == sorted([k for k in range(30) if k % 4] + [1])


BAR = "instrument string, candle_id string, closes_at timestamp"


def frames(spark, n=30):
    one = [("x", f"m{k}", START + dt.timedelta(minutes=5 * k)) for k in range(n)]
    two = [("x", f"q{k}", START + dt.timedelta(minutes=15 * k + 10)) for k in range(n // 3)]
    return one, two, spark.createDataFrame(one, BAR), spark.createDataFrame(two, BAR)


def snapshot_inputs(df):
    status = F.when(F.col("candle_id") == "m7", F.lit("STALE")).otherwise(F.lit("LIVE"))
    return df.withColumn("source_watermark", F.col("closes_at").cast("string")).withColumn("data_mode", F.lit("LIVE")).withColumn("data_status", status)


def test_snapshots_equal_a_loop_and_their_stream(spark, tmp_path):
    one, two, primary, context = frames(spark)
    rows = snapshot_inputs(primary)
    build = lambda df: snapshots.build(df, primary, {"15m": context}, ["instrument"], limits=(4, 2))
    got = {r["candle_id"]: r for r in build(rows).collect()}
    assert len(got) == len(one)
    for _, name, at in one:
        r = got[name]
        recent, ctx = [i for _, i, t in one if t <= at][-4:], [i for _, i, t in two if t <= at][-2:]
        checksum = hashlib.sha256("|".join(recent + ctx).encode()).hexdigest()
        status = "STALE" if name == "m7" else "LIVE"
        iso = at.replace(tzinfo=dt.timezone.utc).isoformat()
        said = f"snapshot:x:{iso}:{checksum}:LIVE:{status}:{iso}:{at}"
        assert (r["recent_ids"], r["15m_ids"], r["checksum"], r["snapshot_id"]) == (recent, ctx, checksum, str(uuid.uuid5(uuid.NAMESPACE_URL, said)))
        assert r["blockers"] == (["DATA_STATUS_STALE"] if name == "m7" else []) + ([] if ctx else ["FINALIZED_15M_CONTEXT_UNAVAILABLE"])
        assert r["eligible"] == (not r["blockers"]) and r["15m_id"] == (ctx[-1] if ctx else None)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows.where("candle_id < 'm2'"), rows.where("candle_id >= 'm2'")):
        part.coalesce(1).write.mode("append").parquet(source)
    live.ran(S.files(spark, source, rows.schema, most_files=1), live.snapshotted(sink, lambda s: (primary, {"15m": context}), ["instrument"]), str(tmp_path / "ck"))
    full = {r["candle_id"]: r for r in snapshots.build(rows, primary, {"15m": context}, ["instrument"]).collect()}
    streamed = spark.read.option("recursiveFileLookup", True).parquet(sink).collect()
    assert {r["candle_id"]: (r["snapshot_id"], r["blockers"]) for r in streamed} == {k: (r["snapshot_id"], r["blockers"]) for k, r in full.items()}


def test_views_name_what_does_not_fit(spark):
    schema = """case string, instrument string, decision_time timestamp, primary_id string, primary_frame string, model_input_ids array<string>, checksum string, developing_id string,
        bars array<struct<candle_id:string,frame:string,opens_at:timestamp,closes_at:timestamp,status:string,instrument:string>>, developing struct<candle_id:string,frame:string,opens_at:timestamp,closes_at:timestamp,status:string,instrument:string>"""
    t = lambda m: START + dt.timedelta(minutes=m)
    bar = lambda i, m, frame="5m", status="FINALIZED", who="x": (i, frame, t(m - 5), t(m), status, who)
    ids = ["a", "b"]
    checksum = hashlib.sha256(b"a|b").hexdigest()
    good = {"instrument": "x", "decision_time": t(10), "primary_id": "b", "primary_frame": "5m", "model_input_ids": ids, "checksum": checksum, "developing_id": None, "bars": [bar("a", 5), bar("b", 10)], "developing": None}
    cases = {
        "good": ({}, []), "twice": ({"bars": [bar("a", 5), bar("b", 10), bar("b", 15)]}, ["CANDLE_IDS_NOT_UNIQUE", "CANDLE_AFTER_DECISION_TIME"]), "open": ({"bars": [bar("a", 5, status="DEVELOPING"), bar("b", 10)]}, ["CANDLE_NOT_FINALIZED"]),
        "other": ({"bars": [bar("a", 5, who="y"), bar("b", 10)]}, ["INSTRUMENT_MISMATCH"]), "bucket": ({"bars": [bar("a", 5), bar("b", 10), bar("c", 10)]}, ["SEVERAL_REVISIONS_OF_ONE_BUCKET"]),
        "missing": ({"bars": [bar("b", 10)]}, ["CANDLE_REVISIONS_MISSING"]), "no primary": ({"bars": [bar("a", 5)]}, ["CANDLE_REVISIONS_MISSING", "PRIMARY_CANDLE_MISSING"]), "frame": ({"bars": [bar("a", 5), bar("b", 10, "15m")]}, ["PRIMARY_CANDLE_MISSING"]),
        "close": ({"decision_time": t(11)}, ["DECISION_TIME_IS_NOT_THE_PRIMARY_CLOSE"]), "sum": ({"checksum": "0"}, ["REVISION_CHECKSUM_INVALID"]), "no developing": ({"developing_id": "d"}, ["DEVELOPING_CANDLE_MISSING"]),
        "developing": ({"developing_id": "d", "developing": bar("d", 15, status="DEVELOPING")}, []), "final": ({"developing_id": "d", "developing": bar("d", 15)}, ["DEVELOPING_CANDLE_HAS_OTHER_STATUS"]),
        "mismatch": ({"developing_id": None, "developing": bar("a", 15, status="DEVELOPING")}, ["DEVELOPING_CANDLE_MISMATCH", "DEVELOPING_CANDLE_IS_AN_INPUT"]),
    }
    names = ["case", "instrument", "decision_time", "primary_id", "primary_frame", "model_input_ids", "checksum", "developing_id", "bars", "developing"]
    rows = [tuple(({**good, **change, "case": c})[n] for n in names) for c, (change, _) in cases.items()]
    got = {r["case"]: r["errors"] for r in snapshots.view_errors(spark.createDataFrame(rows, schema), ["instrument"]).collect()}
    assert got == {c: want for c, (_, want) in cases.items()}


MODEL = {
    "shadow_only": True, "approved_for_live_inference": False, "feature_names": ["f1", "f2"], "scaler_mean": [1.0, 2.0], "scaler_scale": [2.0, 0.5], "classes": ["DOWN", "NEITHER", "UP"],
    "coefficients": [[0.4, -0.3], [0.0, 0.1], [-0.2, 0.5]], "intercepts": [0.1, -0.5, 0.0], "temperature": 1.5,
}
POLICY = {
    "shadow_only": True, "approved_for_live_inference": False, "shadow_candidate_directions_enabled": True, "deployment_prior": {"DOWN": 0.3, "NEITHER": 0.4, "UP": 0.3},
    "thresholds": {"score_source": "CALIBRATED_PROBABILITY", "activation_score": 0.4, "minimum_class_margin": 0.05, "maximum_neither_score": 0.4, "minimum_prior_lift": 0.02},
}
SNAPS = "snapshot_id string, checksum string, instrument string, decision_time timestamp, data_mode string, data_status string, blockers array<string>, close double, atr_14 double, f1 double, f2 double"


def snaps(n=40):
    r = np.random.default_rng(5)
    return [
        (f"s{k}", f"c{k}", "x", START + dt.timedelta(minutes=5 * k), "REPLAY" if k == 1 else "LIVE", "STALE" if k == 2 else "LIVE", ["EVENT"] if k == 3 else [], 100.0 + k, None if k == 4 else 2.0, None if k == 5 else float(r.normal(1, 2)), float(r.normal(2, 1)))
        for k in range(n)
    ]


def test_artifacts_prove_their_hash(spark, tmp_path):
    path = tmp_path / "model.json"
    path.write_text(json.dumps(shadow.signed(MODEL)))
    model = shadow.load(spark, str(path))
    assert shadow.load(spark, str(path), model["sha256"]) == model
    for bad, expected_hash in (({**model, "intercepts": [0, 0, 0]}, None), (model, "0" * 64), (shadow.signed({**MODEL, "shadow_only": False}), None), (shadow.signed({**MODEL, "scaler_scale": [0.0, 1.0]}), None)):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            shadow.load(spark, str(path), expected_hash)


def test_shadow_predictions_equal_numpy_and_are_recorded_once(spark, tmp_path):
    model, policy, rows = shadow.signed(MODEL), shadow.signed(POLICY), snaps()
    df = spark.createDataFrame(rows, SNAPS)
    got = {r["snapshot_id"]: r for r in shadow.predict(df, model, policy).collect()}
    reasons = {"s1": "SHADOW_REQUIRES_LIVE_DATA_MODE", "s2": "SHADOW_DATA_STATUS_STALE", "s3": "EVENT", "s4": "SHADOW_ATR_UNAVAILABLE", "s5": "FEATURES_NOT_READY"}
    sides = set()
    for s, c, _, at, *_, close, atr, f1, f2 in rows:
        r = got[s]
        assert r["reason"] == reasons.get(s, "SHADOW_PREDICTION_RECORDED")
        if s in reasons:
            assert r["prediction_id"] is None and r["p_up"] is None
            continue
        z = (np.array([f1, f2]) - MODEL["scaler_mean"]) / MODEL["scaler_scale"] @ np.array(MODEL["coefficients"]).T + MODEL["intercepts"]
        p = np.exp(z - z.max())
        p /= p.sum()
        q = p ** (1 / 1.5) / (p ** (1 / 1.5)).sum()
        assert [r["p_down"], r["p_neither"], r["p_up"]] == pytest.approx(list(p)) and [r["calibrated_down"], r["calibrated_neither"], r["calibrated_up"]] == pytest.approx(list(q))
        side, own, other, prior = ("BUY", q[2], q[0], 0.3) if q[2] >= q[0] else ("SELL", q[0], q[2], 0.3)
        ok = q[1] <= 0.4 and own >= 0.4 and own - max(other, q[1]) >= 0.05 and own - prior >= 0.02
        assert r["direction"] == (side if ok else "WAIT") and r["up_barrier"] == close + 3.0 and r["outcome_due_at"] == at + dt.timedelta(minutes=60)
        said = f"shadow-prediction:{s}:{c}:{model['sha256']}:{policy['sha256']}"
        assert r["prediction_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, said))
        sides.add(r["direction"])
    assert sides == {"BUY", "SELL", "WAIT"}
    path = str(tmp_path / "ledger")
    write = live.shadowed(path, model, policy)
    write(df.limit(20), 0)
    write(df.limit(20), 0)  # the batch is run again
    write(df, 1)  # earlier snapshots come again
    write(df, 1)
    ledger = spark.read.option("recursiveFileLookup", True).parquet(path)
    assert ledger.count() == ledger.select("prediction_id").distinct().count() == 35
    assert {r["batch"] for r in ledger.where("snapshot_id in ('s0', 's19')").collect()} == {0}


def test_due_predictions_are_assessed_once(spark):
    model, policy = shadow.signed(MODEL), shadow.signed(POLICY)
    predictions = shadow.predict(spark.createDataFrame([snaps(7)[k] for k in (0, 6)], SNAPS), model, policy)
    minutes = [("x", START + dt.timedelta(minutes=m), 100.0 + (9 if m == 7 else 0), 99.5) for m in range(80)]
    bars = spark.createDataFrame(minutes, "instrument string, at timestamp, high double, low double")
    none = spark.createDataFrame([], "prediction_id string")
    at = lambda m: F.lit(START + dt.timedelta(minutes=m)).cast("timestamp")
    assert shadow.assess_due(predictions, none, bars, ["instrument"], at(59)).count() == 0
    first = shadow.assess_due(predictions, none, bars, ["instrument"], at(60)).collect()
    assert [(r["outcome"], r["quality"]) for r in first] == [("UP", "ASSESSED")]
    assert first[0]["assessment_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"shadow-assessment:{first[0]['prediction_id']}:1p5-atr-60m-v1"))
    known = spark.createDataFrame([(first[0]["prediction_id"],)], "prediction_id string")
    later = shadow.assess_due(predictions, known, bars, ["instrument"], at(500)).collect()
    assert [(r["outcome"], r["quality"]) for r in later] == [("UNASSESSABLE", "MISSING_MINUTE_WINDOW")]
