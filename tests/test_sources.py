"""Sources and sinks on small files: decoding, acquisition by chunks, bundles, contracts, feed states, routing."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickloom.operators import folds, ingest, quality
from tickloom.sources import readers, sinks
from tickloom.streaming import pipelines as S

START = dt.datetime(2026, 8, 24, 4, 0)


def test_raw_events_are_read_or_fail(spark, tmp_path):
    path = tmp_path / "ticks.jsonl"
    path.write_text('{"provider": "feed", "provider_sequence": 4, "price": 10.5}\n\n{"provider": "feed", "price": null}\n')
    rows = readers.ticks_jsonl(spark, str(path)).select("provider", "provider_sequence", "price").collect()
    assert [(r["provider"], r["provider_sequence"], r["price"]) for r in rows] == [("feed", 4, Decimal("10.5")), ("feed", None, None)]
    path.write_text('{"provider": "feed"}\n{"provider": \n')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.ticks_jsonl(spark, str(path)).collect()


def test_chunks_cover_a_span_once():
    assert readers.chunks(START, START + dt.timedelta(days=65), 30) == [(START + dt.timedelta(days=a), START + dt.timedelta(days=b)) for a, b in ((0, 30), (30, 60), (60, 65))]
    for bad in ((START, START, 5), (START, START + dt.timedelta(days=1), 0), (START, START + dt.timedelta(days=1), 31)):
        with pytest.raises(ValueError):
            readers.chunks(*bad)


def test_acquired_chunks_merge_equal_minutes_and_refuse_others(spark):
    def fetch(a, b):  # each chunk also gives the minute where it ends
        return [(a, 1.0), (b, 1.0)]

    end = START + dt.timedelta(days=3)
    out = readers.acquired(spark, fetch, START, end, 1, "opens_at timestamp, close double")
    assert sorted(r["opens_at"] for r in out.collect()) == [START + dt.timedelta(days=k) for k in range(4)]
    with pytest.raises(Exception, match="two chunks disagree"):
        readers.acquired(spark, lambda a, b: [(a, float(a.day)), (b, 0.5)], START, end, 1, "opens_at timestamp, close double").collect()


def test_decoding(spark):
    raw = spark.createDataFrame([("7", 1_700_000_000_123, 2_512_345, 9)], "token string, exchange_timestamp long, last_traded_price long, sequence_number long")
    r = readers.decoded_ticks(raw, "7", 100).first()
    assert r["price"] == Decimal("25123.45") and r["provider_sequence"] == 9 and not r["provider_sequence_is_contiguous"]
    assert r["provider_event_time"] == dt.datetime(2023, 11, 14, 22, 13, 20, 123000)
    with pytest.raises(Exception, match="another instrument"):
        readers.decoded_ticks(raw, "8", 100).collect()
    bars = "opens_at timestamp, open double, high double, low double, close double, volume long"
    one, same, other = (readers.decoded_bars(spark.createDataFrame([(START, 1.0, 3.0, 0.5, c, v)], bars), "x").first() for c, v in ((2.0, 5), (2.0, 6), (2.5, 5)))
    assert one["provider_bar_id"] == same["provider_bar_id"] != other["provider_bar_id"] and one["volume"] is None
    with pytest.raises(Exception, match="out of order"):
        readers.decoded_bars(spark.createDataFrame([(START, 1.0, 1.5, 0.5, 2.0, 1)], bars), "x").collect()


def test_nearest_contracts(spark):
    rows = [("1", "A1", "FUT", "28AUG2026"), ("2", "A0", "FUT", "28AUG2026"), ("3", "A2", "FUT", "20AUG2026"), ("4", "O", "OPT", "24AUG2026"), ("5", "Z", "OPT", "25SEP2026")]
    master = spark.createDataFrame([("NFO", "NIFTY", *r) for r in rows] + [("BFO", "NIFTY", "6", "B", "FUT", "25AUG2026")], "exchange string, name string, token string, symbol string, instrument_type string, expiry string")
    out = readers.nearest_contracts(master, "NFO", "NIFTY", dt.date(2026, 8, 24)).collect()
    assert {(r["instrument_type"], r["symbol"], r["expires_on"]) for r in out} == {("FUT", "A0", dt.date(2026, 8, 28)), ("OPT", "O", dt.date(2026, 8, 24))}


def test_derivatives_snapshots(spark):
    options = [("s", "CE", 100.0, 0.52, 12.0, 10), ("s", "CE", 110.0, 0.24, 11.0, 30), ("s", "PE", 100.0, -0.48, 13.0, 50), ("s", "PE", 90.0, -0.26, 15.0, 30), ("t", "CE", 100.0, 0.5, 9.0, 0)]
    out = {r["snap"]: r for r in readers.derivatives_snapshot(spark.createDataFrame(options, "snap string, kind string, strike double, delta double, iv double, volume long"), ["snap"]).collect()}
    assert (out["s"]["atm_implied_volatility"], out["s"]["delta25_put_call_iv_skew"], out["s"]["option_volume_put_call_ratio"]) == (12.5, 4.0, 2.0)
    assert out["t"]["atm_implied_volatility"] is None and out["t"]["option_volume_put_call_ratio"] is None
    futures = spark.createDataFrame([(30, 10, 101.0, 100.0), (0, 0, 1.0, 0.0)], "total_buy_quantity long, total_sell_quantity long, futures_ltp double, spot_ltp double")
    got = [(r["futures_book_imbalance"], r["futures_basis_bps"]) for r in readers.futures_snapshot(futures).collect()]
    assert got[0] == (0.5, pytest.approx(100.0)) and got[1] == (None, None)


def test_bundles_prove_their_rows_and_survive_a_broken_write(spark, tmp_path):
    path, schema = str(tmp_path / "bundle"), "id long, v string"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    rows.limit(1).write.json(f"{path}/rows")  # a write that was broken off before its digest
    digest = sinks.save_bundle(rows, path, {"at": "now"})
    assert sinks.save_bundle(rows.orderBy(F.desc("id")), path, {"at": "later"}) == digest
    assert sorted((r["id"], r["v"]) for r in sinks.read_bundle(spark, path, schema).collect()) == [(1, "a"), (2, "b")]
    assert json.loads(spark.read.text(f"{path}/meta").first()[0])["at"] == "now"
    with pytest.raises(ValueError, match="another bundle"):
        sinks.save_bundle(rows.limit(1), path, {})
    spark.createDataFrame([(3, "c")], schema).write.mode("append").json(f"{path}/rows")
    with pytest.raises(ValueError, match="digest differs"):
        sinks.read_bundle(spark, path, schema)


def test_runs_name_their_tables_once(spark, tmp_path):
    tables = {"a": spark.range(3), "b": spark.range(2)}
    for _ in range(2):
        sinks.save_run(tables, str(tmp_path), "r1")
    assert [(r["run_id"], r["tables"]) for r in spark.read.parquet(f"{tmp_path}/runs").collect()] == [("r1", ["a", "b"])]
    assert spark.read.parquet(f"{tmp_path}/a/run=r1").count() == 3


def test_states_of_a_feed(spark):
    cases = [(1, 5, True, "CONNECTED", False, "LIVE"), (4, 5, True, "CONNECTED", False, "DELAYED"), (16, 5, True, "CONNECTED", False, "STALE"), (1, 61, True, "CONNECTED", False, "DELAYED"), (1, 301, True, "CONNECTED", False, "STALE")]
    cases += [(1, 5, False, "CONNECTED", True, "MARKET_CLOSED"), (1, 5, True, "RECONNECTING", True, "RECONNECTING"), (99, 5, True, "CONNECTED", True, "RECOVERING"), (3, 60, True, "CONNECTED", False, "LIVE")]
    rows = spark.createDataFrame([(float(a), float(b), *r) for a, b, *r in cases], "age double, bar double, open boolean, provider string, recovering boolean, want string")
    out = rows.withColumn("got", S.data_status(F.col("age"), F.col("bar"), F.col("open"), F.col("provider"), F.col("recovering"))).collect()
    assert [r["got"] for r in out] == [r["want"] for r in out]


def test_signals_at_a_bar(spark):
    rows = [("BUY", 10.0, 9.9, 0, "ENTERED"), ("BUY", 12.0, 11.0, 0, "TARGET"), ("BUY", 9.5, 8.0, 0, "STOPPED"), ("BUY", 12.0, 8.0, 0, "INVALIDATED"), ("BUY", 12.0, 8.0, 9, "EXPIRED"), ("BUY", 11.5, 11.0, 0, "WAITING"), ("SELL", 9.0, 8.0, 0, "TARGET"), ("SELL", 12.0, 11.0, 0, "STOPPED")]
    df = spark.createDataFrame([(side, 9.8, 10.2, *((8.5, 12.0) if side == "BUY" else (11.5, 8.0)), high, low, START + dt.timedelta(hours=at), START + dt.timedelta(hours=9), want) for side, high, low, at, want in rows], "side string, entry_low double, entry_high double, stop double, target double, high double, low double, at timestamp, expires_at timestamp, want string")
    out = df.withColumn("got", folds.lifecycle(df)).collect()
    assert [r["got"] for r in out] == [r["want"] for r in out]


def test_inspection_of_a_batch(spark):
    t = lambda m, s=0: START + dt.timedelta(minutes=m, seconds=s)
    good = [("a", t(k), f"a{k}", 1, k, True) for k in range(5)]
    late = [("b", t(0), "b0", 1, 0, True), ("b", t(2), "b2", 1, 1, True), ("b", t(1), "b1", 1, 2, True)]
    bad = [("c", t(0), "c0", 1, 0, True), ("c", t(0), "c0", 1, 1, True), ("c", t(1, 5), "c1", 1, 2, False), ("c", t(99), "c9", 1, 3, True)]
    df = spark.createDataFrame(good + late + bad, "series string, opens_at timestamp, bar_id string, revision long, arrival long, inside boolean")
    out = {r["series"]: r for r in quality.inspect(df, F.col("inside"), F.lit(t(0)), F.lit(t(60))).collect()}
    assert {k: r["status"] for k, r in out.items()} == {"a": "PASS", "b": "DEGRADED", "c": "REJECTED"}
    r = out["c"]
    assert [r[f"n_{n}"] for n in ("duplicate_ids", "out_of_request", "misaligned", "out_of_session", "invalid_corrections")] == [1, 1, 1, 1, 1]


def test_routed_batches_part(spark, tmp_path):
    fields = [f.split()[:2] for f in ingest.RAW.replace("\n", " ").replace("decimal(18,6)", "decimal(18#6)").replace("map<string,string>", "map<string#string>").split(",")]
    given = {"provider": F.lit("feed"), "provider_instrument_id": F.col("id").cast("string"), "event_type": F.lit("TRADE"), "provider_event_time": F.lit(START).cast("timestamp"), "server_arrival_time": F.lit(START).cast("timestamp"), "price": F.lit(5).cast("decimal(18,6)")}
    batch = spark.range(4).select(*[given.get(n, F.lit(None).cast(t.replace("#", ","))).alias(n) for n, t in fields])
    known = spark.createDataFrame([("feed", str(k), f"i{k}", True) for k in range(3)], "provider string, provider_instrument_id string, instrument_id string, supports_volume boolean")
    stored, apart = str(tmp_path / "stored"), str(tmp_path / "apart")
    S.routed(batch, known, stored, apart)(batch, 0)
    kept, gone = spark.read.parquet(stored), spark.read.parquet(apart)
    assert kept.count() + gone.count() == 4 and gone.count() >= 1 and kept.select("batch_id").distinct().first()[0] == 0
