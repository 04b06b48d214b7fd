"""Invariants of the time-series operators on small hand-made series."""

from __future__ import annotations

import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from tickloom.functions.expressions import uuid5
from tickloom.operators import asof, audit, calendar, calibration, candles, features, folds, ingest, labels, metrics, tracking
from tickloom.operators import recurrence as R
from tickloom.sources import readers, sinks

START = dt.datetime(2026, 8, 24, 3, 45)
OHLC = "series string, opens_at timestamp, open double, high double, low double, close double"


def bars(spark, n, change=None):
    rows = []
    for i in range(n):
        p = 25000 + 3 * i + i % 4 * (5 if i % 7 else -9)
        c = p + 2 + (1000 if change == i else 0)
        rows.append(("a", START + dt.timedelta(minutes=5 * i), float(p), float(max(p, c) + 4), float(min(p, c) - 2), float(c)))
    return spark.createDataFrame(rows, OHLC)


def test_recurrences_equal_a_loop(spark):
    rows = bars(spark, 700)
    close = [r["close"] for r in rows.orderBy("opens_at").collect()]
    out = R.ema(R.rsi(rows, "close", 14, ["series"], "opens_at", "rsi"), F.col("close"), 20, ["series"], "opens_at", "ema").orderBy("opens_at").collect()
    y = sum(close[:20]) / 20
    for i in range(20, 700):
        y = 2 / 21 * close[i] + 19 / 21 * y
        assert out[i]["ema"] == pytest.approx(y, rel=1e-10)
    assert out[18]["ema"] is None and out[13]["rsi"] is None and 0 <= out[14]["rsi"] <= 100


def test_rsi_of_a_flat_series_is_fifty(spark):
    flat = spark.createDataFrame([("a", START + dt.timedelta(minutes=i), 5.0, 5.0, 5.0, 5.0) for i in range(20)], OHLC)
    assert R.rsi(flat, "close", 14, ["series"], "opens_at", "r").orderBy(F.desc("opens_at")).first()["r"] == 50.0


def _base(rows):
    day = F.col("opens_at").cast("date")
    rows = rows.withColumn("closes_at", F.col("opens_at") + F.expr("interval 5 minutes")).withColumn("session_date", day)
    rows = rows.withColumn("session_opens", day.cast("timestamp")).withColumn("session_closes", day.cast("timestamp") + F.expr("interval 24 hours"))
    return features.base(rows, ["series"]).select("opens_at", *features.BASE).orderBy("opens_at").collect()


def test_the_past_does_not_change_with_the_future(spark):
    whole, prefix, changed = _base(bars(spark, 80)), _base(bars(spark, 60)), _base(bars(spark, 80, change=70))
    assert [r["opens_at"] for r in whole[:60]] == [r["opens_at"] for r in prefix]
    for a, b, c in zip(whole[:60], prefix, changed):
        for name in features.BASE:
            x, y, z = a[name], b[name], c[name]
            assert (x is None) == (y is None) == (z is None)
            if x is not None:
                assert x == pytest.approx(y, rel=1e-9, abs=1e-9) and x == pytest.approx(z, rel=1e-9, abs=1e-9)
    assert whole[75]["return_1"] != changed[70]["return_1"]


def test_sessions_follow_rules_holidays_and_special_days(spark):
    c = calendar.Calendar(holidays=("2026-08-26",), special=(("2026-08-29", "18:00", "19:00"),))
    days = {str(r["session_date"]): (r["opens_at"], r["closes_at"]) for r in calendar.sessions(spark, c, dt.date(2026, 7, 30), dt.date(2026, 8, 30)).collect()}
    assert days["2026-07-31"][1].strftime("%H:%M") == "10:00" and days["2026-08-03"][1].strftime("%H:%M") == "09:45"
    assert "2026-08-26" not in days and "2026-08-30" not in days and days["2026-08-29"][0].strftime("%H:%M") == "12:30"


def test_buckets_are_anchored_at_the_open_and_cut_at_the_close(spark):
    days = calendar.sessions(spark, calendar.Calendar(), dt.date(2026, 7, 30), dt.date(2026, 7, 30))
    t = spark.createDataFrame([(dt.datetime(2026, 7, 30, 3, 45),), (dt.datetime(2026, 7, 30, 9, 50),), (dt.datetime(2026, 7, 30, 10, 0),)], "ts timestamp")
    out = calendar.bucket(calendar.in_session(t, days, "ts"), "ts", 60).orderBy("ts").collect()
    assert out[0]["bucket_closes"] == dt.datetime(2026, 7, 30, 4, 45) and not out[0]["partial"]
    assert out[1]["bucket_opens"] == dt.datetime(2026, 7, 30, 9, 45) and out[1]["partial"] and out[2]["bucket_opens"] is None


def test_events_are_routed(spark):
    t = dt.datetime(2026, 8, 24, 4)
    x = {"provider": " Feed ", "provider_instrument_id": "1", "event_type": "TRADE", "provider_event_time": t, "server_arrival_time": t, "price": None}
    made = [x | {"price": 5, "provider_sequence": 1, "provider_sequence_scope": "s"}, x | {"price": 6, "provider_sequence": 1, "provider_sequence_scope": "s", "server_arrival_time": t + dt.timedelta(seconds=1)}, x, x | {"price": 7, "provider_instrument_id": "9"}, x | {"price": 8, "server_arrival_time": t + dt.timedelta(seconds=9)}]
    import decimal

    made = [m | {"price": decimal.Decimal(m["price"]) if m["price"] else None} for m in made]
    events = spark.createDataFrame(made, ingest.RAW)
    known = spark.createDataFrame([("feed", "1", "index", False)], "provider string, provider_instrument_id string, instrument_id string, supports_volume boolean")
    out = ingest.route(ingest.identity(ingest.normalize(events, known))).collect()
    assert sorted(r["status"] for r in out) == ["DUPLICATE", "QUARANTINED", "QUARANTINED", "STORED", "STORED"]
    assert {tuple(r["issues"]) for r in out} == {(), ("PRICE_REQUIRED",), ("UNKNOWN_INSTRUMENT",), ("LATE_ARRIVAL",)}


def test_uuids_equal_python(spark):
    got = spark.range(50).select(F.col("id").cast("string").alias("n"), uuid5(ingest.NAMESPACE, F.col("id").cast("string")).alias("u")).collect()
    assert all(str(uuid.uuid5(uuid.UUID(ingest.NAMESPACE), r["n"])) == r["u"] for r in got)


def test_asof_never_looks_ahead(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 6), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 6, None)], "k string, t int, v int")
    out = {(r["k"], r["t"]): r["v"] for r in asof.asof_join(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert out == {("a", 1): None, ("a", 5): 50, ("a", 6): None, ("b", 5): None}


def test_coarse_bars_need_all_parts_and_null_volume_stays(spark):
    rows = [("a", i, float(i), float(i), float(i), float(i), None if i == 1 else 1.0) for i in (0, 1, 2, 3, 5, 6, 7)]
    out = candles.coarser(spark.createDataFrame(rows, "k string, opens_at int, open double, high double, low double, close double, volume double"), F.floor(F.col("opens_at") / 4), 4, ["k"]).collect()
    assert len(out) == 1 and out[0]["volume"] is None and (out[0]["open"], out[0]["close"]) == (0.0, 3.0)


def test_stop_counts_before_target_in_one_bar(spark):
    rows = [("a", 0, 10.0, 10.0, 10.0, 10.0, 4.0), ("a", 1, 10.0, 20.0, 1.0, 10.0, 4.0), ("a", 2, 10.0, 10.0, 10.0, 10.0, 4.0)]
    df = spark.createDataFrame(rows, "k string, t int, open double, high double, low double, close double, atr double")
    out = labels.trade_path(df, ["k"], "t", "atr", 1, horizon=2).collect()
    assert [(r["exit_reason"], r["exit_bar"]) for r in out] == [("STOP", 1)]
    assert labels.first_touch(df, ["k"], "t", "atr", horizon=2).orderBy("t").first()["outcome"] == "AMBIGUOUS"


def test_hash_chain_breaks_where_it_is_changed(spark):
    rows = spark.createDataFrame([("x", i, f"e{i}") for i in range(6)], "c string, n int, e string")
    good = audit.chained(rows, ["c"], "n", ["n", "e"])
    assert audit.broken(good, ["c"], "n", ["n", "e"]).count() == 0
    bad = good.withColumn("e", F.when(F.col("n") == 3, F.lit("changed")).otherwise(F.col("e")))
    assert [r["n"] for r in audit.broken(bad, ["c"], "n", ["n", "e"]).collect()] == [3]


def test_appends_are_idempotent_and_collisions_fail(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert audit.append_new(rows, str(tmp_path / "t"), ["id"], ["v"]) == 2
    assert audit.append_new(rows, str(tmp_path / "t"), ["id"], ["v"]) == 0
    with pytest.raises(ValueError, match="identity"):
        audit.append_new(spark.createDataFrame([(1, "z")], "id int, v string"), str(tmp_path / "t"), ["id"], ["v"])


def test_csv_bars_fail_on_bad_rows(spark, tmp_path):
    head = "provider_bar_id,provider_revision,opens_at,closes_at,open,high,low,close,volume,finalized_at,source_watermark\n"
    row = "b{0},1,2026-08-24T03:4{0}:00Z,2026-08-24T03:4{1}:00Z,10,12,9,11,{2},2026-08-24T03:4{1}:01Z,w{0}\n"
    (tmp_path / "good.csv").write_text(head + row.format(5, 6, "") + row.format(6, 7, ""))
    (tmp_path / "volume.csv").write_text(head + row.format(5, 6, "3"))
    (tmp_path / "broken.csv").write_text(head + "b,1,never,x,1,1,1,1,,,\n")
    assert len(readers.bars_csv(spark, str(tmp_path / "good.csv")).collect()) == 2
    for name in ("volume", "broken"):
        with pytest.raises(Exception):  # noqa: B017 Spark's own error types
            readers.bars_csv(spark, str(tmp_path / f"{name}.csv")).collect()


def test_datasets_are_saved_once(spark, tmp_path):
    rows = bars(spark, 5).withColumn("closes_at", F.col("opens_at") + F.expr("interval 5 minutes"))
    assert sinks.save_dataset(rows, str(tmp_path), "one", "PASS", "test") and not sinks.save_dataset(rows, str(tmp_path), "one", "PASS", "test")
    assert sinks.save_dataset(rows, str(tmp_path), "two", "REJECTED", "test") and sinks.latest_passed(spark, str(tmp_path)) == "one"
    assert sinks.dataset(spark, str(tmp_path), "one").count() == 5


def test_causal_percentiles_equal_counting(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i int, v int")
    out = folds.causal_percentile(df, ["k"], "i", "v", "p").orderBy("i").collect()
    for i, r in enumerate(out):
        assert r["p"] == (None if i == 0 else pytest.approx(sum(x <= values[i] for x in values[:i]) / i))


def test_fits_find_known_parameters(spark):
    rows = spark.range(4000).select(((F.col("id") % 99 + 1) / 100).alias("p"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 < (F.col("id") % 99 + 1) / 100).cast("int").alias("y"))
    a, b = calibration.fit_platt(rows, [F.ln(F.col("p") / (1 - F.col("p")))], "y")
    assert a == pytest.approx(1, abs=0.15) and b == pytest.approx(0, abs=0.15)
    pools = calibration.fit_isotonic(rows, "p", "y")
    assert [y for _, y in pools] == sorted(y for _, y in pools)
    assert metrics.binary_metrics(rows, [], "p", "y").first()["auc"] > 0.75


def test_gates_fail_closed(spark):
    out = tracking.gate(spark.createDataFrame([(1, None), (5, 2)], "a int, b int"), {"A": F.col("a") > 2, "B": F.col("b") > 1}).orderBy("a").collect()
    assert [(r["blockers"], r["released"]) for r in out] == [(["A", "B"], False), ([], True)]


def test_calendar_json_is_verified(spark):
    c = calendar.Calendar.read(json.dumps({"holidays": ["2026-01-26"], "verified_from": "2026-01-01", "verified_through": "2026-12-31"}))
    with pytest.raises(ValueError, match="verified"):
        calendar.sessions(spark, c, dt.date(2025, 12, 31), dt.date(2026, 1, 2))


def wilder(values, n):
    out, y = [0.0] * len(values), None
    for i, v in enumerate(values):
        y = sum(values[:n]) / n if i == n - 1 else (y * (n - 1) + v) / n if i >= n else None
        out[i] = y or 0.0
    return out


def exponential(values, n, first=False):
    out, y = [], None
    for i, v in enumerate(values):
        y = v if first and i == 0 else sum(values[:n]) / n if not first and i == n - 1 else y if y is None else 2 / (n + 1) * v + (1 - 2 / (n + 1)) * y
        out.append(y or 0.0)
    return out


def test_macd_and_adx_equal_a_loop(spark):
    rows = bars(spark, 120)
    b = rows.orderBy("opens_at").collect()
    close = [r["close"] for r in b]
    line = [x - y for x, y in zip(exponential(close, 12), exponential(close, 26))]
    signal = exponential(line, 9, True)
    tr, up, down = [0.0], [0.0], [0.0]
    for x, y in zip(b, b[1:]):
        u, d = y["high"] - x["high"], x["low"] - y["low"]
        up.append(u if u > d and u > 0 else 0.0)
        down.append(d if d > u and d > 0 else 0.0)
        tr.append(max(y["high"] - y["low"], abs(y["high"] - x["close"]), abs(y["low"] - x["close"])))
    t, p, m = (wilder(v, 14) for v in (tr, up, down))
    spread = [(x - y) / z if z > 1e-12 else 0.0 for x, y, z in zip(p, m, t)]
    adx = wilder([abs(x - y) / (x + y) if z > 1e-12 and x + y else 0.0 for x, y, z in zip(p, m, t)], 14)
    rows = features.research(R.atr(rows, 14, ["series"], "opens_at", "atr_14").withColumn("session_date", F.col("opens_at").cast("date")), ["series"])
    out = rows.orderBy("opens_at").collect()
    for i in range(14, 120):
        a = out[i]["atr_14"]
        want = {"macd_line_atr": line[i] / a, "macd_signal_atr": signal[i] / a, "macd_histogram_atr": (line[i] - signal[i]) / a, "adx_14": adx[i], "di_spread": spread[i]}
        for n, v in want.items():
            assert out[i][f"research_v3__{n}"] == pytest.approx(v, rel=1e-7, abs=1e-9), (n, i)


def test_paper_trades_end_by_the_stated_rules(spark):
    at = lambda k: START + dt.timedelta(hours=k)
    path = [("a", at(0), 120.0, 110.0, 115.0), ("a", at(1), 101.0, 99.0, 100.0), ("a", at(2), 104.0, 98.0, 103.0), ("a", at(3), 112.0, 100.0, 111.0), ("a", at(6), 90.0, 80.0, 85.0)]
    b = spark.createDataFrame(path, "k string, at timestamp, high double, low double, close double")
    made = [
        ("target", "BUY", 99.5, 100.5, 95.0, 110.0, 4), ("same bar", "BUY", 100.0, 102.0, 99.0, 130.0, 4), ("both", "BUY", 100.5, 101.5, 98.5, 103.5, 4), ("short stop", "SELL", 99.5, 100.5, 103.5, 90.0, 4),
        ("never", "BUY", 50.0, 51.0, 45.0, 70.0, 4), ("at expiry", "BUY", 99.5, 100.5, 60.0, 150.0, 4), ("open", "BUY", 99.5, 100.5, 60.0, 150.0, 9), ("waiting", "BUY", 50.0, 51.0, 45.0, 70.0, 9),
        ("stop in the expiry bar", "BUY", 99.0, 101.0, 82.0, 150.0, 4), ("target in it", "SELL", 99.5, 100.5, 150.0, 88.0, 4), ("both in it", "BUY", 99.5, 100.5, 98.5, 103.5, 1.5),
    ]
    trades = spark.createDataFrame([("a", *m[:6], at(0), at(m[6])) for m in made], "k string, trade_id string, side string, entry_low double, entry_high double, stop double, target double, opened_at timestamp, expires_at timestamp")
    out = {r["trade_id"]: (r["state"], r["points"]) for r in tracking.paper_trades(trades, b, ["k"]).collect()}
    assert out == {
        "target": ("TARGET_1_HIT", 9.5), "same bar": ("INVALIDATED", None), "both": ("INVALIDATED", None), "short stop": ("STOP_HIT", -4.0), "never": ("EXPIRED", None),
        "at expiry": ("EXPIRED", -15.5), "open": ("OPEN", None), "waiting": ("WAITING", None),
        "stop in the expiry bar": ("STOP_HIT", -19.0), "target in it": ("TARGET_1_HIT", 11.5), "both in it": ("INVALIDATED", None),
    }


def test_interval_joins_meet_the_last_fraction_of_a_second(spark):
    a = spark.createDataFrame([("k", 0.0, 3600.5), ("k", 3600.0, 3600.0), ("k", -0.5, 0.25), ("k", 7200.0, 7200.001)], "k string, s double, e double")
    b = spark.createDataFrame([("k", t) for t in (-0.5, 0.0, 0.25, 3600.2, 3600.5, 7200.0)], "k string, at double")
    out = asof.interval_join(a, b, ["k"], F.col("s"), F.col("e"), "at", 3600)
    assert sorted((r["s"], r["at"]) for r in out.collect()) == [(-0.5, -0.5), (-0.5, 0.0), (0.0, 0.0), (0.0, 0.25), (0.0, 3600.2), (7200.0, 7200.0)]


def test_bounded_histories_equal_a_loop(spark):
    """The last rows known at each moment, in blocks smaller and larger than a series, with ties and missing times."""
    right = [("ab"[k % 2], START + dt.timedelta(minutes=5 * (k // 3)), k) for k in range(60)] + [("c", START, 1), ("a", None, 99), (None, START, 98)]
    left = [(s, START + dt.timedelta(minutes=m), m) for s in "abz" for m in range(-5, 120, 4)] + [("a", None, 1007), (None, START, 1008)]
    x = spark.createDataFrame(left, "s string, at timestamp, n long")
    y = spark.createDataFrame(right, "s string, known timestamp, id long")
    for limit in (1, 4, 1000):
        got = {(r["s"], r["n"]): [v["id"] for v in r["last"]] for r in asof.tails(x, y, ["s"], "at", "known", ["id"], limit, "last").collect()}
        assert len(got) == len(left)
        for s, at, n in left:
            own = sorted((t, i) for u, t, i in right if u is not None and u == s and t is not None and at is not None and t <= at)
            assert got[s, n] == [i for _, i in own][-limit:], (s, n, limit)
    first = {(r["s"], r["n"]): r["next"] and r["next"]["id"] for r in asof.first_from(x.where("s is not null and at is not null"), y, ["s"], "at", "known", ["id"], "next").collect()}
    for s, at, n in left:
        if s and at:
            assert first[s, n] == min(((t, i) for u, t, i in right if u == s and t is not None and t >= at), default=(None, None))[1]


def test_gates_of_unknown_inputs_block(spark):
    blank = spark.createDataFrame([(1,)], "i int").select(*[F.lit(None).cast("boolean").alias(c) for _, c in folds.HARD_GATES], F.lit(None).cast("string").alias("data_status"), F.lit(None).cast("double").alias("reference_close"), F.lit(None).cast("double").alias("atr"))
    assert blank.select(folds.hard_gates().alias("g")).first()["g"] == ["DATA_NOT_LIVE_UNKNOWN", *[code for code, _ in folds.HARD_GATES], "REFERENCE_PRICE_UNAVAILABLE", "ATR_UNAVAILABLE"]


def test_vector_scaling_finds_what_was_done(spark):
    """Labels drawn by hash from probabilities whose logarithms were halved and shifted."""
    rows = spark.range(20000).select(*[(1 + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(9))).cast("double").alias(f"w{k}") for k in range(3)], (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10007)) / 10007).alias("u"))
    total = F.col("w0") + F.col("w1") + F.col("w2")
    rows = rows.select(*[(F.col(f"w{k}") / total).alias(f"p{k}") for k in range(3)], "u")
    true = calibration.vector_scaled(["p0", "p1", "p2"], [0.5, 0.5, 0.5], [0.4, 0.0, -0.4])
    rows = rows.withColumn("y", F.when(F.col("u") < true[0], F.lit("A")).when(F.col("u") < true[0] + true[1], F.lit("B")).otherwise(F.lit("C")))
    w, b = calibration.fit_vector(rows, ["p0", "p1", "p2"], "y", ("A", "B", "C"), ridge=1e-6)

    def loss(weights, shifts):
        p = calibration.vector_scaled(["p0", "p1", "p2"], weights, shifts)
        own = F.when(F.col("y") == "A", p[0]).when(F.col("y") == "B", p[1]).otherwise(p[2])
        return rows.agg(F.avg(-F.ln(own))).first()[0]

    best = loss(w, b)
    assert best <= loss([0.5] * 3, [0.4, 0.0, -0.4]) < loss([1.0] * 3, [0.0] * 3)
    for k in range(3):  # the least: every step from it loses
        for step in (-0.05, 0.05):
            assert best < loss([x + step * (i == k) for i, x in enumerate(w)], b)


def test_percentiles_of_ranges_equal_counting(spark):
    r = [(i * 7919 % 503) / 7 for i in range(400)]
    a, b = spark.createDataFrame([(x,) for x in r], "v double"), spark.createDataFrame([(x * 1.3,) for x in r[:150]], "v double")
    for row in folds.reference_percentile(a, b, "v", "p", ranges=7).collect():
        assert row["p"] == pytest.approx(sum(x * 1.3 <= row["v"] for x in r[:150]) / 150)
