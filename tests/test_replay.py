"""Chains of decisions, replayed policies and policy grids against plain loops."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import chains, folds, replay

START = dt.datetime(2026, 8, 24, 3, 45)


def greedy(rows, cap=None):
    """Ids taken of (id, day, start, end), in order of (start, end)."""
    until, counts, out = None, {}, set()
    for i, day, a, b in sorted(rows, key=lambda r: r[2:] + r[:1]):
        if (until is None or a >= until) and (cap is None or counts.get(day, 0) < cap):
            until, counts[day] = b, counts.get(day, 0) + 1
            out.add(i)
    return out


def intervals(seed, n, longest):
    r, at, out = random.Random(seed), 0, []
    for i in range(n):
        at += r.choice((1, 1, 2, 5))
        out.append((i, at // 40, at, at + r.randint(0 if seed % 2 else 1, longest)))
    return out


@pytest.mark.parametrize("block", [2, 4096])
def test_non_overlapping_equals_a_loop(spark, block):
    """Short and long intervals, chains over many blocks, a series of one row, rows without times."""
    series = {"a": intervals(1, 300, 4), "b": intervals(2, 300, 60), "c": intervals(3, 40, 500), "d": [(0, 0, 5, 9)]}
    rows = [(s, i, d, a, b) for s, own in series.items() for i, d, a, b in own] + [("a", 900, 0, None, 5), ("z", 901, 0, 5, None), (None, 902, 0, 1, 2)]
    df = spark.createDataFrame(rows, "s string, id long, day long, a long, b long")
    got = {(r["s"], r["id"]): r["taken"] for r in chains.non_overlapping(df, ["s"], "a", "b", block=block).collect()}
    assert len(got) == len(rows) and not any(got[k] for k in (("a", 900), ("z", 901), (None, 902)))
    for s, own in series.items():
        # which of equal intervals is taken is open, so ends are compared
        ends = lambda ids: sorted((own[i][2], own[i][3]) for i in ids)
        assert ends([i for i, *_ in own if got[s, i]]) == ends(greedy(own)), s


def test_non_overlapping_with_a_cap(spark, block=4):
    series = {s: intervals(k, 250, longest) for k, (s, longest) in enumerate((("a", 3), ("b", 30), ("c", 70)), 4)}
    df = spark.createDataFrame([(s, *r) for s, own in series.items() for r in own], "s string, id long, day long, a long, b long")
    for cap in (1, 3):
        out = chains.non_overlapping(df, ["s"], "a", "b", "day", cap, block)
        got = {}
        for r in out.where("taken").collect():
            got.setdefault(r["s"], set()).add(r["id"])
        for s, own in series.items():
            ends = lambda ids: sorted((own[i][2], own[i][3]) for i in ids)
            assert ends(got[s]) == ends(greedy(own, cap)), (s, cap)


def test_bins_do_not_matter(spark):
    """Places, counts and carried values are the same in bins of a few rows."""
    rows = [("ab"[k % 2], START + dt.timedelta(seconds=k * k % 977), k) for k in range(200)]
    df = spark.createDataFrame(rows, "s string, at timestamp, id long").withColumn("_t", chains.number(spark.createDataFrame(rows, "s string, at timestamp, id long"), "at"))
    found = []
    for bin_rows in (3, 10**6):
        width = chains.bin_width(df, "_t", bin_rows)
        out = chains.placed(df, ["s"], ["_t", "id"], "place", width)
        out = chains.counted_before(out.withColumn("ask", F.col("_t") + 5_000_000), ["s"], "_t", "ask", "n", width)
        out = chains.last_before(out, ["s"], ["_t", "id"], F.when(F.col("id") % 7 == 0, F.col("id")), "last", width)
        found.append(sorted(tuple(r[c] for c in ("s", "id", "place", "n")) + (-1 if r["last"] is None else r["last"],) for r in out.collect()))
    assert found[0] == found[1]
    for s in "ab":
        own = sorted((t, i) for x, t, i in rows if x == s)
        for place, (t, i) in enumerate(own):
            n = sum(u < t + dt.timedelta(seconds=5) for u, _ in own)
            last = next((j for _, j in reversed(own[:place]) if j % 7 == 0), -1)
            assert (s, i, place, n, last) in set(found[0])


def predictions(n, seed):
    r, rows, at = random.Random(seed), [], START
    for k in range(n):
        at += dt.timedelta(minutes=r.choice((0, 5, 5, 10, 70)))
        p = sorted((r.random(), r.random()))
        neither = r.choice((0.05, 0.1, 0.3, 0.5))
        up = (1 - neither) * (p[0] if r.random() < 0.5 else p[1])
        rows.append(("xy"[seed % 2], at, k, 1 - neither - up, neither, up, 100.0, 2.0 if k % 11 else 0.0, [] if k % 9 else ["SNAPSHOT_REVISION_MISMATCH"]))
    return rows


@pytest.mark.parametrize("block", [3, 4096])
def test_policy_replay_equals_a_loop(spark, block):
    schema = "series string, at timestamp, id long, p_down double, p_neither double, p_up double, reference_close double, atr double, gates array<string>"
    rows = predictions(400, 1) + predictions(300, 2)
    df = spark.createDataFrame(rows, schema)
    out = replay.policy_replay(df, ["series"], "at", "id", block=block).collect()
    got = {(r["series"], r["id"]): r for r in out}
    free = {(r["series"], r["id"]): r["decision"] for r in folds.signal(df.withColumn("active_side", F.lit(None).cast("string"))).collect()}
    assert len(got) == len(rows)
    seen = set()
    for s in "xy":
        side = until = None
        for _, at, k, *_ in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2])):
            if until is not None and at >= until:
                side = until = None
            own, r = free[s, k], got[s, k]
            assert r["active_side"] == side and r["expires_at"] == at + dt.timedelta(minutes=60)
            decision = own if own != "WAIT" and side in (None, own) else "WAIT"
            assert r["decision"] == decision
            if own != "WAIT" and decision == "WAIT":
                assert r["blockers"][-1] == "CONFLICTING_ACTIVE_SIGNAL_MUST_INVALIDATE_FIRST"
                seen.add("conflict")
            if decision != "WAIT":
                seen.add("renewed" if side == own else "new")
                side, until = own, at + dt.timedelta(minutes=60)
    assert seen == {"conflict", "renewed", "new"}


def test_confidence_bins(spark):
    rows = spark.createDataFrame([(p,) for p in (0.0, 0.34, 0.6, 0.99, 1.0)], "p double")
    assert [r[0] for r in rows.select(replay.confidence_bin(F.col("p"))).collect()] == ["0.0-0.1", "0.3-0.4", "0.6-0.7", "0.9-1.0", "0.9-1.0"]


SCORE = "struct<down:double,neither:double,up:double>"
PATH = "struct<exit_at:timestamp,exit_reason:string,net_points:double,r_multiple:double>"
SAMPLES = f"series string, at timestamp, id long, scores map<string,{SCORE}>, prior struct<down:double,up:double>, paths map<string,{PATH}>"
SMALL = {"source": ("RAW_MODEL_SCORE", "CALIBRATED_PROBABILITY"), "activation": (0.38, 0.45), "margin": (0.02, 0.08), "neither": (0.35, 0.45), "lift": (0.0, 0.04)}


def samples(n, seed):
    r, rows = random.Random(seed), []
    for k in range(n):
        at = START + dt.timedelta(minutes=5 * k)

        def score():
            a, b = r.random(), r.random() * 0.5
            return {"down": (1 - b) * a, "neither": b, "up": (1 - b) * (1 - a)}

        def path():
            points = r.choice((3.0, -2.0, 0.4))
            return (at + dt.timedelta(minutes=r.randint(1, 60)), r.choice(("TARGET", "STOP", "HORIZON")), points, points / 2.5)

        paths = {s: path() if r.random() < 0.9 else None for s in ("BUY", "SELL")} if k % 13 else None
        scores = {s: (x["down"], x["neither"], x["up"]) for s in SMALL["source"] for x in [score()]}
        rows.append(("s", at, k, scores, (0.33, 0.36), paths))
    return rows


def loop(rows, source, activation, margin, neither_max, lift):
    """A policy's trades and waits, by the stated order of questions."""
    until, trades, waits = None, [], {"n_active": 0, "n_wait": 0, "n_no_input": 0, "n_no_path": 0}
    for _, at, k, scores, prior, paths in rows:
        if until is not None and at < until:
            waits["n_active"] += 1
            continue
        down, neither, up = scores[source]
        side, own, other, before = ("BUY", up, down, prior[1]) if up >= down else ("SELL", down, up, prior[0])
        if neither > neither_max or own < activation or own - max(other, neither) < margin or own - before < lift:
            waits["n_wait"] += 1
        elif paths is None:
            waits["n_no_input"] += 1
        elif paths[side] is None:
            waits["n_no_path"] += 1
        else:
            until = paths[side][0]
            trades.append((k, side, *paths[side][1:]))
    return trades, waits


def test_policy_grid_equals_a_loop(spark):
    rows = samples(300, 3)
    df = spark.createDataFrame(rows, SAMPLES)
    trades, metrics = replay.replay_grid(df, ["series"], "at", "id", SMALL, block=8)
    got = {}
    for r in trades.collect():
        got.setdefault(r["policy"], []).append((r["id"], r["direction"], r["exit_reason"], r["net_points"], r["r_multiple"]))
    rows_of = {tuple(r[n] for n in SMALL): r for r in metrics.collect()}
    assert len(rows_of) == 32 and [rows_of[key]["policy"] for key in itertools.product(*SMALL.values())] == list(range(32))
    for key, r in rows_of.items():
        want, waits = loop(rows, *key)
        assert sorted(got.get(r["policy"], [])) == want and {k: r[k] for k in waits} == waits, key
        top = fall = total = 0.0
        for *_, x in want:
            total += x
            top = max(top, total)
            fall = max(fall, top - total)
        assert r["max_drawdown"] == pytest.approx(fall, abs=1e-9) and r["n_trades"] == len(want)
    best = replay.leader(metrics).first()
    worst = lambda x: round(x or 0, 9) or -999.0
    rank = lambda r: (worst(r["mean_r_lower"]), round(r["profit_factor"] or 0.0, 9), r["n_trades"], worst(r["mean_r"]), -r["policy"])
    assert rank(best) == max(map(rank, rows_of.values()))


def test_policy_selection(spark):
    first, second = (spark.createDataFrame(samples(200, k), SAMPLES) for k in (4, 5))
    r = replay.select_policy(first, second, ["series"], "at", "id", SMALL).first()
    _, metrics = replay.replay_grid(second, ["series"], "at", "id", SMALL)
    same = metrics.where(F.col("policy") == r["policy"]).first()
    assert r["n_trades"] == same["n_trades"] and r["mean_r"] == pytest.approx(same["mean_r"])
    assert r["mode"] == ("SHADOW_CANDIDATES" if not r["selection_blockers"] and not r["evaluation_blockers"] else "WAIT_ONLY")


def test_grid_of_no_rows(spark):
    _, metrics = replay.replay_grid(spark.createDataFrame([], SAMPLES), ["series"], "at", "id", SMALL)
    assert {(r["n_trades"], r["n_wait"], r["coverage"]) for r in metrics.collect()} == {(0, 0, None)}
