"""Whitening against plain arithmetic with Python's integers and NumPy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, x int, component string, n string"


def rows_of(vectors):
    return [(k, v, 1, "c", "n") for k, v in vectors]


def plain(vectors, k=4):
    """(vec_id, component) to (n, deviation, whitened, explained), by exact covariance."""
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in good]
    fit = sorted({v for _, v in x})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    y = [[n * v[j] - sums[j] for j in range(d)] for v in fit]
    cov = np.array([[sum(r[a] * r[b] for r in y) / n**3 for b in range(d)] for a in range(d)])
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1], w[:, ::-1]
    out = []
    for i, v in x:
        z = np.array([n * v[j] - sums[j] for j in range(d)], float) / n
        for c in range(min(k, d)):
            far = sum((n * v[j] - sums[j]) ** 2 for j in range(d))
            out.append((i, c + 1, n, far, float(z @ w[:, c]) / math.sqrt(e[c]), e[c] / np.trace(cov)))
    return out


def compared(spark, vectors):
    df = spark.createDataFrame(rows_of(vectors), SCHEMA)
    got = sorted((r[:4], r[4:]) for r in map(tuple, whitening.whiten_table(df).collect()))
    want = sorted((r[:4], r[4:]) for r in plain(vectors))
    assert [k for k, _ in got] == [k for k, _ in want]
    by = {}
    for ((_, component, _, _), (z, share, error, _)), (_, (own, explained)) in zip(got, want, strict=True):
        by.setdefault(component, []).append((z, own))
        assert share == pytest.approx(explained, rel=1e-9) and error < 1e-9
    for pairs in by.values():
        a, b = np.array(pairs).T
        sign = 1 if a @ b > 0 else -1
        assert np.allclose(a, sign * b, atol=1e-7)


def test_equals_exact_arithmetic(spark):
    r = random.Random(5)
    vectors = [(k, [r.gauss(0, 1 + j) for j in range(7)]) for k in range(300)]
    vectors += [(1000 + k, vectors[0][1]) for k in range(200)]  # one vector many times
    vectors += [(5, vectors[7][1]), (5, [0.5] * 7), (600, [0.0] * 7), (601, [-0.0] * 7)]
    odd = [(700, None), (701, [None] * 7), (702, [float("nan")] * 7), (703, [float("inf")] + [0.0] * 6), (704, []), (705, [1.0])]
    df = spark.createDataFrame(rows_of(vectors + odd), SCHEMA)
    assert {r["vec_id"] for r in whitening.whiten_table(df).collect()} == {k for k, _ in vectors}
    compared(spark, vectors)
    compared(spark, [(k, v[:2]) for k, v in vectors])  # fewer dimensions than components


def test_limbs_are_exact():
    r = np.random.default_rng(3)
    for y in (r.integers(-100, 100, (5000, 5)), r.integers(-(1 << 61), 1 << 61, (3000, 4)), r.integers(-(1 << 61), 1 << 61, (50, 3)).astype(object) * 10**25):
        own = y.astype(object)
        assert (whitening.gram(y) == own.T @ own).all()
        assert all((np.abs(p) < 1 << whitening.LIMB).all() for p in whitening.limbs(y))


def test_wide_numbers_stay_exact(spark):
    """Numbers whose squares no long can hold, and one entry that no long can hold at all."""
    r = random.Random(8)
    vectors = [(k, [r.uniform(-1e16, 1e16), r.uniform(-3, 3), r.uniform(-1e9, 1e9)]) for k in range(60)]
    df = spark.createDataFrame([(k, v) for k, v in [*vectors, (99, [1e300, 0.0, 0.0])]], "vec_id long, embedding array<double>")
    x = {k: [math.floor(256 * c) for c in v] for k, v in vectors}
    sums = [sum(v[j] for v in x.values()) for j in range(3)]
    out = whitening.whiten_table(df).collect()
    assert len(out) == 180
    for row in out:
        far = sum((60 * x[row["vec_id"]][j] - sums[j]) ** 2 for j in range(3))
        assert int(row["deviation_digits"]) == far and row["deviation"] == (far if far < 1 << 63 else None)


def test_layout_does_not_matter(spark):
    r = random.Random(6)
    df = spark.createDataFrame(rows_of([(k, [r.gauss(0, 1) for _ in range(6)]) for k in range(400)]), SCHEMA)
    one, other = (sorted(map(tuple, whitening.whiten_table(df.repartition(n)).collect())) for n in (1, 7))
    assert [a[:6] for a in one] == [b[:6] for b in other]


def test_little_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten_table(empty).collect() == []
    assert whitening.whiten_table(spark.createDataFrame(rows_of([(1, None), (2, [])]), SCHEMA)).collect() == []
    same = whitening.whiten_table(spark.createDataFrame(rows_of([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])]), SCHEMA)).collect()
    assert len(same) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, None, None)}
    flat = whitening.whiten_table(spark.createDataFrame(rows_of([(1, [1.0, 5.0]), (2, [2.0, 5.0])]), SCHEMA)).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)}
    assert all(r["identity_error"] < 1e-9 for r in flat)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = queries.op11_digit_slice_whitening(spark, sf)
    assert dict(out.dtypes) | {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"} == dict(out.dtypes)
    got = {(r["vec_id"], r["component"]): r for r in out.collect()}
    want = plain(vectors)
    assert len(got) == len(want)
    signs = {}
    for i, c, n, far, z, share in want:
        r = got[i, c]
        assert (r["n"], r["deviation"]) == (n, far) and r["explained"] == pytest.approx(share, rel=1e-4) and r["identity_error"] <= 1e-4
        if abs(z) > 1e-3:
            signs.setdefault(c, set()).add(np.sign(r["whitened"] * z))
        assert abs(r["whitened"]) == pytest.approx(abs(z), abs=1e-6)
    assert all(len(s) == 1 for s in signs.values())
    assert out.where(F.col("whitened").isNull()).count() == 0
