"""Whitening of vectors by an exact covariance: digit-slice products.

Vectors become whole numbers. The centred numbers n*x - S are cut into small limbs, so that float64 matrix products of
limbs are exact; each task puts its limb products together as big integers, these are summed over all tasks, and the
driver decomposes the quotient, a matrix of the dimension's size.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: A limb's bits, and rows in a product: a sum of 2^11 products of two limbs stays within the 2^53 that a double holds exactly.
LIMB, ROWS = 21, 1 << 11
#: An eigenvalue below this share of the greatest one is rounding: its component is not scaled.
RANK = 1e-13


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows (vec_id, x) with x = floor(scale * component) as longs.

    Null and empty vectors, those with null or non-finite entries or entries that no long can hold, and those of other than the
    commonest length (the shorter of equally common ones) take no part. Repeated and null ids stay rows of their own.
    """
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * scale).cast("long"))
    bad = F.exists(F.col(vector).cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c * scale) >= 2.0**63))
    rows = vectors.where((F.size(vector) > 0) & ~bad)
    sizes = rows.groupBy(F.size(vector).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    common = sizes.orderBy(F.desc("rows"), "n").limit(1).first()
    rows = rows.where(F.size(vector) == (common["n"] if common else -1))
    return rows.select(F.col(key).cast("long").alias("vec_id"), scaled.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S exactly: as longs where they surely fit, else as Python's integers."""
    most = int(np.abs(x.astype("f8")).max(initial=0)) + 1
    if n * most + max((abs(s) for s in sums.tolist()), default=0) < 1 << 62:
        return x * np.int64(n) - sums.astype("i8")
    return x.astype(object) * n - sums


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Matrices of doubles with y = sum of limb k times 2^(LIMB k): all in 0..2^LIMB - 1 but the last, which has the sign."""
    out = []
    while True:
        small = bool(((y >= -(1 << (LIMB - 1))) & (y < 1 << (LIMB - 1))).all())
        out.append((y if small else y & ((1 << LIMB) - 1)).astype("f8"))
        if small:
            return out
        y = y >> LIMB


def gram(y: np.ndarray) -> np.ndarray:
    """y'y as Python's integers, by float64 products of limbs."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), ROWS):
        parts = limbs(y[at : at + ROWS])
        for i, a in enumerate(parts):
            for j in range(i, len(parts)):
                product = (a.T @ parts[j]).astype("i8").astype(object) << (LIMB * (i + j))
                total += product if i == j else product + product.T
    return total


def summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], parts: int = 64) -> np.ndarray:
    """The matrix ``of``(x) of big integers, summed over all rows (x): by task, then in two steps; totals alone reach the driver."""
    schema = "part int, row int, v array<string>"

    def table(part: int, at: list[int], total: np.ndarray) -> pa.RecordBatch:
        said = pa.array([[str(v) for v in r] for r in total.tolist()], pa.list_(pa.string()))
        numbers = pa.array(np.full(len(total), part, "i4")), pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays([*numbers, said], ["part", "row", "v"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = of(_matrix(b.column(0)))
                total = own if total is None else total + own
        if total is not None:
            yield table(TaskContext.get().partitionId(), list(range(len(total))), total)

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.array([int(v) for v in r], object) for r in t.column("v").to_pylist())
        return pa.Table.from_batches([table(t.column("part")[0].as_py(), [t.column("row")[0].as_py()], total[None, :])])

    sums = rows.select("x").mapInArrow(local, schema)
    for keys in ([(F.col("part") % parts).alias("k"), "row"], ["row"]):
        sums = sums.groupBy(*keys).applyInArrow(add, schema)
    found = sorted(sums.select("row", "v").collect(), key=lambda r: r["row"])
    return np.array([[int(v) for v in r["v"]] for r in found], object)


@dataclasses.dataclass(frozen=True)
class Whitening:
    """The fit list's size and sums, its covariance's eigenvalues (falling) and unit eigenvectors (columns)."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def scales(self, k: int) -> np.ndarray:
        """1 / sqrt(e) of the first ``k`` components; nan where e is no more than rounding."""
        e = self.values[:k]
        real = e > RANK * max(self.values.max(initial=0.0), 0.0)
        return np.where(real, 1 / np.sqrt(np.where(real, e, 1.0)), np.nan)

    def project(self, y: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` whitened components of rows with ``centred`` numbers y."""
        return (y.astype("f8") / self.n) @ self.vectors[:, :k] * self.scales(k)


def fit(fit_list: DataFrame) -> Whitening | None:
    """Fits the rows (x) of distinct whole vectors, all of one length; None without rows.

    The covariance is exact until the one division of each entry, so it depends on neither order nor partitions.
    """
    rows = fit_list.select("x")

    def sums(x: np.ndarray) -> np.ndarray:
        fits = len(x) * (int(np.abs(x.astype("f8")).max(initial=0)) + 1) < 1 << 62
        total = x.sum(0).astype(object) if fits else x.astype(object).sum(0)
        return np.stack([np.array([len(x), *[0] * (x.shape[1] - 1)], object), total])

    found = summed(rows, sums)
    if not len(found):
        return None
    n, total = int(found[0][0]), found[1]
    products = summed(rows, lambda x: gram(centred(x, n, total)))
    v = np.array([[p / n**3 for p in r] for r in products.tolist()])  # Python rounds a quotient of integers once
    values, vectors = np.linalg.eigh(v)
    trace = sum(products[i][i] for i in range(len(products))) / n**3
    return Whitening(n, total, values[::-1].copy(), vectors[:, ::-1].copy(), trace)


def components(rows: DataFrame, model: Whitening, k: int = 4) -> DataFrame:
    """Rows (vec_id, deviation, whitened) of ``rows`` (vec_id, x).

    ``deviation``: the sum over dimensions of (n*x - S)^2, exact, as text since it may outgrow a long; ``whitened``: the
    first ``k`` components, null where an eigenvalue is no more than rounding (all of them if there is one distinct vector).
    """

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = centred(_matrix(b.column(1)), model.n, model.sums) if b.num_rows else np.zeros((0, len(model.sums)), "i8")
            most = max(int(np.abs(y).max(initial=0)), 1)
            wide = y if y.shape[1] * most**2 < 1 << 63 else y.astype(object)
            far = (wide * wide).sum(1).tolist()
            z = [[None if np.isnan(v) else v for v in r] for r in model.project(y, k).tolist()]
            columns = [b.column(0), pa.array([str(d) for d in far], pa.string()), pa.array(z, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(projected, "vec_id long, deviation string, whitened array<double>")


def identity_error(fit_list: DataFrame, model: Whitening, k: int = 4) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity; None if no component is scaled."""
    use = np.flatnonzero(~np.isnan(model.scales(k)))
    if not len(use):
        return None
    z = components(fit_list.select(F.lit(0).cast("long").alias("vec_id"), "x"), model, k)
    z = z.select(*[F.col("whitened")[int(i)].alias(f"z{i}") for i in use])
    mean = z.agg(*[F.avg(c).alias(c) for c in z.columns]).first()
    z = z.select(*[(F.col(c) - mean[c]).alias(c) for c in z.columns])
    pairs = [(a, b) for i, a in enumerate(z.columns) for b in z.columns[i:]]
    found = z.agg(*[F.avg(F.col(a) * F.col(b)) for a, b in pairs]).first()
    return float(max(abs(v - (a == b)) for (a, b), v in zip(pairs, found, strict=True)))


def whiten_table(vectors: DataFrame, k: int = 4, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits), ``k`` a vector.

    Fits each distinct whole vector once (``whole`` says which take part), whatever number of rows has it. Fewer
    dimensions than ``k`` give fewer components. ``deviation`` is null where a long cannot hold it; ``deviation_digits`` has it
    always. ``explained`` is null where all vectors are equal. Tables without usable vectors give no rows.
    """
    rows = whole(vectors, key, vector, scale)
    fit_list = staged(rows.select("x").distinct(), "fit_list")
    model = fit(fit_list)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    if model is None:
        return vectors.sparkSession.createDataFrame([], out)
    share = [float(e / model.trace) if model.trace > 0 else None for e in model.values[:k]]
    found = components(rows, model, k).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        F.array(*[F.lit(s).cast("double") for s in share])[F.col("at")].alias("explained"),
        F.lit(identity_error(fit_list, model, k)).cast("double").alias("identity_error"),
        F.col("deviation").alias("deviation_digits"),
    )
