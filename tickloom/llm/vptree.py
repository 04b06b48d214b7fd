"""Largest inner products by vantage-point trees: a coarse one deals vectors to shards, and each shard has its own.

A point x becomes (x, sqrt(M² - |x|²)) with M the greatest length, a query q (q, 0): the nearest of these points have the
largest products with q, and the triangle inequality holds.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

LEAF = 256
#: The most leaves of the coarse tree, and the most rows of which it is built.
COARSE, SAMPLE = 1024, 8192


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (vec_id, v) with double components, without nulls, non-finite components and zero vectors.

    Only vectors of the commonest length take part (the shorter of equally common ones): others have no product with them.
    """
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def scaled(factor: float, reach: np.ndarray) -> np.ndarray:
    """``factor`` times the k-th distances; where fewer than k are found all is near enough, whatever the factor."""
    return np.where(np.isinf(reach), np.inf, factor * np.where(np.isinf(reach), 0.0, reach))


def build(ids: np.ndarray, x: np.ndarray, norm: float, seed: int = 11) -> dict[str, np.ndarray]:
    """A tree over points (x, sqrt(norm² - |x|²)), whose nearest to (q, 0) have the largest products with q.

    Node k: its vantage point ``at[k]`` and, for each side, the child and the
    least and largest distance of the side's points from the vantage point. Sides
    are halves in order of distance, so equal distances cannot unbalance it.
    A child below 0 is a leaf: rows ``starts[-c-1]`` up to the next start.
    """
    extra = np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))
    random, order = np.random.default_rng(seed), []
    at, child, low, high, starts = [], [], [], [], [0]

    def grow(own: np.ndarray) -> int:
        if len(own) <= LEAF:
            order.append(own[np.argsort(ids[own])])
            starts.append(starts[-1] + len(own))
            return -(len(starts) - 1)
        some = own[random.integers(0, len(own), 8)]
        far = [np.var(x[own[:: max(1, len(own) // 200)]] @ x[p]) for p in some]
        p = some[int(np.argmax(far))]
        d = np.sqrt(np.maximum(2 * norm**2 - 2 * (x[own] @ x[p] + extra[own] * extra[p]), 0))
        by = np.argsort(d, kind="stable")
        k, half = len(at), len(own) // 2
        for rows in (at, child, low, high):
            rows.append(None)
        sides = by[:half], by[half:]
        at[k], low[k], high[k] = p, [d[s].min() for s in sides], [d[s].max() for s in sides]
        child[k] = [grow(own[s]) for s in sides]
        return k

    root = grow(np.arange(len(ids)))
    rows = np.concatenate(order)
    place = np.empty(len(rows), "i8")
    place[rows] = np.arange(len(rows))
    return {
        "ids": ids[rows], "x": x[rows], "at": place[np.array(at, "i8")] if at else np.zeros(0, "i8"), "child": np.array(child, "i8").reshape(-1, 2),
        "low": np.array(low, "f8").reshape(-1, 2), "high": np.array(high, "f8").reshape(-1, 2), "starts": np.array(starts), "root": np.array(root), "norm": np.array(norm),
    }


def search(tree: dict[str, np.ndarray], keys: np.ndarray, q: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and products of the ``k`` best for each query, best first, ties to the smaller id, and each find's bound; unfilled places have id -1.

    A side is skipped where the triangle inequality puts its points farther than ``factor`` times the k-th best distance:
    with factor 1 nothing is lost. ``floor``: products that other trees have found k times already. A find's
    bound is the greatest of those distances on the way to it: what a search must allow for to meet it.
    """
    ids, x, norm = tree["ids"], tree["x"], float(tree["norm"])
    best, score, way = np.full((len(q), k), -1, "i8"), np.full((len(q), k), -np.inf), np.zeros((len(q), k))
    floor = np.full(len(q), -np.inf) if floor is None else floor
    long = (q * q).sum(1) + norm**2
    near_zero = 1e-9 * np.sqrt((q * q).sum(1)) * norm  # products of one pair may differ by so much with the shape of the matrix
    to_vantage = np.sqrt(np.maximum(long[:, None] - 2 * q @ x[tree["at"]].T, 0))

    def visit(node: int, own: np.ndarray, least: np.ndarray) -> None:
        if node < 0:
            a, b = tree["starts"][-node - 1], tree["starts"][-node]
            s = q[own] @ x[a:b].T
            s[ids[a:b][None, :] == keys[own][:, None]] = -np.inf
            kth = -np.partition(-s, k - 1, axis=1)[:, k - 1] if b - a > k else np.full(len(own), -np.inf)
            row, col = np.nonzero((s >= (np.maximum(np.maximum(kth, score[own, k - 1]), floor[own]) - near_zero[own])[:, None]) & ~np.isneginf(s))
            if not len(row):
                return
            # what may be among the best gets its score by one sum, whatever the block; worse ones are left out
            n = np.bincount(row, minlength=len(own))
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            new, found = np.full((len(own), n.max()), -np.inf), np.full((len(own), n.max()), -1, "i8")
            new[row, place], found[row, place] = (q[own[row]] * x[a + col]).sum(1), ids[a + col]
            s, c = np.concatenate([score[own], new], 1), np.concatenate([best[own], found], 1)
            w = np.concatenate([way[own], np.broadcast_to(least[:, None], found.shape)], 1)
            by = np.lexsort((c, -s), axis=1)[:, :k]
            best[own], score[own], way[own] = (np.take_along_axis(m, by, 1) for m in (c, s, w))
            return
        d = to_vantage[own, node]
        bound = np.maximum(0, np.maximum(d[:, None] - tree["high"][node], tree["low"][node] - d[:, None]))
        near = d <= (tree["high"][node][0] + tree["low"][node][1]) / 2
        for first, group in ((0, near), (1, ~near)):
            for side in (first, 1 - first):
                worst = np.maximum(score[own[group], k - 1], floor[own[group]])
                kth = np.sqrt(np.maximum(long[own[group]] - 2 * worst, 0))
                ok = bound[group, side] <= scaled(factor, kth) + 1e-9
                if ok.any():
                    visit(int(tree["child"][node][side]), own[group][ok], np.maximum(least[group], bound[group, side])[ok])

    if len(ids) and len(q):
        visit(int(tree["root"]), np.arange(len(q)), np.zeros(len(q)))
    best[np.isneginf(score)] = -1
    return best, score, way


class Coarse:
    """A vantage-point tree over a sample, whose leaves are the shards' numbers; ``ranges`` bounds each leaf's distances from the vantage points on its way."""

    def __init__(self, x: np.ndarray, norm: float, leaves: int, seed: int = 3):
        extra = np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))
        self.norm, self.depth = norm, max(0, int(np.ceil(np.log2(max(1, leaves)))))
        points, random = np.column_stack([x, extra]), np.random.default_rng(seed)
        nodes = (1 << self.depth) - 1
        self.at, self.cut = np.zeros((nodes, points.shape[1])), np.zeros(nodes)
        groups = [np.arange(len(x))]
        for level in range(self.depth):
            deeper = []
            for i, own in enumerate(groups):
                node = (1 << level) - 1 + i
                if len(own):
                    some = own[random.integers(0, len(own), 8)]
                    seen = points[own[:: max(1, len(own) // 200)]]
                    far = [np.var(np.sqrt(np.maximum(((seen - points[p]) ** 2).sum(1), 0))) for p in some]
                    self.at[node] = points[some[int(np.argmax(far))]]
                    d = np.sqrt(((points[own] - self.at[node]) ** 2).sum(1))
                    self.cut[node] = np.median(d)
                    deeper += [own[d <= self.cut[node]], own[d > self.cut[node]]]
                else:
                    deeper += [own, own]
            groups = deeper
        self.low, self.high = np.full((1 << self.depth, self.depth), np.inf), np.full((1 << self.depth, self.depth), -np.inf)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's leaf, and its distances from the vantage points on the way."""
        points = np.column_stack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))])
        i, way = np.zeros(len(x), "i8"), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            node = (1 << level) - 1 + i
            way[:, level] = np.sqrt(((points - self.at[node]) ** 2).sum(1))
            i = 2 * i + (way[:, level] > self.cut[node])
        return i, way

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The least distance that each leaf's points can have from each query (infinite for leaves without points)."""
        to = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (self.at**2).sum(1) - 2 * q @ self.at[:, :-1].T, 0))
        out = np.zeros((len(q), 1 << self.depth))
        leaf = np.arange(1 << self.depth)
        for level in range(self.depth):
            d = to[:, (1 << level) - 1 + (leaf >> (self.depth - level))]
            np.maximum(out, np.maximum(self.low[:, level] - d, d - self.high[:, level]), out=out)
        return out


def _bytes(arrays: dict[str, np.ndarray]) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


def _arrays(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Index:
    """The coarse tree, which holds at most ``COARSE`` leaves, and a staged table (leaf, part, tree) of the shards' trees."""

    def __init__(self, coarse: Coarse, trees: DataFrame):
        self.coarse, self.trees = coarse, trees


def index(rows: DataFrame, shard_rows: int = 8192, same: int = 21) -> Index | None:
    """Indexes all ``usable`` rows; None where there are none.

    The coarse tree is built of the ``SAMPLE`` rows with the least hashes; every row is then dealt by it. A leaf
    of more than ``shard_rows`` rows has several trees. Of equal vectors the ``same`` least ids are kept: ties go to the smaller
    id, so with ``same`` above the number of neighbours no other can be one, and a hot vector is no hot shard.
    """
    least = W.partitionBy("v").orderBy("vec_id")
    rows = rows.dropDuplicates(["vec_id", "v"])
    rows = staged(rows.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= same).drop("_n"), "vectors")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    if not total["n"]:
        return None
    norm, leaves = float(np.sqrt(total["m"])), min(COARSE, -(-total["n"] // shard_rows))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    coarse = Coarse(np.array([r["v"] for r in sample]), norm, leaves)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf, way = coarse.place(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(list(way), pa.list_(pa.float64()))], ["vec_id", "v", "leaf", "way"])

    placed = rows.mapInArrow(dealt, "vec_id long, v array<double>, leaf long, way array<double>")
    ends = [f(F.col("way")[i]).alias(f"{n}{i}") for i in range(coarse.depth) for n, f in (("low", F.min), ("high", F.max))]
    parts = {}
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *ends).collect():  # a row a leaf
        parts[r["leaf"]] = -(-r["n"] // shard_rows)
        coarse.low[r["leaf"]], coarse.high[r["leaf"]] = [r[f"low{i}"] for i in range(coarse.depth)], [r[f"high{i}"] for i in range(coarse.depth)]

    def tree(t: pa.Table) -> pa.Table:
        one = lambda c: pa.array([t.column(c)[0].as_py()], pa.int64())
        return pa.table({"leaf": one("leaf"), "part": one("part"), "tree": pa.array([_bytes(build(t.column("vec_id").to_numpy(), _matrix(t.column("v")), norm))], pa.binary())})

    many = F.create_map(*[F.lit(x).cast("long") for leaf, n in parts.items() for x in (leaf, n)])[F.col("leaf")]
    placed = placed.select("vec_id", "v", "leaf", F.pmod(F.xxhash64("vec_id"), many).alias("part"))
    return Index(coarse, staged(placed.groupBy("leaf", "part").applyInArrow(tree, "leaf long, part long, tree binary"), "trees"))


def _visits(index: Index, queries: DataFrame, k: int, factor: float, block_rows: int) -> DataFrame:
    """Rows (query_id, vec_id, score, bound): each tree's ``k`` best for the queries (vec_id, v, leaf, bound, floor) that visit its leaf."""
    counts = {r["leaf"]: -(-r["n"] // block_rows) for r in queries.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a leaf
    if not counts:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, bound double")
    blocks = F.create_map(*[F.lit(x).cast("long") for p in counts.items() for x in p])[F.col("leaf")]

    def block(t: pa.Table) -> pa.Table:
        data = _bytes({"ids": t.column("vec_id").to_numpy(), "x": _matrix(t.column("v")), "bound": t.column("bound").to_numpy(), "floor": t.column("floor").to_numpy()})
        return pa.table({"leaf": pa.array([t.column("leaf")[0].as_py()], pa.int64()), "queries": pa.array([data], pa.binary())})

    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks)).groupBy("leaf", "block").applyInArrow(block, "leaf long, queries binary")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, own in zip(b.column(0), b.column(1)):
                q = _arrays(own.as_py())
                ids, score, way = search(_arrays(tree.as_py()), q["ids"], q["x"], k, factor, q["floor"])
                there, way = ids >= 0, np.maximum(way, q["bound"][:, None])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q["ids"], there.sum(1))), pa.array(ids[there]), pa.array(score[there]), pa.array(way[there])], ["query_id", "vec_id", "score", "bound"])

    pairs = index.trees.select("leaf", "tree").join(asked, "leaf").select("tree", "queries")
    return pairs.mapInArrow(found, "query_id long, vec_id long, score double, bound double")


def _best(rows: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _routed(index: Index, queries: DataFrame, which: str, factor: float) -> DataFrame:
    """Rows (vec_id, v, leaf, bound, floor): ``queries`` (vec_id, v, kth, reach) with the leaves to visit: the ``home`` (least bound), or the ``others`` that ``factor`` times reach (the k-th distance) allows."""
    coarse = index.coarse

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                own = b.slice(at, 1024)
                bounds = coarse.bounds(_matrix(own.column(1)))
                home = np.argmin(bounds, axis=1)
                if which == "home":
                    row, leaf = np.arange(len(home)), home
                else:
                    reach = own.column(3).to_numpy()
                    ok = (bounds <= scaled(factor, reach)[:, None] + 1e-9) & np.isfinite(bounds)
                    ok[np.arange(len(home)), home] = False
                    row, leaf = np.nonzero(ok)
                cols = [own.column(0).take(pa.array(row)), own.column(1).take(pa.array(row)), pa.array(leaf.astype("i8")), pa.array(bounds[row, leaf]), own.column(2).take(pa.array(row))]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "v", "leaf", "bound", "floor"])

    return queries.mapInArrow(routes, "vec_id long, v array<double>, leaf long, bound double, floor double")


def nearest(index: Index, queries: DataFrame, k: int = 20, factor: float = 1.0, block_rows: int = 2048) -> DataFrame:
    """The ``k`` rows of the largest inner product for each query, itself left out: query_id, rank, vec_id, score, bound.

    Queries first search their home leaf; the distance of its k-th find then tells which other leaves can hold nearer
    points, and only those are visited: with ``factor`` 1 nothing is lost, a smaller one leaves out what is hardly nearer.
    """
    none = F.lit(float("-inf"))
    first = staged(_best(_visits(index, _routed(index, queries.select("vec_id", "v", none.alias("kth"), none.alias("reach")), "home", factor), k, factor, block_rows), k), "home")
    kth = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
    long = F.aggregate("v", F.lit(index.coarse.norm**2), lambda s, x: s + x * x)
    reach = F.when(F.col("kth").isNull(), F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(long - 2 * F.col("kth"), F.lit(0.0))))
    again = queries.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("kth", none).alias("kth"), reach.alias("reach"))
    others = staged(_routed(index, again, "others", factor), "routes")
    found = _visits(index, others, k, factor, block_rows)
    return _best(first.drop("rank").unionByName(found), k).select("query_id", "rank", "vec_id", "score", "bound")


def calibrated(index: Index, queries: DataFrame, k: int, target: float, sample: int = 128) -> float:
    """The factor with which a share ``target`` of the true neighbours of ``sample`` queries (of the least hashes) would be met.

    Those queries are searched exactly, which also tells each neighbour's bound on the way to it; what counts is
    the bound's share of the k-th distance.
    """
    some = queries.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(sample)
    found = nearest(index, some, k, 1.0).join(some, F.col("query_id") == some.vec_id).select("query_id", "score", "bound", "v").collect()  # sample * k rows
    far: dict[int, float] = {}
    for r in found:
        d = np.sqrt(max(np.dot(r["v"], r["v"]) + index.coarse.norm**2 - 2 * r["score"], 1e-12))
        far[r["query_id"]] = max(far.get(r["query_id"], 0.0), d)
    ratio = [min(1.0, r["bound"] / far[r["query_id"]]) for r in found]
    return float(np.quantile(ratio, target)) if ratio else 1.0


def search_table(vectors: DataFrame, every: int = 20, k: int = 20, factor: float | None = None, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 8192) -> DataFrame:
    """Searches ``vectors`` for its rows whose id is divisible by ``every``: query_id, rank, vec_id, score, bound.

    Without ``factor`` the one that should meet 0.97 of the neighbours is found first (``calibrated``). Vectors that take
    no part have no rows. Rows that repeat an id and its vector are one candidate, other vectors of an id are candidates each; of
    queries that repeat an id the least vector is searched for.
    """
    rows = usable(vectors, key, vector)
    queries = staged(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    made = index(rows, shard_rows, k + 1)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, bound double")
    return nearest(made, queries, k, calibrated(made, queries, k, 0.97) if factor is None else factor)
