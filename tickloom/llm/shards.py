"""Balanced label propagation: documents of one group move to one shard, sizes stay even."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, spread_join, staged


def allowed_moves(asked: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many of the ``asked`` moves between shards (from, to) can be made at once, so that no shard gains more than its ``room``.

    Moves around a circle of shards need no room: circles are taken while any are left, then rows of moves that end
    where there is room. Each taken circle or row uses up a pair's wishes or a shard's room, so the steps are
    fewer than pairs and shards together, whatever the corpus.
    """
    left, room, out = {p: n for p, n in asked.items() if n > 0 and p[0] != p[1]}, dict(room), {}

    def take(path: list[tuple[int, int]], most: int | None) -> int:
        n = min([left[p] for p in path] + ([most] if most is not None else []))
        for p in path:
            out[p] = out.get(p, 0) + n
            left[p] -= n
            if not left[p]:
                del left[p]
        return n

    def way(start: int, good) -> list[tuple[int, int]] | None:
        """The shortest row of moves from ``start`` to a shard that is ``good``."""
        came, todo = {}, [start]
        for a in todo:
            for _, b in sorted(p for p in left if p[0] == a):
                if good(b):
                    path = [(a, b)]
                    while path[0][0] != start:
                        path.insert(0, (came[path[0][0]], path[0][0]))
                    return path
                if b not in came and b != start:
                    came[b] = a
                    todo.append(b)
        return None

    for s in sorted(room):
        while path := way(s, lambda b, s=s: b == s):
            take(path, None)
    for s in sorted(room):
        while path := way(s, lambda b: room[b] > 0):
            n = take(path, room[path[-1][1]])
            room[path[-1][1]] -= n
            room[s] += n
    return out


def balanced_labels(nodes: DataFrame, shards: int = 24, rounds: int = 12, groups: str = "grp", node: str = "node") -> DataFrame:
    """Adds ``shard`` to ``nodes`` (a unique ``node``, a ``groups`` key that linked nodes share); give a staged table.

    Shards' row counts differ by one at most. Each round counts a group's nodes in each shard, and its nodes ask
    to move to the shard that holds most of it (ties by a hash, so that wishes go both ways). The driver sees the
    counts of wishes from shard to shard alone, and lets as many pass as change places or find room
    (``allowed_moves``), until hardly any wish is left. A group above a shard's size counts as several of half of it. Nodes without links
    fill up. An empty table gives an empty table; a null group is a node without links.
    """
    start = F.pmod(F.xxhash64(node), F.lit(shards)).cast("int")
    total = nodes.count()
    target = {s: total // shards + (s < total % shards) for s in range(shards)}
    sizes = nodes.where(F.col(groups).isNotNull()).groupBy(groups).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    full = max(1, total // shards)
    parts = F.when(F.col("_size") > full, F.ceil(F.col("_size") * 2 / F.lit(full))).otherwise(F.lit(1))
    split = F.when(parts > 1, F.pmod(F.xxhash64(F.lit(7), node), parts)).otherwise(F.lit(0))
    linked = spread_join(nodes.select(node, groups), sizes, [groups], [node])
    linked = linked.select(node, F.xxhash64(groups, split).alias("_unit"), "_size", start.alias("shard"))
    linked, wishes = staged(linked, "linked"), None
    for _ in range(rounds):
        votes = linked.groupBy("_unit", "shard").agg(F.count(F.lit(1)).alias("n"))
        tie = F.xxhash64("_unit", "shard")
        best = votes.groupBy("_unit").agg(F.max_by("shard", F.struct("n", tie)).alias("_to"), F.count(F.lit(1)).alias("_in")).where("_in > 1")
        # a unit of one shard has no wish, so only the others' few rows meet here
        wishes = spread_join(linked, best.select("_unit", "_to"), ["_unit"], [node]).where("shard <> _to").select(node, "_unit", "_size", "shard", "_to")
        wishes = staged(wishes, "wishes")
        asked = {(r["shard"], r["_to"]): r["n"] for r in wishes.groupBy("shard", "_to").agg(F.count(F.lit(1)).alias("n")).collect()}
        held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        quota = allowed_moves(asked, {s: n - held.get(s, 0) for s, n in target.items()})
        moved = sum(quota.values())
        if not moved:
            break
        # units stay together in the order of a pair's queue; a large unit is spread over buckets
        bucket = F.pmod(F.col("_unit"), F.lit(256)) * 64 + F.when(F.col("_size") > 64, F.pmod(F.xxhash64(node), F.lit(64))).otherwise(F.lit(0))
        movers = ranked(wishes, ["shard", "_to"], ["_unit", node], "_rank", bucket)
        pair = F.col("shard") * shards + F.col("_to")
        most = F.coalesce(F.create_map(*[F.lit(x) for (a, b), n in quota.items() for x in (a * shards + b, n)])[pair], F.lit(0))
        movers = movers.where(F.col("_rank") < most).select(node, F.col("_to").alias("_now"))
        linked = linked.join(movers, node, "left").select(node, "_unit", "_size", F.coalesce("_now", "shard").cast("int").alias("shard"))
        linked = staged(linked, "linked")
        if moved * 1000 < total:
            break

    # wishes of small units are all met now; shards then give away what is above their size, small whole units last in the queue
    small = F.col("_size") <= max(64, total // shards // 64)
    if wishes is not None:
        late = wishes.where(small).select(node, F.col("_to").alias("_now"))
        linked = linked.join(late, node, "left").select(node, "_unit", "_size", F.coalesce("_now", "shard").cast("int").alias("shard"))
    by_unit = F.pmod(F.col("_unit"), F.lit(1024))
    bucket = F.when(small, 4096 + by_unit).otherwise(F.pmod(F.col("_unit"), F.lit(64)) * 64 + F.pmod(F.xxhash64(node), F.lit(64)))
    queue = staged(ranked(linked, ["shard"], ["_unit", node], "_rank", bucket), "queue")
    placed = queue.where(F.col("_rank") < _of(target, "shard")).select(node, "shard")
    held = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    # units that had no place go to the gaps one after the other, then nodes without links
    over = queue.where(F.col("_rank") >= _of(target, "shard")).select(node, "_unit", by_unit.alias("_q"))
    alone = nodes.join(linked, node, "left_anti").select(node, F.lit(None).cast("long").alias("_unit"), (1024 + F.pmod(F.xxhash64(node), F.lit(1024))).alias("_q"))
    rest = ranked(over.unionByName(alone), [], ["_unit", node], "_rank", F.col("_q"))
    rest = rest.select(node, _by_interval("_rank", {s: n - held.get(s, 0) for s, n in target.items()}).alias("shard"))
    return nodes.join(placed.unionByName(rest).select(node, F.col("shard").cast("int")), node)


def _by_interval(rank: str, room: dict[int, int]):
    """The shard whose interval of ``room`` holds the rank."""
    out, end = F.lit(None).cast("int"), 0
    ends = []
    for shard, n in sorted(room.items()):
        end += n
        ends.append((shard, end))
    for shard, end in reversed(ends):
        out = F.when(F.col(rank) < end, F.lit(shard)).otherwise(out)
    return out


def _of(values: dict[int, int], key: str):
    return F.create_map(*[F.lit(x) for s, n in values.items() for x in (s, n)])[F.col(key)]


def cut_share(labels: DataFrame, groups: str = "grp") -> float:
    """The share of links (pairs of rows of one group) whose ends are in different shards; 0 without links."""
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    own = labels.where(F.col(groups).isNotNull()).groupBy(groups, "shard").agg(F.count(F.lit(1)).alias("n"))
    own = own.groupBy(groups).agg(F.sum("n").alias("m"), F.sum(pairs("n")).alias("kept"))
    r = own.agg(F.sum("kept").alias("kept"), F.sum(pairs("m")).alias("all")).first()
    return 1 - r["kept"] / r["all"] if r["all"] else 0.0


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 12) -> DataFrame:
    """All rows of ``docs`` in shards of equal row counts, equal texts together where a shard has room.

    Columns: doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null). Every row has a place of its own,
    rows that repeat an id or have none too. A null text counts as an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    nodes = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("grp"),
        F.monotonically_increasing_id().alias("node"),
    )
    out = balanced_labels(staged(nodes, "nodes"), shards, rounds)  # staged once, so that a node keeps its number
    out = ranked(out.select("doc_id", "node", "size", "text_crc32", "shard"), ["shard"], ["doc_id", "node"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
