"""Order MinHash near-duplicates: ordered samples of least word grams, candidates verified by banded alignment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, row_key, sliced, spread_join, staged
from .words import grams, hashed, lowered, mixed

_SEEDS = np.random.default_rng(5).integers(1, 2**63, 4096, "u8") | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def occurrences(g: np.ndarray) -> np.ndarray:
    """Which copy of its gram each is, from 0, in text order."""
    by = np.argsort(g, kind="stable")
    sorted_ = g[by]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]] if len(g) else np.zeros(0, bool)
    at = np.arange(len(g))
    out = np.empty(len(g), "u8")
    out[by] = at - np.maximum.accumulate(np.where(new, at, 0)) if len(g) else at
    return out


def sketch(h: np.ndarray, k: int, least: int, samples: int) -> np.ndarray:
    """``samples`` hashes, each of the ``least`` occurrence-labelled grams that are smallest under one order, as they follow in the text."""
    g = grams(h, k)
    if len(g) == 0:  # fewer words than a gram: the words themselves
        g = grams(h, len(h)) if len(h) else np.zeros(1, "u8")
    labelled = mixed(g + occurrences(g) * _BASE)
    m = min(least, len(g))
    out = np.zeros(samples, "u8")
    step = max(1, 2_000_000 // len(g))
    for a in range(0, samples, step):
        seeds = _SEEDS[a : min(a + step, samples)]
        order = (labelled[None, :] ^ seeds[:, None]) * (seeds[:, None] | np.uint64(1))
        order ^= order >> np.uint64(31)
        at = np.sort(np.argpartition(order, m - 1, axis=1)[:, :m], axis=1) if m < len(g) else np.broadcast_to(np.arange(m), (len(seeds), m))
        part = np.zeros(len(seeds), "u8")
        for i in range(m):
            part = mixed(part * _BASE + labelled[at[:, i]])
        out[a : a + len(seeds)] = mixed(part + np.arange(a, a + len(seeds), dtype="u8") * _SEEDS[-1])
    return out


#: Up to so many grams' length of words, texts have samples of single words, of which edits leave more than of grams.
SHORT = 16


def all_samples(h: np.ndarray, k: int, least: int, samples: int, similarity: float) -> np.ndarray:
    """The text's samples of ``k``-word grams, of single words if it is short, and of both where partners of either kind can be similar."""
    short, parts = SHORT * k, []
    if len(h) >= similarity * (short + 1) - 1e-9:
        parts.append(sketch(h, k, least, samples))
    if len(h) <= short:
        parts.append(sketch(h, 1, least + 1, max(1, samples // 2)))
    return np.concatenate(parts)


def _prefix(c: np.ndarray, power: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, "u8"), np.cumsum(c * power[: len(c)], dtype="u8")])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Members of two sorted multisets in common."""
    both = np.concatenate([x, y])
    kinds, which = np.unique(both, return_inverse=True)
    return int(np.minimum(np.bincount(which[: len(x)], minlength=len(kinds)), np.bincount(which[len(x) :], minlength=len(kinds))).sum())


def _many_edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The same for texts of many edits: columns of the distance table as bits of their differences."""
    place: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        place[w] = place.get(w, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for left, w in zip(range(len(b) - 1, -1, -1), b.tolist()):
        same = place.get(w, 0)
        vertical = same | down
        level = (((same & up) + up) ^ up) | same
        more, fewer = down | (full & ~(level | up)), up & level
        score += bool(more & top) - bool(fewer & top)
        if score - left > most:  # each word of b that is left takes off one at most
            return None
        more = more << 1 | 1
        up, down = (fewer << 1 | ~(vertical | more)) & full, more & vertical & full
    return score if score <= most else None


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of word codes where it is ``most`` at most, else None.

    Furthest-reaching places on the diagonals of the band, one edit more each
    round; equal runs are skipped by comparing hashes of stretches.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        tail = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        d = max(len(a), len(b))
        return d if d <= most else None
    if abs(len(a) - len(b)) > most:
        return None
    # words without a partner cost an edit each
    kinds, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    surplus = np.bincount(which[: len(a)], minlength=len(kinds)) - np.bincount(which[len(a) :], minlength=len(kinds))
    if max(surplus[surplus > 0].sum(), -surplus[surplus < 0].sum()) > most:
        return None
    # an edit breaks two pairs of neighbours at most
    x, y = np.sort(which[: len(a) - 1] * len(kinds) + which[1 : len(a)]), np.sort(which[len(a) : -1] * len(kinds) + which[len(a) + 1 :])
    if max(len(x), len(y)) - _common(x, y) > 2 * most:
        return None
    power = np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(max(len(a), len(b)), _BASE, "u8"), dtype="u8")])
    pa_, pb, la, lb = _prefix(mixed(a), power), _prefix(mixed(b), power), len(a), len(b)

    def slide(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the equal run from each (i, j)."""
        out = np.zeros(len(i), "i8")
        inside = (i >= 0) & (j >= 0) & (i < la) & (j < lb)
        live = np.flatnonzero(inside)
        live = live[a[i[live]] == b[j[live]]]
        if len(live):
            x, y = i[live], j[live]
            low, high = np.ones(len(live), "i8"), np.minimum(la - x, lb - y)
            while (open_ := low < high).any():
                mid = (low + high + 1) >> 1
                same = (pa_[x + mid] - pa_[x]) * power[y] == (pb[y + mid] - pb[y]) * power[x]
                low = np.where(open_ & same, mid, low)
                high = np.where(open_ & ~same, mid - 1, high)
            out[live] = low
        return out

    reach, goal = np.array([0], "i8"), lb - la  # by diagonal j - i from -d to d: the furthest i
    reach += slide(reach, reach)
    n = min(la, lb)
    few = 2 + n // 60 + n * n // 1_000_000
    for d in range(most + 1):
        if d > few:
            return _many_edits(a, b, most)
        if abs(goal) <= d and reach[goal + d] >= la:
            return d
        wide = np.full(2 * d + 3, -2, "i8")
        wide[1:-1] = reach + 1  # change
        wide[:-2] = np.maximum(wide[:-2], reach + 1)  # a word of a left out
        wide[2:] = np.maximum(wide[2:], reach)  # a word of b put in
        k = np.arange(-d - 1, d + 2)
        wide = np.minimum(wide, np.minimum(la, lb - k))
        ok = wide >= np.maximum(0, -k)
        wide = np.where(ok, wide, -2)
        reach = wide + slide(wide, wide + k)
    return None


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 1 - edit distance / longer length is ``least`` or more, in words; two empty texts are alike."""
    longer = max(len(a), len(b))
    return distance(a, b, int((1 - least) * longer + 1e-9)) is not None


def sketches(docs: DataFrame, k: int, least: int, samples: int, similarity: float) -> DataFrame:
    """Rows (id, doc_id, row_key, text_key, n_words, words, sketch) of whole texts; ``text_key`` is equal for equal words, ``id`` numbers rows."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 36
        for b in sliced(batches):
            h, at = hashed(lowered(b.column(1).to_pylist()))
            own = [h[x:z] for x, z in zip(at[:-1], at[1:])]
            keys = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in own]
            codes = [(w >> np.uint64(32)).astype("<u4").tobytes() for w in own]
            made = pa.array([all_samples(w, k, least, samples, similarity).view("i8") for w in own], pa.list_(pa.int64()))
            cols = [pa.array(np.arange(n, n + len(own))), b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array([len(w) for w in own], pa.int64()), pa.array(codes, pa.binary()), made]
            n += len(own)
            yield pa.RecordBatch.from_arrays(cols, ["id", "doc_id", "row_key", "text_key", "n_words", "words", "sketch"])

    made = docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("row_key"))
    return made.mapInArrow(rows, "id long, doc_id long, row_key long, text_key binary, n_words long, words binary, sketch array<long>")


def verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Rows (a, b, linked) of candidate pairs (a staged table) by banded alignment of the whole texts."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ok = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    x, y = words.select(F.col("id").alias("a"), F.col("words").alias("aw")), words.select(F.col("id").alias("b"), F.col("words").alias("bw"))
    # a head may meet very many texts; both sides grow with the corpus, so that neither is ever to be broadcast
    met = spread_join(pairs.select("a", "b"), x, ["a"], ["b"], merge=True).join(y.hint("merge"), "b")
    return met.select("a", "b", "aw", "bw").mapInArrow(aligned, "a long, b long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, root) of linked ids, root the least id of the component, by alternating stars; staged each round."""
    edges, last = staged(edges.select("a", "b").distinct(), "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both.where("b > a"), least, ["a"], ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = staged(small, "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
        if last == now:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        last = now


#: Grams of a text by which it is searched anew where its samples led to buckets of several classes.
BOTTOM = 64
#: All texts of a gram that no more rows hold meet each other; in larger groups each meets one head.
CLOSE = 24


def bottom(h: np.ndarray, k: int, least: float) -> np.ndarray:
    """The ``BOTTOM`` least hashes of the text's distinct ``k``-word grams, of pairs of words in short texts, of both where partners can be of either kind."""
    short, parts, wide = SHORT * k, [], np.sqrt(least)
    for size, fits in ((k, len(h) >= short * wide), (2, len(h) <= short / wide)):
        if fits:
            g = np.unique(mixed(grams(h, size) + np.uint64(size)))
            parts.append(g[:BOTTOM])
    return np.concatenate(parts)


def fitting(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of different roots whose lengths allow the similarity; ``texts``: (id, root, n_words)."""
    x, y = (texts.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"), F.col("n_words").alias(f"{c}_words")) for c in "ab")
    both = pairs.join(x, "a").join(y, "b").where("a_root <> b_root")
    return both.where(F.least("a_words", "b_words") >= F.greatest("a_words", "b_words") * least - 1e-9).drop("a_root", "b_root")


def closer(ids: DataFrame, texts: DataFrame, words: DataFrame, k: int, least: float) -> DataFrame:
    """Rows (a, b): pairs of different classes among ``ids`` that share several grams of ``bottom`` and can be similar by length.

    Texts around a common passage fill one another's buckets, so that near ones among them may never meet one another.
    Half or more of a text's least grams are its own, and rare: those bring its near texts together directly.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            made = [bottom(np.frombuffer(w, "<u4").astype("u8"), k, least).view("i8") for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int64()))], ["id", "grams"])

    found = words.join(ids, "id", "left_semi").select("id", "words").mapInArrow(rows, "id long, grams array<long>")
    found = staged(found.join(texts, "id").select("id", "root", F.explode("grams").alias("gram")), "grams")
    head = F.min(F.struct(F.xxhash64("gram", "id").alias("o"), "id"))["id"].alias("h")
    sets = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("x"), F.max("root").alias("y"), head).where("x <> y").select("gram", "n", "h")
    found = staged(spread_join(found, sets, ["gram"], ["id"], merge=True), "shared")
    one = found.where(F.col("n") <= CLOSE).select("gram", "id", "root")
    near = one.join(one.select("gram", F.col("id").alias("h"), F.col("root").alias("h_root")), "gram").where("id < h and root <> h_root").select("id", "h")
    pairs = near.unionByName(found.where((F.col("n") > CLOSE) & (F.col("id") != F.col("h"))).select("id", "h"))
    pairs = pairs.groupBy(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = fitting(staged(pairs, "met"), texts, least)
    return pairs.where((F.col("n") > 2) | (F.least("a_words", "b_words") <= SHORT * k)).select("a", "b")


#: Rows of a part of a group, and bins of a text's counts of words and of its counts of grams, in ``remaining``.
PART, BINS = 512, (2048, 128)


def bins(h: np.ndarray, k: int) -> np.ndarray:
    """Counts (255 at most) of the text's words by ``BINS`` bins, then of its ``k``-word grams."""
    parts = [mixed(h), mixed(grams(h, k)) if len(h) >= k else np.zeros(0, "u8")]
    return np.concatenate([np.minimum(np.bincount((x % np.uint64(m)).astype("i8"), minlength=m), 255).astype("u1") for x, m in zip(parts, BINS)])


def remaining(waiting: DataFrame, labels: DataFrame, words: DataFrame, k: int, least: float) -> DataFrame:
    """Rows (a, b): all pairs of different classes that share a bucket, but those whose lengths or counts exclude the similarity.

    An edit changes one word and ``k`` grams on either side at most, so larger surpluses of counts are proof; bins only lessen them. Texts around
    one passage share dozens of buckets, most of which have one head: they meet once by their head, not once a bucket. Groups are cut into parts
    of about ``PART`` rows, and each two parts meet in a group of their own: the pairs of a large one are spread, and a task holds two parts.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            made = [bins(np.frombuffer(w, "<u4").astype("u8"), k).tobytes() for w in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["id", "n_words", "counts"])

    def met(t: pa.Table) -> pa.Table:
        part, ids, root, n = (t.column(c).to_numpy() for c in ("part", "id", "root", "n_words"))
        counts = np.frombuffer(b"".join(t.column("counts").to_pylist()), "u1").reshape(len(ids), sum(BINS))
        own, a, b = part == part.min(), [], []
        cross = not own.all()
        for r in np.flatnonzero(own):
            fits = (~own if cross else ids > ids[r]) & (root != root[r]) & (np.minimum(n, n[r]) >= np.maximum(n, n[r]) * least - 1e-9)
            at = np.flatnonzero(fits)
            for of, each in ((slice(BINS[0], None), k), (slice(BINS[0]), 1)):
                x, y = counts[at, of], counts[r, of]
                most = each * ((1 - least) * np.maximum(n[at], n[r]) + 1e-9).astype("i8")
                both = np.minimum(x, y).sum(1, dtype="i8")
                at = at[np.maximum(x.sum(1, dtype="i8"), y.sum(dtype="i8")) - both <= most]
            a.append(np.minimum(ids[r], ids[at]))
            b.append(np.maximum(ids[r], ids[at]))
        a, b = (np.concatenate(x) if x else np.zeros(0, "i8") for x in (a, b))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    rows = waiting.select("bucket", "a", "id").join(labels, "id", "left").select("bucket", "a", "id", F.coalesce("root", "id").alias("root"))
    rows = staged(rows, "rooted")
    sets = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    rows = staged(spread_join(rows, sets, ["bucket"], ["id"], merge=True).select("a", "id", "root").distinct(), "apart")
    sets = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / PART).alias("parts"))
    found = words.join(rows.select("id").distinct(), "id", "left_semi").select("id", "n_words", "words").mapInArrow(counted, "id long, n_words long, counts binary")
    rows = spread_join(rows, sets, ["a"], ["id"], merge=True).withColumn("part", F.pmod(F.xxhash64("id"), "parts")).join(found, "id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("a", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "root", "n_words", "counts")
    return staged(rows.groupBy("a", "i", "j").applyInArrow(met, "a long, b long").distinct(), "remaining")


def _merged(labels: DataFrame | None, linked: DataFrame) -> DataFrame:
    """``labels`` (id, root) after links between ids: only links between different roots are joined into components."""
    if labels is None:
        found = components(linked)
        return staged(found.unionByName(found.select(F.col("root").alias("id"), "root")).distinct(), "labels")
    root = lambda c: labels.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    ends = linked.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    found = components(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    moved = found.withColumnRenamed("root", "_new").withColumnRenamed("id", "root")
    old = labels.join(moved, "root", "left").select("id", F.coalesce("_new", "root").alias("root"))
    fresh = found.unionByName(found.select(F.col("root").alias("id"), "root")).distinct().join(labels.select("id"), "id", "left_anti")
    return staged(old.unionByName(fresh), "labels")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, gram: int = 3, least: int = 2, samples: int = 48) -> DataFrame:
    """``classes`` without their last two columns: a row (doc_id, class_id, text_id) for each document."""
    return classes(docs, similarity, gram, least, samples).select("doc_id", "class_id", "text_id")


def classes(docs: DataFrame, similarity: float = 0.8, gram: int = 3, least: int = 2, samples: int = 48) -> DataFrame:
    """Rows (doc_id, class_id, text_id, row_key, leads) of all documents: the least doc_id of its class and of its equal texts.

    Texts are equal where their words are (lower case, runs of letters and digits); null and wordless texts are one
    class. Texts whose edit similarity in words is ``similarity`` or more and that share an ordered sample (``least``
    ``gram``-word grams, one of ``samples``; in short texts of words, ``all_samples``) are candidates. Classes are the
    components of verified links. In every bucket each text is aligned with one head. Texts in buckets that then hold
    several classes are searched again by their rarest shared grams (``closer``), and all pairs of different classes that a
    bucket still holds are compared (``remaining``), so no candidate is lost; only buckets of unlike texts cost by pairs. Rows
    without a doc_id take part by their text; a text that only they hold has null for its ids. Rows of one doc_id with different texts are texts of their own.
    ``row_key`` hashes id and text, and ``leads`` tells of one id and text of each class, and of rows without an id.
    """
    rows = staged(sketches(docs, gram, least, samples, similarity), "sketches")
    # one row for each text; words stay in the first table, which holds them under the row's number
    equal = staged(rows.groupBy("text_key").agg(F.min("id").alias("text"), F.min("doc_id").alias("text_id")), "equal")
    members = staged(spread_join(rows.select("id", "doc_id", "row_key", "text_key"), equal, ["text_key"], ["id"]).select("doc_id", "row_key", "text", "text_id"), "members")
    words = rows.select("id", "n_words", "words")
    texts = rows.where("n_words > 0").join(equal.select(F.col("text").alias("id")), "id", "left_semi")
    waiting = texts.select("id", F.explode("sketch").alias("bucket"))
    heads = waiting.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("a")).where("_n > 1").select("bucket", "a")
    # both tables grow with the corpus, so that neither is ever to be broadcast
    waiting = staged(waiting.join(heads.hint("merge"), "bucket"), "waiting")
    free_shuffles(waiting)
    pairs = staged(waiting.where("id <> a").select("a", F.col("id").alias("b")).distinct(), "pairs")  # a head is the least id
    alone = words.select("id", F.col("id").alias("root"), "n_words")
    known = staged(verified(staged(fitting(pairs, alone, similarity).select("a", "b"), "fitting"), words, similarity), "verified")
    free_shuffles(known)
    labels = _merged(None, known.where("linked").select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = F.coalesce("root", "id")
    mixed_ = waiting.join(labels, "id", "left").groupBy("bucket").agg(F.min(own).alias("_x"), F.max(own).alias("_y")).where("_x <> _y").select("bucket")
    again = waiting.join(mixed_, "bucket", "left_semi").select("id").distinct()
    again = staged(again.join(words.select("id", "n_words"), "id").join(labels, "id", "left").select("id", own.alias("root"), "n_words"), "again")
    pairs = staged(closer(again.select("id"), again, words, gram, similarity).join(known.select("a", "b"), ["a", "b"], "left_anti"), "closer")
    free_shuffles(pairs)
    labels = _merged(labels, verified(pairs, words, similarity).where("linked").select(F.col("b").alias("a"), F.col("a").alias("b")))
    tried = known.select("a", "b").unionByName(pairs.select("a", "b"))
    pairs = staged(remaining(waiting, labels, words, gram, similarity).join(tried, ["a", "b"], "left_anti"), "untried")
    free_shuffles(pairs)
    labels = _merged(labels, verified(pairs, words, similarity).where("linked").select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = labels.join(equal.select(F.col("text").alias("id"), "text_id"), "id")
    heads = named.groupBy("root").agg(F.min(F.struct(F.col("text_id").isNull(), "text_id", "id")).alias("_h"))
    heads = heads.select("root", F.col("_h.text_id").alias("class_id"), F.col("_h.id").alias("head"))
    found = staged(spread_join(labels, heads, ["root"], ["id"]).select(F.col("id").alias("text"), "class_id", "head"), "classes")
    free_shuffles(found)
    # texts without links are not in the table
    leads = F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("class_id")) & (F.col("text") == F.col("head")))
    columns = ["doc_id", "class_id", "text_id", "row_key", leads.alias("leads")]
    linked = spread_join(members, found, ["text"], ["doc_id"]).select(*columns)
    alone = members.join(found, "text", "left_anti").withColumn("class_id", F.col("text_id")).withColumn("head", F.col("text"))
    return linked.unionByName(alone.select(*columns))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without those that do not lead their class: the least doc_id and one text of it stay.

    Rows are judged by id and text; repeated rows of the first stay, and so do rows without an id.
    """
    others = classes(docs, **options).where("not leads").select("row_key").distinct()
    return docs.withColumn("_key", row_key()).join(others, F.col("_key") == others.row_key, "left_anti").drop("_key")
