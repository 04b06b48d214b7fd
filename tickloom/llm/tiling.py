"""Benchmark decontamination: greedy string tiling of documents that share word seeds with test items."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import row_key, sliced, spread_join, staged
from .words import grams, hashed, lowered

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _windows(codes: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``s`` free words follow each other, and the rolling hash of those words."""
    n = len(codes) - s + 1
    if n <= 0:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[s:] == taken[:n])
    h = np.zeros(len(at), "u8")
    for i in range(s):
        h = h * _BASE + codes[at + i]
    return at, h


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length) by greedy string tiling with running Karp-Rabin matching.

    Matches of at least ``s`` free words are found by their hash and extended;
    the longest that do not overlap are marked, then ``s`` falls to ``least``. A match
    over 2 ``s`` long starts again with its length. Ties go to the earlier place in item, then in text.
    """
    own, known = np.ones(len(item), bool), np.isin(text, item)
    s, out = max(least, min(20, len(item))), []
    while True:
        at, h = _windows(item, own, s)
        by = defaultdict(list)
        for p, x in zip(at.tolist(), h.tolist()):
            by[x].append(p)
        there, g = _windows(text, known, s)
        hit = np.isin(g, h)
        found, longest = [], s
        for q, x in zip(there[hit].tolist(), g[hit].tolist()):
            for p in by[x]:
                if p and q and own[p - 1] and known[q - 1] and item[p - 1] == text[q - 1]:
                    continue  # a longer match holds this one
                n = 0
                while p + n < len(item) and q + n < len(text) and own[p + n] and known[q + n] and item[p + n] == text[q + n]:
                    n += 1
                if n >= s:
                    found.append((-n, p, q))
                    longest = max(longest, n)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for n, p, q in sorted(found):
            n = -n
            if own[p : p + n].all() and known[q : q + n].all():
                own[p : p + n] = known[q : q + n] = False
                out.append((p, q, n))
            else:
                again = True
        if again:  # what is left of a match that a longer one cut
            continue
        if s == least:
            return out
        s = max(least, s // 2)


def _item_rows(items: DataFrame, seed_words: int) -> DataFrame:
    """Rows (key, seeds, n_words, words, size) of test items: distinct hashes of ``size`` words, which are ``seed_words`` or all words of a shorter item."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            h, at = hashed(lowered(b.column(1).to_pylist()))
            own = [(i, h[x:z], min(seed_words, int(z - x))) for i, x, z in zip(b.column(0).to_pylist(), at[:-1], at[1:]) if z > x]
            out = [(i, np.unique(grams(w, k)).view("i8"), len(w), w.tobytes(), k) for i, w, k in own]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int32()))], ["key", "seeds", "n_words", "words", "size"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(seeds, "key long, seeds array<long>, n_words long, words binary, size int")


def _text_rows(docs: DataFrame, sizes: list[int], filter_bits: bytes) -> DataFrame:
    """Rows (key, seeds, n_words, words) of documents that hold runs of ``sizes`` words which ``filter_bits`` marks: those, and all words' hashes as bytes."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filter_bits, "u1")
        for b in sliced(batches):
            h, at = hashed(lowered(b.column(1).to_pylist()))
            found = []
            for k in sizes:
                g = grams(h, k)
                slot = g % np.uint64(len(bits) * 8)
                places = np.flatnonzero(bits[(slot >> np.uint64(3)).astype("i8")] >> (slot & np.uint64(7)).astype("u1") & 1)
                # a run ends in its own text
                found.append((g, places, np.searchsorted(places, at[:-1]), np.searchsorted(places, np.maximum(at[1:] - k + 1, at[:-1]))))
            out = []
            for d, (i, w, z) in enumerate(zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist())):
                own = [g[places[lo[d] : hi[d]]] for g, places, lo, hi in found]
                if any(map(len, own)):
                    out.append((i, np.unique(np.concatenate(own)).view("i8"), z - w, h[w:z].tobytes()))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()))], ["key", "seeds", "n_words", "words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(seeds, "key long, seeds array<long>, n_words long, words binary")


def _filter(seeds: DataFrame, bits: int) -> bytes:
    """Bits of all seeds, ``bits`` in number whatever the benchmark's size: each slot is counted once, eight to a byte."""
    slot = F.col("seed").bitwiseAND(F.lit(bits - 1))  # bits is a power of two
    rows = seeds.select(slot.alias("slot")).groupBy((F.col("slot") / 8).cast("long").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(slot % 8 as int))")).alias("v"))
    out = np.zeros(bits // 8, "u1")
    for r in rows.toLocalIterator():
        out[r["byte"]] = r["v"]
    return out.tobytes()


def _rarest(items: DataFrame) -> DataFrame:
    """Rows (item, seed) of each item's seeds but for its ``least`` - 1 commonest: who shares ``least`` seeds shares one of these."""
    seeds = items.select("item", "least", F.size("seeds").alias("n_seeds"), F.explode("seeds").alias("seed"))
    counts = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n_items"))
    place = F.row_number().over(W.partitionBy("item").orderBy("n_items", "seed"))  # as many rows as the item has words
    return seeds.join(counts, "seed").withColumn("place", place).where(F.col("place") <= F.col("n_seeds") - F.col("least") + 1).select("item", "seed")


def _sharing(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (text, item, n) of those that share at least the item's ``least`` seeds. ``texts`` (text, seeds) is read twice.

    Pairs are sought by the items' rarest seeds, so a passage that most items and documents hold brings none together as
    long as it is shorter than what an item needs; a seed that many texts hold is dealt to several tasks.
    """
    found = spread_join(texts.select("text", F.explode("seeds").alias("seed")), _rarest(items), ["seed"], ["text"]).select("text", "item").distinct()
    both = found.join(texts.withColumnRenamed("seeds", "own"), "text").join(items.select("item", "least", "seeds"), "item")
    return both.withColumn("n", F.size(F.array_intersect("own", "seeds"))).where("n >= least").select("text", "item", "n")


def overlaps(docs: DataFrame, items: DataFrame, seed_words: int = 5, coverage: float = 0.6, filter_bits: int = 1 << 22) -> DataFrame:
    """Rows (doc_id, item_id, coverage, n_tiles, matched_words, item_words) of documents that hold test items.

    Words are runs of letters and digits (all of ASCII's other characters part them), lower case. A
    document and an item that share a run of ``seed_words`` words (an item of fewer words: all of them) are tiled with
    tiles of at least that length, in any order; coverage is the tiles' share of the item's
    words. Items and documents without such a run have no rows, nor have nulls; rows that repeat an
    id are judged by text. A bit table of fixed size spares documents without seeds the join; as
    it fills, more rows take part in the join and none is lost.
    """
    marked = staged(_item_rows(items.where("text is not null"), seed_words), "items")
    sizes = sorted({seed_words} | {r["size"] for r in marked.select("size").distinct().collect()})  # seed_words sizes at most
    seeds = marked.select(F.col("key").alias("item_id"), F.col("n_words").alias("item_words"), F.explode("seeds").alias("seed"))
    hits = staged(_text_rows(docs.where("text is not null"), sizes, _filter(seeds, filter_bits)), "hits")
    # rows of one id with other texts are texts of their own
    hits, marked = hits.withColumn("text", F.xxhash64("words")), marked.withColumn("item", F.xxhash64("words"))
    item_seeds = marked.select("item", "n_words", "size", "seeds").dropDuplicates(["item"])
    # a seed may stand at several places of the item, which its length bounds
    least = F.ceil(coverage * F.col("n_words") / F.col("size") - (F.col("n_words") - F.col("size") + 1 - F.size("seeds")) - 1e-9)
    item_seeds = item_seeds.withColumn("least", F.greatest(least.cast("int"), F.lit(1)))
    texts = staged(hits.select("text", "seeds").dropDuplicates(["text"]), "texts")
    pairs = _sharing(texts, item_seeds).select("text", "item")
    holders = hits.select("text", F.col("key").alias("doc_id"), F.col("words").alias("doc_words"))
    both = spread_join(holders, pairs, ["text"], ["doc_id"]).join(marked.select("item", F.col("key").alias("item_id"), "words"), "item")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for doc, item, text, words in zip(*(c.to_pylist() for c in b.columns)):
                item_words = np.frombuffer(words, "u8")
                found = tiles(item_words, np.frombuffer(text, "u8"), min(seed_words, len(item_words)))
                n = sum(x[2] for x in found)
                if n >= coverage * len(item_words):
                    out.append((doc, item, n / len(item_words), len(found), n, len(item_words)))
            cols = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "coverage", "n_tiles", "matched_words", "item_words"])

    out = both.select("doc_id", "item_id", "doc_words", "words").mapInArrow(tiled, "doc_id long, item_id long, coverage double, n_tiles long, matched_words long, item_words long")
    return out.distinct()


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents of which ``overlaps`` finds an item; rows that share an id are judged by their own texts."""
    held = overlaps(docs.select(row_key().alias("doc_id"), "text"), items, **options).select(F.col("doc_id").alias("_held")).distinct()
    return docs.withColumn("_key", row_key()).join(held, F.col("_key") == F.col("_held"), "left_anti").drop("_key")
