"""Katz backoff scores: Good-Turing discounted n-gram counts, exactly normalised, evaluated recursively for each token.

Texts are cut into blocks of a few megabytes. Each block asks for the corpus counts of its distinct n-grams:
requests meet by hash bucket, where counts are summed, and the answers go back to the block. Words go first; their
answers also number them, and these numbers, a few bits each, stand for words in all that follows. Then each order
has a round of its own, so that only one order's requests are on disk at a time. N-grams
that a bucket assigns to one block alone ("owned") give each history's discounted mass and what the lower order gives to the
words seen after it; these meet by bucket again and come back as sums, to blocks whose scores depend on them. So all tables are split by bucket; blocks and
buckets have a bounded size, and where very many blocks ask a bucket, they are summed in two steps (``summed``).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, free_shuffles, sliced, staged
from .words import SPACED_BYTES, hashed, mixed

#: Counts above this are not discounted.
RELIABLE = 5
END, START = np.uint64(0x1D8AF066A5C2E3B7), np.uint64(0xC3A5C85C97CB3127)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of rows: texts; counts of n-grams have their order as kind, masses of histories their order above this.
TEXTS, WORDS, MASSES = 0, 1, 100
ROW = "block long, kind int, bucket long, data binary"
#: What is summed for a key: of an n-gram its count; of a history how many n-grams after it have each count up to RELIABLE, how many
#: of the same words have each count in the order below, and the larger ones of those counts in all. Whole numbers, so sums are exact.
COUNT, MASS = ("<u8",), (f"{2 * RELIABLE}<u4", "<u8")
#: What answers to words hold besides the count: the word's place in its bucket. What requests for masses hold besides them: whether an answer is wanted.
PLACE, WANTED = ("<u8",), ("<u1",)
#: A history with less of its mass left than this counts as having nothing discounted.
BARE = 1e-12
_SIZE, _ZSTD = struct.Struct("<q"), pa.Codec("zstd")


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of any lengths with their bytes in planes, compressed."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view("u1").reshape(len(a), a.itemsize).T)
        body = _ZSTD.compress(planes, asbytes=True)
        out += [np.array([len(a), a.itemsize, len(body)], "<i8").tobytes(), body]
    return b"".join(out)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    """Arrays of these types."""
    at, out = 0, []
    for kind in kinds:
        n, size, k = np.frombuffer(data, "<i8", 3, at).tolist()
        planes = np.frombuffer(_ZSTD.decompress(memoryview(data)[at + 24 : at + 24 + k], n * size, asbytes=True), "u1")
        out.append(np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind))
        at += 24 + k
    return out


def _cut(sizes: np.ndarray, *arrays: np.ndarray) -> list[bytes]:
    """Arrays of one length (or rows of some numbers), cut into pieces of these sizes, each packed; as pieces are many and small, planes are made once for all."""
    widths = [a.itemsize * (a.shape[1] if a.ndim > 1 else 1) for a in arrays]
    planes = np.concatenate([np.ascontiguousarray(a).view("u1").reshape(len(a), w).T for a, w in zip(arrays, widths)])
    ends = np.cumsum(sizes).tolist()
    return [_SIZE.pack(b - a) + _ZSTD.compress(np.ascontiguousarray(planes[:, a:b]), asbytes=True) for a, b in zip([0, *ends[:-1]], ends)]


def _joined(pieces: list[bytes], *kinds: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The pieces' sizes, and their arrays of these types, each over all pieces; a type with several numbers, such as 10<u4, gives rows."""
    sizes = np.array([_SIZE.unpack_from(d)[0] for d in pieces], "i8")
    forms = [(int(many or 1), np.dtype("<" + one)) for many, one in (k.split("<") for k in kinds)]
    widths = [many * one.itemsize for many, one in forms]
    planes, at = np.empty((sum(widths), int(sizes.sum())), "u1"), 0
    for d, n in zip(pieces, sizes.tolist()):
        flat = _ZSTD.decompress(memoryview(d)[_SIZE.size :], n * len(planes), asbytes=True)
        planes[:, at : at + n] = np.frombuffer(flat, "u1").reshape(len(planes), n)
        at += n
    out, top = [], 0
    for (many, one), w in zip(forms, widths):
        flat = np.ascontiguousarray(planes[top : top + w].T).reshape(-1).view(one)
        out.append(flat.reshape(-1, many) if many > 1 else flat)
        top += w
    return sizes, out


def _behind(data: bytes, arrays: int) -> bytes:
    """What follows the first arrays."""
    at = 0
    for _ in range(arrays):
        at += 24 + int(np.frombuffer(data, "<i8", 3, at)[2])
    return data[at:]


def _deltas(keys: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Differences; the first key of each piece stands as it is."""
    out = keys.copy()
    out[1:] -= keys[:-1]
    if sizes is not None:
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        out[first] = keys[first]
    return out


def _risen(deltas: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The keys of pieces, from their differences."""
    out = np.cumsum(deltas, dtype="u8")
    before = np.r_[np.zeros(1, "u8"), out][np.cumsum(sizes) - sizes]
    return out - np.repeat(before, sizes)


def _bits(n: int) -> int:
    return max(0, n - 1).bit_length()


def _order(keys: np.ndarray) -> np.ndarray:
    """Places of the keys in rising order, equal ones as they come.

    Numbers are sorted that hold a key's first bits and its place, which is several times as fast as sorting places;
    where keys differ only in the bits left out, they are sorted the plain way.
    """
    if not len(keys):
        return np.zeros(0, "i8")
    least, room = keys.min(), _bits(len(keys))
    over = max(0, int(keys.max() - least).bit_length() + room - 64)
    both = ((keys - least) >> np.uint64(over)) << np.uint64(room)
    both |= np.arange(len(keys), dtype="u8")
    both.sort()
    out = (both & np.uint64((1 << room) - 1)).view("i8")
    own = keys[out]
    return out if not over or (own[1:] >= own[:-1]).all() else np.argsort(keys, kind="stable")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order, and the place of each key among them."""
    order = _order(keys)
    own, new = keys[order], np.ones(len(keys), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    which = np.empty(len(keys), "i8")
    which[order] = np.cumsum(new) - 1
    return own[new], which


def is_held_out(doc_id: int, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()  # A-Z alone


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of kind TEXTS: sorted word hashes and how often training texts have each; then document ids, which of them are null, token counts,
    the place of the end among the words, the words' ranks by frequency, and the tokens' ranks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            words, at = hashed(texts, SPACED_BYTES)
            counts = np.diff(at)
            tokens = np.insert(words, at[1:], END)
            met = pa.array(tokens).dictionary_encode()  # fewer words than tokens need sorting
            found, places = met.dictionary.to_numpy(), met.indices.to_numpy()
            order = np.argsort(found)
            kinds = found[order]
            # places by frequency, so that most are small numbers
            by = np.argsort(-np.bincount(places)[order], kind="stable")
            rank, ranks = np.empty((2, len(by)), "<i4")
            rank[by] = np.arange(len(by))
            ranks[order] = rank
            none = np.array([d is None for d in ids])
            teach = np.repeat([d is None or not is_held_out(d) for d in ids], counts + 1)
            own = _packed(_deltas(kinds), np.bincount(places[teach], minlength=len(kinds))[order].astype("<u8"))
            end = np.searchsorted(kinds, [END]).astype("<i4")
            rest = _packed(np.array([d or 0 for d in ids], "<i8"), none.astype("u1"), (counts + 1).astype("<i4"), end, rank, ranks[places])
            return _row(part << 32 | seq, TEXTS, 0, own + rest)

        for b in sliced(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(doc)
                texts.append(lowered(text))
                held += len(texts[-1]) + 1
                if held >= block_bytes:
                    yield row()
                    seq, ids, texts, held = seq + 1, [], [], 0
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, ROW)


def _row(block: int, kind: int, bucket: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([bucket], pa.int64()), pa.array([data], pa.binary())], ["block", "kind", "bucket", "data"])


def numbered(t: pa.Table, bits: int) -> pa.Table:
    """A block with its words' numbers (the bucket, then the place in it, so they sort as the hashes do) and answers instead of hashes and own counts."""
    buckets, sizes, (answers, places) = _answers(t, WORDS, *COUNT, *PLACE)
    ids = _risen(places, sizes) + (np.repeat(buckets, sizes) << np.uint64(64 - bits) if bits else np.uint64(0))
    texts = _behind(t.column("data")[t.column("kind").to_pylist().index(TEXTS)].as_py(), 2)
    return _table([(t.column("block")[0].as_py(), TEXTS, 0, _packed(_deltas(ids), answers) + texts)])


class Block:
    """A block's tokens, as places among its words, once these are numbered."""

    def __init__(self, data: bytes):
        deltas, self.words_answers, ids, none, counts, end, rank, tokens = _unpacked(data, "<u8", *COUNT, "<i8", "<u1", "<i4", "<i4", "<i4", "<i4")
        by = np.empty(len(rank), "i8")
        by[rank] = np.arange(len(rank))
        self.tokens, self.words, self.end = by[tokens], np.cumsum(deltas, dtype="u8"), int(end[0])
        self.ids = [None if n else d for d, n in zip(ids.tolist(), none.tolist())]
        self.starts, self.counts = np.cumsum(counts) - counts, counts
        self.held = np.array([d is not None and is_held_out(d) for d in self.ids], bool)
        self.place = np.arange(len(tokens)) - np.repeat(self.starts, counts)

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By order from two on: the tokens that end such an n-gram (the first one of a text has a word pair with the start, but no longer n-gram), and its hash."""
        word = mixed(self.words)[self.tokens]
        full = word
        for n in range(2, order + 1):
            at = np.flatnonzero(self.place >= n - 2)
            key = mixed(np.where(self.place[at] == 0, START, full[at - 1]) * _STEP + word[at])
            yield n, at, key
            full = np.zeros(len(word), "u8")
            full[at] = key

    def requests(self, n: int, bits: int) -> Iterator[tuple[int, int, bytes]]:
        """How often this block's training texts have each of its n-grams."""
        *_, (_, at, key) = self.grams(n)
        keys, which = _distinct(key)
        teach = np.repeat(~self.held, self.counts)[at]
        yield from _dealt(n, keys, bits, np.bincount(which[teach], minlength=len(keys)).astype("<u8"))


def _dealt(kind: int, keys: np.ndarray, bits: int, *values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Sorted keys, cut by their first ``bits`` bits; only buckets that have keys are met."""
    buckets = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), "u8")
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(keys) else np.zeros(0, "i8")
    sizes = np.diff(starts, append=len(keys))
    for bucket, piece in zip(buckets[starts].tolist(), _cut(sizes, _deltas(keys, sizes), *values)):
        yield kind, bucket, piece


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    block, kind, bucket, data = list(zip(*rows)) or [[]] * 4
    return pa.table({"block": pa.array(block, pa.int64()), "kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int64()), "data": pa.array(data, pa.binary())})


class Requests:
    """The requests of one kind and bucket: keys of all blocks together, their values' sums, and who asked what. Words are answered with places, too, and masses only where they are wanted."""

    def __init__(self, t: pa.Table):
        t = t.sort_by("block")
        self.kind, self.bucket, self.blocks = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py(), t.column("block").to_pylist()
        self.counts, self.places = self.kind < MASSES, self.kind == WORDS
        self.types = COUNT if self.counts else MASS
        self.sizes, (deltas, *self.values) = _joined(t.column("data").to_pylist(), "<u8", *self.types, *(() if self.counts else WANTED))
        self.keys, self.which = _distinct(_risen(deltas, self.sizes))
        self.wanted = np.ones(len(self.which), bool) if self.counts else self.values.pop() > 0
        if not self.counts:
            self.sizes = np.add.reduceat(self.wanted, np.cumsum(self.sizes) - self.sizes, dtype="i8")
        add = lambda v: np.bincount(self.which, v, len(self.keys)).astype(v.dtype)
        self.sums = [np.column_stack([add(c) for c in v.T]) if v.ndim > 1 else add(v) for v in self.values]

    def wanted_keys(self) -> np.ndarray:
        return np.bincount(self.which[self.wanted], minlength=len(self.keys)) > 0

    def one(self, block: int, bits: int) -> pa.Table:
        """All as requests of one block, dealt by their first ``bits`` bits."""
        wanted = [] if self.counts else [self.wanted_keys().astype("<u1")]
        return _table([(block, *r) for r in _dealt(self.kind, self.keys, bits, *self.sums, *wanted)])

    def answers(self, totals: list[np.ndarray], owned: np.ndarray, alone: np.ndarray) -> list[tuple[int, int, int, bytes]]:
        """Each block's totals. Counts come four times, plus two where no other block has asked for a key that is ``alone``
        here, plus one where the block is the first that has taught a key that is ``owned`` here."""
        out = [x[self.which] if self.counts else x[self.which[self.wanted]] for x in totals]
        if self.counts:
            taught = np.flatnonzero(self.values[0] > 0)[::-1]
            first = np.full(len(self.keys), -1)
            first[self.which[taught]] = taught  # the last one that is written stays
            own = np.zeros(len(self.which), bool)
            own[first[(first >= 0) & owned]] = True
            only = (np.bincount(self.which, minlength=len(self.keys)) == 1) & alone
            out[0] = (out[0] << np.uint64(2)) + (only[self.which] * 2 + own).astype("<u8")
        if self.places:  # they rise with the keys
            out[-1] = _deltas(out[-1], self.sizes)
        return [(b, self.kind, self.bucket, d) for b, n, d in zip(self.blocks, self.sizes, _cut(self.sizes, *out)) if n]


def _total(t: pa.Table) -> pa.Table:
    """Answers to all blocks, and for counts the bucket's counts of counts (block -1)."""
    asked = Requests(t)
    totals = [*asked.sums, np.arange(len(asked.keys), dtype="<u8")] if asked.places else asked.sums
    rows = asked.answers(totals, *np.ones((2, len(asked.keys)), bool))
    if asked.counts:
        c = asked.sums[0].astype("i8")
        seen = np.r_[(c > 0).sum(), c.sum(), np.bincount(c[c <= RELIABLE + 1], minlength=RELIABLE + 2)[1:]]
        rows.append((-1, asked.kind, asked.bucket, seen.astype("<i8").tobytes()))
    return _table(rows)


def _passed_on(t: pa.Table, bits: int, more: int) -> pa.Table:
    """Answers to the blocks of one part, which were dealt by ``bits`` bits, from the answers to the part, dealt by ``more`` bits besides."""
    asked = Requests(t.filter(pc.invert(t.column("answer"))))
    if not asked.wanted.any():
        return _table([])
    answers, types = t.filter(t.column("answer")).sort_by("fine"), (*asked.types, *PLACE) if asked.places else asked.types
    (sizes, totals), owned = _joined(answers.column("data").to_pylist(), *types), np.ones(len(asked.keys), bool)
    alone = owned
    if asked.places:  # places in the finer buckets become places in this one
        fine = answers.column("fine").to_numpy().astype("u8") & np.uint64((1 << more) - 1)
        totals[-1] = _risen(totals[-1], sizes) + (np.repeat(fine, sizes) << np.uint64(64 - bits - more))
    if asked.counts:
        owned, alone, totals[0] = totals[0] & np.uint64(1) > 0, totals[0] & np.uint64(2) > 0, totals[0] >> np.uint64(2)
    else:
        wanted = asked.wanted_keys()
        for k, some in enumerate(totals):
            totals[k] = np.zeros((len(wanted), *some.shape[1:]), some.dtype)
            totals[k][wanted] = some
    return _table(asked.answers(totals, owned, alone))


def summed(requests: DataFrame, blocks: int, fan: int, bits: int) -> DataFrame:
    """Answers to ``requests`` by bucket, as dealt by ``bits`` bits. Frequent n-grams are asked for by every block: above ``fan`` blocks,
    parts of these meet first, and deal what they ask to finer buckets. So a block deals to at most about ``fan`` buckets, whatever the corpus."""
    if blocks <= fan:
        return requests.groupBy("kind", "bucket").applyInArrow(_total, ROW)
    parts = -(-blocks // fan)
    more = _bits(min(parts, fan))
    requests = requests.withColumn("part", -2 - F.pmod(F.xxhash64("block"), F.lit(parts)))

    def one(t: pa.Table) -> pa.Table:
        return Requests(t).one(t.column("part")[0].as_py(), bits + more)

    asked = requests.groupBy("kind", "bucket", "part").applyInArrow(one, ROW)
    totals = staged(summed(asked, parts, fan, bits + more), "totals")
    free_shuffles(totals)
    back = totals.where("block < -1").withColumn("part", F.col("block")).withColumn("fine", F.col("bucket"))
    back = back.withColumn("bucket", F.shiftright("bucket", more)).withColumn("answer", F.lit(True))
    back = requests.withColumn("fine", F.col("bucket")).withColumn("answer", F.lit(False)).unionByName(back)
    answers = back.groupBy("kind", "bucket", "part").applyInArrow(lambda t: _passed_on(t, bits, more), ROW)
    return answers.unionByName(totals.where("block = -1"))


def discounts(n: list[int]) -> np.ndarray:
    """Katz's factors for counts from 0 to RELIABLE, by Good-Turing estimates from ``n``[r-1] keys of count r.

    The largest k up to RELIABLE for which all factors lie between 0 and 1 is taken; where none is,
    every count up to RELIABLE loses n1 / (n1 + 2 n2) (a half without any).
    """
    out = np.ones(RELIABLE + 1)
    for k in range(RELIABLE, 0, -1):
        if all(n[: k + 1]):
            a = (k + 1) * n[k] / n[0]
            d = [((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a) if a != 1 else 0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                out[1 : k + 1] = d
                return out
    lost = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    out[1:] = [(r - min(lost, 0.9)) / r for r in range(1, RELIABLE + 1)]
    return out


class Unigrams:
    """Probabilities of words by their corpus count; what the known ones leave is for all unknown words together."""

    def __init__(self, kinds: int, total: int, n: list[int]):
        self.kinds, self.total, self.factors = kinds, total, discounts(n)
        lost = sum(k * r * (1 - self.factors[r]) for r, k in enumerate(n[:RELIABLE], 1))
        self.divisor = total if lost > 0 else total + 1
        if not lost > 0:
            self.factors[:] = 1
        self.unknown = (lost if lost > 0 else 1) / self.divisor if self.divisor else 1.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        kept = c * self.factors[np.minimum(c, RELIABLE)] if len(c) else c.astype("f8")
        kept = np.where(c > RELIABLE, c, kept)
        return np.where(c > 0, kept / self.divisor, self.unknown)


def _answers(t: pa.Table, kind: int, *types: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A block's answers of a kind in the order of their keys: buckets, how many are in each, and the arrays."""
    own = t.filter(pc.equal(t.column("kind"), kind)).sort_by("bucket")
    return own.column("bucket").to_numpy().astype("u8"), *_joined(own.column("data").to_pylist(), *types)


class Met(Block):
    """A block with its answers and its distinct n-grams of orders 1 to ``order``, in the order of their keys.

    By order: ``keys``; ``valid``, the tokens that end such an n-gram; ``of``, by token the n-gram that it ends; ``ends``, for each n-gram
    a token that ends it; ``history``, for each n-gram the place of its history among the n-grams of the order below, or for pairs the word,
    with the start behind all words; the n-grams' corpus counts, whether the block owns them and has them alone; and the counts of histories.
    """

    def __init__(self, t: pa.Table, order: int):
        super().__init__(t.column("data")[t.column("kind").to_pylist().index(TEXTS)].as_py())
        self.block, self.count, self.owned, self.alone, self.before = t.column("block")[0].as_py(), {}, {}, {}, {}
        self.keys, self.valid, self.of, self.ends, self.history = {1: self.words}, {1: np.arange(len(self.tokens))}, {1: self.tokens}, {}, {}
        for n, at, key in self.grams(order):
            self.keys[n], which = _distinct(key)
            self.valid[n], self.of[n], self.ends[n] = at, np.zeros(len(self.tokens), "i8"), np.empty(len(self.keys[n]), "i8")
            self.of[n][at], self.ends[n][which] = which, at
            self.history[n] = np.where(self.place[self.ends[n]] == 0, len(self.words), self.of[n - 1][self.ends[n] - 1])
        for n in self.keys:
            a = self.words_answers if n == 1 else _answers(t, n, *COUNT)[2][0]
            self.count[n], self.owned[n], self.alone[n] = (a >> np.uint64(2)).astype("i8"), a & np.uint64(1) > 0, a & np.uint64(2) > 0
        for n in self.history:  # a text's start is as frequent as its end
            self.before[n] = np.r_[self.count[1], self.count[1][self.end]] if n == 2 else self.count[n - 1]

    def history_keys(self, n: int) -> np.ndarray:
        return np.r_[self.keys[1], START] if n == 2 else self.keys[n - 1]

    def adding(self, n: int, histories: np.ndarray) -> np.ndarray:
        """The n-grams that this block owns and that add to the marked histories."""
        return np.flatnonzero(self.owned[n] & (self.count[n] > 0) & histories[self.history[n]])

    def masses(self, n: int, histories: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the n-grams ``use`` add to these histories, theirs among them (``MASS``)."""
        row = np.empty(len(self.before[n]), "i8")
        row[histories] = np.arange(len(histories))
        h, c, lower = row[self.history[n][use]], self.count[n][use], self.count[n - 1][self.of[n - 1][self.ends[n][use]]]
        cells = [(h * (2 * RELIABLE) + at + x - 1)[x <= RELIABLE] for at, x in ((0, c), (RELIABLE, lower))]
        small = np.bincount(np.concatenate(cells), minlength=2 * RELIABLE * len(histories)).reshape(-1, 2 * RELIABLE)
        return small.astype("<u4"), np.bincount(h, np.where(lower > RELIABLE, lower, 0), len(histories)).astype("<u8")

    def shared(self, n: int, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each history of order ``n``: whether training and other blocks have it (of all others the block knows all that
        follows), and whether its sums change the scores here.

        They do where a token must back off from it, or where nothing that follows here is known to be discounted;
        ``lost`` is what n-grams of each count up to RELIABLE lose.
        """
        alone = np.r_[self.alone[1], False] if n == 2 else self.alone[n - 1]
        c, h, size = self.count[n], self.history[n], len(self.before[n])
        met = (np.bincount(h, minlength=size) > 0) & (self.before[n] > 0)
        free = np.bincount(h, np.r_[0.0, lost, 0.0][np.minimum(c, RELIABLE + 1)], size) / np.maximum(self.before[n], 1)
        return met & ~alone, met & ((np.bincount(h[c == 0], minlength=size) > 0) | (free < 2 * BARE))

    def sorted_by_key(self, n: int, histories: np.ndarray) -> np.ndarray:
        """Places of the marked histories of order ``n``, in the order of their keys."""
        own = np.flatnonzero(histories)
        return own[np.argsort(self.history_keys(n)[own])] if n == 2 else own


def score_texts(docs: DataFrame, order: int = 3, block_bytes: int = 4 << 20, fan: int = 1024) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents.

    Learns from documents whose crc32(doc_id as text) mod 7 is not 2. ``score`` is the text's log10 probability: an
    n-gram of ``order`` tokens seen in training has its discounted share of its history; any other the history's weight times the
    probability that the order below gives; a history never seen backs off with weight 1. The lowest order has one
    class for all unknown words. A history of which no mass is discounted gets one count more, for what was not
    seen. N-grams are told apart by 64-bit hashes, so scores depend on neither blocks nor partitions. Null texts count as empty: one end token. Rows of one doc_id are texts of their own; null ids teach.
    """
    texts = staged(blocks(docs, block_bytes), "blocks")
    n_blocks = texts.count()
    bits = _bits(min(n_blocks, fan))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist()):
                deltas, taught = _unpacked(data, "<u8", *COUNT)
                for kind, bucket, request in _dealt(WORDS, np.cumsum(deltas, dtype="u8"), bits, taught):
                    yield _row(block, kind, bucket, request)

    def asking(n: int):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist()):
                    for kind, bucket, request in Block(data).requests(n, bits):
                        yield _row(block, kind, bucket, request)

        return ask

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(data, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), kind, "i4")), pa.array(np.arange(len(v), dtype="i4")), pa.array(v)], ["kind", "i", "n"])

    stats = {n: [0] * (RELIABLE + 3) for n in range(1, order + 1)}

    def counted(requests: DataFrame) -> DataFrame:
        """The answers, staged; some numbers of each order go to the driver."""
        out = staged(summed(requests, n_blocks, fan, bits), "counts")
        sums = out.where("block = -1").select("kind", "data").mapInArrow(numbers, "kind int, i int, n long").groupBy("kind", "i").agg(F.sum("n").alias("n"))
        for r in sums.collect():
            stats[r["kind"]][r["i"]] = r["n"]
        free_shuffles(out)
        return out

    hashes, known = texts, counted(texts.mapInArrow(words, ROW))
    texts = staged(hashes.unionByName(known.where("block >= 0")).groupBy("block").applyInArrow(lambda t: numbered(t, bits), ROW), "numbered")
    free_shuffles(texts)
    drop_staged(hashes, known)
    answers = texts
    for n in range(2, order + 1):
        answers = answers.unionByName(counted(texts.mapInArrow(asking(n), ROW)).where("block >= 0"))
    unigram = Unigrams(stats[1][0], stats[1][1], stats[1][2:])
    factors = {n: discounts(stats[n][2:]) for n in range(2, order + 1)}

    r = np.arange(1, RELIABLE + 1)
    lost = {n: r * (1 - f[1:]) for n, f in factors.items()}

    def kept(n: int, c: np.ndarray) -> np.ndarray:
        return c * np.where(c > RELIABLE, 1.0, factors[n][np.minimum(c, RELIABLE)])

    def masses(t: pa.Table) -> pa.Table:
        block, rows = Met(t, order), []
        for n in range(2, order + 1):
            shared, changing = block.shared(n, lost[n])
            wanted, use = shared & changing, block.adding(n, shared)
            asked = wanted.copy()
            asked[block.history[n][use]] = True
            own = block.sorted_by_key(n, asked)
            rows += [(block.block, *r) for r in _dealt(MASSES + n, block.history_keys(n)[own], bits, *block.masses(n, own, use), wanted[own].astype("<u1"))]
        return _table(rows)

    def scored(t: pa.Table) -> pa.Table:
        block = Met(t, order)
        tokens, words = block.tokens, block.count[1]
        p, divisor = unigram(words)[tokens], np.full(len(tokens), max(unigram.divisor, 1), "f8")
        for n in range(2, order + 1):
            shared, changing = block.shared(n, lost[n])
            own, known = block.sorted_by_key(n, shared & changing), np.flatnonzero(changing & ~shared)
            # the order below gives a word its kept count over the divisor of the shorter history
            below = unigram.factors if n == 2 else factors[n - 1]
            # histories that change no score count as discounted, and nothing backs off from them
            free, seen = np.ones(len(block.before[n])), np.zeros(len(block.before[n]))
            for some, (small, large) in ((own, _answers(t, MASSES + n, *MASS)[2]), (known, block.masses(n, known, block.adding(n, changing & ~shared)))):
                free[some] = small[:, :RELIABLE] @ lost[n] / np.maximum(block.before[n][some], 1)
                seen[some] = small[:, RELIABLE:] @ (r * below[1:]) + large
            at, which = block.valid[n], block.of[n][block.valid[n]]
            h = block.history[n][which]
            c, before = block.count[n][which], block.before[n][h]
            bare = (free < BARE)[h]
            whole = before + bare.astype("f8")
            weight = np.where(bare, 1 / np.maximum(whole, 1), free[h]) / np.maximum(1 - seen[h] / divisor[at], 1e-12)
            p[at] = np.where(before == 0, p[at], np.where(c > 0, np.where(bare, c, kept(n, c)) / np.maximum(whole, 1), weight * p[at]))
            divisor = np.ones(len(tokens))
            divisor[at] = np.maximum(whole, 1)
        base = np.log10((words + 1) / (unigram.total + unigram.kinds + 1))
        add = lambda x: np.add.reduceat(x, block.starts)
        return pa.table({
            "doc_id": pa.array(block.ids, pa.int64()), "held_out": pa.array(block.held), "n_tokens": pa.array(block.counts.astype("i8")), "n_known": pa.array(add((words > 0)[tokens].astype("i8"))),
            "train_tokens": pa.array(np.full(len(block.ids), unigram.total, "i8")), "base_score": pa.array(add(base[tokens])), "score": pa.array(add(np.log10(p))),
        })

    met = answers.groupBy("block").applyInArrow(masses, ROW)
    weights = staged(summed(met, n_blocks, fan, bits), "weights")
    free_shuffles(weights)
    out = answers.unionByName(weights).groupBy("block").applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out
