"""Token ids in patched frame-of-reference blocks, in files ordered by document."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import sliced, small_batches
from .tokens import END_ID, crc, documents_ids

BLOCK = 256
#: Share of a block's values that its packed width must hold; the others are exceptions.
COVERED = 0.95
SEGMENT = 1 << 20
#: Documents that are encoded together: the more, the fewer words are looked up twice; Spark bounds their bytes.
ROWS = 2000
_HEAD = struct.Struct("<QI")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values to (blocks, bytes), ``width`` bits each, lowest bit first."""
    size = 2 if width <= 16 else 4
    raw = np.ascontiguousarray(values.astype(f"<u{size}")).view("u1").reshape(len(values), BLOCK, size)
    return np.packbits(np.unpackbits(raw, axis=2, count=width, bitorder="little").reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(data: np.ndarray, width: int) -> np.ndarray:
    """Each value from the bytes that hold its bits: at most five, four up to 25 bits."""
    first = np.arange(BLOCK) * width
    at, shift, many = first >> 3, (first & 7).astype("u8"), 4 if width <= 25 else 5
    wide = np.zeros((len(data), data.shape[1] + many), "u1")
    wide[:, : data.shape[1]] = data
    size = "u4" if many == 4 else "u8"
    out = wide[:, at].astype(size)
    for k in range(1, many):
        out |= wide[:, at + k].astype(size) << np.array(8 * k, size)
    return ((out >> shift.astype(size)) & np.array((1 << width) - 1, size)).astype("u4")


def encode(values: np.ndarray) -> bytes:
    """Count and block count; each block's start, least value, width and number of exceptions; blocks.

    A block: its packed low bits, then its exceptions' positions (a byte each)
    and what they exceed the width by (4 bytes each). Block starts let a reader
    decode any block alone. The last block is filled up with its last value.
    """
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return _HEAD.pack(0, 0)
    full = np.concatenate([values, np.full(blocks * BLOCK - n, values[-1], "<u4")]).reshape(blocks, BLOCK).astype("u4")
    least = full.min(1)
    rest = full - least[:, None]
    k = min(BLOCK - 1, int(np.ceil(BLOCK * COVERED)) - 1)
    at = np.partition(rest, k, axis=1)[:, k]
    widths = np.where(at > 0, np.floor(np.log2(np.maximum(at, 1).astype("f8"))) + 1, 0).astype("u1")
    high = rest >> widths[:, None].astype("u4") if widths.max() < 32 else np.where(widths[:, None] < 32, rest >> np.minimum(widths, 31)[:, None].astype("u4"), 0)
    wrong = high > 0
    bodies: list = [b""] * blocks
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        low = rest[own] & np.uint32((1 << int(w)) - 1)
        packed = _pack(low, int(w)) if w else np.zeros((len(own), 0), "u1")
        for k, body in zip(own.tolist(), packed):
            where = np.flatnonzero(wrong[k])
            bodies[k] = body.tobytes() + where.astype("u1").tobytes() + high[k, where].astype("<u4").tobytes()
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])[:-1]]).astype("<u8")
    return b"".join([_HEAD.pack(n, blocks), starts.tobytes(), least.astype("<u4").tobytes(), widths.tobytes(), wrong.sum(1).astype("<u2").tobytes(), *bodies])


def _parts(data: bytes):
    n, blocks = _HEAD.unpack_from(data)
    at, out = _HEAD.size, []
    for kind, size in (("<u8", 8), ("<u4", 4), ("u1", 1), ("<u2", 2)):
        out.append(np.frombuffer(data, kind, blocks, at))
        at += size * blocks
    return n, *out, np.frombuffer(data, "u1", offset=at)


def decode(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """All values, or those of blocks ``first`` up to ``last`` (exclusive)."""
    n, starts, least, widths, wrong, body = _parts(data)
    blocks = np.arange(len(starts))[first:last]
    out = np.zeros((len(blocks), BLOCK), "u4")
    for w in np.unique(widths[blocks]):
        own = np.flatnonzero(widths[blocks] == w)
        size = BLOCK * int(w) // 8
        if size:
            out[own] = _unpack(body[starts[blocks[own]].astype("i8")[:, None] + np.arange(size)], int(w))
    for k in np.flatnonzero(wrong[blocks]):
        b = blocks[k]
        at, m = int(starts[b]) + BLOCK * int(widths[b]) // 8, int(wrong[b])
        high = np.frombuffer(body[at + m : at + 5 * m].tobytes(), "<u4")
        out[k, body[at : at + m]] |= high << np.uint32(widths[b])
    out += least[blocks][:, None]
    return out.reshape(-1)[: n - first * BLOCK if last is None else min(len(blocks) * BLOCK, n - first * BLOCK)].astype("<u4")


SEGMENTS = "part int, seq long, docs array<long>, lengths binary, ids binary, n_tokens long"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Writes ``docs``'s ids to ``path``, in ascending doc_id order, as Parquet rows of segments.

    A segment holds the ids of neighbouring documents (about a million; always
    whole documents) as blocks, and the documents' ids and lengths. (part, seq)
    orders segments. Null texts count as empty: they have the end id alone. Null ids come
    first; rows of one id are in the order of a hash of their texts.
    """
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, own, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            x = [[part], [seq], [own], [encode(np.array([len(i) for i in ids], "<u4"))], [encode(np.concatenate(ids))], [held]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(x, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()))], ["part", "seq", "docs", "lengths", "ids", "n_tokens"])

        for b in sliced(batches, ROWS):
            for doc, i in zip(b.column(0).to_pylist(), documents_ids(tokenizer, b.column(1).to_pylist(), end_id)):
                own.append(doc)
                ids.append(i)
                held += len(i)
                if held >= SEGMENT:
                    yield row()
                    seq, ids, own, held = seq + 1, [], [], 0
        if own:
            yield row()

    order = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")]
    ordered = docs.select(*order, "text").repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    with small_batches(docs.sparkSession, ROWS):
        ordered.mapInArrow(segments, SEGMENTS).write.parquet(path)


def read_tokens(segments: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of what ``write_tokens`` wrote.

    Starts come from sums of the parts and of the segments in a part, so no
    task sees more than one part's segments or the list of parts.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for part, seq, docs, lengths, data in zip(*(c.to_pylist() for c in b.columns)):
                ids, n = decode(data), decode(lengths).astype("i8")
                ends = np.cumsum(n)
                crcs = [crc(ids[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, "i4")), pa.array(np.full(len(n), seq, "i8")), pa.array(docs, pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crcs, pa.int64())], ["part", "seq", "doc_id", "_at", "n_tokens", "ids_crc32"])

    rows = segments.select("part", "seq", "docs", "lengths", "ids").mapInArrow(documents, "part int, seq long, doc_id long, _at long, n_tokens long, ids_crc32 long")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(W.orderBy("part")).alias("_part"))
    starts = segments.select("part", "seq", before(W.partitionBy("part").orderBy("seq")).alias("_seq")).join(parts, "part")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("_part") + F.col("_seq") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")
