"""Documents into sequences of a fixed token length: exact complements first, best fit for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, sliced, staged
from .tokens import END_ID, crc, documents_ids


def _complement(free: np.ndarray, gap: int, most: int) -> tuple[int, ...] | None:
    """Up to ``most`` available lengths whose sum is ``gap``, fewest and longest first."""
    if free[gap] > 0:
        return (gap,)
    if most < 2:
        return None
    has = free[: gap + 1] > 0
    a = np.arange(gap // 2, gap)
    ok = has[a] & has[gap - a] & ((2 * a != gap) | (free[a] > 1))
    if ok.any():
        a = int(a[np.flatnonzero(ok)[-1]])
        return a, gap - a
    if most < 3:
        return None
    for a in np.flatnonzero(has[:gap])[::-1].tolist():
        if 3 * a < gap:
            break
        free[a] -= 1
        rest = _complement(free, gap - a, 2) if gap - a <= 2 * a else None
        free[a] += 1
        if rest and len(rest) == 2:
            return a, *rest
    return None


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence) and how often each is used, for ``counts`` of lengths up to ``size``.

    From the longest length down, the gap behind it is filled exactly by one,
    two or three lengths while any are available; else by the longest that
    fits, and the gap that stays is treated alike. Each step uses up a length or
    all sequences of its pattern, so steps grow with ``size``, not with the corpus.
    """
    free = np.zeros(size + 1, "i8")
    for k, n in counts.items():
        free[k] = n
    out = []
    for length in range(size, 0, -1):
        while free[length]:
            n, free[length] = int(free[length]), 0
            todo = [((length,), n)]
            while todo:
                pattern, n = todo.pop()
                gap = size - sum(pattern)
                fits = np.flatnonzero(free[: gap + 1]) if gap else ()
                if not len(fits):
                    out.append((pattern, n))
                    continue
                fill = _complement(free, gap, 3) or (int(fits[-1]),)
                lengths, each = np.unique(fill, return_counts=True)
                m = min(n, int((free[lengths] // each).min()))
                free[lengths] -= m * each
                if n > m:
                    todo.append((pattern, n - m))
                todo.append((pattern + fill, m))
    return out


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): whole documents, longer ones cut every ``size`` tokens."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for b in sliced(batches):
            rows = [
                (doc, at // size, at, len(part), crc(part))
                for doc, ids in zip(b.column(0).to_pylist(), documents_ids(tokenizer, b.column(1).to_pylist(), end_id))
                for at in range(0, len(ids), size)
                for part in [ids[at : at + size]]
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = END_ID) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``; null texts count as empty (the end id alone).

    The counts of lengths (``size`` numbers at most) come to the driver, and the
    plan goes back to the tasks: pieces of a length are interchangeable, so a
    piece's rank among them tells its sequence.
    """
    rows = staged(pieces(docs, tokenizer, size, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, base = [], 0
    for pattern, n in plan(counts, size):
        for at, length in zip(np.cumsum([0, *pattern]).tolist(), pattern):
            slots.append((length, n, base, at))
        base += n
    slots.sort()
    length, n, first, at = (np.array(c, "i8") for c in zip(*slots)) if slots else (np.zeros(0, "i8"),) * 4
    before = np.cumsum(n) - n
    starts = before - before[np.searchsorted(length, length)] if len(length) else before
    key = (length << 42) + starts  # ranks of a length stay below 2 ** 42

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(key, (own << 42) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(first[k] + rank - starts[k]), pa.array(at[k])], [*b.schema.names[:-1], "sequence_id", "offset"])

    order = ranked(rows, ["length"], ["doc_id", "piece"], "rank").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return order.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
