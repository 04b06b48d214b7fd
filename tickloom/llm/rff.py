"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import dataclasses
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, sliced, staged

_WORD = re.compile(r"\w+")
STATISTICS = (
    "chars", "words", "word_length", "letters", "upper", "digits", "spaces", "marks", "odd_marks", "accents", "distinct",
    "bare", "doubled", "lines", "line_words", "line_repeats", "commas", "stops", "short", "long", "capitals", "top", "ends",
)


def statistics(text: str | None) -> list[float]:
    """Numbers of a whole text; shares of nothing are 0, so a null or empty text has them all at 0."""
    text = text or ""
    n, tokens, lines = max(1, len(text)), text.split(), text.split("\n")
    m = max(1, len(tokens))
    letters = len(_WORD.sub("", text))  # all that is no word letter
    marks = letters - text.count(" ") - text.count("\n")
    folded = [t.lower() for t in tokens]
    kinds = set(folded)
    lengths = [len(t) for t in tokens]
    raw = text.encode("utf-8", "replace")
    raw = raw.translate(None, bytes(range(0x80, 0x100)))
    upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    digits = len(raw) - len(raw.translate(None, bytes(range(48, 58))))
    repeats = sum(a == b for a, b in zip(folded, folded[1:]))
    common = max(Counter(folded).values(), default=0)
    return [
        np.log1p(len(text)), np.log1p(len(tokens)), np.log1p(sum(lengths) / m), 1 - letters / n, upper / n, digits / n, (text.count(" ") + text.count("\n")) / n,
        marks / n, (marks - text.count(".") - text.count(",")) / n, (len(text) - len(raw)) / n, len(kinds) / m,
        sum(not t.isalnum() for t in tokens) / m, repeats / m, np.log1p(len(lines)), np.log1p(m / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        text.count(",") / m, text.count(".") / m, sum(k <= 3 for k in lengths) / m, sum(k >= 12 for k in lengths) / m, sum(t[:1].isupper() for t in tokens) / m, common / m,
        float(text[-1:] in (".", "!", "?")),
    ]


def features(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, x, row_key) with ``statistics`` of the text; no other column is read."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64())), b.column(2)], ["doc_id", "x", "row_key"])

    docs = docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("row_key"))
    return docs.mapInArrow(rows, "doc_id long, x array<double>, row_key long")


@dataclasses.dataclass(frozen=True)
class Model:
    """Scores by ``ridge`` over random features of standardised statistics, then a monotone map."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray
    levels: np.ndarray  # raw scores
    calibrated: np.ndarray  # what they map to, not falling

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        """Isotonic levels joined by lines; a thousandth of the raw score orders equal levels."""
        raw = self.raw(x)
        level = np.interp(raw, self.levels, self.calibrated) if len(self.levels) else np.full(len(raw), 0.5)
        return 0.999 * level + 0.001 / (1 + np.exp(-4 * (raw - 0.5)))


def _matrix(column) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, of, parts: int = 64) -> list[np.ndarray]:
    """Rows of the matrix ``of``(x, y), summed over partitions: each row's sums meet in two steps, and only totals come to the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = of(_matrix(b.column("x")), b.column("y").to_numpy())
                total = own if total is None else total + own
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), part, "i4")), pa.array(np.arange(len(total), dtype="i4")), pa.array(list(total), pa.list_(pa.float64()))], ["part", "row", "v"])

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        total = np.sum(_matrix(t.column("v").combine_chunks()), 0)
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "row": pa.array([t.column("row")[0].as_py()], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})

    schema = "part int, row int, v array<double>"
    sums = rows.select("x", "y").mapInArrow(local, schema)
    for keys in ([(F.col("part") % parts).alias("k"), "row"], ["row"]):
        sums = sums.groupBy(*keys).applyInArrow(add, schema)
    return [np.array(r["v"]) for r in sorted(sums.select("row", "v").collect(), key=lambda r: r["row"])]


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending ``x`` with ``n`` cases and ``y`` hits each: block centres and means."""
    blocks: list[list[float]] = []
    for a, k, s in zip(x.tolist(), n.tolist(), y.tolist()):
        blocks.append([a * k, k, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(rows: DataFrame, waves: int = 256, width: float = 4.0, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Fits ``rows`` (x, y of 0 or 1, calibrate boolean): sums of partitions, no row comes to the driver.

    ``width`` is the Gaussian kernel's in standard deviations; ``ridge`` is per
    row. Rows with ``calibrate`` fit the isotonic map (counts in 2,048 steps of
    the raw score) and no weights. Without rows all scores are one half.
    """
    d = len(STATISTICS)
    moments = _summed(rows, lambda x, y: np.stack([np.r_[len(x), np.zeros(d - 1)], x.sum(0), (x * x).sum(0)]))
    n = moments[0][0] if moments else 0
    mean = moments[1] / n if n else np.zeros(d)
    spread = np.sqrt(np.maximum(moments[2] / n - mean**2, 0)) if n else np.ones(d)
    random = np.random.default_rng(seed)
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), random.normal(size=(d, waves)) / width, random.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.zeros(0), np.zeros(0))
    if not n:
        return model

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.lift(x)
        return np.column_stack([z.T @ z, z.T @ y])

    sums = _summed(rows.where("not calibrate"), normal)
    if sums:
        sums = np.array(sums)
        a = sums[:, :-1] + ridge * sums[-1, -2] * np.eye(waves + 1)
        model = dataclasses.replace(model, ridge=np.linalg.solve(a, sums[:, -1]))

    def steps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = np.clip(((model.raw(x) + 0.5) * 1024).astype("i8"), 0, 2047)
        return np.stack([np.bincount(k, minlength=2048), np.bincount(k, y, 2048)]).astype("f8")

    counts = _summed(rows.where("calibrate"), steps)
    if counts and (own := counts[0] > 0).any():
        levels, calibrated = isotonic((np.arange(2048)[own] + 0.5) / 1024 - 0.5, counts[0][own], counts[1][own])
        model = dataclasses.replace(model, levels=levels, calibrated=calibrated)
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, **options) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, row_key) of every document; ``row_key`` hashes id and text.

    Learns from labelled documents whose crc32(doc_id as text) is not divisible
    by ``folds``; one of the other residues calibrates. Null labels teach
    nothing; null and empty texts are scored like any other. Without documents there are no rows.
    """
    x = staged(features(docs), "statistics")
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    taught = labels.where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    rows = staged(x.where(fold != 0).join(taught, "doc_id").select("x", "y", (fold == 1).alias("calibrate")), "taught")
    model = fit(rows, **options)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b.column("x"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype("i4")), b.column("row_key")], ["doc_id", "score", "predicted", "row_key"])

    out = x.mapInArrow(scored, "doc_id long, score double, predicted int, row_key long")
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted", "row_key")


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` that ``classify`` does not reject; rows that share an id are judged by their own texts."""
    kept = classify(docs, labels, **options).where("predicted = 1").select(F.col("row_key").alias("_kept")).distinct()
    return docs.withColumn("_key", row_key()).join(kept, F.col("_key") == F.col("_kept"), "left_semi").drop("_key")
