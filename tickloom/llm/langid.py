"""Language identification by compression: the language whose text, as a raw-content dictionary, makes a text smallest.

zstandard alone tells little of a short text: without earlier symbols it stores a few words as they are, whatever the
dictionary. So a language also has primers, pieces of its text that are not in its dictionary: a text is compressed
behind a primer, and what counts is how many bytes it adds.
"""

from __future__ import annotations

import dataclasses
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import sliced

_WORD = re.compile(r"[^\W\d_]+")
#: Zstandard's level, the bytes of a text that are compressed at once, and the most primers a language has.
LEVEL, PIECE, PRIMERS = 3, 8192, 8
UNKNOWN = "und"


def letters(text: str | None) -> bytes:
    """A whole text's words, runs of letters in lower case, with one space between them."""
    return " ".join(_WORD.findall((text or "").lower())).encode("utf-8", "replace")


def segment(words: bytes, size: int, at: float) -> bytes:
    """A run of whole words of ``size`` bytes about the share ``at`` of all (0 to 1); shorter texts are one segment."""
    if len(words) <= size:
        return words
    start = words.find(b" ", int(at * (len(words) - size))) + 1
    end = words.rfind(b" ", start, start + size)
    return words[start : end if end > start else start + size].decode("utf-8", "ignore").encode()


@dataclasses.dataclass(frozen=True)
class Language:
    """A language's dictionary, and its primers."""

    name: str
    body: bytes
    primers: tuple[bytes, ...]

    @functools.cached_property
    def compressor(self) -> zstandard.ZstdCompressor:
        form = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE, dict_size=len(self.body), **form)
        if not self.body:
            return zstandard.ZstdCompressor(compression_params=p)
        own = zstandard.ZstdCompressionDict(self.body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=own, compression_params=p)

    @functools.cached_property
    def alone(self) -> list[int]:
        return [len(self.compressor.compress(p)) for p in self.primers]

    def added(self, words: bytes, turn: int) -> int:
        """Bytes that a whole text adds to a primer, piece by piece."""
        k = turn % len(self.primers)
        primer, alone, compress = self.primers[k], self.alone[k], self.compressor.compress
        return sum(len(compress(primer + words[a : a + PIECE])) - alone for a in range(0, len(words), PIECE))

    def __getstate__(self) -> dict:
        return {"name": self.name, "body": self.body, "primers": self.primers}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)


def language(name: str, segments: list[bytes]) -> Language:
    """The first segments are primers, two each, where there are enough of them; the others make the dictionary."""
    n = min(PRIMERS, len(segments) // 8) or len(segments) // 2 and 1
    primers = [b" ".join(segments[2 * k : 2 * k + 2]) + b" " for k in range(n)] if n > 1 else [s + b" " for s in segments[:n]]
    return Language(name, b" ".join(segments[(2 * n if n > 1 else n) :]), tuple(primers or [b""]))


def predict(languages: list[Language], text: str | None, near: int = 8) -> tuple[str, float, float | None]:
    """The language, a score from 0 to 1, and by how many bytes the next language is larger (None if there is none).

    Languages within ``near`` bytes of each other are measured again behind the next primers, and the mean counts.
    The score is the best one's share if each byte more halves a language's weight. Ties go to the first language by name.
    """
    words = letters(text)
    if not words or not languages:
        return UNKNOWN, 0.0, None
    total = np.zeros(len(languages))
    for turn in range(PRIMERS):
        total += [x.added(words, turn) for x in languages]
        size = total / (turn + 1)
        by = np.argsort(size, kind="stable")
        margin = float(size[by[1]] - size[by[0]]) if len(by) > 1 else None
        if margin is None or margin > near:
            break
    return languages[by[0]].name, float(1 / np.exp2(np.maximum(size[by[0]] - size, -1000)).sum()), margin


def learn(taught: DataFrame, segments: int = 264, segment_bytes: int = 512, total_bytes: int = 64 << 20) -> list[Language]:
    """Languages by name, of rows (lang, text, seed): ``seed`` is a hash that chooses rows.

    A language's dictionary and primers are ``segments`` pieces of ``segment_bytes`` of its normalised text, each of
    another row; with very many languages there are fewer, so that all of them together have ``total_bytes`` at most. Rows are a
    sample by hash (equal texts count once), a bound that does not grow with the corpus; the driver sees a count a
    language and these pieces. Languages whose texts have no letters are not learned.
    """
    counts = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    segments = max(24, min(segments, total_bytes // (segment_bytes * len(counts))))
    # four times as many rows as are kept, as some are copies of others
    rates = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 4.0 * segments / n))])
    share = lambda seed: F.pmod(seed, F.lit(1 << 30)) / float(1 << 30)
    some = taught.where(share(F.col("seed")) < rates[F.col("lang")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            at = b.column(2).to_numpy()
            words = [segment(letters(t), segment_bytes, p) for t, p in zip(b.column(1).to_pylist(), at)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], ["lang", "words"])

    place = share(F.xxhash64("text"))  # equal texts give equal pieces
    pieces = some.select("lang", "text", place.alias("at")).mapInArrow(cut, "lang string, words binary")
    order = W.partitionBy("lang").orderBy(F.xxhash64("words"), "words")
    kept = pieces.where(F.length("words") > 0).distinct().withColumn("k", F.row_number().over(order))
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in kept.where(F.col("k") <= segments).collect():
        found.setdefault(r["lang"], []).append((r["k"], bytes(r["words"])))
    return [language(name, [w for _, w in sorted(found[name])]) for name in sorted(found)]


def is_held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, least_margin: float = 2.0, near: int = 8, **options) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, margin, rejected) of every document.

    Learns (``learn``) from rows with a lang whose crc32(doc_id as text) mod 4 is not 2; rows without an id are not
    held out. Whole texts are compressed. Null texts and those without a letter are `und` with score 0, as are all if there is
    no language to learn. ``rejected``: the next language is less than ``least_margin`` bytes larger, or the text is `und`;
    such a prediction is still given. Equal texts have equal results; rows that repeat an id are documents each.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    held = is_held_out(F.col("doc_id"))
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held)
    languages = learn(taught.select("lang", "text", F.xxhash64("doc_id", "text").alias("seed")), **options)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = [predict(languages, t, near) for t in b.column(1).to_pylist()]
            name, score, margin = zip(*out) if out else ([], [], [])
            columns = [b.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "margin"])

    out = docs.select("doc_id", "text").mapInArrow(predicted, "doc_id long, lang_pred string, score double, margin double")
    rejected = (F.col("lang_pred") == UNKNOWN) | F.coalesce(F.col("margin") < least_margin, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", rejected.alias("rejected"))
