"""Fill-in-the-middle: texts are ropes, whose leaves know how many units and code points they hold.

A rope is split at ranks of units, its subtrees change places between sentinels, and the inverse splits a rope of the
output where its sentinels stand. Trees are never changed: a split shares all subtrees that it does not cut, so it costs
a path of nodes and one leaf.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import sliced

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points after which a leaf ends, at the next end of a unit.
LEAF = 2048
#: A unit ends where white space (of ASCII) follows anything else.
_END = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
_UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_SPACE = b" \t\n\x0b\x0c\r"


def units(text: str) -> int:
    """How many units a text has: words with the white space before them, and white space at the end."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw.split()) + (raw[-1:] in _SPACE if raw else 0)  # bytes part at ASCII's white space alone


@dataclasses.dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (with ``text``) or a node over two ropes."""

    units: int
    chars: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            rope = stack.pop()
            if rope.left is None:
                yield rope.text
            else:
                stack += [rope.right, rope.left]

    def __str__(self) -> str:
        return "".join(self.leaves())


EMPTY = Rope(0, 0)


def leaf(text: str, n: int) -> Rope:
    return Rope(n, len(text), text) if text else EMPTY


def joined(a: Rope, b: Rope) -> Rope:
    """Both one after the other."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    return Rope(a.units + b.units, a.chars + b.chars, "", a, b)


def balanced(ropes: list[Rope]) -> Rope:
    """A tree of least height over ropes in order."""
    while len(ropes) > 1:
        ropes = [joined(*ropes[k : k + 2]) if k + 1 < len(ropes) else ropes[k] for k in range(0, len(ropes), 2)]
    return ropes[0] if ropes else EMPTY


def rope(text: str) -> Rope:
    """A balanced rope of a text; leaves end where units do (a longer unit is a leaf with others before it)."""
    parts, at = [], 0
    while at < len(text):
        found = _END.search(text, at + LEAF) if at + LEAF < len(text) else None
        end = found.start() if found else len(text)
        parts.append(leaf(text[at:end], units(text[at:end])))
        at = end
    return balanced(parts)


def split_units(r: Rope, k: int) -> tuple[Rope, Rope]:
    """The first ``k`` units, and the others."""
    if k <= 0 or k >= r.units:
        return (EMPTY, r) if k <= 0 else (r, EMPTY)
    if r.left is None:
        found = _UNIT.finditer(r.text)
        end = next(m.end() for i, m in enumerate(found, 1) if i == k)
        return leaf(r.text[:end], k), leaf(r.text[end:], r.units - k)
    if k < r.left.units:
        a, b = split_units(r.left, k)
        return a, joined(b, r.right)
    a, b = split_units(r.right, k - r.left.units)
    return joined(r.left, a), b


def split_chars(r: Rope, at: int) -> tuple[Rope, Rope]:
    """The first ``at`` code points, and the others; only code points are counted in the parts."""
    if at <= 0 or at >= r.chars:
        return (EMPTY, r) if at <= 0 else (r, EMPTY)
    if r.left is None:
        return leaf(r.text[:at], 0), leaf(r.text[at:], 0)
    if at < r.left.chars:
        a, b = split_chars(r.left, at)
        return a, joined(b, r.right)
    a, b = split_chars(r.right, at - r.left.chars)
    return joined(r.left, a), b


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits, by a hash of seed and id (of the seed alone where the id is null)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


@dataclasses.dataclass(frozen=True)
class Rates:
    """Percent of texts that change form, and of these that have the suffix first; the seed of all draws."""

    changed: int = 50
    suffix_first: int = 80
    seed: int = 42


def rearranged(doc_id: int | None, text: str | None, rates: Rates = Rates()) -> tuple[int, str, int | None, int | None, str]:
    """Units, form (plain, spm, psm), code points of prefix and middle (None if plain), and the output."""
    text = text or ""
    h1, h2, h3, h4 = draws(rates.seed, doc_id)
    if not text or h3 % 100 >= rates.changed or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return units(text), "plain", None, None, text
    whole = rope(text)
    first, last = sorted((h1 % (whole.units + 1), h2 % (whole.units + 1)))
    head, suffix = split_units(whole, last)
    prefix, middle = split_units(head, first)
    mark = {s: leaf(s, 0) for s in (PREFIX, SUFFIX, MIDDLE)}
    if h4 % 100 < rates.suffix_first:
        form, parts = "spm", [mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle]
    else:
        form, parts = "psm", [mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle]
    return whole.units, form, prefix.chars, middle.chars, str(balanced(parts))


def restored(output: str, form: str) -> str:
    """The text behind an output: its rope is split at the sentinels, which no part of a changed text holds."""
    if form == "plain":
        return output
    marks = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    parts, rest, at = {}, balanced([leaf(output[k : k + LEAF], 0) for k in range(0, len(output), LEAF)]), 0
    for mark, following in zip(marks, (*marks[1:], None)):
        _, rest = split_chars(rest, len(mark))
        begin = at + len(mark)
        at = output.index(following, begin) if following else len(output)
        parts[mark], rest = split_chars(rest, at - begin)
    return str(balanced([parts[PREFIX], parts[MIDDLE], parts[SUFFIX]]))


def infill(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    Whole texts in units of a word with the white space before it; null texts are empty. Empty texts and those that hold a
    sentinel stay plain, whatever the draws. Equal ids draw the same ranks; a null id draws by the seed alone. Rows that
    repeat an id are texts of their own.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = [rearranged(d, t, rates) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            cols = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array(c, t) for c, t in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` (of ``infill``) with a column ``restored``: each text, of its output and form alone."""
    place = {c: outputs.columns.index(c) for c in ("output", "form")}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            both = zip(b.column(place["output"]).to_pylist(), b.column(place["form"]).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([restored(o, f) for o, f in both], pa.string())], [*b.schema.names, "restored"])

    return outputs.mapInArrow(rows, StructType([*outputs.schema.fields, StructField("restored", StringType())]))
