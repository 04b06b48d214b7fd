"""Chains of decisions: each row that is taken names the next one that may be, and all that a first row leads to is marked.

Greedy choices (trades that do not overlap, signals that stay active until they expire) are sequential only along links.
Rows get places by counts of time bins, links are counts too, and chains are followed within blocks of places; what enters a
block from others is a short list, whose chain doubles its steps from round to round. No task holds a series.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import staged

#: Rows of a time bin, on average over all series, and places of a block.
BIN_ROWS, BLOCK = 10_000, 4096
#: Rows of a task that sorts a range, on average.
PART_ROWS = 100_000


def number(rows: DataFrame, column: str) -> Column:
    """A column as a number: timestamps in microseconds, dates in days."""
    kind = rows.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    is_time = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
    return F.unix_micros(F.col(column).cast("timestamp")) if is_time else F.col(column)


def bin_width(rows: DataFrame, at: str, bin_rows: int = BIN_ROWS) -> float:
    """Width of time bins (of the number ``at``) that hold ``bin_rows`` rows on average."""
    r = rows.agg(F.count(at).alias("n"), F.min(at).alias("a"), F.max(at).alias("b")).first()
    span = float(r["b"]) - float(r["a"]) if r["n"] else 0.0
    return max(span * bin_rows / r["n"], 1e-9) if span > 0 else 1.0


def _known(*columns) -> Column:
    """All of these columns (or lists of them) have values."""
    out = F.lit(True)
    for c in columns:
        for name in [c] if isinstance(c, str) else c:
            out = out & F.col(name).isNotNull()
    return out


def _bin(at: str, width: float) -> Column:
    return F.floor(F.col(at) / width).cast("long")


def placed(rows: DataFrame, by: list[str], order: list[str], out: str, width: float) -> DataFrame:
    """Adds the place of each row in its series, from 0, in ``order``, whose first column is a number that makes the bins.

    Rows are sorted within a bin, and counts of the bins before give its first place.
    """
    rows = rows.withColumn("_b", _bin(order[0], width))
    counts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # a row a bin
    starts = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = W.partitionBy(*by, "_b").orderBy(*order)
    rows = rows.withColumn("_r", F.row_number().over(within)).join(starts, [*by, "_b"])
    return rows.withColumn(out, F.col("_first") + F.col("_r") - 1).drop("_b", "_r", "_first")


def matched(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``other`` by equal keys; null is equal to null, as in windows and groups."""
    named = other.select(*[F.col(k).alias(f"_its_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"_its_{k}")) for k in keys], how).drop(*[f"_its_{k}" for k in keys])


def ranked(rows: DataFrame, by: list[str], order: list[str | Column], out: str, part_rows: int = PART_ROWS, size: int | None = None) -> DataFrame:
    """Adds the place of each row in its series, from 0, in an ``order`` of any types; a staged table.

    Rows are dealt to tasks by ranges of series and order, whatever their number in a series, and counts of the tasks before give each one's first place.
    """
    size = rows.count() if size is None else size
    parts = max(1, -(-size // part_rows))
    dealt = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    dealt = staged(dealt.withColumn("_m", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("_part", F.shiftright("_m", 33))
    counts = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_a"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a task
    starts = counts.select(*by, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_a")).alias("_first"))
    found = matched(dealt, starts, [*by, "_part"])
    return found.select(*rows.columns, (F.col("_m") + F.col("_first")).alias(out))


def counted_before(rows: DataFrame, by: list[str], at: str, asked: str, out: str, width: float, also: str | None = None) -> DataFrame:
    """Adds how many rows of the series have ``at`` below this row's ``asked`` (with ``also``, a boolean column: of those where it holds).

    Both are numbers. Rows and questions of a bin are sorted together; counts of the bins before are added.
    """
    one = F.lit(1) if also is None else F.col(also).cast("int")
    kept = F.struct(*rows.columns)
    marks = rows.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"), one.alias("_one"), F.lit(None).cast(rows.select(kept).schema[0].dataType).alias("_row"))
    asks = rows.select(*by, F.col(asked).cast(rows.schema[at].dataType).alias("_t"), F.lit(0).alias("_side"), F.lit(0).alias("_one"), kept.alias("_row"))
    both = marks.unionByName(asks).withColumn("_b", _bin("_t", width))
    counts = both.groupBy(*by, "_b").agg(F.sum("_one").alias("_n"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = W.partitionBy(*by, "_b").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_k", F.sum("_one").over(within)).where("_side = 0").join(starts, [*by, "_b"])
    return found.select("_row.*", (F.col("_first") + F.col("_k")).alias(out))


def last_before(rows: DataFrame, by: list[str], order: list[str], value: Column, out: str, width: float) -> DataFrame:
    """Adds the last non-null ``value`` of the rows before this one in its series.

    ``order`` is total and begins with the number that makes the bins; what the bins before leave over is one value a bin.
    """
    rows = rows.withColumn("_v", value).withColumn("_b", _bin(order[0], width))
    within = W.partitionBy(*by, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ends = rows.where(F.col("_v").isNotNull()).groupBy(*by, "_b").agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    ends = rows.select(*by, "_b").distinct().join(ends, [*by, "_b"], "left")
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    rows = rows.withColumn("_own", F.last("_v", ignorenulls=True).over(within)).join(ends, [*by, "_b"])
    return rows.withColumn(out, F.coalesce("_own", "_carry")).drop("_v", "_b", "_own", "_carry")


def _followed(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of links p to q (sorted by p, q above p, -1: none), the first place outside of ``p`` that each leads to (-1: none)."""
    at = np.minimum(np.searchsorted(p, q), len(p) - 1)
    step = np.where((q >= 0) & (p[at] == q), at, np.arange(len(p)))
    while True:  # each round doubles the steps
        far = step[step]
        if (far == step).all():
            return q[far]
        step = far


def _walked(p: np.ndarray, q: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which of the places p the entries lead to."""
    on = np.isin(p, entries)
    at = np.minimum(np.searchsorted(p, q), len(p) - 1)
    step = np.where((q >= 0) & (p[at] == q), at, np.arange(len(p)))
    for _ in range(len(p).bit_length() + 1):
        on[step[on]] = True
        step = step[step]
    return on


def _sorted(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    p, q = t.column("_p").to_numpy(), t.column("_q").fill_null(-1).to_numpy()
    by = np.argsort(p, kind="stable")
    return p[by], q[by]


def reached(links: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """Rows (*by, _p) that the first place 0 of each series leads to, over ``links`` (*by, _p, _q): a place and the next one.

    Places are unique longs from 0, and ``_q`` is a larger place of the series or null. A block of ``block`` places is
    followed in one task; the places where chains enter other blocks follow each other in rounds, each of two
    equi-joins, as many as the logarithm of the number of blocks that a chain meets.
    """
    keys = links.select(*by).schema
    links = staged(links.select(*by, "_p", "_q", F.floor(F.col("_p") / block).alias("_g")), "links")

    def outside(t: pa.Table) -> pa.Table:
        p, q = _sorted(t)
        out = _followed(p, q)
        own = {c: pa.array([t.column(c)[0].as_py()] * len(p), t.schema.field(c).type) for c in by}
        return pa.table({**own, "_p": pa.array(p), "_q": pa.array(out, mask=out < 0)})

    schema = T.StructType([*keys.fields, T.StructField("_p", T.LongType()), T.StructField("_q", T.LongType())])
    exits = staged(links.groupBy(*by, "_g").applyInArrow(outside, schema), "exits")
    first = exits.where("_p = 0").select(*by, "_p")
    entries = exits.where("_q is not null").select(*by, F.col("_q").alias("_p")).distinct()
    jumps = exits.join(entries.unionByName(first).distinct(), [*by, "_p"]).where("_q is not null")
    found, jumps = first, staged(jumps, "jumps")
    while not jumps.isEmpty():
        found = staged(found.unionByName(found.join(jumps, [*by, "_p"]).select(*by, F.col("_q").alias("_p"))).distinct(), "found")
        then = jumps.select(*by, F.col("_p").alias("_q"), F.col("_q").alias("_then"))
        jumps = staged(jumps.join(then, [*by, "_q"]).select(*by, "_p", F.col("_then").alias("_q")), "jumps")

    def inside(t: pa.Table) -> pa.Table:
        p, q = _sorted(t.filter(t.column("_link")))
        on = p[_walked(p, q, t.filter(pc.invert(t.column("_link"))).column("_p").to_numpy())]
        own = {c: pa.array([t.column(c)[0].as_py()] * len(on), t.schema.field(c).type) for c in by}
        return pa.table({**own, "_p": pa.array(on)})

    entered = found.select(*by, "_p", F.lit(None).cast("long").alias("_q"), F.floor(F.col("_p") / block).alias("_g"), F.lit(False).alias("_link"))
    blocks = links.join(entered.select(*by, "_g").distinct(), [*by, "_g"], "left_semi").withColumn("_link", F.lit(True))
    marked = T.StructType([*keys.fields, T.StructField("_p", T.LongType())])
    return blocks.unionByName(entered).groupBy(*by, "_g").applyInArrow(inside, marked)


def non_overlapping(rows: DataFrame, by: list[str], start: str, end: str, daily: str | None = None, cap: int | None = None, block: int = BLOCK) -> DataFrame:
    """Adds taken: in order of (start, end), a row is taken if it does not start before the last taken row's ``end`` (and its ``daily`` group has fewer than ``cap``).

    Links: a row's next is the first one behind it that starts at or after its end. With a ``cap``, a place is a row
    and how many of its day are taken with it: behind the last of a day the next is the first row of a later day. Days
    follow the order of ``start``. Rows without a key, start or end are never taken; which of equal rows is taken is open.
    """
    spark_columns = rows.columns
    good = _known(by, start, end)
    timed = rows.where(good).withColumn("_s", number(rows, start)).withColumn("_e", number(rows, end))
    width = bin_width(timed, "_s")
    timed = staged(placed(timed, by, ["_s", "_e", *([daily] if cap is not None else [])], "_i", width), "places")
    one = timed.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    links = counted_before(timed.select(*by, "_i", "_s", "_e", *([daily] if cap is not None else [])), by, "_s", "_e", "_next", width)
    links = links.withColumn("_next", F.greatest("_next", F.col("_i") + 1)).join(one, by)
    if cap is None:
        links = links.select(*by, F.col("_i").alias("_p"), F.when(F.col("_next") < F.col("_size"), F.col("_next")).alias("_q"))
        marks = reached(links, by, block).select(*by, F.col("_p").alias("_i"), F.lit(True).alias("taken"))
    else:
        days = timed.groupBy(*by, daily).agg((F.max("_i") + 1).alias("_over"))
        links = links.join(days, [*by, daily])
        turn = F.explode(F.sequence(F.lit(1), F.lit(cap))).alias("_k")
        links = links.select("*", turn)
        same = F.col("_next") < F.col("_over")
        following = F.when(same & (F.col("_k") < cap), F.col("_next") * cap + F.col("_k")).otherwise(F.greatest("_next", "_over") * cap)
        after = F.when(following < F.col("_size") * cap, following)
        links = links.select(*by, (F.col("_i") * cap + F.col("_k") - 1).alias("_p"), after.alias("_q"))
        places = reached(links, by, block * cap).select(*by, F.floor(F.col("_p") / cap).alias("_i"))
        marks = places.distinct().withColumn("taken", F.lit(True))
    out = timed.join(marks, [*by, "_i"], "left").select(*spark_columns, F.coalesce("taken", F.lit(False)).alias("taken"))
    return out.unionByName(rows.where(~good).withColumn("taken", F.lit(False)))


def emitted(rows: DataFrame, by: list[str], at: str, tie: str, side: str, until: str, block: int = BLOCK) -> DataFrame:
    """Adds emitted, active_side and active_until: ``side`` (null: none) becomes active until ``until`` unless another side is active.

    A signal of the active side renews it; one of another side waits until it has expired (a row at ``until`` or later finds none
    active). Rows are taken in order of (``at``, ``tie``), which must be total. ``active_side``: what is active just before the row. Rows without
    a key, time, tie or end are left out.
    """
    columns = rows.columns
    rows = staged(rows.where(_known(by, at, tie, until)).withColumn("_s", number(rows, at)).withColumn("_e", number(rows, until)), "rows")
    width = bin_width(rows, "_s")
    signals = rows.where(F.col(side).isNotNull()).select(*by, tie, side, "_s", "_e")
    signals = placed(signals, by, ["_s", tie], "_i", width)
    signals = staged(placed(signals, [*by, side], ["_s", tie], "_own", width), "signals")
    size = signals.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    links = counted_before(signals, by, "_s", "_e", "_next", width).join(size, by)
    links = links.withColumn("_next", F.greatest("_next", F.col("_i") + 1))
    again = signals.select(*by, side, (F.col("_own") - 1).alias("_own"), F.col("_i").alias("_again"))
    links = links.join(again, [*by, side, "_own"], "left")
    following = F.least(F.when(F.col("_next") < F.col("_size"), F.col("_next")), "_again")  # nulls are left out
    marks = reached(links.select(*by, F.col("_i").alias("_p"), following.alias("_q")), by, block)
    marks = signals.join(marks.withColumnRenamed("_p", "_i"), [*by, "_i"]).select(*by, tie, F.lit(True).alias("emitted"))
    out = staged(rows.join(marks, [*by, tie], "left").withColumn("emitted", F.coalesce("emitted", F.lit(False))), "emitted")
    last = F.when(F.col("emitted"), F.struct(F.col(side).alias("side"), F.col(until).alias("until"), F.col("_e").alias("e")))
    out = last_before(out, by, ["_s", tie], last, "_last", width)
    live = F.col("_last.e") > F.col("_s")
    return out.select(*columns, "emitted", F.when(live, F.col("_last.side")).alias("active_side"), F.when(live, F.col("_last.until")).alias("active_until"))
