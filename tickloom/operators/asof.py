"""As-of and interval joins of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import chains


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], prefix: str = "") -> DataFrame:
    """For each left row the values of the last right row of its series with ``right_at`` <= ``left_at`` (nulls where none).

    One sort of both sides together and a running last value: linear, and no
    row meets more than one partner. The last right row counts even if its
    values are null.
    """
    own = left.columns
    a = left.select(F.struct(*own).alias("_left"), *keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    b = right.select(F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), *keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    before = W.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(before)).where("_side = 1")
    return rows.select("_left.*", *[F.col("_v")[v].alias(prefix + v) for v in values])


def next_rows(rows: DataFrame, keys: list[str], order: str, columns: list[str], n: int, out: str) -> DataFrame:
    """Adds an array of the next ``n`` rows' structs, fewer at the end of a series."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(1, n)
    return rows.withColumn(out, F.collect_list(F.struct(*columns)).over(w))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], start: Column, end: Column, at: str, width: int) -> DataFrame:
    """Pairs with start <= ``at`` < end (seconds as numbers, whole or not) in a series, by bins of ``width`` seconds: an equi-join, then the exact condition."""
    a = left.withColumn("_s", start).withColumn("_e", end).where("_s < _e")
    a = a.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / width), F.ceil(F.col("_e") / width) - 1)))
    b = right.withColumn("_at", F.col(at)).withColumn("_bin", F.floor(F.col(at) / width))
    return a.join(b, [*keys, "_bin"]).where((F.col("_at") >= F.col("_s")) & (F.col("_at") < F.col("_e"))).drop("_s", "_e", "_bin", "_at")


def first_from(left: DataFrame, right: DataFrame, keys: list[str], moment: str, at: str, columns: list[str], out: str) -> DataFrame:
    """Adds a struct of the first right row of the series with ``at`` at or after ``moment`` (null: none), without a series in one task.

    Right rows of one time are taken in order of ``columns``. Rows without a key or moment have none.
    """
    kept, value = F.struct(*left.columns), F.struct(*columns)
    width = chains.bin_width(right.withColumn("_a", chains.number(right, at)), "_a")
    none = lambda df, x: F.lit(None).cast(df.select(x).schema[0].dataType)
    asks = left.select(*keys, (-chains.number(left, moment)).alias("_m"), F.lit(1).alias("_side"), none(right, value).alias("_r"), kept.alias("_left"))
    rows = right.select(*keys, (-chains.number(right, at)).alias("_m"), F.lit(0).alias("_side"), value.alias("_r"), none(left, kept).alias("_left"))
    known = F.col("_m").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    # backwards in time, so that the last row before is the first one after; of one time the least struct comes last
    both = asks.unionByName(rows).where(known).groupBy(*keys, "_m", "_side", "_left").agg(F.min("_r").alias("_r"))
    found = chains.last_before(both, keys, ["_m", "_side"], F.when(F.col("_side") == 0, F.col("_r")), "_found", width).where("_side = 1")
    return found.select("_left.*", F.col("_found").alias(out))


def tails(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, columns: list[str], limit: int, out: str) -> DataFrame:
    """Adds an array of structs: the last ``limit`` right rows of the series with ``right_at`` <= ``left_at``, oldest first.

    Times are timestamps or whole numbers, and right rows are ordered by (``right_at``, ``columns``). Right rows get places
    and lie in blocks of ``limit`` of them; a left row meets the block of its last row and the one before, whatever the series'
    length. Left rows without a partner, key or time have an empty array.
    """
    own = left.columns
    a = left.withColumn("_t", chains.number(left, left_at))
    b = right.withColumn("_t", chains.number(right, right_at))
    known = F.col("_t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    width = chains.bin_width(b, "_t")
    b = chains.staged(chains.placed(b.where(known).select(*keys, "_t", *[c for c in columns if c not in keys]), keys, ["_t", *[c for c in columns if c not in keys]], "_p", width), "places")
    blocks = b.groupBy(*keys, F.floor(F.col("_p") / limit).alias("_g")).agg(F.sort_array(F.collect_list(F.struct("_p", F.struct(*columns).alias("v")))).alias("_rows"))
    marks = b.select(*keys, "_t", F.lit(True).alias("_right")).unionByName(a.where(known).select(*keys, "_t").distinct().withColumn("_right", F.lit(False)))
    marks = marks.withColumn("_next", F.col("_t") + 1)
    ends = chains.counted_before(marks, keys, "_t", "_next", "_end", width, also="_right").where("not _right").select(*keys, "_t", "_end")
    a = a.join(ends, [*keys, "_t"], "left").withColumn("_g", F.floor((F.col("_end") - 1) / limit))
    none = F.array().cast(blocks.schema["_rows"].dataType)
    before = blocks.select(*keys, (F.col("_g") + 1).alias("_g"), F.col("_rows").alias("_before"))
    a = a.join(blocks, [*keys, "_g"], "left").join(before, [*keys, "_g"], "left")
    both = F.concat(F.coalesce("_before", none), F.coalesce("_rows", none))
    kept = F.filter(both, lambda x: (x["_p"] < F.col("_end")) & (x["_p"] >= F.col("_end") - limit))
    return a.select(*own, F.transform(kept, lambda x: x["v"]).alias(out))
