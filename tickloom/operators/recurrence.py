"""Linear recurrences y[t] = u[t] + keep * y[t-1] as window sums, without a sequential pass in Python.

Rows of a series are cut into blocks. Inside a block the recurrence is a running
sum of ``u`` divided by powers of ``keep``, times that power again. What earlier
blocks leave falls by ``keep`` ** block; blocks are so long that a few of them
hold all that a double can show, so a short frame over block ends completes it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def decayed(df: DataFrame, u: str, keep: float, by: list[str], order: str, out: str, index: str | None = None) -> DataFrame:
    """Adds ``out``: the sum over earlier rows j of ``u``[j] * keep ** (t - j); null ``u`` counts as 0."""
    if not 0 < keep < 1:
        raise ValueError("keep must lie between 0 and 1")
    fall = -math.log10(keep)
    size = max(2, min(256, int(60 / fall)))
    far = max(1, math.ceil(40 / (fall * size)))
    rows = df if index else df.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1)
    i = F.col(index or "_i")
    rows = rows.withColumn("_block", F.floor(i / size)).withColumn("_k", (i % size).cast("double"))
    within = W.partitionBy(*by, "_block").orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    power = F.pow(F.lit(float(keep)), F.col("_k"))
    rows = rows.withColumn("_own", F.sum(F.coalesce(F.col(u), F.lit(0.0)) / power).over(within) * power)
    rows = rows.withColumn("_end", F.when(F.col("_k") == size - 1, F.col("_own")))
    # frames over block numbers move once a block, and need no join or shuffle beyond the series' own
    blocks = W.partitionBy(*by).orderBy("_block")
    carry = sum((F.coalesce(F.sum("_end").over(blocks.rangeBetween(-k, -k)), F.lit(0.0)) * float(keep) ** (size * (k - 1)) for k in range(1, far + 1)), F.lit(0.0))
    rows = rows.withColumn("_carry", carry).withColumn(out, F.col("_own") + power * keep * F.col("_carry"))
    return rows.drop("_block", "_k", "_own", "_end", "_carry", *([] if index else ["_i"]))


def _numbered(df: DataFrame, by: list[str], order: str) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1)


def seeded(df: DataFrame, x: Column, alpha: float, seed: int, by: list[str], order: str, out: str, start: int = 0, warm_up: float | None = None) -> DataFrame:
    """Recursive mean y[t] = alpha * x[t] + (1 - alpha) * y[t-1], from the mean of the first ``seed`` values on.

    Values count from row ``start`` of the series; rows before the seed is full get
    ``warm_up`` (null, or a number for the variants that have one).
    """
    w = W.partitionBy(*by).orderBy("_i")
    rows = _numbered(df, by, order).withColumn("_x", x)
    first = start + seed - 1
    mean = F.avg("_x").over(w.rowsBetween(-(seed - 1), 0))
    i = F.col("_i")
    rows = rows.withColumn("_u", F.when(i == first, mean).when(i > first, F.lit(float(alpha)) * F.col("_x")).otherwise(F.lit(0.0)))
    rows = decayed(rows, "_u", 1 - alpha, by, order, "_y", "_i")
    return rows.withColumn(out, F.when(F.col("_i") >= first, F.col("_y")).otherwise(F.lit(warm_up).cast("double"))).drop("_i", "_x", "_u", "_y")


def ema(df: DataFrame, x: Column, n: int, by: list[str], order: str, out: str, seed: int | None = None, warm_up: float | None = None) -> DataFrame:
    """Exponential mean of span ``n``; seeded by the mean of n values, or of ``seed`` (1: by the first value)."""
    return seeded(df, x, 2 / (n + 1), n if seed is None else seed, by, order, out, 0, warm_up)


def wilder(df: DataFrame, x: Column, n: int, by: list[str], order: str, out: str, start: int = 0, warm_up: float | None = None) -> DataFrame:
    return seeded(df, x, 1 / n, n, by, order, out, start, warm_up)


def bounded(df: DataFrame, x: Column, alpha: float, seed: int, limit: int, by: list[str], order: str, out: str, first: Column | None = None) -> DataFrame:
    """``seeded`` as if each row saw only the last ``limit`` rows: what lies before them is exchanged for the mean that seeds them.

    ``first``: the value that the first of these rows has instead of ``x``, which may look back beyond it.
    """
    w = W.partitionBy(*by).orderBy(order)
    rows = seeded(df.withColumn("_bx", x), F.col("_bx"), alpha, seed, by, order, out).withColumn("_bn", F.row_number().over(w))
    mean = F.avg("_bx").over(w.rowsBetween(-(seed - 1), 0))
    if first is not None:
        rows = rows.withColumn("_bf", first - F.col("_bx"))
        mean = mean + F.lag("_bf", seed - 1).over(w) / seed
    gap = limit - seed
    rows = rows.withColumn("_bm", mean - F.col(out)).withColumn("_bm", F.lag("_bm", gap).over(w))
    shift = F.when(F.col("_bn") > limit, F.col("_bm") * float((1 - alpha) ** gap)).otherwise(F.lit(0.0))
    return rows.withColumn(out, F.col(out) + shift).drop(*[c for c in ("_bx", "_bn", "_bm", "_bf") if c in rows.columns])


def bounded_ema(df: DataFrame, x: Column, n: int, limit: int, by: list[str], order: str, out: str) -> DataFrame:
    return bounded(df, x, 2 / (n + 1), n, limit, by, order, out)


def bounded_atr(df: DataFrame, n: int, limit: int, by: list[str], order: str, out: str) -> DataFrame:
    return bounded(df, true_range(by, order), 1 / n, n, limit, by, order, out, F.col("high") - F.col("low"))


def rsi(df: DataFrame, close: str, n: int, by: list[str], order: str, out: str) -> DataFrame:
    """Wilder's relative strength index, first at row n; 50 where nothing moved, 100 where nothing fell."""
    change = F.col(close) - F.lag(close).over(W.partitionBy(*by).orderBy(order))
    rows = df.withColumn("_d", change)
    rows = wilder(rows, F.greatest("_d", F.lit(0.0)), n, by, order, "_g", 1)
    rows = wilder(rows, F.greatest(-F.col("_d"), F.lit(0.0)), n, by, order, "_l", 1)
    g, loss = F.col("_g"), F.col("_l")
    value = F.when(loss == 0, F.when(g > 0, F.lit(100.0)).otherwise(F.lit(50.0))).otherwise(100 - 100 / (1 + F.try_divide(g, loss)))
    return rows.withColumn(out, value).drop("_d", "_g", "_l")


def true_range(by: list[str], order: str, first: Column | None = None) -> Column:
    """Largest of the bar's range and its gaps from the previous close; a series' first bar has its range, or ``first``."""
    before = F.lag("close").over(W.partitionBy(*by).orderBy(order))
    own = F.col("high") - F.col("low")
    return F.when(before.isNull(), own if first is None else first).otherwise(F.greatest(own, F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(df: DataFrame, n: int, by: list[str], order: str, out: str) -> DataFrame:
    rows = df.withColumn("_tr", true_range(by, order))
    return wilder(rows, F.col("_tr"), n, by, order, out).drop("_tr")


def adx(df: DataFrame, n: int, by: list[str], order: str, out: str = "adx", spread: str = "di_spread") -> DataFrame:
    """Average directional index and the difference of directional indicators, in 0..1, by Wilder's means: 0 until ``n`` rows are there; the first row's range is 0."""
    w = W.partitionBy(*by).orderBy(order)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    rows = df.withColumn("_tr", true_range(by, order, F.lit(0.0)))
    rows = rows.withColumn("_p", F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0))).withColumn("_m", F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)))
    for c in ("_tr", "_p", "_m"):
        rows = wilder(rows, F.col(c), n, by, order, c + "s", warm_up=0.0)
    plus, minus = (F.when(F.col("_trs") > 1e-12, F.try_divide(c, "_trs")).otherwise(F.lit(0.0)) for c in ("_ps", "_ms"))
    rows = rows.withColumn(spread, plus - minus).withColumn("_dx", F.coalesce(F.try_divide(F.abs(plus - minus), plus + minus), F.lit(0.0)))
    return wilder(rows, F.col("_dx"), n, by, order, out, warm_up=0.0).drop("_tr", "_p", "_m", "_trs", "_ps", "_ms", "_dx")


def macd_parts(df: DataFrame, by: list[str], order: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Adds macd_line, the difference of two exponential means (each 0 while it warms up), and macd_signal, its own mean of ``signal`` from the first value."""
    rows = ema(df, F.col("close"), fast, by, order, "_f", warm_up=0.0)
    rows = ema(rows, F.col("close"), slow, by, order, "_s", warm_up=0.0)
    rows = rows.withColumn("macd_line", F.col("_f") - F.col("_s")).drop("_f", "_s")
    return ema(rows, F.col("macd_line"), signal, by, order, "macd_signal", seed=1)


def macd(df: DataFrame, by: list[str], order: str, out: str = "macd", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """The histogram of ``macd_parts``: the line less its mean."""
    return macd_parts(df, by, order, fast, slow, signal).withColumn(out, F.col("macd_line") - F.col("macd_signal")).drop("macd_line", "macd_signal")
