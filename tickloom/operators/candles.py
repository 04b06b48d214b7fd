"""Bars from ticks and from finer bars, their revisions, and the newest state of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["instrument_id", "opens_at"]

#: Provider of a bar whose parts have several.
MIXED = "canonical-mixed"


def from_ticks(ticks: DataFrame, bucket: Column, keys: list[str], ts: str = "ts", price: str = "value", tie: str = "event_id") -> DataFrame:
    """One bar for each series and bucket that holds a tick; empty buckets stay missing."""
    at = F.struct(F.col(ts), F.col(tie))
    return ticks.groupBy(*keys, bucket.alias("opens_at")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).alias("n_ticks"),
    )


def coarser(bars: DataFrame, bucket: Column, expected: int, keys: list[str]) -> DataFrame:
    """Bars of a coarser frame from those with all ``expected`` parts. Volume is null as soon as one part's is.

    Where the parts have them: provider (``MIXED`` if there are several), the latest finalized_at, the highest source_revision, the last part's watermark.
    """
    one_provider = F.min("provider") == F.max("provider")
    kept = {
        "volume": F.when(F.count("volume") == F.count(F.lit(1)), F.sum("volume")), "provider": F.when(one_provider, F.min("provider")).otherwise(F.lit(MIXED)),
        "finalized_at": F.max("finalized_at"), "source_revision": F.max("source_revision"), "watermark": F.max_by("watermark", "opens_at"),
    }
    out = bars.groupBy(*keys, bucket.alias("bucket")).agg(
        F.min_by("open", "opens_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "opens_at").alias("close"),
        F.count(F.lit(1)).alias("n_parts"), *[f.alias(c) for c, f in kept.items() if c in bars.columns],
    )
    return out.where(F.col("n_parts") == expected).withColumnRenamed("bucket", "opens_at").drop("n_parts")


def developing(ticks: DataFrame, bucket: Column, keys: list[str], ts: str = "ts", price: str = "value", tie: str = "event_id") -> DataFrame:
    """The bar as it stood after each tick, with its revision; never mixed with finished bars."""
    rows = ticks.withColumn("opens_at", bucket)
    w = W.partitionBy(*keys, "opens_at").orderBy(ts, tie)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    return rows.select(
        *keys, "opens_at", tie, F.first(price).over(so_far).alias("open"), F.max(price).over(so_far).alias("high"), F.min(price).over(so_far).alias("low"),
        F.col(price).alias("close"), F.row_number().over(w).alias("revision"),
    )


def revisions(rows: DataFrame, keys: list[str], order: list[str], identity: str) -> DataFrame:
    """Numbers versions from 1 and points each at the one that it supersedes."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("revision", F.row_number().over(w)).withColumn("supersedes", F.lag(identity).over(w))


def ingested(rows: DataFrame, keys: list[str], order: list[str], provider_revision: str, identity: str) -> DataFrame:
    """Numbers the versions of each bar as they arrive, and refuses those whose provider revision does not grow.

    Adds refused, and for versions that stay revision (from 1) and supersedes (the version before). What was refused
    is never above what stayed, so the highest revision before a row, refused or not, is that of the version in force.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("refused", F.coalesce(F.col(provider_revision) <= F.max(provider_revision).over(before), F.col(provider_revision).isNull()))
    stays = F.when(~F.col("refused"), F.col(identity))
    rows = rows.withColumn("_stays", stays)
    return rows.withColumns({
        "revision": F.when(~F.col("refused"), F.count("_stays").over(w.rowsBetween(W.unboundedPreceding, 0))),
        "supersedes": F.when(~F.col("refused"), F.last("_stays", ignorenulls=True).over(before)),
    }).drop("_stays")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest version of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def tails(rows: DataFrame, keys: list[str], order: Column, limits: Column | int) -> DataFrame:
    """The last rows of each series, up to a limit that may depend on the row's series."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= limits).drop("_n")


def propagate(minutes: DataFrame, bucket: Column, expected: int, keys: list[str], arrival: str = "arrived_at") -> DataFrame:
    """All revisions of coarser bars: one for each arrival that completes or changes the bucket's parts.

    ``minutes`` has a row for each version of each part. At an arrival, the bar holds the newest version of every part so far; it is
    new where all ``expected`` parts are there and one of their versions differs from the bar's before. Running maxima keep the newest
    version of each part, so a bucket's work grows with its versions alone.
    """
    rows = minutes.withColumn("bucket", bucket)
    rows = rows.withColumn("_part", F.dense_rank().over(W.partitionBy(*keys, "bucket").orderBy("opens_at")))
    so_far = W.partitionBy(*keys, "bucket").orderBy(arrival).rangeBetween(W.unboundedPreceding, 0)
    newest = [F.max(F.when(F.col("_part") == k, F.struct("revision", "opens_at", "open", "high", "low", "close"))).over(so_far) for k in range(1, expected + 1)]
    rows = rows.withColumn("_v", F.array(*newest)).withColumn("_known", F.max("_part").over(so_far))
    rows = rows.where((F.col("_known") <= expected) & F.forall("_v", lambda x: x.isNotNull()))
    part = lambda c: F.transform("_v", lambda x: x[c])
    bars = rows.select(*keys, "bucket", F.col(arrival).alias("as_of"), "_v").dropDuplicates([*keys, "bucket", "as_of"])
    w = W.partitionBy(*keys, "bucket").orderBy("as_of")
    bars = bars.withColumn("_new", ~F.col("_v").eqNullSafe(F.lag("_v").over(w))).where("_new")
    ends = lambda k, c: F.element_at("_v", k)[c]
    return bars.select(
        *keys, F.col("bucket").alias("opens_at"), "as_of", ends(1, "open").alias("open"), F.array_max(part("high")).alias("high"), F.array_min(part("low")).alias("low"),
        ends(-1, "close").alias("close"), F.row_number().over(w).alias("revision"),
    )


def invalid(prefix: str = "") -> Column:
    """Codes of what is wrong with a bar: alignment to a minute, order of prices, sign, revision."""
    from ..functions.expressions import codes

    o, h, low, c = (F.col(prefix + x) for x in ("open", "high", "low", "close"))
    return codes(
        (F.least(o, h, low, c) <= 0, "PRICE_NOT_POSITIVE"), (low > F.least(o, c), "LOW_ABOVE_BODY"), (h < F.greatest(o, c), "HIGH_BELOW_BODY"),
        (F.col("closes_at") != F.col("opens_at") + F.expr("interval 1 minute"), "NOT_ONE_MINUTE"), (F.col("revision") < 1, "REVISION_BELOW_ONE"),
    )
