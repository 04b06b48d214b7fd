"""Training samples and imports: rows that are kept, and the reason for each that is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import codes
from .asof import asof_join

OUTCOMES = ("UP", "DOWN", "NEITHER")


def first_reason(*pairs: tuple[Column, Column | str]) -> Column:
    """The first reason whose condition holds; an unknown condition does not."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(pairs):
        out = F.when(condition, F.lit(reason) if isinstance(reason, str) else reason).otherwise(out)
    return out


def reasons(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many rows each reason excludes."""
    return rows.where("reason is not null").groupBy(*(by or []), "reason").agg(F.count(F.lit(1)).alias("n"))


def exact_context(samples: DataFrame, series: dict[str, DataFrame], main: DataFrame, keys: list[str], at: str = "decision_time", warm_up: int = 50) -> DataFrame:
    """Adds every context series' columns (prefixed by its name) and the main one's at the very decision time, and reason.

    ``series`` and ``main``: keys, closes_at, index (from 0) and values. A sample without a bar of each series is
    CONTEXT_5M_EXACT_CLOSE_MISSING, with fewer than ``warm_up`` bars before it CONTEXT_WARMUP_INCOMPLETE, without a main bar with three before it
    MAIN_ALIGNMENT_MISSING; nothing is filled in from other times.
    """
    out, absent, early = samples, F.lit(False), F.lit(False)
    for name, rows in {**series, "main": main}.items():
        values = [c for c in rows.columns if c not in (*keys, "closes_at")]
        out = out.join(rows.select(*keys, F.col("closes_at").alias(at), *[F.col(v).alias(f"{name}__{v}") for v in values]), [*keys, at], "left")
        if name != "main":
            absent, early = absent | F.col(f"{name}__index").isNull(), early | (F.col(f"{name}__index") < warm_up)
    unaligned = F.col("main__index").isNull() | (F.col("main__index") < 3)
    return out.withColumn("reason", first_reason((absent, "CONTEXT_5M_EXACT_CLOSE_MISSING"), (early, "CONTEXT_WARMUP_INCOMPLETE"), (unaligned, "MAIN_ALIGNMENT_MISSING")))


def assemble(primary: DataFrame, labels: DataFrame, context_15m: DataFrame, context_1h: DataFrame, keys: list[str], values: list[str], at: str = "decision_time") -> DataFrame:
    """Joins features of three frames and labels into samples, each with its reason for exclusion (null: kept).

    ``primary``: keys, decision_time, bar_id, ready and values; the contexts: the same, known from their decision_time on. ``labels``: bar_id,
    label_id, eligible, outcome, reason. Reasons in order: the label's own (LABEL_NOT_TRAINING_ELIGIBLE without one), PRIMARY_5M_FEATURES_NOT_READY,
    FINALIZED_15M_FEATURES_NOT_READY, FINALIZED_1H_FEATURES_NOT_READY, NULL_FEATURE_VALUE. A sample's checksum names the bars behind it.
    """
    rows = primary.select(*keys, at, "bar_id", "ready", *[F.col(v).alias(f"primary_5m__{v}") for v in values])
    rows = rows.join(labels.select("bar_id", "label_id", "eligible", "outcome", F.col("reason").alias("_why")), "bar_id", "left")
    for name, frame in (("context_15m", context_15m), ("context_1h", context_1h)):
        rows = asof_join(rows, frame.select(*keys, at, "bar_id", "ready", *values), keys, at, at, ["bar_id", "ready", *values], f"{name}__")
    usable = F.coalesce(F.col("eligible") & F.col("outcome").isin(*OUTCOMES), F.lit(False))
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    names = [f"{p}__{v}" for p in ("primary_5m", "context_15m", "context_1h") for v in values]
    gap = F.exists(F.array(*[F.col(n).isNull() for n in names]), lambda x: x)
    reason = first_reason(
        (~usable, F.coalesce("_why", F.lit("LABEL_NOT_TRAINING_ELIGIBLE"))), (~known("ready"), "PRIMARY_5M_FEATURES_NOT_READY"), (~known("context_15m__ready"), "FINALIZED_15M_FEATURES_NOT_READY"),
        (~known("context_1h__ready"), "FINALIZED_1H_FEATURES_NOT_READY"), (gap, "NULL_FEATURE_VALUE"),
    )
    checksum = F.sha2(F.concat_ws("|", "bar_id", "context_15m__bar_id", "context_1h__bar_id"), 256)
    return rows.select(*keys, at, "bar_id", "label_id", "outcome", *names, checksum.alias("input_checksum"), reason.alias("reason"))


def store_errors(bars: DataFrame, keys: list[str], arrival: str = "arrival") -> DataFrame:
    """Adds errors of bars appended in order of ``arrival`` (bar_id, revision, supersedes): what an append-only store must refuse.

    A bar_id comes once; the n-th bar of a key has revision n and supersedes the one before it, the first none.
    """
    own, same = W.partitionBy(*keys).orderBy(arrival), W.partitionBy("bar_id").orderBy(arrival)
    n, before = F.row_number().over(own), F.lag("bar_id").over(own)
    found = codes(
        (F.row_number().over(same) > 1, "BAR_ALREADY_STORED"), (F.col("revision") != n, "UNEXPECTED_REVISION"),
        ((n > 1) & ~F.col("supersedes").eqNullSafe(before), "CORRECTION_MUST_SUPERSEDE_THE_PRIOR_REVISION"), ((n == 1) & F.col("supersedes").isNotNull(), "INITIAL_BAR_CANNOT_SUPERSEDE"),
    )
    return bars.withColumn("errors", found)


def imported(bars: DataFrame, dataset: str, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """The rows of whole datasets that may be stored, and one row a dataset: n, n_errors, status. One bad row rejects its dataset."""
    counts = bars.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(errors) > 0).alias("n_errors"))
    counts = counts.withColumn("status", F.when(F.col("n_errors") > 0, F.lit("REJECTED")).otherwise(F.lit("PASS")))
    return bars.join(counts.where("status = 'PASS'").select(dataset), dataset, "left_semi"), counts
