"""What is missing, repeated or out of order in a set of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing(expected: DataFrame, observed: DataFrame, on: list[str]) -> DataFrame:
    """Expected rows without a partner."""
    return expected.join(observed.select(*on).distinct(), on, "left_anti")


def longest_gaps(absent: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Longest run of consecutive numbers in ``index`` for each key: the difference from the row number names a run."""
    w = W.partitionBy(*keys).orderBy(index)
    runs = absent.withColumn("_run", F.col(index) - F.row_number().over(w)).groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest_gap"))


def coverage(expected: DataFrame, observed: DataFrame, by: str, on: list[str]) -> DataFrame:
    """For each ``by``: how many rows were expected, seen and missing, and the share seen."""
    seen = observed.select(*on).distinct().withColumn("_seen", F.lit(1))
    out = expected.join(seen, on, "left").groupBy(by).agg(F.count(F.lit(1)).alias("n_expected"), F.count("_seen").alias("n_observed"))
    return out.withColumn("n_missing", F.col("n_expected") - F.col("n_observed")).withColumn("ratio", F.col("n_observed") / F.col("n_expected"))


def accepted(total: DataFrame, ratio: float = 0.995, per_session: int = 15, consecutive: int = 5):
    """Whether coverage passes the limits: least share, most missing in a session, longest gap."""
    return (F.col("ratio") >= ratio) & (F.col("worst_missing") <= per_session) & (F.col("longest_gap") <= consecutive)


def inspect(bars: DataFrame, session_of, start, end) -> DataFrame:
    """One row of counts and a status for a batch (columns opens_at, bar_id, revision, arrival): REJECTED before DEGRADED before PASS."""
    by_arrival = W.partitionBy("series").orderBy("arrival")
    by_bar = W.partitionBy("series", "opens_at").orderBy("arrival")
    rows = bars.select(
        "*", F.lag("opens_at").over(by_arrival).alias("_before"), F.lag("revision").over(by_bar).alias("_revision"),
    )
    first_seen = F.col("_revision").isNull()
    total = rows.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_bars"), (F.count(F.lit(1)) - F.count_distinct("bar_id")).alias("n_duplicate_ids"),
        F.count_if(first_seen & (F.col("opens_at") < F.col("_before"))).alias("n_out_of_order"), F.count_if((F.col("opens_at") < start) | (F.col("opens_at") >= end)).alias("n_out_of_request"),
        F.count_if(F.second("opens_at") != 0).alias("n_misaligned"), F.count_if(~session_of).alias("n_out_of_session"),
        F.count_if(F.col("_revision") >= F.col("revision")).alias("n_invalid_corrections"),
    )
    rejected = (F.col("n_duplicate_ids") + F.col("n_out_of_request") + F.col("n_misaligned") + F.col("n_out_of_session") + F.col("n_invalid_corrections")) > 0
    return total.withColumn("status", F.when(rejected, F.lit("REJECTED")).when(F.col("n_out_of_order") > 0, F.lit("DEGRADED")).otherwise(F.lit("PASS")))
