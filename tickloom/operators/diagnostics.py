"""Whether a model of three classes has collapsed, how it does by regime, and two binary models joined to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clip, codes
from . import metrics

#: Least shares of predictions and least recalls of the directions.
COLLAPSE = {"up_share": 0.05, "down_share": 0.05, "up_recall": 0.10, "down_recall": 0.10}
#: Regimes by the alignment of trends, closed on the outside.
REGIMES = (("BEAR_ALIGNED", None, -0.66), ("MIXED", -0.66, 0.66), ("BULL_ALIGNED", 0.66, None))


def joined(actionable: Column, up_given: Column) -> dict[str, Column]:
    """Probabilities of DOWN, NEITHER and UP of a model of whether anything happens and one of the direction if it does; both are clipped to 0..1."""
    a, u = clip(actionable, 0.0, 1.0), clip(up_given, 0.0, 1.0)
    return {"DOWN": a * (1 - u), "NEITHER": 1 - a, "UP": a * u}


def collapse(rows: DataFrame, by: list[str], columns: list[str], actual: str = "actual", gate: dict[str, float] = COLLAPSE) -> DataFrame:
    """``metrics.class_metrics`` with how often each class is predicted, its share, blockers and collapsed.

    A class that does not occur has recall 0. Ties of probabilities go to the first class.
    """
    predicted = rows.withColumn("_p", metrics.argmax(columns))
    shares = predicted.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_p") == n).alias(f"n_{n.lower()}") for n in metrics.CLASSES])
    shares = shares.withColumns({f"share_{n.lower()}": F.col(f"n_{n.lower()}") / F.col("_n") for n in metrics.CLASSES}).drop("_n")
    out = metrics.class_metrics(rows, by, columns, actual)
    out = out.withColumns({f"recall_{n.lower()}": F.coalesce(f"recall_{n.lower()}", F.lit(0.0)) for n in metrics.CLASSES})
    out = out.join(shares, by) if by else out.crossJoin(shares)  # one row each
    found = codes(
        (F.col("share_up") < gate["up_share"], "UP_PREDICTION_SHARE_TOO_LOW"), (F.col("share_down") < gate["down_share"], "DOWN_PREDICTION_SHARE_TOO_LOW"),
        (F.col("recall_up") < gate["up_recall"], "UP_RECALL_TOO_LOW"), (F.col("recall_down") < gate["down_recall"], "DOWN_RECALL_TOO_LOW"),
    )
    return out.withColumn("blockers", found).withColumn("collapsed", F.size("blockers") > 0)


def regime(alignment: Column) -> Column:
    """The regime of an alignment of trends; null where that is."""
    out = F.when(alignment.isNotNull(), F.lit("MIXED"))
    (bear, _, low), _, (bull, high, _) = REGIMES
    return F.when(alignment <= low, F.lit(bear)).when(alignment >= high, F.lit(bull)).otherwise(out)


def by_regime(rows: DataFrame, by: list[str], alignment: str, columns: list[str], actual: str = "actual") -> DataFrame:
    """``collapse`` for each regime; regimes without a row are there with n 0."""
    found = collapse(rows.withColumn("regime", regime(F.col(alignment))).where("regime is not null"), [*by, "regime"], columns, actual)
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    every = groups.withColumn("regime", F.explode(F.array(*[F.lit(n) for n, _, _ in REGIMES])))
    return every.join(found, [*by, "regime"], "left").fillna(0, ["n"])
