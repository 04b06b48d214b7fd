"""Queries of model diagnostics: collapse, regimes, joined models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from .registry import query, rounded, table

#: Two binary models of an event, some of whose numbers lie outside of 0..1, the event's own class, and an alignment of trends.
_A, _U = "(event_id * 7 % 23 - 1) / cast(20 as double)", "(event_id * 11 % 19 - 1) / cast(17 as double)"
_ACTUAL = "case when event_id % 3 = 0 then 'UP' when event_id % 5 = 0 then 'DOWN' else 'NEITHER' end"
_ALIGN = "(event_id % 4 - 2) / cast(3 as double)"
_COLUMNS = ["p_down", "p_neither", "p_up"]


def _rows(spark, d):
    rows = table(spark, d, "events").select("event_type", F.expr(_A).alias("a"), F.expr(_U).alias("u"), F.expr(_ACTUAL).alias("actual"), F.expr(_ALIGN).alias("alignment"))
    return rows.withColumns({f"p_{n.lower()}": c for n, c in D.joined(F.col("a"), F.col("u")).items()})


_SQL = f"""WITH i AS (SELECT event_type, greatest(0, least(1, {_A})) AS a, greatest(0, least(1, {_U})) AS u, {_ACTUAL} AS actual, {_ALIGN} AS al FROM events), p AS (SELECT event_type, actual, a * (1 - u) AS dn, 1 - a AS ne, a * u AS up, CASE WHEN al <= -0.66::DOUBLE THEN 'BEAR_ALIGNED' WHEN al >= 0.66::DOUBLE THEN 'BULL_ALIGNED' ELSE 'MIXED' END AS regime FROM i),
    q AS (SELECT *, CASE WHEN dn >= ne AND dn >= up THEN 'DOWN' WHEN ne >= up THEN 'NEITHER' ELSE 'UP' END AS pred FROM p)"""
_MEASURES = """count(*) AS n, round(avg((pred = actual)::INT), 9) AS accuracy, round(avg(pow(dn - (actual = 'DOWN')::INT, 2) + pow(ne - (actual = 'NEITHER')::INT, 2) + pow(up - (actual = 'UP')::INT, 2)), 9) AS brier,
    round(avg((pred = 'UP')::INT), 9) AS share_up, round(avg((pred = 'DOWN')::INT), 9) AS share_down, round(coalesce(avg((pred = 'UP')::INT) FILTER (actual = 'UP'), 0), 9) AS recall_up, round(coalesce(avg((pred = 'DOWN')::INT) FILTER (actual = 'DOWN'), 0), 9) AS recall_down"""
_CODES = """concat_ws('|', CASE WHEN share_up < 0.05 THEN 'UP_PREDICTION_SHARE_TOO_LOW' END, CASE WHEN share_down < 0.05 THEN 'DOWN_PREDICTION_SHARE_TOO_LOW' END, CASE WHEN recall_up < 0.1 THEN 'UP_RECALL_TOO_LOW' END, CASE WHEN recall_down < 0.1 THEN 'DOWN_RECALL_TOO_LOW' END)"""
_OUT = ["n", "accuracy", "brier", "share_up", "share_down", "recall_up", "recall_down"]


@query(f"{_SQL}, m AS (SELECT event_type, {_MEASURES} FROM q GROUP BY 1) SELECT *, {_CODES} AS blockers FROM m")
def collapse_diagnostics(spark, d):
    """Two joined models by event type: shares, recalls, and what speaks of a collapse."""
    out = D.collapse(_rows(spark, d), ["event_type"], _COLUMNS).select("event_type", *_OUT, F.concat_ws("|", "blockers").alias("blockers"))
    return rounded(out, _OUT[1:], 9)


@query(f"{_SQL}, m AS (SELECT regime, {_MEASURES} FROM q GROUP BY 1) SELECT regime, coalesce(n, 0) AS n, accuracy, brier, share_up, share_down, recall_up, recall_down, coalesce({_CODES}, '') AS blockers FROM (SELECT unnest(['BEAR_ALIGNED', 'MIXED', 'BULL_ALIGNED']) AS regime) LEFT JOIN m USING (regime)")
def regime_diagnostics(spark, d):
    """The same by regime of the trends' alignment; one of the three holds no event."""
    out = D.by_regime(_rows(spark, d), [], "alignment", _COLUMNS).select("regime", *_OUT, F.concat_ws("|", "blockers").alias("blockers"))
    return rounded(out, _OUT[1:], 9)
