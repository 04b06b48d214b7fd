"""Queries that run as streams over what is there, and end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import pipelines as S
from ..sources.scratch import scratch
from .registry import query, table


def _ticks(spark, d):
    """The events file as a stream; event times need a zone for watermarks."""
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS opens_at, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n_ticks FROM events GROUP BY 1, 2""")
def stream_candles_1h(spark, d):
    """Developing bars at the end of the stream equal the batch's."""
    out = S.completed(S.windowed_candles(_ticks(spark, d), ["event_type"], "ts", "value", "event_id", "1 hour"), scratch(spark, "stream"), "complete")
    return out.select("event_type", F.col("opens_at").cast("timestamp_ntz").alias("opens_at"), "open", "high", "low", "close", "n_ticks")


@query("SELECT event_id, event_type, value FROM events")
def stream_dedup(spark, d):
    """Every event arrives twice and stays once."""
    rows = _ticks(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return S.completed(S.deduplicated(rows, ["event_id"], "ts", "1 hour").select("event_id", "event_type", "value"), scratch(spark, "stream"))


@query("""WITH e AS (SELECT *, CAST(props->>'k' AS BIGINT) AS seq FROM events), m AS (SELECT *, max(seq) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e)
    SELECT user_id, event_id, CASE WHEN last IS NULL THEN 'OK' WHEN seq < last THEN 'OUT_OF_ORDER' WHEN seq > last + 1 THEN 'GAP' ELSE 'OK' END AS mark FROM m""")
def stream_sequence(spark, d):
    rows = _ticks(spark, d).select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("seq"))
    return S.completed(S.sequence_marks(rows, ["user_id"], "seq", "event_id", "ts"), scratch(spark, "stream"))
