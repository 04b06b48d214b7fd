"""Structured Streaming forms of ingestion, candles, and finalisation. Streams and batches share their expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ingest


def files(spark: SparkSession, path: str, schema, kind: str = "parquet", most_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).load(path)


def deduplicated(events: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """The first event of each key; state is dropped ``delay`` behind the newest event time, so repeats later than that pass again."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_candles(ticks: DataFrame, keys: list[str], time: str, price: str, tie: str, width: str, start: str = "0 seconds", delay: str | None = None) -> DataFrame:
    """Bars by tumbling windows: with a delay finished bars in append mode, else developing bars in update mode."""
    rows = ticks.withWatermark(time, delay) if delay else ticks
    at = F.struct(time, tie)
    out = rows.groupBy(*keys, F.window(time, width, startTime=start).alias("w")).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).alias("n_ticks"))
    return out.select(*keys, F.col("w.start").alias("opens_at"), F.col("w.end").alias("closes_at"), "open", "high", "low", "close", "n_ticks")


def sequence_marks(events: DataFrame, keys: list[str], sequence: str, identity: str, order: str) -> DataFrame:
    """OK, GAP or OUT_OF_ORDER for each event; the state is the last accepted sequence of a key.

    A key's rows of one micro-batch are sorted in memory; ``files`` bounds a micro-batch.
    """
    fields = {f.name: f.dataType.simpleString() for f in events.schema}
    output = ", ".join([f"{k} {fields[k]}" for k in keys] + [f"{identity} {fields[identity]}", "mark string"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        marks = []
        for s in rows[sequence].tolist():
            marks.append("OK" if last is None or last <= s <= last + 1 else "GAP" if s > last else "OUT_OF_ORDER")
            last = s if last is None else max(last, s)
        state.update((int(last),))
        yield pd.DataFrame({**dict(zip(keys, key)), identity: rows[identity], "mark": marks})

    return events.groupBy(*keys).applyInPandasWithState(step, output, "last long", "append", GroupStateTimeout.NoTimeout)


def data_status(age: Column, finalized_age: Column, open_: Column, provider: Column, recovering: Column) -> Column:
    """State of a live feed by the ages (seconds) of its newest tick and bar; fixed limits of 3, 15, 60 and 300 seconds."""
    return (
        F.when(~open_, F.lit("MARKET_CLOSED")).when(provider != "CONNECTED", provider).when(recovering, F.lit("RECOVERING")).when(age > 15, F.lit("STALE"))
        .when(age > 3, F.lit("DELAYED")).when(finalized_age > 300, F.lit("STALE")).when(finalized_age > 60, F.lit("DELAYED")).otherwise(F.lit("LIVE"))
    )


def routed(events: DataFrame, instruments: DataFrame, stored: str, quarantined: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: normalises, validates and appends each batch to two tables, duplicates of the batch left out."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = ingest.route(ingest.identity(ingest.normalize(batch, instruments))).withColumn("batch_id", F.lit(batch_id))
        rows.where("status = 'STORED'").write.mode("append").parquet(stored)
        rows.where("status = 'QUARANTINED'").write.mode("append").parquet(quarantined)

    return write


def completed(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns its rows, written to ``path``: a folder a batch, or in complete mode the last batch alone.

    A batch that is run again overwrites its own folder, so nothing counts twice.
    """

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{'whole' if mode == 'complete' else k}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")
