"""Streams of events: deduplication, windows, sessions and a first-seen table.

An extension beyond batch parity. All state is bounded by watermarks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRAIL = "raw_id long, source_file string, received_at timestamp, body string"


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(events: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """The first event of every key within the watermark; late ones are dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, time: str, keys: list[str], size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """window_start, window_end, keys, n: tumbling or sliding counts."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counted = events.withWatermark(time, delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """session_start, session_end, key, n: runs of events without a longer gap."""
    grouped = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def first_seen(events: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """key, first_time, n: a row whenever a key's first time is set or moves earlier."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, n = state.get if state.exists else (None, 0)
        before = first
        for batch in batches:
            earliest = batch[time].min()
            at = int(earliest.value // 1000)
            first = at if first is None else min(first, at)
            n += len(batch)
        state.update((first, n))
        if first != before:
            yield pd.DataFrame({key: [keys[0]], "first_us": [first], "n": [n]})

    kind = dict(events.dtypes)[key]
    out = events.withWatermark(time, delay).select(key, time).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, first_us long, n long", "first_us long, n long", "update", GroupStateTimeout.NoTimeout)
    return out.select(key, F.timestamp_micros("first_us").alias("first_time"), "n")


def run_once(frame: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Everything that is there, through a memory table: for tests and one-off runs."""
    writer = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)
