"""Rollout streams: windowed statistics, bounded queues with counters, and running moments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Events from files as they arrive; their time, without a zone, is read as the session's."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean of each type in tumbling windows; state older than the watermark goes."""
    return (
        stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
    )


def bounded_queue(stream: DataFrame, capacity: int, required: int) -> DataFrame:
    """A first-in first-out queue for each type: rows over ``capacity`` push out the oldest, every ``required`` rows are consumed together.

    Emits (event_type, produced, consumed, dropped, waiting) after each batch of rows of a type; the counters are running totals.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        produced, consumed, dropped, waiting = state.get if state.exists else (0, 0, 0, [])
        waiting = list(waiting)
        # a batch may come in several parts; first in, first out holds over all of them
        for i in sorted(int(x) for part in parts for x in part["event_id"]):
            waiting.append(i)
            produced += 1
            if len(waiting) > capacity:
                waiting.pop(0)
                dropped += 1
            if len(waiting) >= required:
                consumed += required
                waiting = waiting[required:]
        state.update((produced, consumed, dropped, waiting))
        yield pd.DataFrame({"event_type": [key[0]], "produced": [produced], "consumed": [consumed], "dropped": [dropped], "waiting": [len(waiting)]})

    return stream.groupBy("event_type").applyInPandasWithState(
        step, "event_type string, produced bigint, consumed bigint, dropped bigint, waiting bigint",
        "produced bigint, consumed bigint, dropped bigint, waiting array<bigint>", "update", GroupStateTimeout.NoTimeout,
    )


def running_moments(stream: DataFrame) -> DataFrame:
    """Count, mean and sample deviation of each type so far, as mergeable partial states."""
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))


def staleness(stream: DataFrame, version_size: int) -> DataFrame:
    """(event_type, version, stale, resets) after each batch of rows: how many rows of a type came since its version last changed. A row's version is its event_id over ``version_size``; the counter starts anew when it grows."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, stale, resets = state.get if state.exists else (-1, 0, 0)
        for i in sorted(int(x) for part in parts for x in part["event_id"]):
            if i // version_size > version:
                version, resets, stale = i // version_size, resets + 1, 0
            stale += 1
        state.update((version, stale, resets))
        yield pd.DataFrame({"event_type": [key[0]], "version": [version], "stale": [stale], "resets": [resets]})

    return stream.groupBy("event_type").applyInPandasWithState(
        step, "event_type string, version bigint, stale bigint, resets bigint", "version bigint, stale bigint, resets bigint", "update", GroupStateTimeout.NoTimeout,
    )


def drained(stream: DataFrame, name: str) -> DataFrame:
    """The last update of each type of a stream over what there is now: a few rows, in memory."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
