"""Streaming operators over the events table as it stands: what they have counted at its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.sources.files import shared_path
from weftline.sources.tables import table
from weftline.streaming import once, queue

REQUIRED, VERSION = 8, 100


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.source(spark, f"{sf_dir}/events.parquet*")


@query(
    "queue_counters",
    f"SELECT event_type, count(*) AS produced, count(*) // {REQUIRED} * {REQUIRED} AS consumed, CAST(0 AS BIGINT) AS dropped, count(*) % {REQUIRED} AS waiting FROM events GROUP BY event_type",
)
def queue_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded queue for each type whose consumer takes eight rows at a time: produced, consumed, dropped and waiting."""
    rows = queue.drained(queue.bounded_queue(_events(spark, sf_dir), 100, REQUIRED), f"queue_{uuid.uuid4().hex[:8]}")
    last = rows.groupBy("event_type").agg(F.max_by(F.struct("produced", "consumed", "dropped", "waiting"), "produced").alias("r"))
    return last.select("event_type", "r.*")


@query(
    "overflowing_queue",
    "SELECT event_type, count(*) AS produced, greatest(count(*) - 5, 0) AS dropped, least(count(*), 5) AS waiting FROM events GROUP BY event_type",
)
def overflowing_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue of five whose consumer waits for more: the oldest rows are dropped."""
    rows = queue.drained(queue.bounded_queue(_events(spark, sf_dir), 5, 1_000_000_000), f"queue_{uuid.uuid4().hex[:8]}")
    last = rows.groupBy("event_type").agg(F.max_by(F.struct("produced", "dropped", "waiting"), "produced").alias("r"))
    return last.select("event_type", "r.*")


@query(
    "staleness_counters",
    f"SELECT event_type, max(event_id // {VERSION}) AS version, count(*) FILTER (WHERE event_id // {VERSION} = top) AS stale, count(DISTINCT event_id // {VERSION}) AS resets FROM (SELECT *, max(event_id // {VERSION}) OVER (PARTITION BY event_type) AS top FROM events) GROUP BY event_type",
)
def staleness_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows since a type's version last changed, and how often it has."""
    rows = queue.drained(queue.staleness(_events(spark, sf_dir), VERSION), f"stale_{uuid.uuid4().hex[:8]}")
    last = rows.groupBy("event_type").agg(F.max_by(F.struct("version", "stale", "resets"), F.struct("version", "stale")).alias("r"))
    return last.select("event_type", "r.*")


@query("committed_lines", "SELECT event_id, event_type FROM events")
def committed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, a batch at a time, each written once: the first batch comes a second time, as after a failure, and adds nothing."""
    path, columns = shared_path(spark), ["event_id", "event_type"]
    once.lines_once(_events(spark, sf_dir).select(*columns), path, f"{path}-checkpoint").awaitTermination()
    once.commit_batch(table(spark, sf_dir, "events").select(*columns), path, 0)
    return once.committed(spark, path, "event_id bigint, event_type string")
