"""A sink of JSON lines that has each batch once, however often it is written.

    path/data/<batch>-<attempt>/   the lines of an attempt
    path/commits/<batch>           names the attempt that counts

An attempt's lines are written first; its commit is one small file that can be
created once. A batch that is tried again after a failure, before or after its
commit, finds the commit or leaves lines that nobody reads. Rows of a batch are
written as they are, in parallel, and no batch waits for another.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from weftline.sources.files import create_once, exists, names, remove


def commit_batch(df: DataFrame, path: str, batch: int) -> bool:
    """Append the rows of a batch; False, and nothing is added, if the batch is there."""
    spark = df.sparkSession
    if exists(spark, f"{path}/commits/{batch}"):
        return False
    attempt = f"{batch}-{uuid.uuid4().hex[:8]}"
    df.write.json(f"{path}/data/{attempt}")
    if create_once(spark, f"{path}/commits/{batch}", attempt):
        return True
    remove(spark, f"{path}/data/{attempt}")  # another writer was first
    return False


def committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all committed batches."""
    done = [r["value"] for r in spark.read.text(f"{path}/commits").collect()] if names(spark, f"{path}/commits") else []
    kept = [f"{path}/data/{a}" for a in done]
    return spark.read.schema(schema).json(kept) if kept else spark.createDataFrame([], schema)


def uncommitted(spark: SparkSession, path: str) -> list[str]:
    """Attempts that no commit names: what failures left behind."""
    done = {r["value"] for r in spark.read.text(f"{path}/commits").collect()} if names(spark, f"{path}/commits") else set()
    return sorted(set(names(spark, f"{path}/data")) - done)


def lines_once(stream: DataFrame, path: str, checkpoint: str, write=commit_batch) -> StreamingQuery:
    """Write what a stream has now to the sink, batch by batch."""
    return stream.writeStream.foreachBatch(lambda df, batch: write(df, path, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
