"""Readers for the fixed tables of a data folder. Paths go to Spark's readers only, so any store that Spark can read will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of ``sf_dir``; a scan, so filters and columns are pushed down to it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
