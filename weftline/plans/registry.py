"""All queries of the engine proper, by name, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its oracle over the same tables."""

    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register Spark SQL over tables named in braces; ``oracle`` is the same in the oracle's dialect where that differs."""
    import re

    from weftline.sources.tables import table

    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    run.__name__ = name
    query(name, re.sub(r"\{(\w+)\}", r"\1", text) if oracle is None else oracle)(run)
