"""Row generators: synthetic tasks with hash-derived randomness, so that every run and every partitioning gives the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.sources.tables import table


def uniform(seed: int, *parts: Column) -> Column:
    """A number from 0 up to 1 that depends on the seed and the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / float(2**53)


def integer(low: int, high: int, seed: int, *parts: Column) -> Column:
    """A whole number from ``low`` to ``high``, both included."""
    return (F.lit(low) + F.floor(uniform(seed, *parts) * (high - low + 1))).cast("int")


def resample(df: DataFrame, key: str, weight: str, seed: int) -> DataFrame:
    """Rows with their number of copies: the weight's share of all rows, the fraction by chance. The expectation is that of a draw with replacement."""
    total = df.agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    share = F.col(weight) / F.col("w") * F.col("n")
    counted = df.crossJoin(F.broadcast(total)).withColumn("copies", (F.floor(share) + (uniform(seed, F.col(key)) < share - F.floor(share)).cast("int")).cast("int"))
    return counted.select(key, "copies").where("copies > 0")


@query("resampled_rows")
def resampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 5)


@query("conversation_bootstrap")
def conversation_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over 200 resamples of each type's user means: a Monte Carlo check of the closed forms."""

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rng, x = np.random.default_rng(42), np.sort(part["m"].to_numpy())
        best = rng.choice(x, (200, 4)).max(axis=1)
        return pd.DataFrame({"event_type": part["event_type"].iloc[:1], "best_4": [best.mean()], "std": [best.std()]})

    means = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return means.groupBy("event_type").applyInPandas(draw, "event_type string, best_4 double, std double")


@query(
    "best_versus_other",
    """SELECT user_id, arg_max(event_id, value * 1e9 - event_id) AS chosen, (SELECT min(o.event_id) FROM events o WHERE o.user_id = e.user_id AND o.event_type <> (SELECT t.event_type FROM events t WHERE t.user_id = e.user_id ORDER BY t.value DESC, t.event_id LIMIT 1)) AS rejected
    FROM events e GROUP BY user_id HAVING count(DISTINCT event_type) > 1""",
)
def best_versus_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best event of each user and the first that differs in type from it."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    best = e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).where("rn = 1")
    other = e.alias("e").join(best.alias("b"), "user_id").where("e.event_type <> b.event_type").groupBy("user_id").agg(F.min("e.event_id").alias("rejected"))
    return best.join(other, "user_id").select("user_id", F.col("event_id").alias("chosen"), "rejected")
