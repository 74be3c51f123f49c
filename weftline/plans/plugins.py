"""Named plug-ins: losses, reward managers, judges, samplers, and functions that are run on parts of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.files import exists, names, remove, shared_path


class Registry(dict):
    """Functions by name. A second, different one under a name is an error, as is a name that isn't there."""

    def __init__(self, kind: str) -> None:
        super().__init__()
        self.kind = kind

    def register(self, name: str):
        def keep(f):
            if self.get(name, f) is not f:
                raise ValueError(f"{self.kind} {name} is taken")
            self[name] = f
            return f

        return keep

    def __missing__(self, name: str):
        raise KeyError(f"no {self.kind} {name}; there are {sorted(self)}")


LOSSES, REWARDS, JUDGES = Registry("loss"), Registry("reward manager"), Registry("judge")


@LOSSES.register("clipped")
def clipped_loss(log_ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """The clipped policy loss, bounded by ``dual`` times the advantage where that is negative."""
    ratio = F.exp(F.least(F.greatest(log_ratio, F.lit(-20.0)), F.lit(20.0)))
    first = F.greatest(-advantage * ratio, -advantage * F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high)))
    return F.when(advantage < 0, F.least(first, -advantage * dual)).otherwise(first)


@LOSSES.register("vanilla")
def vanilla_loss(log_prob: Column, advantage: Column) -> Column:
    return -advantage * log_prob


@REWARDS.register("additive")
def additive_reward(score: Column, length: Column, expected: int, buffer: int, factor: float = 1.0) -> Column:
    """A score less the penalty for what is over the expected length."""
    from weftline.functions.text import overlong_penalty

    return score + overlong_penalty(length, expected, buffer, factor)


@REWARDS.register("multiplicative")
def multiplicative_reward(score: Column, length: Column, expected: int, buffer: int, factor: float = 1.0) -> Column:
    """A score times one less the penalty, not below zero."""
    from weftline.functions.text import overlong_penalty

    return score * F.greatest(1.0 + overlong_penalty(length, expected, buffer, factor), F.lit(0.0))


@JUDGES.register("longer")
def longer(prompts: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
    """The index of the longer completion."""
    return (second.str.len() > first.str.len()).astype(int)


def judged(pairs: DataFrame, judge: str, prompt: str = "prompt", first: str = "first", second: str = "second") -> DataFrame:
    """``pairs`` with ``winner``: 0 or 1 as a named judge says of a batch of pairs, -1 where it fails or something is missing."""
    f = JUDGES[judge]

    def of(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(-1, index=p.index)
        whole = p.notna() & a.notna() & b.notna()
        try:
            found = f(p[whole], a[whole], b[whole])
        except Exception:  # noqa: BLE001  a judge that fails has no opinion
            return out
        out[whole] = found.where(found.isin([0, 1]), -1)
        return out

    return pairs.withColumn("winner", F.pandas_udf(of, "int")(prompt, first, second))


def dispatched(split: str | None = None, schema: str | None = None):
    """Mark a function of a pandas table as run on parts of a DataFrame: whole groups of ``split``, or any batches; results are put together as ``schema``, by default the input's."""

    def mark(f: Callable[[pd.DataFrame], pd.DataFrame]):
        def run(df: DataFrame) -> DataFrame:
            out = schema or df.schema
            if split is not None:
                return df.groupBy(split).applyInPandas(f, out)

            def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in parts:
                    yield f(part)

            return df.mapInPandas(each, out)

        run.__name__, run.split = f.__name__, split
        return run

    return mark


class CurriculumSampler:
    """Rows in an order that feedback changes: those whose group's last mean score is nearest to one half come first.

    Its state is a number for each group, a table under ``path`` in versions:
    an update merges into the last one and writes the next, so a plan reads one
    table however many updates there were, and a sampler at the same path goes
    on where another stopped. A version counts once it is complete; older ones
    but the last are deleted.
    """

    def __init__(self, group: str, spark: SparkSession, path: str | None = None) -> None:
        self.group, self.spark, self.path = group, spark, path or shared_path(spark)

    def version(self) -> int:
        """The last complete version, 0 if there is none."""
        return max((int(n.removeprefix("v")) for n in names(self.spark, self.path) if n.startswith("v") and exists(self.spark, f"{self.path}/{n}/_SUCCESS")), default=0)

    def state(self) -> DataFrame | None:
        last = self.version()
        return self.spark.read.parquet(f"{self.path}/v{last}") if last else None

    def update(self, scored: DataFrame, score: str = "score") -> None:
        last, old = self.version(), self.state()
        new = scored.groupBy(self.group).agg(F.avg(score).alias("mean"))
        if old is not None:
            was, group = F.col("was"), F.col("old_group")
            old = old.select(F.col(self.group).alias("old_group"), F.col("mean").alias("was"))
            new = new.join(old, F.col(self.group).eqNullSafe(group), "full").select(F.coalesce(self.group, group).alias(self.group), F.coalesce("mean", was).alias("mean"))
        new.write.mode("overwrite").parquet(f"{self.path}/v{last + 1}")
        remove(self.spark, f"{self.path}/v{last - 1}")

    def next_rows(self, rows: DataFrame, n: int, key: str) -> DataFrame:
        seen = self.state()
        d = rows.withColumn("mean", F.lit(0.5)) if seen is None else rows.join(seen, self.group, "left").na.fill(0.5, ["mean"])
        return d.orderBy(F.abs(F.col("mean") - 0.5), F.xxhash64(key), key).limit(n).drop("mean")
