"""Validation metrics over prompts: means, and bootstrapped best, worst and majority of n.

A prompt's samples are one array. Which of them each draw takes depends on the
draw, the place in it and the number of samples, so the places of all draws are
one matrix for all prompts of a size, and a batch of prompts is indexed with it
at once; nothing of a draw leaves the task but its part in two moments.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.groupstats import RO, rollouts
from weftline.plans.registry import query

DRAWS, SEED = 1000, 42
#: Values of a matrix of draws that are held at a time.
HELD = 1 << 18
KINDS = ("best", "worst", "maj")


def sizes_of(n: int) -> list[int]:
    """2, 4, 8, ... below ``n``, and ``n``; none for a single sample."""
    out = [1 << i for i in range(1, n.bit_length()) if 1 << i < n]
    return [*out, n] if n > 1 else []


@cache
def places(n: int, size: int, draws: int, seed: int) -> np.ndarray:
    """Places below ``n`` for each of ``draws`` draws of ``size`` with replacement: a multiplicative hash in whole numbers, the same in any engine."""
    b, j = np.arange(draws, dtype=np.uint64)[:, None], np.arange(size, dtype=np.uint64)[None, :]
    mixed = (b * np.uint64(7919) + j * np.uint64(104729) + np.uint64(seed * 15485863)) * np.uint64(2654435761) % np.uint64(1 << 32)
    return (mixed // np.uint64(65536) % np.uint64(n)).astype(np.int64)


def replicated(values: np.ndarray, votes: np.ndarray, size: int, draws: int = DRAWS, seed: int = SEED) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each row of ``values`` the mean and deviation over the draws of the best, the worst and the majority's value. Missing values (nan) are no best or worst; the majority's is the first drawn of the commonest vote, of equally common ones of that which comes first."""
    at = np.ascontiguousarray(places(values.shape[1], size, draws, seed).T)  # draws last, so that every step below runs along them
    first = (votes[:, :, None] == votes[:, None, :]).argmax(axis=2)
    own = first == np.arange(votes.shape[1])
    codes = np.take_along_axis(own.cumsum(axis=1) - 1, first, axis=1).astype(np.int16)  # a prompt's votes from 0
    out = {k: (np.empty(len(values)), np.empty(len(values))) for k in KINDS}
    step = max(1, HELD // (draws * size))
    for a in range(0, len(values), step):
        rows = slice(a, a + step)
        v, p = values[rows][:, at], codes[rows][:, at]
        count = np.stack([(p == c).sum(axis=1, dtype=np.int16) for c in range(int(p.max()) + 1)], axis=1)
        most, maj = count.max(axis=1), v[:, -1]
        for j in range(size - 2, -1, -1):
            maj = np.where(np.take_along_axis(count, p[:, j : j + 1], axis=1)[:, 0] == most, v[:, j], maj)
        for k, x in (("best", np.fmax.reduce(v, axis=1)), ("worst", np.fmin.reduce(v, axis=1)), ("maj", maj)):
            out[k][0][rows], out[k][1][rows] = x.mean(axis=1), x.std(axis=1)
    return out


def bootstrap(values: Column, votes: Column, sizes: tuple[int, ...] | None = None, draws: int = DRAWS, seed: int = SEED) -> Column:
    """array<struct<kind, size, mean, std>> of a prompt's samples: ``values`` (array<double>) with their ``votes`` (array<string>), for ``sizes`` or those of sizes_of()."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("size", pa.int32()), ("mean", pa.float64()), ("std", pa.float64())]))

    def of(vals: pa.Array, preds: pa.Array) -> pa.Array:
        n = vals.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        out: list[list[dict]] = [[] for _ in n]
        for m in np.unique(n[n > 0]).tolist():
            rows = np.flatnonzero(n == m)
            take = pa.array(rows)
            v = vals.take(take).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, m)
            p = preds.take(take).flatten().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).reshape(-1, m)
            for size in sizes or sizes_of(m):
                for k, (mean, std) in replicated(v, p, size, draws, seed).items():
                    for r, a, b in zip(rows.tolist(), mean.tolist(), std.tolist(), strict=True):
                        out[r].append({"kind": k, "size": size, "mean": a, "std": b})
        return pa.array(out, kind)

    return F.arrow_udf(of, "array<struct<kind: string, size: int, mean: double, std: double>>")(values, votes)


def prompts(samples: DataFrame, source: str, prompt: str, order: str, value: str, vote: str) -> DataFrame:
    """(source, prompt, n, mean, std, vals, preds): a row for each prompt, its samples in order."""
    s = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("val"), F.col(vote).cast("string").alias("pred"))))
    g = samples.groupBy(source, prompt).agg(s.alias("s"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").cast("int").alias("n"))
    return g.select(source, prompt, "n", "mean", "std", F.transform("s", lambda x: x["val"]).alias("vals"), F.transform("s", lambda x: x["pred"]).alias("preds"))


def validation(samples: DataFrame, source: str, prompt: str, order: str, value: str, vote: str, draws: int = DRAWS) -> DataFrame:
    """(source, metric, value): of each source the means over its prompts of mean@N and std@N and of best@n, worst@n and maj@n for n = 2, 4, ..., N, mean and deviation. A metric counts for the prompts that have it."""
    g = prompts(samples, source, prompt, order, value, vote)
    own = F.array(F.struct(F.concat(F.lit("mean@"), F.col("n")).alias("metric"), F.col("mean").alias("x")), F.struct(F.concat(F.lit("std@"), F.col("n")).alias("metric"), F.when(F.col("n") > 1, F.col("std")).alias("x")))
    boot = F.flatten(F.transform(bootstrap(F.col("vals"), F.col("preds"), draws=draws), lambda b: F.array(*(F.struct(F.concat(b["kind"], F.lit("@"), b["size"], F.lit(f"/{m}")).alias("metric"), b[m].alias("x")) for m in ("mean", "std")))))
    rows = g.select(source, F.explode(F.concat(own, boot)).alias("m")).where("m.x IS NOT NULL AND NOT isnan(m.x)")
    return rows.groupBy(source, F.col("m.metric").alias("metric")).agg(F.avg("m.x").alias("value"))


def _drawn(sizes: str) -> str:
    """SQL: r (samples with place ``at`` and ``n``), then what each prompt, size and draw gives."""
    return f"""r AS (SELECT event_type, user_id, value, k % 3 AS pred, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS at, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM {RO}),
    z AS (SELECT n, unnest({sizes}) AS m FROM (SELECT DISTINCT n FROM r)),
    d AS (SELECT n, m, b, j, (((b * 7919 + j * 104729 + {SEED} * 15485863) * 2654435761 % 4294967296) // 65536) % n AS at FROM z, range({DRAWS}) tb(b), range(64) tj(j) WHERE j < m),
    v AS (SELECT r.event_type, r.user_id, m, b, pred, count(*) AS c, min(j) AS j, arg_min(value, j) AS v, max(value) AS hi, min(value) AS lo FROM d JOIN r ON r.n = d.n AND r.at = d.at GROUP BY ALL),
    w AS (SELECT event_type, user_id, m, b, max(hi) AS best, min(lo) AS worst, arg_max(v, c * 1000 - j) AS maj FROM v GROUP BY ALL),
    p AS (SELECT event_type, user_id, m, {", ".join(f"avg({k}) AS {k}_mean, stddev_pop({k}) AS {k}_std" for k in KINDS)} FROM w GROUP BY ALL),
    o AS (SELECT event_type, user_id, n, avg(value) AS mean, CASE WHEN count(*) > 1 THEN stddev_pop(value) END AS std FROM r GROUP BY ALL)"""


_BOOTED = [f"{k}_{m}" for k in KINDS for m in ("mean", "std")]


@query(
    "bootstrap_metrics",
    f"""WITH {_drawn("[2, 4]")}, a AS (SELECT event_type, avg(mean) AS mean, avg(std) AS std FROM o GROUP BY event_type)
    SELECT event_type, round(any_value(mean), 5) AS mean, round(any_value(std), 5) AS std, {", ".join(f"round(avg({c}) FILTER (WHERE m = {n}), 2) AS {c}_{n}" for n in (2, 4) for c in _BOOTED)} FROM a JOIN p USING (event_type) GROUP BY event_type""",
)
def bootstrap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source the mean over its prompts of: mean and deviation, and the best, worst and majority of 2 and of 4 over 1,000 draws."""
    r = rollouts(spark, sf_dir).select("event_type", "user_id", "event_id", "value", (F.col("k") % 3).alias("pred"))
    g = prompts(r, "event_type", "user_id", "event_id", "value", "pred")
    g = g.select("event_type", "mean", F.when(F.col("n") > 1, F.col("std")).alias("std"), bootstrap(F.col("vals"), F.col("preds"), (2, 4)).alias("b"))
    of = lambda c, n: F.avg(F.filter("b", lambda x: (x["kind"] == c.split("_")[0]) & (x["size"] == n))[0][c.split("_")[1]])
    return g.groupBy("event_type").agg(F.round(F.avg("mean"), 5).alias("mean"), F.round(F.avg("std"), 5).alias("std"), *(F.round(of(c, n), 2).alias(f"{c}_{n}") for n in (2, 4) for c in _BOOTED))


@query(
    "validation_metrics",
    f"""WITH {_drawn("CASE WHEN n > 1 THEN list_filter([2, 4, 8, 16, 32], lambda s: s < n) || [n] ELSE [] END")}
    SELECT event_type, metric, round(avg(x) + 1e-9, 5) AS value FROM (SELECT event_type, 'mean@' || n AS metric, mean AS x FROM o UNION ALL SELECT event_type, 'std@' || n, std FROM o WHERE n > 1
    {" ".join(f"UNION ALL SELECT event_type, '{k}@' || m || '/{s}', {k}_{s} FROM p" for k in KINDS for s in ("mean", "std"))}) GROUP BY ALL""",
)
def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of all sources, for every size up to a prompt's number of samples, over 1,000 draws."""
    r = rollouts(spark, sf_dir).select("event_type", "user_id", "event_id", "value", (F.col("k") % 3).alias("pred"))
    # a millionth of a unit makes halves round alike in any engine
    return validation(r, "event_type", "user_id", "event_id", "value", "pred").withColumn("value", F.round(F.col("value") + 1e-9, 5))
