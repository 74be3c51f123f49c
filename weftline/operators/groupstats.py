"""Group-relative statistics of rollouts, as window expressions.

A group is (user_id, event_type) of ``events``, its score ``value``; a rollout's
length is the number of words that its payload k stands for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.sources.tables import table

EPS = 1e-6
GROUP = ["user_id", "event_type"]
ESTIMATORS: dict[str, Callable[..., Column]] = {}


def estimator(name: str):
    """Register an advantage estimator; a second, different function under a name is an error."""

    def keep(f):
        if ESTIMATORS.get(name, f) is not f:
            raise ValueError(f"estimator {name} is taken")
        ESTIMATORS[name] = f
        return f

    return keep


@estimator("group_norm")
def group_norm(score: Column, group: list[str], scale_by_std: bool = True, eps: float = EPS) -> Column:
    """Score less the mean of its group, over the sample deviation; a group of one keeps its score."""
    w = Window.partitionBy(*group)
    n, mean, std = F.count(score).over(w), F.avg(score).over(w), F.stddev_samp(score).over(w)
    mean = F.when(n == 1, F.lit(0.0)).otherwise(mean)
    std = F.when(n == 1, F.lit(1.0)).otherwise(std)
    return (score - mean) / (std + eps) if scale_by_std else score - mean


@estimator("group_norm_floor")
def group_norm_floor(score: Column, group: list[str], eps: float = EPS) -> Column:
    """As group_norm, with the variance held above ``eps``."""
    w = Window.partitionBy(*group)
    n, mean, var = F.count(score).over(w), F.avg(score).over(w), F.var_samp(score).over(w)
    return F.when(n == 1, score / (1 + eps)).otherwise((score - mean) / (F.sqrt(F.greatest(var, F.lit(eps))) + eps))


@estimator("best_minus_second")
def best_minus_second(score: Column, group: list[str], order: Column, eps: float = EPS) -> Column:
    """The best score's lead over the second, over the deviation, for the best row (the first of equal ones); 0 for the others."""
    w = Window.partitionBy(*group)
    ranked = w.orderBy(score.desc(), order)
    lead = score - F.lead(score).over(ranked)
    return F.when(F.row_number().over(ranked) == 1, lead / (F.stddev_samp(score).over(w) + eps)).otherwise(F.lit(0.0))


@estimator("leave_one_out")
def leave_one_out(score: Column, group: list[str], singleton: str = "raw") -> Column:
    """n/(n-1) of the score less the group's mean; a group of one keeps its score or, by ``singleton``, gets zero."""
    w = Window.partitionBy(*group)
    n = F.count(score).over(w)
    alone = score if singleton == "raw" else F.lit(0.0)
    return F.when(n > 1, n / F.greatest(n - 1, F.lit(1)) * (score - F.avg(score).over(w))).otherwise(alone)


@estimator("length_weighted")
def length_weighted(score: Column, group: list[str], length: Column) -> Column:
    """Score less the group's mean weighted by length; a group of one has no baseline."""
    w = Window.partitionBy(*group)
    base = F.sum(length * score).over(w) / F.sum(length).over(w)
    return F.when(F.count(score).over(w) > 1, score - base).otherwise(score)


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


RO = "(SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
OVER = "WINDOW w AS (PARTITION BY user_id, event_type)"


@query(
    "adv_group_norm",
    """SELECT event_id, round(CASE WHEN n = 1 THEN value / (1 + 1e-6) ELSE (value - m) / (s + 1e-6) END, 6) AS advantage
    FROM (SELECT event_id, value, count(*) OVER w n, avg(value) OVER w m, stddev_samp(value) OVER w s
    FROM events WINDOW w AS (PARTITION BY user_id, event_type))""",
)
def adv_group_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(group_norm(F.col("value"), GROUP), 6).alias("advantage"))


@query(
    "adv_group_centred",
    f"SELECT event_id, round(CASE WHEN count(*) OVER w = 1 THEN value ELSE value - avg(value) OVER w END, 6) AS advantage FROM {RO} {OVER}",
)
def adv_group_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select("event_id", F.round(group_norm(F.col("value"), GROUP, scale_by_std=False), 6).alias("advantage"))


@query(
    "adv_group_norm_floor",
    f"""SELECT event_id, round(CASE WHEN count(*) OVER w = 1 THEN value / (1 + 1e-6)
    ELSE (value - avg(value) OVER w) / (sqrt(greatest(var_samp(value) OVER w, 1e-6)) + 1e-6) END, 6) AS advantage FROM {RO} {OVER}""",
)
def adv_group_norm_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select("event_id", F.round(group_norm_floor(F.col("value"), GROUP), 6).alias("advantage"))


@query(
    "group_moments",
    f"""SELECT user_id, event_type, count(*) AS n, round(CASE WHEN count(*) = 1 THEN 0 ELSE avg(value) END, 6) AS mean,
    round(CASE WHEN count(*) = 1 THEN 1 ELSE stddev_samp(value) END, 6) AS std FROM {RO} GROUP BY user_id, event_type""",
)
def group_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return rollouts(spark, sf_dir).groupBy("user_id", "event_type").agg(
        n.alias("n"), F.round(F.when(n == 1, F.lit(0.0)).otherwise(F.avg("value")), 6).alias("mean"), F.round(F.when(n == 1, F.lit(1.0)).otherwise(F.stddev_samp("value")), 6).alias("std")
    )


@query(
    "factorise_labels",
    "SELECT event_id, code FROM events JOIN (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)",
)
def factorise_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes 0.. by sorted label: ranked over the distinct labels, not over the rows."""
    e = table(spark, sf_dir, "events")
    codes = e.select("event_type").distinct().withColumn("code", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long"))
    return e.join(codes, "event_type").select("event_id", "code")


@query(
    "adv_best_minus_second",
    f"""SELECT event_id, round(CASE WHEN rn = 1 THEN (value - nxt) / (s + 1e-6) ELSE 0 END, 6) AS advantage FROM (
    SELECT event_id, value, row_number() OVER o rn, lead(value) OVER o nxt, stddev_samp(value) OVER w s, count(*) OVER w n FROM {RO}
    {OVER}, o AS (PARTITION BY user_id, event_type ORDER BY value DESC, event_id)) WHERE n > 1""",
)
def adv_best_minus_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rollouts(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy(*GROUP)))
    r = r.withColumn("advantage", F.round(best_minus_second(F.col("value"), GROUP, F.col("event_id")), 6))
    return r.where("n > 1").select("event_id", "advantage")


@query(
    "adv_leave_one_out",
    f"""SELECT event_id, round(CASE WHEN n > 1 THEN n * 1.0 / (n - 1) * (value - m) ELSE value END, 6) AS raw_singleton,
    round(CASE WHEN n > 1 THEN n * 1.0 / (n - 1) * (value - m) ELSE 0 END, 6) AS zero_singleton
    FROM (SELECT event_id, value, count(*) OVER w n, avg(value) OVER w m FROM {RO} {OVER})""",
)
def adv_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return rollouts(spark, sf_dir).select(
        "event_id", F.round(leave_one_out(v, GROUP), 6).alias("raw_singleton"), F.round(leave_one_out(v, GROUP, "zero"), 6).alias("zero_singleton")
    )


@query(
    "adv_length_weighted",
    f"""SELECT event_id, round(CASE WHEN count(*) OVER w > 1 THEN value - sum((k + 1) * value) OVER w / sum(k + 1) OVER w ELSE value END, 6) AS advantage FROM {RO} {OVER}""",
)
def adv_length_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select("event_id", F.round(length_weighted(F.col("value"), GROUP, F.col("k") + 1), 6).alias("advantage"))


@query(
    "adv_scaled_centred",
    f"""SELECT event_id, round((SELECT count(*) / greatest(sum(CASE WHEN k <> 0 THEN 1 ELSE 0 END), 1) FROM {RO}) * (value - avg(value) OVER w) / 2.0, 6) AS advantage FROM {RO} {OVER}""",
)
def adv_scaled_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alpha is rows over rows with a payload; the one-row aggregate is broadcast."""
    r = rollouts(spark, sf_dir)
    alpha = r.agg((F.count("*") / F.greatest(F.sum((F.col("k") != 0).cast("int")), F.lit(1))).alias("alpha"))
    centred = F.col("value") - F.avg("value").over(Window.partitionBy(*GROUP))
    return r.crossJoin(F.broadcast(alpha)).select("event_id", F.round(F.col("alpha") * centred / 2.0, 6).alias("advantage"))


@query(
    "adv_centred_whitened",
    f"""SELECT event_id, round((c - avg(c) OVER ()) / sqrt(var_samp(c) OVER () + 1e-8), 6) AS advantage FROM
    (SELECT event_id, CASE WHEN count(*) OVER w = 1 THEN value ELSE value - avg(value) OVER w END c FROM {RO} {OVER})""",
)
def adv_centred_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-centred, then whitened over all rows; the moments are one aggregated row, never a window over everything."""
    c = rollouts(spark, sf_dir).select("event_id", group_norm(F.col("value"), GROUP, scale_by_std=False).alias("c"))
    m = c.agg(F.avg("c").alias("m"), F.var_samp("c").alias("v"))
    return c.crossJoin(F.broadcast(m)).select("event_id", F.round((F.col("c") - F.col("m")) / F.sqrt(F.col("v") + 1e-8), 6).alias("advantage"))


@query(
    "reverse_cumulative_return",
    f"""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS ret FROM {RO}""",
)
def reverse_cumulative_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rollouts(spark, sf_dir).select("event_id", F.round(F.sum("value").over(w), 6).alias("ret"))


def discounted_returns(rewards: Column, gamma: float, after: Column | None = None) -> Column:
    """R_t = r_t + gamma R_(t+1) over an array, last to first; ``after`` is the return that follows it, 0 by default. For arrays of a block's length."""
    start = F.struct(F.array().cast("array<double>").alias("out"), (F.lit(0.0) if after is None else after).alias("run"))

    def step(a: Column, r: Column) -> Column:
        x = r + gamma * a["run"]
        return F.struct(F.array_append(a["out"], x).alias("out"), x.alias("run"))

    return F.reverse(F.aggregate(F.reverse(rewards), start, step, lambda a: a["out"]))


#: Steps of a block of a trajectory.
BLOCK = 1024


def discounted(rows: DataFrame, group: list[str], order: str, value: str, gamma: float) -> DataFrame:
    """``rows`` (group, order, value) with ``ret``, the discounted sum of the value from a row to its trajectory's end.

    Trajectories are cut into blocks of BLOCK steps. A block's own sum comes
    from its array; what follows a block is folded from the sums of the blocks
    after it, BLOCK times fewer than steps. So no array is as long as a
    trajectory, and all is done where one shuffle by trajectory has put it.
    """
    w = Window.partitionBy(*group).orderBy(order)
    r = rows.select(*group, order, F.col(value).cast("double").alias("_v")).withColumn("_b", F.floor((F.row_number().over(w) - 1) / BLOCK).cast("int"))
    blocks = r.groupBy(*group, "_b").agg(F.array_sort(F.collect_list(F.struct(order, "_v"))).alias("_s"))
    blocks = blocks.withColumn("_own", F.get(discounted_returns(F.col("_s._v"), gamma), F.lit(0)))
    later = Window.partitionBy(*group).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_c", F.collect_list(F.struct("_own", F.size("_s").alias("_n"))).over(later))
    after = F.aggregate("_c", F.lit(0.0), lambda run, c: c["_own"] + F.pow(F.lit(gamma), c["_n"].cast("double")) * run)
    rets = blocks.select(*group, F.explode(F.arrays_zip(F.col(f"_s.{order}").alias("_o"), discounted_returns(F.col("_s._v"), gamma, after).alias("_r"))).alias("_z"))
    return rets.select(*group, F.col("_z._o").alias(order), F.col("_z._r").alias("ret"))


@query(
    "discounted_returns",
    f"""WITH RECURSIVE s AS (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM {RO}),
    r AS (SELECT user_id, event_id, rn, value AS ret FROM s WHERE rn = 1 UNION ALL
    SELECT s.user_id, s.event_id, s.rn, s.value + 0.875 * r.ret FROM s JOIN r ON s.user_id = r.user_id AND s.rn = r.rn + 1)
    SELECT event_id, round(ret, 6) AS ret FROM r""",
)
def discounted_returns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted returns over the steps of each user."""
    d = discounted(rollouts(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 0.875)
    return d.select("event_id", F.round("ret", 6).alias("ret"))


@query(
    "rolling_key_stats",
    f"""SELECT event_id, round(avg(value) OVER o, 6) AS mean, round(stddev_pop(value) OVER o, 6) AS std FROM {RO}
    WINDOW o AS (PARTITION BY event_type, user_id ORDER BY event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""",
)
def rolling_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event_type", "user_id").orderBy("event_id").rowsBetween(-15, 0)
    return rollouts(spark, sf_dir).select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"), F.round(F.stddev_pop("value").over(w), 6).alias("std"))


@query(
    "adv_weighted_rewards",
    f"""SELECT event_id, round((s - avg(s) OVER g) / (stddev_samp(s) OVER g + 1e-4), 5) AS advantage FROM
    (SELECT event_id, event_id // 8 AS grp, 0.7 * value + 0.3 * coalesce(nullif(k, 0), 0) AS s FROM {RO}) WINDOW g AS (PARTITION BY grp)""",
)
def adv_weighted_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted sum of reward columns, a missing one counting zero, standardised in groups of eight consecutive rows."""
    r = rollouts(spark, sf_dir).select("event_id", F.floor(F.col("event_id") / 8).alias("grp"), (F.col("value") * 0.7 + F.coalesce(F.nullif(F.col("k"), F.lit(0)), F.lit(0)) * 0.3).alias("s"))
    w = Window.partitionBy("grp")
    return r.select("event_id", F.round((F.col("s") - F.avg("s").over(w)) / (F.stddev_samp("s").over(w) + 1e-4), 5).alias("advantage"))


@query(
    "consecutive_runs",
    f"""SELECT user_id, min(event_id) AS first_id, count(*) AS n FROM (SELECT user_id, event_id, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM {RO})
    GROUP BY user_id, event_type, island HAVING count(*) >= 3""",
)
def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three or more equal types in a user's order: gaps and islands."""
    r = rollouts(spark, sf_dir)
    island = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    runs = r.withColumn("island", island).groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))
    return runs.where("n >= 3").select("user_id", "first_id", "n")


@query(
    "version_lag",
    f"SELECT event_type, count(*) AS n, count(*) FILTER (WHERE 100 - k >= 1) AS stale, count(*) FILTER (WHERE 100 - k >= 50) AS very_stale FROM {RO} GROUP BY event_type",
)
def version_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = F.lit(100) - F.col("k")
    return rollouts(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(lag >= 1, 1)).alias("stale"), F.count(F.when(lag >= 50, 1)).alias("very_stale"))


@query(
    "round_robin",
    """SELECT vec_id, rn FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) ORDER BY rn, label LIMIT 100""",
)
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each label, then the second, 100 in all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    e = e.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long"))
    return e.orderBy("rn", "label").limit(100).select("vec_id", "rn")


@query(
    "exclusive_running_total",
    "SELECT doc_id, CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at FROM documents",
)
def exclusive_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of documents in one stream. Totals of blocks of ids come first, so that no window holds all rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").withColumn("block", F.floor(F.col("doc_id") / 4096))
    w = Window.partitionBy("block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = d.groupBy("block").agg(F.sum("n_chars").alias("total"))
    before = blocks.select("block", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return d.join(before, "block").select("doc_id", (F.col("before") + F.coalesce(F.sum("n_chars").over(w), F.lit(0))).alias("start_at"))
