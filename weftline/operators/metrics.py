"""Aggregation of evaluation results: pivots, hierarchical metrics, votes, closed-form bootstraps.

``events`` stands for results: event_type is the model, user_id % 4 the
category, user_id % 3 the context length, value the score, k the length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.groupstats import RO, rollouts
from weftline.plans.registry import query, sql_query
from weftline.sources.tables import table

DIMENSIONS = "event_id, event_type AS model, user_id % 4 AS category, user_id % 3 AS ctx, user_id, value, "
RES = f"(SELECT {DIMENSIONS}CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
SPARK_RES = f"(SELECT {DIMENSIONS}CAST(get_json_object(props, '$.k') AS INT) AS k FROM {{events}})"


def results(name: str, text: str, duck: str | None = None) -> None:
    sql_query(name, text.replace("$R", SPARK_RES), (duck or text).replace("$R", RES))


results("metric_means", "SELECT model, round(avg(value), 6) AS score, round(avg(k), 6) AS length, round(avg(CASE WHEN k > 50 THEN value END), 6) AS long_score, count(*) AS n FROM $R GROUP BY model")
results(
    "count_pivot",
    "SELECT * FROM (SELECT model, category, 1 AS one FROM $R) PIVOT (count(one) FOR category IN (0 AS c0, 1 AS c1, 2 AS c2, 3 AS c3))",
    "SELECT model, count(*) FILTER (WHERE category = 0) AS c0, count(*) FILTER (WHERE category = 1) AS c1, count(*) FILTER (WHERE category = 2) AS c2, count(*) FILTER (WHERE category = 3) AS c3 FROM $R GROUP BY model",
)
results("mean_by_category_ctx", "SELECT model, category, ctx, round(avg(value), 6) AS score FROM $R GROUP BY model, category, ctx")
results("short_long_wide", "SELECT model, category, round(avg(CASE WHEN ctx IN (0, 1) THEN value END), 6) AS short_score, round(avg(CASE WHEN ctx = 2 THEN value END), 6) AS long_score FROM $R GROUP BY model, category")
results("mean_and_std", "SELECT model, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS std_value, round(avg(k), 6) AS mean_k, round(stddev_samp(k), 6) AS std_k FROM $R GROUP BY model")
results(
    "row_mean_of_cells",
    "SELECT model, round(avg(cell), 6) AS mean_of_means FROM (SELECT model, ctx, avg(value) AS cell FROM $R GROUP BY model, ctx) GROUP BY model",
)
results("column_override", "SELECT event_id, CASE WHEN model = 'click' THEN CAST(k AS DOUBLE) ELSE value END AS score FROM $R")
results("mean_of_row_means", "SELECT category, round(avg(row_mean), 6) AS score FROM (SELECT category, user_id, avg(value) AS row_mean FROM $R GROUP BY category, user_id) GROUP BY category")
results(
    "reduce_by_name",
    "SELECT name, round(CASE WHEN name LIKE '%max%' THEN max(x) WHEN name LIKE '%min%' THEN min(x) ELSE avg(x) END, 6) AS x FROM (SELECT 'loss_' || model AS name, value AS x FROM $R UNION ALL SELECT 'max_' || model, value FROM $R UNION ALL SELECT 'minibatch_' || model, value FROM $R) GROUP BY name",
)
results(
    "batch_summary",
    "SELECT round(avg(value), 6) AS mean_score, round(max(value), 6) AS max_score, round(min(value), 6) AS min_score, round(avg(CASE WHEN k > 0 THEN k END), 6) AS mean_length, round(avg(CASE WHEN k >= 90 THEN 1e0 ELSE 0e0 END), 6) AS clip_ratio, round(avg(CASE WHEN k = 0 THEN 1e0 ELSE 0e0 END), 6) AS aborted_ratio FROM $R",
)
results("ms_per_token", "SELECT model, round(sum(value) * 1000 / sum(CASE WHEN model = 'view' THEN k ELSE k + 10 END), 6) AS ms FROM $R GROUP BY model")
results("tokens_per_second", "SELECT category, round(sum(k) / (sum(value) * 8), 6) AS per_device FROM $R GROUP BY category")
results("gradient_proxy", "SELECT category, round(avg(value * value * k), 4) AS total_power, round(avg(value) * avg(value), 6) AS signal_power FROM $R GROUP BY category")
results("grade_counts", "SELECT ctx, CAST(k % 4 AS INT) AS grade, count(*) AS n, count(DISTINCT user_id) AS queries FROM $R GROUP BY ctx, k % 4")
results("judged_per_query", "SELECT round(avg(n), 6) AS mean_n, min(n) AS min_n, max(n) AS max_n FROM (SELECT user_id, count(*) AS n FROM $R GROUP BY user_id)")
results("value_ranges", "SELECT model, min(k) AS min_k, max(k) AS max_k, round(avg(k), 6) AS mean_k, count(DISTINCT k) AS distinct_k FROM $R GROUP BY model")
results("top_options", "SELECT category, k AS option_k, n FROM (SELECT category, k, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, k) AS rn FROM $R GROUP BY category, k) WHERE rn <= 5")
results("threshold_count", "SELECT category, count(*) AS n FROM $R WHERE value > 20 AND k BETWEEN 10 AND 60 GROUP BY category")
results(
    "threshold_argmax",
    "SELECT category, event_id, value FROM (SELECT category, event_id, value, row_number() OVER (PARTITION BY category ORDER BY value DESC, event_id) AS rn FROM $R WHERE k BETWEEN 10 AND 60) WHERE rn = 1",
)
results("pairwise_accuracy", "SELECT model, round(avg(CASE WHEN value > k THEN 1e0 ELSE 0e0 END), 6) AS accuracy, count(*) AS n FROM $R WHERE value <> k GROUP BY model")
results("nan_skipping", "SELECT model, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high FROM (SELECT model, CASE WHEN k % 7 = 0 THEN NULL ELSE value END AS x FROM $R) GROUP BY model")
results("masked_sum_mean", "SELECT model, round(sum(CASE WHEN k > 30 THEN value END), 4) AS total, round(sum(CASE WHEN k > 30 THEN value ELSE 0 END) / (sum(CASE WHEN k > 30 THEN 1 ELSE 0 END) + 1e-8), 6) AS mean FROM $R GROUP BY model")
results(
    "masked_variance",
    "SELECT model, round((sum(value * value) - sum(value) * sum(value) / count(*)) / (count(*) - 1), 4) AS variance FROM $R WHERE k > 30 GROUP BY model HAVING count(*) > 1",
)
results("global_moments", "SELECT round(avg(value), 6) AS mean, round(max(value), 6) AS high, round(min(value), 6) AS low, round(stddev_samp(value), 6) AS std FROM $R")
results(
    "loss_aggregation",
    "SELECT round(sum(value) / count(*), 6) AS token_mean, (SELECT round(avg(s), 4) FROM (SELECT sum(value) AS s FROM $R GROUP BY user_id)) AS seq_mean_token_sum, (SELECT round(avg(m), 6) FROM (SELECT sum(value) / (count(*) + 1e-8) AS m FROM $R GROUP BY user_id)) AS seq_mean_token_mean, (SELECT round(sum(value) / 128, 4) FROM $R) AS seq_mean_token_sum_norm FROM $R",
)
results("partition_spread", "SELECT min(s) AS low, max(s) AS high, max(s) - min(s) AS spread FROM (SELECT event_id % 8 AS part, CAST(sum(k) AS BIGINT) AS s FROM $R GROUP BY event_id % 8)")
results("population_moments", "SELECT model, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance FROM $R GROUP BY model")
results(
    "majority_value",
    "SELECT user_id, value FROM (SELECT r.user_id, r.value, row_number() OVER (PARTITION BY r.user_id ORDER BY c.n DESC, c.first_at, r.event_id) AS rn FROM $R r JOIN (SELECT user_id, model, count(*) AS n, min(event_id) AS first_at FROM $R GROUP BY user_id, model) c ON r.user_id = c.user_id AND r.model = c.model) WHERE rn = 1",
)
results("vote_winner", "SELECT category, k AS winner FROM (SELECT category, k, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, min(event_id)) AS rn FROM $R GROUP BY category, k) WHERE rn = 1")
results("win_rate", "SELECT model, round(avg(CASE WHEN k % 2 = 1 THEN 1e0 ELSE 0e0 END), 6) AS win_rate FROM $R GROUP BY model")
results(
    "core_metrics",
    "SELECT name, x FROM (SELECT name, x, n, max(n) OVER () AS top FROM (SELECT 'mean@' || CAST(ctx AS VARCHAR(10)) || '/' || model AS name, ctx AS n, round(avg(value), 6) AS x FROM $R GROUP BY ctx, model)) WHERE n = top AND (name LIKE 'mean%' OR name LIKE 'best%')",
)
results(
    "reward_vector",
    "SELECT event_id, round(0.5 * coalesce(a, 0) + 0.3 * coalesce(b, 0) + 0.2 * coalesce(c, 0), 6) AS reward, a IS NULL AND b IS NULL AND c IS NULL AS none_applies FROM (SELECT event_id, CASE WHEN k > 20 THEN value END AS a, CASE WHEN k > 40 THEN k * 1e0 END AS b, CASE WHEN ctx = 1 THEN 1e0 END AS c FROM $R)",
)


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts(spark, sf_dir).select("event_type", "user_id", "event_id", "value")


@query(
    "hierarchical_metrics",
    f"""SELECT event_type, round(avg(m), 6) AS mean_at_n, round(avg(s), 6) AS std_at_n, count(*) AS prompts FROM
    (SELECT event_type, user_id, avg(value) AS m, stddev_pop(value) AS s FROM {RO} GROUP BY event_type, user_id) GROUP BY event_type""",
)
def hierarchical_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per prompt first, then over prompts; the deviation of a prompt's samples is the population's."""
    inner = draws(spark, sf_dir).groupBy("event_type", "user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return inner.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean_at_n"), F.round(F.avg("s"), 6).alias("std_at_n"), F.count("*").alias("prompts"))


def best_worst(samples: DataFrame, group: list[str], value: str, sizes: tuple[int, ...]) -> DataFrame:
    """Expected best and worst of n draws with replacement, in closed form: the limit of a bootstrap with ever more rounds."""
    i = F.row_number().over(Window.partitionBy(*group).orderBy(value))
    s = samples.withColumn("i", i).withColumn("n", F.count("*").over(Window.partitionBy(*group)))
    at = lambda x, m: F.pow(x / F.col("n"), F.lit(float(m)))
    best = [F.sum(F.col(value) * (at(F.col("i"), m) - at(F.col("i") - 1, m))).alias(f"best_{m}") for m in sizes]
    worst = [F.sum(F.col(value) * (at(F.col("n") - F.col("i") + 1, m) - at(F.col("n") - F.col("i"), m))).alias(f"worst_{m}") for m in sizes]
    return s.groupBy(*group).agg(*best, *worst)


def _best(m: int) -> str:
    return f"sum(value * (pow(i * 1e0 / n, {m}) - pow((i - 1) * 1e0 / n, {m}))) AS best_{m}, sum(value * (pow((n - i + 1) * 1e0 / n, {m}) - pow((n - i) * 1e0 / n, {m}))) AS worst_{m}"


@query(
    "best_worst_of_n",
    f"""SELECT event_type, round(avg(best_2), 5) AS best_2, round(avg(best_4), 5) AS best_4, round(avg(worst_2), 5) AS worst_2, round(avg(worst_4), 5) AS worst_4 FROM
    (SELECT event_type, user_id, {_best(2)}, {_best(4)} FROM (SELECT event_type, user_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value) i,
    count(*) OVER (PARTITION BY event_type, user_id) n FROM {RO}) GROUP BY event_type, user_id) GROUP BY event_type""",
)
def best_worst_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = best_worst(draws(spark, sf_dir), ["event_type", "user_id"], "value", (2, 4))
    return b.groupBy("event_type").agg(*(F.round(F.avg(c), 5).alias(c) for c in ("best_2", "best_4", "worst_2", "worst_4")))


_NINE = ["value", "k", "value + k", "value - k", "value * k", "CASE WHEN k > 50 THEN 1e0 ELSE 0e0 END", "CASE WHEN k > 50 THEN value END", "CASE WHEN value > 30 THEN 1e0 ELSE 0e0 END", "CASE WHEN value > 30 THEN k END"]


@query("nine_means", f"SELECT model, {', '.join(f'round(sum({e}) / count({e}), 5) AS m{i}' for i, e in enumerate(_NINE))}, count(*) AS n FROM {RES} GROUP BY model")
def nine_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of nine measures, some of which apply to part of the rows."""
    r = spark.sql(f"SELECT * FROM {SPARK_RES}", events=table(spark, sf_dir, "events"))
    return r.groupBy("model").agg(*(F.round(F.avg(F.expr(e)), 5).alias(f"m{i}") for i, e in enumerate(_NINE)), F.count("*").alias("n"))


@query(
    "wide_means",
    f"""SELECT model, {', '.join(f"round(avg(value) FILTER (WHERE category = {c}), 6) AS score_{c}, round(avg(k) FILTER (WHERE category = {c}), 6) AS length_{c}" for c in range(4))} FROM {RES} GROUP BY model""",
)
def wide_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two means by category, a column for each."""
    r = spark.sql(f"SELECT * FROM {SPARK_RES}", events=table(spark, sf_dir, "events"))
    p = r.groupBy("model").pivot("category", list(range(4))).agg(F.round(F.avg("value"), 6).alias("score"), F.round(F.avg("k"), 6).alias("length"))
    return p.select("model", *(F.col(f"{c}_{m}").alias(f"{m}_{c}") for c in range(4) for m in ("score", "length")))


@query(
    "answers_first_seen",
    """WITH a AS (SELECT user_id, event_type, min(event_id) AS first_at, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY ALL)
    SELECT user_id, string_agg(event_type, '|||' ORDER BY first_at) AS answers, string_agg(CAST(ids[1] AS VARCHAR) || '..' || CAST(ids[-1] AS VARCHAR), ',' ORDER BY first_at) AS provenance FROM a GROUP BY user_id""",
)
def answers_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's distinct answers in the order in which they first appear, and where: grouped by answer first, so no list of all events is made."""
    a = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    g = a.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "event_type"))).alias("s"))
    spans = F.transform("s", lambda x: F.concat(x["lo"].cast("string"), F.lit(".."), x["hi"].cast("string")))
    return g.select("user_id", F.array_join(F.transform("s", lambda x: x["event_type"]), "|||").alias("answers"), F.array_join(spans, ",").alias("provenance"))
