"""Token arrays: masks, padding, stops, advantage estimation over steps, whitening.

The steps of a user, in the order of their events, stand for the tokens of a
trajectory: ``value`` is the reward, k the token, and k over 95 a stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.groupstats import RO, discounted, rollouts
from weftline.plans.registry import query, sql_query

R = "(SELECT event_id, user_id, event_type, value, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events})"
BY = "PARTITION BY user_id ORDER BY event_id"


def steps(name: str, text: str, duck: str | None = None) -> None:
    """SQL over the rollouts $R, in both dialects."""
    sql_query(name, text.replace("$R", R), (duck or text).replace("$R", RO))


steps("mask_to_first_stop", f"SELECT event_id, coalesce(sum(CASE WHEN k > 95 THEN 1 ELSE 0 END) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS kept FROM $R")
steps("first_stop_position", "SELECT user_id, coalesce(min(CASE WHEN k > 95 THEN pos END), count(*)) AS stop_at FROM (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM $R) GROUP BY user_id")
steps("pad_after_stop", f"SELECT event_id, CASE WHEN coalesce(sum(CASE WHEN k > 95 THEN 1 ELSE 0 END) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN -1 ELSE k END AS token FROM $R")
steps("whitened_values", "SELECT event_id, round((value - m) / sqrt(v + 1e-8), 6) AS w FROM $R CROSS JOIN (SELECT avg(value) AS m, var_samp(value) AS v FROM $R)")
steps("return_minus_baseline", f"SELECT event_id, round(sum(value) OVER ({BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - sum(value) OVER (PARTITION BY user_id) / 8, 7) AS adv FROM $R")
steps(
    "step_weighted_baseline",
    "SELECT event_id, round(g - sum(g * w) OVER (PARTITION BY event_type, pos) / (sum(w) OVER (PARTITION BY event_type, pos) + 1e-8), 5) AS adv FROM (SELECT event_id, event_type, pos, sum(value) OVER (PARTITION BY user_id, event_type ORDER BY pos DESC) AS g, sum(k + 1) OVER (PARTITION BY user_id, event_type ORDER BY pos) AS w FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS pos FROM $R))",
)
steps(
    "rotate_to_first_valid",
    "SELECT event_id, (pos - f + n) % n AS new_pos FROM (SELECT event_id, pos, n, min(CASE WHEN k % 2 = 1 THEN pos END) OVER (PARTITION BY user_id) AS f FROM (SELECT event_id, user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM $R))",
)
steps("middle_truncation", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM $R) WHERE n <= 40 OR pos <= 20 OR pos > n - 20")
steps(
    "keep_protected_tokens",
    "SELECT event_id FROM (SELECT event_id, k, sum(CASE WHEN k > 90 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS others, sum(CASE WHEN k > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS protected FROM $R) WHERE k > 90 OR others <= 30 - protected",
)
steps("next_token_pairs", "SELECT k, nxt, count(*) AS n FROM (SELECT k, lead(k) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM $R) WHERE nxt IS NOT NULL GROUP BY k, nxt")
steps(
    "next_token_sets",
    "SELECT a.k AS first_token, b.k AS second_token, c.k AS next_token, count(*) AS n FROM (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM $R) a JOIN (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM $R) b ON a.user_id = b.user_id AND b.p = a.p + 1 JOIN (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM $R) c ON b.user_id = c.user_id AND c.p = b.p + 1 GROUP BY a.k, b.k, c.k",
)
steps("positive_rank_interleave", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY rn, event_type) AS pos FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM $R)", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rn, event_type) AS INTEGER) AS pos FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM $R)")


def running_sums(rows: DataFrame, key: str, *names: str) -> DataFrame:
    """``rows``, one for each whole number ``key``, with the sum of each column up to it. Sums of 1,024 keys come first, so that no window holds all rows."""
    d = rows.withColumn("_block", F.floor(F.col(key) / 1024))
    w = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("_block").agg(*(F.sum(n).alias(n) for n in names))
    before = totals.select("_block", *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_{n}") for n in names))
    own = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumns({f"_own_{n}": F.sum(n).over(own) for n in names}).join(before, "_block").select(key, *((F.col(f"_own_{n}") + F.col(f"_{n}")).alias(n) for n in names))


@query("running_moments_by_batch")
def running_moments_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and variance of all values up to each batch of a hundred, from mergeable sums."""
    b = rollouts(spark, sf_dir).groupBy(F.expr("event_id DIV 100").alias("batch")).agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    r = running_sums(b, "batch", "n", "s", "q")
    return r.select("batch", F.round(F.col("s") / (F.col("n") + 1e-3), 6).alias("mean"), F.round((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), 4).alias("variance"))




@query(
    "generalised_advantages",
    f"""WITH RECURSIVE s AS (SELECT user_id, event_id, value AS r, k * 0.5e0 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM {RO}),
    g AS (SELECT user_id, event_id, rn, v, r - v AS a FROM s WHERE rn = 1 UNION ALL
    SELECT s.user_id, s.event_id, s.rn, s.v, s.r + 0.5e0 * g.v - s.v + 0.25e0 * g.a FROM s JOIN g ON s.user_id = g.user_id AND s.rn = g.rn + 1)
    SELECT event_id, round(a, 6) AS advantage FROM g""",
)
def generalised_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discounted sum, by gamma times lambda, of each step's reward and next value less its own."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    v = F.col("k") * 0.5
    d = rollouts(spark, sf_dir).select("user_id", "event_id", (F.col("value") + 0.5 * F.coalesce(F.lead(v).over(w), F.lit(0.0)) - v).alias("delta"))
    return discounted(d, ["user_id"], "event_id", "delta", 0.25).select("event_id", F.round("ret", 6).alias("advantage"))


# --- messages and rows ---

sql_query("renamed_roles", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS speaker FROM {conversations}")
sql_query("overlong_filter", "SELECT doc_id FROM {documents} WHERE size(filter(split(text, '[ \\\\t\\\\n\\\\r\\\\f\\\\x0B]+'), w -> w <> '')) <= 500", "SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) <= 500")
sql_query("lookup_in_array", "SELECT user_id, element_at(vals, CAST(array_position(types, 'click') AS INT)) AS clicked FROM (SELECT user_id, transform(array_sort(collect_list(struct(event_type, m))), s -> s.event_type) AS types, transform(array_sort(collect_list(struct(event_type, m))), s -> s.m) AS vals FROM (SELECT user_id, event_type, round(max(value), 6) AS m FROM {events} GROUP BY user_id, event_type) GROUP BY user_id) WHERE array_contains(types, 'click')", "SELECT user_id, round(max(value), 6) AS clicked FROM events WHERE event_type = 'click' GROUP BY user_id")
sql_query("projection_with_fallback", "SELECT d.doc_id, coalesce(l.quality, d.n_chars % 2, -1) AS truth, 'search_' || d.source AS origin FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id", "SELECT d.doc_id, coalesce(l.quality, d.n_chars % 2, -1) AS truth, 'search_' || d.source AS origin FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
sql_query("label_filter", "SELECT doc_id FROM {documents} WHERE length(source) > 0 AND lang IS NOT NULL")
sql_query("retrieval_top_up", "SELECT doc_id FROM (SELECT d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS rn FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id LEFT ANTI JOIN {benchmark} b ON d.text = b.text) WHERE rn <= 5", "SELECT doc_id FROM (SELECT d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS rn FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)) WHERE rn <= 5")
sql_query("horizontal_concat", "SELECT o.o_orderkey, l.lines, o.o_totalprice FROM {orders} o JOIN (SELECT l_orderkey, count(*) AS lines FROM {lineitem} GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey")
sql_query("paragraph_offsets", "SELECT doc_id, par, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY par ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char, n FROM (SELECT doc_id, par, CAST(length(line) AS BIGINT) AS n FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) t AS par, line)", "SELECT doc_id, par, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY par ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char, n FROM (SELECT doc_id, CAST(i - 1 AS INTEGER) AS par, length(lines[i]) AS n FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))")
sql_query("level_filter", "SELECT p_partkey FROM {part} WHERE substr(p_brand, length(p_brand), 1) BETWEEN '2' AND '4' AND p_type NOT LIKE '%STEEL%'")
sql_query("column_to_lists", "SELECT user_id, count(*) AS n, array_join(transform(array_sort(collect_list(struct(event_id, event_type))), s -> s.event_type), ',') AS types FROM {events} GROUP BY user_id", "SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY user_id")
sql_query("split_columns", "SELECT vec_id, half, round(aggregate(slice(embedding, half * 32 + 1, 32), 0D, (a, x) -> a + x), 5) AS total FROM {embeddings} LATERAL VIEW explode(array(0, 1)) t AS half", "SELECT vec_id, half, round(list_sum(list_transform(embedding[half * 32 + 1 : half * 32 + 32], lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings, (SELECT CAST(range AS INTEGER) AS half FROM range(2))")
sql_query("batch_repeat_order", "SELECT doc_id, rep, mini FROM {documents} LATERAL VIEW explode(sequence(0, 1)) a AS rep LATERAL VIEW explode(sequence(0, 2)) b AS mini WHERE doc_id < (SELECT floor(count(*) / 8) * 8 FROM {documents})", "SELECT doc_id, CAST(a.range AS INTEGER) AS rep, CAST(b.range AS INTEGER) AS mini FROM documents, range(2) a, range(3) b WHERE doc_id < (SELECT floor(count(*) / 8) * 8 FROM documents)")
