"""Queries over the text functions: documents answer, benchmark items ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.plans.registry import query, sql_query
from weftline.sources.tables import table



def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


LIST = "list_filter(string_split_regex({x}, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"


@query("word_counts", f"SELECT doc_id, CAST(len({LIST.format(x='text')}) AS BIGINT) AS words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("words"))


ART = (
    "array_to_string(list_filter(string_split(trim(regexp_replace(translate(lower(text), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' '), "
    "lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"
)


@query("normalised_answers", f"SELECT doc_id, md5({ART}) AS digest FROM documents")
def normalised_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_answer(F.col("text")).cast("binary")).alias("digest"))


@query(
    "gsm_answers",
    """SELECT doc_id, CASE WHEN len(f) > 0 THEN replace(f[len(f)], ',', '') END AS answer FROM (SELECT doc_id,
    regexp_extract_all(right(text || ' #### ' || CAST(n_chars AS VARCHAR) || ',0', 300), '#### (-?[0-9.,]+)', 1) AS f FROM documents)""",
)
def gsm_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.col("text"), F.lit(" #### "), F.col("n_chars").cast("string"), F.lit(",0"))
    return docs(spark, sf_dir).select("doc_id", T.last_number_mark(s).alias("answer"))


@query(
    "marked_spans",
    """SELECT doc_id, CAST(len(s) AS BIGINT) AS spans, coalesce(array_to_string(s, '|'), '') AS joined FROM (SELECT doc_id,
    regexp_extract_all('<q>' || text || '</q> x <q>' || source || '</q>', '(?s)<q>(.*?)</q>', 1) AS s FROM documents)""",
)
def marked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<q>"), F.col("text"), F.lit("</q> x <q>"), F.col("source"), F.lit("</q>"))
    return docs(spark, sf_dir).select("doc_id", F.size(T.between(marked, "<q>", "</q>")).cast("long").alias("spans"), F.array_join(T.between(marked, "<q>", "</q>"), "|").alias("joined"))


@query(
    "token_f1",
    f"""WITH p AS (SELECT c.conv_id, c.turn, {LIST.format(x="lower(c.text)")} AS a, {LIST.format(x="lower(d.text)")} AS b FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn = c.turn + 1),
    x AS (SELECT conv_id, turn, w, count(*) n FROM (SELECT conv_id, turn, unnest(a) w FROM p) GROUP BY ALL),
    y AS (SELECT conv_id, turn, w, count(*) n FROM (SELECT conv_id, turn, unnest(b) w FROM p) GROUP BY ALL),
    o AS (SELECT conv_id, turn, sum(least(x.n, y.n)) c FROM x JOIN y USING (conv_id, turn, w) GROUP BY ALL)
    SELECT p.conv_id, p.turn, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE 2e0 * coalesce(c, 0) / (len(a) + len(b)) END, 6) AS f1 FROM p LEFT JOIN o USING (conv_id, turn)""",
)
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of a turn's tokens against the next turn's."""
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", T.tokens(F.lower("text")).alias("a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), T.tokens(F.lower("text")).alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.multiset_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query(
    "edge_overlaps",
    """SELECT doc_id, CASE WHEN contains(a, b) THEN CAST(length(b) AS BIGINT) WHEN contains(b, a) THEN CAST(length(a) AS BIGINT) ELSE
    CAST((SELECT max(i) FROM (SELECT unnest(range(0, least(length(a), length(b)) + 1)) AS i) WHERE right(a, i) = left(b, i) OR right(b, i) = left(a, i)) AS BIGINT) END AS overlap
    FROM (SELECT doc_id, source || lang AS a, lang || source AS b FROM documents)""",
)
def edge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", F.concat("source", "lang").alias("a"), F.concat("lang", "source").alias("b"))
    return d.select("doc_id", T.edge_overlap(F.col("a"), F.col("b")).cast("long").alias("overlap"))


@query(
    "two_way_containment",
    """WITH n AS (SELECT doc_id, source, trim(regexp_replace(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS x,
    lower(lang) AS y FROM documents) SELECT doc_id, CASE WHEN contains(array_to_string(list_filter(string_split(x, ' '), lambda w: w NOT IN ('a', 'an', 'the', '')), ' '), y) OR
    contains(y, array_to_string(list_filter(string_split(x, ' '), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')) THEN 1e0 ELSE 0e0 END AS score FROM n""",
)
def two_way_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.contains_either_way(F.col("text"), F.col("lang")).alias("score"))


@query(
    "composite_scores",
    """SELECT doc_id, round(0.2 * f + 0.4 * (a + r) / 2 + 0.4 * (sqrt((a + 0.01) * (r + 0.01)) - 0.01), 6) AS reward, round(p, 6) AS penalty, round(dens, 6) AS density FROM (
    SELECT doc_id, CASE WHEN contains(text, '.') THEN 1e0 ELSE 0e0 END f, (n_chars % 101) / 100e0 AS a, (doc_id % 11) / 10e0 AS r, least(-(n_chars - 1000) / 500e0 * 1e0, 0e0) AS p,
    CASE WHEN greatest(doc_id % 40 - 3, 0) * 1024e0 / greatest(n_chars, 1) <= 2 THEN 1e0 ELSE pow(2e0, -(greatest(doc_id % 40 - 3, 0) * 1024e0 / greatest(n_chars, 1) - 2) / 4e0) END AS dens FROM documents)""",
)
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, answer and retrieval parts in one projection, with length and density penalties."""
    a, r = F.col("n_chars") % 101 / 100.0, F.col("doc_id") % 11 / 10.0
    reward = 0.2 * F.col("text").contains(".").cast("double") + 0.4 * (a + r) / 2 + 0.4 * T.geometric_mean([a, r])
    return docs(spark, sf_dir).select(
        "doc_id", F.round(reward, 6).alias("reward"), F.round(T.overlong_penalty(F.col("n_chars"), 1000, 500, 1.0), 6).alias("penalty"),
        F.round(T.density_penalty(F.col("doc_id") % 40, F.col("n_chars"), 3, 1024, 2.0, 4.0), 6).alias("density"),
    )


@query(
    "context_sizes",
    "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN (doc_id % 128) * 1000 ELSE (doc_id % 4) * 1000000 END AS BIGINT) AS tokens FROM documents",
)
def context_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 2 == 0, F.concat((F.col("doc_id") % 128).cast("string"), F.lit("k"))).otherwise(F.concat((F.col("doc_id") % 4).cast("string"), F.lit("m")))
    return docs(spark, sf_dir).select("doc_id", T.context_size(name).alias("tokens"))


@query("divisor_counts", "SELECT p_partkey, CAST(len(list_filter(range(1, p_partkey % 500 + 2), lambda x: (p_partkey % 500 + 1) % x = 0)) AS BIGINT) AS n FROM part")
def divisor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_partkey") % 500 + 1).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(T.divisors(n)).cast("long").alias("n"))


@query("seed_from_name", "SELECT doc_id, CAST('0x' || substr(sha256('7:' || source), 1, 8) AS BIGINT) AS seed FROM documents")
def seed_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.conv(F.substring(F.sha2(F.concat(F.lit("7:"), "source"), 256), 1, 8), 16, 10).cast("long").alias("seed"))


sql_query("control_prefix", "SELECT doc_id, md5(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN 'Section::::' || text ELSE text END, '^(Section|BULLET|NUMBERED)::::', '')) AS digest FROM {documents}")
sql_query("title_normaliser", "SELECT doc_id, md5(trim(regexp_replace(lower(replace(source || '_ ' || lang, '_', ' ')), ' +', ' '))) AS title FROM {documents}", "SELECT doc_id, md5(trim(regexp_replace(lower(replace(source || '_ ' || lang, '_', ' ')), ' +', ' ', 'g'))) AS title FROM documents")
sql_query("guarded_containment", "SELECT doc_id, length(trim(source)) >= 4 AND position(lower(trim(source)) IN lower(text || source)) > 0 AS found FROM {documents}", "SELECT doc_id, length(trim(source)) >= 4 AND contains(lower(text || source), lower(trim(source))) AS found FROM documents")


@query("cjk_filter", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[\\x{4e00}-\\x{9fff}]')")
def cjk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(~F.col("text").rlike(r"[\x{4e00}-\x{9fff}]")).select("doc_id")


sql_query("quadratic_cost", "SELECT doc_id, CAST(24576 * n_chars + n_chars * n_chars AS BIGINT) AS cost FROM {documents}")
#: Log-probabilities of a token under two policies: k and value as places on a logarithmic scale of 101 and 501 steps.
_RATIO = "ln((k + 1) / 101e0) - ln((least(value, 500e0) + 1) / 501e0)"
_SPARK_LR = f"(SELECT event_id, event_type, {_RATIO} AS d FROM (SELECT event_id, event_type, value, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {{events}}))"
_LR = f"(SELECT event_id, event_type, {_RATIO} AS d FROM (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"


def _ratios(name: str, text: str, duck: str | None = None) -> None:
    sql_query(name, text.replace("$D", _SPARK_LR), (duck or text).replace("$D", _LR))


_K3 = "least(greatest(exp(least(greatest(-d, -20e0), 20e0)) + d - 1, -10e0), 10e0)"
_W = "least(exp(least(greatest(d, -20e0), 20e0)), 2e0)"
_ratios(
    "kl_estimators",
    f"SELECT event_id, round(d, 9) AS k1, round(abs(d), 9) AS k1_abs, round(d * d / 2, 9) AS k2, round({_K3}, 6) AS k3 FROM $D",
    "SELECT event_id, round(d, 9) AS k1, round(CASE WHEN d < 0 THEN -d ELSE d END, 9) AS k1_abs, round(pow(d, 2) * 0.5e0, 9) AS k2, round(CASE WHEN k > 10 THEN 10e0 WHEN k < -10 THEN -10e0 ELSE k END, 6) AS k3 FROM (SELECT *, exp(CASE WHEN d < -20 THEN 20e0 WHEN d > 20 THEN -20e0 ELSE -d END) - (1 - d) AS k FROM $D)",
)
# means are joined: a window over a type would hold its rows in one task
_ratios(
    "importance_weights",
    f"SELECT event_id, round(w / m, 6) AS weight FROM (SELECT event_id, event_type, {_W} AS w FROM $D) JOIN (SELECT event_type, avg({_W}) AS m FROM $D GROUP BY event_type) USING (event_type)",
    f"SELECT event_id, round(w / avg(w) OVER (PARTITION BY event_type), 6) AS weight FROM (SELECT event_id, event_type, {_W} AS w FROM $D)",
)
_ratios(
    "effective_sample_size",
    "SELECT event_type, round(avg(w) * avg(w) / avg(w * w), 6) AS ess FROM (SELECT event_type, least(exp(d), 2e0) AS w FROM $D) GROUP BY event_type",
    "SELECT event_type, round(1e0 / avg((w / m) * (w / m)), 6) AS ess FROM (SELECT event_type, w, avg(w) OVER (PARTITION BY event_type) AS m FROM (SELECT event_type, least(exp(d), 2e0) AS w FROM $D)) GROUP BY event_type",
)
_ratios(
    "rollout_divergence",
    "SELECT event_type, round(avg(d), 6) AS kl, round(avg(exp(-d) + d - 1), 6) AS k3, round(exp(avg(d)), 6) AS ppl, round(avg(exp(2 * d)) - 1, 6) AS chi2 FROM $D GROUP BY event_type",
    "SELECT event_type, round(sum(d) / count(*), 6) AS kl, round((sum(exp(-d)) + sum(d)) / count(*) - 1, 6) AS k3, round(exp(sum(d) / count(*)), 6) AS ppl, round(sum(exp(d) * exp(d)) / count(*) - 1, 6) AS chi2 FROM $D GROUP BY event_type",
)
sql_query("rounding_steps", "SELECT p_partkey, CAST(bround(p_retailprice / 5e0) * 5 AS DOUBLE) AS price FROM {part}", "SELECT p_partkey, CAST(round_even(p_retailprice / 5e0, 0) * 5 AS DOUBLE) AS price FROM part")
sql_query("config_grid", "SELECT k, v, q FROM (SELECT CAST(r_regionkey + 1 AS INT) AS k FROM {region}) a CROSS JOIN (SELECT CAST(r_regionkey + 1 AS INT) AS v FROM {region}) b CROSS JOIN (SELECT CAST(r_regionkey + 1 AS INT) AS q FROM {region}) c WHERE k * v <= 16 AND q <= least(k, 6)")
