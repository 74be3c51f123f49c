"""Joins, set operations, sampling, quotas, batch algebra and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.registry import query, sql_query
from weftline.sources.tables import table

WORD_WINDOW = 80


# --- joins ---

sql_query("lookup_by_id", "SELECT o_orderkey, c_name FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey")
sql_query("lookup_one_to_many", "SELECT n_name, c_custkey FROM {nation} LEFT JOIN {customer} ON n_nationkey = c_nationkey")
sql_query("anti_join_judged", "SELECT doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
sql_query("semi_join_split", "SELECT doc_id, quality >= 1 AS relevant FROM {labels} l WHERE EXISTS (SELECT 1 FROM {documents} d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
sql_query(
    "inner_with_skip_counts",
    "SELECT count(l.doc_id) AS matched, count(*) - count(l.doc_id) AS unmatched FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
)
sql_query("skip_reasons", "SELECT CASE WHEN toxic IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' ELSE 'usable' END AS reason, count(*) AS n FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY 1")
sql_query(
    "first_per_pid",
    "SELECT pid, src FROM (SELECT pid, src, row_number() OVER (PARTITION BY pid ORDER BY src, pos) AS rn FROM (SELECT doc_id % 300 AS pid, 1 AS src, doc_id AS pos FROM {documents} UNION ALL SELECT doc_id % 500, 2, doc_id FROM {labels})) WHERE rn = 1",
)
sql_query(
    "surrogate_keys",
    "SELECT d.doc_id, k.key_id FROM {documents} d JOIN (SELECT source, lang, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS BIGINT) AS key_id FROM {documents} GROUP BY source, lang) k ON d.source = k.source AND d.lang = k.lang",
)
sql_query(
    "composite_key_anti_join",
    "SELECT doc_id FROM (SELECT doc_id, split(source || '__' || lang, '__')[1] AS part FROM {documents}) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT lang FROM {documents} WHERE lang <> 'en') y WHERE y.lang = x.part)",
    "SELECT doc_id FROM (SELECT doc_id, split(source || '__' || lang, '__')[2] AS part FROM documents) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT lang FROM documents WHERE lang <> 'en') y WHERE y.lang = x.part)",
)
sql_query(
    "zip_join",
    "SELECT a.event_id, a.value, b.event_type FROM (SELECT event_id, value, user_id FROM {events}) a JOIN (SELECT event_id, event_type, user_id FROM {events}) b ON a.event_id = b.event_id AND a.user_id <=> b.user_id",
    "SELECT a.event_id, a.value, b.event_type FROM events a JOIN events b ON a.event_id = b.event_id AND a.user_id IS NOT DISTINCT FROM b.user_id",
)
sql_query(
    "rotate_pairs",
    "SELECT event_id, coalesce(lag(event_id) OVER w, max(event_id) OVER (PARTITION BY CAST(floor(event_id / 16) AS BIGINT))) AS partner FROM {events} WINDOW w AS (PARTITION BY CAST(floor(event_id / 16) AS BIGINT) ORDER BY event_id)",
)
def interval_join(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of rows whose half-open intervals [lo, hi) overlap. ``left`` has l_lo and l_hi, ``right`` r_lo and r_hi.

    Both sides are dealt to bins of ``width`` and meet there by an equi-join; a
    pair is kept in the bin where the later of the two begins, so once.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.greatest(F.floor(F.col(lo) / width), F.ceil(F.col(hi) / width) - 1)))
    a, b = left.where("l_lo < l_hi").withColumn("bin", bins("l_lo", "l_hi")), right.where("r_lo < r_hi").withColumn("bin", bins("r_lo", "r_hi"))
    both = a.join(b, "bin").where("l_lo < r_hi AND r_lo < l_hi")
    return both.where(F.col("bin") == F.floor(F.greatest("l_lo", "r_lo") / width)).drop("bin")


@query(
    "range_overlap_argmax",
    "SELECT doc_id, win FROM (SELECT d.doc_id, w.win, row_number() OVER (PARTITION BY d.doc_id ORDER BY least(d.hi, w.hi) - greatest(d.lo, w.lo) DESC, w.win) AS rn FROM (SELECT doc_id, doc_id * 37 % 900 AS lo, doc_id * 37 % 900 + 150 AS hi FROM documents) d JOIN (SELECT item_id AS win, item_id * 100 AS lo, item_id * 100 + 100 AS hi FROM benchmark) w ON d.lo < w.hi AND d.hi > w.lo) WHERE rn = 1",
)
def range_overlap_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each span the window that it overlaps most, the first of equal ones."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id * 37 % 900 AS l_lo", "doc_id * 37 % 900 + 150 AS l_hi")
    w = table(spark, sf_dir, "benchmark").selectExpr("item_id AS win", "item_id * 100 AS r_lo", "item_id * 100 + 100 AS r_hi")
    both = interval_join(d, w, 100)
    best = both.groupBy("doc_id").agg(F.min(F.struct((F.greatest("l_lo", "r_lo") - F.least("l_hi", "r_hi")).alias("o"), "win")).alias("b"))
    return best.select("doc_id", "b.win")


@query("point_in_interval", "SELECT e.event_id, w.item_id FROM events e JOIN benchmark w ON e.value >= w.item_id * 10 AND e.value < w.item_id * 10 + 10")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of each point: points go to the bin they lie in, intervals to the bins they touch."""
    e = table(spark, sf_dir, "events").select("event_id", "value").withColumn("bin", F.floor(F.col("value") / 10))
    w = table(spark, sf_dir, "benchmark").selectExpr("item_id", "item_id * 10 AS lo", "item_id * 10 + 10 AS hi")
    w = w.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / 10), F.ceil(F.col("hi") / 10) - 1)))
    return e.join(w, "bin").where("value >= lo AND value < hi").select("event_id", "item_id")


sql_query(
    "array_key_lookup",
    "SELECT p.conv_id, array_join(transform(array_sort(collect_list(struct(p.turn, d.lang))), s -> s.lang), ',') AS langs FROM {conversations} p JOIN {documents} d ON d.doc_id = p.conv_id * 3 + p.turn GROUP BY p.conv_id",
    "SELECT p.conv_id, string_agg(d.lang, ',' ORDER BY p.turn) AS langs FROM conversations p JOIN documents d ON d.doc_id = p.conv_id * 3 + p.turn GROUP BY p.conv_id",
)

# --- set operations, sampling and quotas ---

sql_query("union_rows", "SELECT doc_id AS id, 'd' AS kind FROM {documents} UNION ALL SELECT page_id, 'p' FROM {pages}")
# texts are compared by their digests, so none is shuffled or sorted
sql_query(
    "keep_first",
    "SELECT min(doc_id) AS doc_id FROM {documents} GROUP BY lower(source), md5(CAST(trim(text) AS BINARY))",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(source), trim(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
)
sql_query(
    "keep_first_caseless",
    "SELECT min(doc_id) AS doc_id FROM {documents} WHERE trim(text) <> '' GROUP BY md5(CAST(lower(trim(text)) AS BINARY))",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS rn FROM documents WHERE trim(text) <> '') WHERE rn = 1",
)
sql_query(
    "apportion",
    "SELECT lang, CASE WHEN rk = k THEN 100 - coalesce(before, 0) ELSE part END AS quota FROM (SELECT lang, rk, k, part, CAST(sum(part) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before FROM (SELECT lang, row_number() OVER (ORDER BY lang) AS rk, count(*) OVER () AS k, CAST(bround(100e0 * count(*) / sum(count(*)) OVER ()) AS BIGINT) AS part FROM {documents} GROUP BY lang))",
    "SELECT lang, CASE WHEN rk = k THEN 100 - coalesce(before, 0) ELSE part END AS quota FROM (SELECT lang, rk, k, part, CAST(sum(part) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before FROM (SELECT lang, row_number() OVER (ORDER BY lang) AS rk, count(*) OVER () AS k, CAST(round_even(100e0 * count(*) / sum(count(*)) OVER (), 0) AS BIGINT) AS part FROM documents GROUP BY lang))",
)
sql_query("split_by_year", "SELECT o_orderkey, CASE WHEN year(o_orderdate) IN (1996, 1997) THEN 'train' ELSE 'validation' END AS split FROM {orders}")
sql_query(
    "stratified_sample",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS STRING)), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM {documents}) WHERE rn <= floor(n * 0.2)",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE rn <= floor(n * 0.2)",
)
sql_query("sample_n", "SELECT doc_id FROM {documents} ORDER BY md5(CAST(doc_id * 7 AS STRING)), doc_id LIMIT 50", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id * 7 AS VARCHAR)), doc_id LIMIT 50")
sql_query("resample_weights", "SELECT event_id, round(pow(value, 0.5) / sum(pow(value, 0.5)) OVER (PARTITION BY event_type), 9) AS weight FROM {events}")
sql_query("repeat_rows", "SELECT doc_id, r FROM {documents} LATERAL VIEW explode(sequence(1, CAST(doc_id % 3 + 1 AS INT))) t AS r", "SELECT doc_id, CAST(unnest(range(1, doc_id % 3 + 2)) AS INTEGER) AS r FROM documents")
sql_query("fold_rows", "SELECT CAST(floor(event_id / 10) AS BIGINT) AS batch, array_join(array_sort(collect_list(event_id)), ',') AS ids FROM {events} GROUP BY CAST(floor(event_id / 10) AS BIGINT)", "SELECT CAST(floor(event_id / 10) AS BIGINT) AS batch, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY ALL")
sql_query("unfold_rows", "SELECT vec_id, pos, x FROM (SELECT vec_id, embedding AS e FROM {embeddings}) LATERAL VIEW posexplode(e) t AS pos, x", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, embedding[i] AS x FROM embeddings, range(1, 65) t(i)")

# --- batch algebra ---

sql_query("chunk_ids", "SELECT event_id, CAST(floor(event_id / 128) AS BIGINT) AS chunk FROM {events}")
sql_query(
    "row_shards",
    "SELECT event_id, CAST(floor(event_id * 8 / (top + 1)) AS BIGINT) AS shard FROM {events} CROSS JOIN (SELECT max(event_id) AS top FROM {events})",
    "SELECT event_id, CAST(floor(event_id * 8 / (max(event_id) OVER () + 1)) AS BIGINT) AS shard FROM events",
)
@query("equal_chunks", "SELECT doc_id, CAST(ntile(8) OVER (ORDER BY doc_id) AS INTEGER) AS part FROM documents")
def equal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous parts of like size, the first ones a row larger: places come from the counts of blocks of ids, so no window holds the table."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 4096).alias("block"))
    counts = d.groupBy("block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.select("block", before.alias("before"), F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    placed = d.join(blocks, "block").withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("doc_id")) - 1)
    size, longer = F.floor(F.col("total") / 8), F.col("total") % 8
    cut = longer * (size + 1)
    part = F.when(F.col("i") < cut, F.floor(F.col("i") / (size + 1))).otherwise(longer + F.floor((F.col("i") - cut) / F.greatest(size, F.lit(1)))) + 1
    return placed.select("doc_id", part.cast("int").alias("part"))


sql_query("strided_rows", "SELECT event_id, value FROM {events} WHERE event_id BETWEEN 10 AND 900 AND event_id % 7 = 3")
sql_query("gather_rows", "SELECT g.turn, e.event_id, e.value FROM (SELECT turn, conv_id * 5 AS idx FROM {conversations}) g JOIN {events} e ON e.event_id = g.idx")
sql_query("cyclic_padding", "SELECT doc_id, false AS padded FROM {documents} UNION ALL SELECT doc_id, true FROM (SELECT doc_id FROM {documents} ORDER BY doc_id LIMIT 24)")
sql_query("drop_padding", "SELECT event_id FROM {events} WHERE event_id < (SELECT max(event_id) FROM {events}) - 6")
sql_query("rename_columns", "SELECT event_id AS row_id, value AS score, event_type AS kind FROM {events}")
sql_query("column_subset", "SELECT event_id, value FROM {events}")
sql_query("count_windows", "SELECT win, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_id, value, CAST(floor(event_id / 64) AS BIGINT) AS win FROM {events}) GROUP BY win HAVING count(*) = 64")
sql_query("inverse_permutation", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rank_in_user FROM {events}", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS INTEGER) AS rank_in_user FROM events")

# --- reshaping ---

sql_query("unpivot_preference", "SELECT conv_id, label, md5(body) AS digest FROM (SELECT conv_id, true AS label, text AS body FROM {conversations} WHERE turn = 1 UNION ALL SELECT conv_id, false, text FROM {conversations} WHERE turn = 0)")
sql_query(
    "render_messages",
    "SELECT conv_id, md5(array_join(transform(array_sort(collect_list(struct(turn, role, text))), m -> '<|' || m.role || '|>' || m.text), '')) AS digest FROM {conversations} GROUP BY conv_id",
    "SELECT conv_id, md5(string_agg('<|' || role || '|>' || text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
)
sql_query("length_filter", "SELECT conv_id FROM {conversations} WHERE turn = 0 AND length(text) <= 512")
sql_query("not_all_same", "SELECT user_id FROM {events} GROUP BY user_id HAVING NOT (min(event_type) = max(event_type))")
sql_query("demo_formats", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || ' | ' || source WHEN 1 THEN lang || ' -> ' || source WHEN 2 THEN lang || ' (' || source || ')' ELSE lang || ': ' || source END AS demo FROM {documents}")
sql_query("question_position", "SELECT item_id, md5(CASE item_id % 3 WHEN 0 THEN text || ' Q' WHEN 1 THEN 'Q ' || text ELSE 'Q ' || text || ' Q' END) AS digest FROM {benchmark}")
sql_query("token_budget_prefix", "SELECT source, count(*) AS kept FROM (SELECT source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM {documents}) WHERE used <= 20000 GROUP BY source")
sql_query("pad_arrays", "SELECT conv_id, array_join(slice(concat(transform(array_sort(collect_list(turn)), t -> CAST(t AS STRING)), array_repeat('-', 8)), 1, 8), ',') AS padded FROM {conversations} GROUP BY conv_id", "SELECT conv_id, array_to_string((list(CAST(turn AS VARCHAR) ORDER BY turn) || list_transform(range(8), lambda i: '-'))[1:8], ',') AS padded FROM conversations GROUP BY conv_id")
sql_query(
    "common_prefix_length",
    "SELECT c.conv_id, CAST(coalesce(array_min(filter(sequence(1, least(length(c.text), length(d.text))), i -> substr(c.text, i, 1) <> substr(d.text, i, 1))) - 1, least(length(c.text), length(d.text))) AS BIGINT) AS lcp FROM (SELECT conv_id, text FROM {conversations} WHERE turn = 0) c JOIN (SELECT conv_id, text FROM {conversations} WHERE turn = 1) d ON c.conv_id = d.conv_id WHERE length(c.text) > 0 AND length(d.text) > 0",
    "SELECT c.conv_id, CAST(coalesce(list_min(list_filter(range(1, least(length(c.text), length(d.text)) + 1), lambda i: substr(c.text, i, 1) <> substr(d.text, i, 1))) - 1, least(length(c.text), length(d.text))) AS BIGINT) AS lcp FROM (SELECT conv_id, text FROM conversations WHERE turn = 0) c JOIN (SELECT conv_id, text FROM conversations WHERE turn = 1) d ON c.conv_id = d.conv_id WHERE length(c.text) > 0 AND length(d.text) > 0",
)
sql_query("flatten_nested", "SELECT event_id, s.kind AS kind, s.score AS score FROM (SELECT event_id, named_struct('kind', event_type, 'score', value) AS s FROM {events})", "SELECT event_id, s.kind AS kind, s.score AS score FROM (SELECT event_id, {'kind': event_type, 'score': value} AS s FROM events)")
sql_query("bracket_cleanup", "SELECT doc_id, md5(replace(regexp_replace(replace('a [title] b [x]  ' || text, ' [title]', '. '), '\\\\[[^\\\\]]*\\\\]', ''), '  ', ' ')) AS digest FROM {documents}", "SELECT doc_id, md5(replace(regexp_replace(replace('a [title] b [x]  ' || text, ' [title]', '. '), '\\[[^\\]]*\\]', '', 'g'), '  ', ' ')) AS digest FROM documents")
sql_query("loss_mask", "SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS trained, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END) AS BIGINT) AS ignored FROM {conversations} GROUP BY conv_id")


@query(
    "text_windows",
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM documents)
    SELECT doc_id, i AS window_id, i * 80 AS start_word, least((i + 1) * 80, len(ws)) AS end_word, md5(array_to_string(ws[i * 80 + 1 : (i + 1) * 80], ' ')) AS digest
    FROM (SELECT doc_id, ws, unnest(range(0, CAST(ceil(len(ws) / 80.0) AS BIGINT))) AS i FROM w)""",
)
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of 80 words: plain arithmetic on positions, exploded within the row."""
    from weftline.functions.text import tokens

    d = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    size = F.size("ws")
    part = lambda i: F.struct(i.alias("i"), F.least((i + 1) * WORD_WINDOW, size).alias("end"), F.array_join(F.slice("ws", i * WORD_WINDOW + 1, F.lit(WORD_WINDOW)), " ").alias("text"))
    d = d.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(size / WORD_WINDOW).cast("int") - 1), part)).alias("w"))
    return d.select("doc_id", F.col("w.i").cast("long").alias("window_id"), (F.col("w.i") * WORD_WINDOW).cast("long").alias("start_word"), F.col("w.end").cast("long").alias("end_word"), F.md5(F.col("w.text").cast("binary")).alias("digest"))


@query(
    "concat_and_cut",
    """WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM conversations),
    f AS (SELECT conv_id, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) - 1 AS g FROM (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM t))
    SELECT conv_id, g // 32 AS chunk, count(*) AS n, md5(string_agg(w, ' ' ORDER BY g)) AS digest FROM f GROUP BY conv_id, g // 32""",
)
def concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a conversation as one stream, cut every 32."""
    from weftline.functions.text import tokens

    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", tokens(F.col("text")).alias("ws")).alias("t"))
    g = c.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["ws"])).alias("ws")).where(F.size("ws") > 0)
    part = lambda i: F.struct(i.alias("chunk"), F.slice("ws", i * 32 + 1, F.lit(32)).alias("ws"))
    g = g.select("conv_id", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.size("ws") / 32).cast("int") - 1), part)).alias("c"))
    return g.select("conv_id", F.col("c.chunk").cast("long").alias("chunk"), F.size("c.ws").cast("long").alias("n"), F.md5(F.array_join("c.ws", " ").cast("binary")).alias("digest"))
