"""File sources and sinks over the tables: each query writes files of the kind that it reads, in the shared folder, and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.files import shared_path as index_path
from weftline.operators.sampling import chance, number
from weftline.plans.registry import query
from weftline.sources import files
from weftline.sources.tables import table

CONVERSATION = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


@query("json_lines_scan", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def json_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed JSON lines with a declared schema, blank and broken lines left out."""
    path = index_path(spark) + ".jsonl"
    lines = table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    lines.union(spark.createDataFrame([("",), ("   ",)], "value string")).write.option("compression", "gzip").text(path)
    rows = files.scan(spark, [path], CONVERSATION)
    return rows.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("message_scan", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS turn, role, length(text) AS n FROM conversations")
def message_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet file of message lists under a nested key, read and unnested."""
    path = index_path(spark) + ".parquet"
    m = F.struct("turn", "role", F.col("text").alias("content"))
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("ms"))
    chats.select("conv_id", F.struct(F.struct(F.transform("ms", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")).alias("chat")).alias("data")).write.parquet(path)
    rows = files.messages(files.scan(spark, [path]).select("conv_id", F.col("data.chat.messages").alias("messages")))
    return rows.select("conv_id", "turn", "role", F.length("content").cast("long").alias("n"))


@query("preference_scan", "SELECT a.conv_id, md5(a.text) AS prompt, md5(b.text) AS chosen, md5(c.text) AS rejected FROM conversations a JOIN conversations b USING (conv_id) JOIN conversations c USING (conv_id) WHERE a.turn = 0 AND b.turn = 1 AND c.turn = 2")
def preference_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs whose columns have other names in the file."""
    path = index_path(spark) + ".parquet"
    c = table(spark, sf_dir, "conversations")
    turn = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    c.groupBy("conv_id").agg(turn(0).alias("question"), turn(1).alias("good"), turn(2).alias("bad")).dropna().write.parquet(path)
    df = files.scan(spark, [path])
    pairs = files.preference_pairs(df.withColumnRenamed("question", "q"), "q", "good", "bad")
    digest = lambda x: F.md5(F.col(x).cast("binary")).alias(x)
    keys = df.select("conv_id", F.col("question").alias("prompt"), F.col("good").alias("chosen"), F.col("bad").alias("rejected"))
    return pairs.join(keys, ["prompt", "chosen", "rejected"]).select("conv_id", digest("prompt"), digest("chosen"), digest("rejected"))


@query(
    "judgement_files",
    "SELECT CAST(d.source AS VARCHAR) AS qid, CAST(l.doc_id AS VARCHAR) AS pid, l.quality + l.toxic AS grade FROM labels l JOIN documents d USING (doc_id)",
)
def judgement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements of two years as text files with a broken line each, and of the documents those that are judged."""
    path = index_path(spark)
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    lines = labels.select((F.col("doc_id") % 2).alias("year"), F.concat_ws(" ", "source", F.lit("Q0"), F.col("doc_id").cast("string"), (F.col("quality") + F.col("toxic")).cast("string")).alias("value"))
    years = []
    for y in (0, 1):
        lines.where(F.col("year") == y).select("value").union(spark.createDataFrame([("no judgement",)], "value string")).write.text(f"{path}-{y}")
        years.append(files.judgements(spark, f"{path}-{y}"))
    judged = files.judged([y.select(F.col("pid"), "qid", "grade") for y in years], table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pid")), "pid")
    return files.union_configs(years).join(judged, "pid", "left_semi").select("qid", "pid", "grade")


@query("result_files", "SELECT 'm' || (user_id % 3) AS model, event_type AS dataset, (user_id % 2 + 1) || 'k' AS context, count(*) AS n, round(avg(value), 5) AS score FROM events GROUP BY ALL")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in folders by model, dataset and context, of which the second name of the folder exists; rows are tagged from their paths."""
    path = index_path(spark)
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("event_type").alias("dataset"), F.concat((F.col("user_id") % 2 + 1).cast("string"), F.lit("k")).alias("context"), F.col("value").alias("score"))
    # one file for each combination; its name is the context, as results are named
    e.write.partitionBy("model", "dataset", "context").json(path)
    folder = files.first_source(spark, [path + "-alias", path])
    rows = spark.read.schema("score double").json(f"{folder}/*/*/*").withColumn("part", F.split(F.input_file_name(), "/"))
    tag = lambda i: F.element_at(F.split(F.element_at("part", i), "="), 2)
    return rows.groupBy(tag(-4).alias("model"), tag(-3).alias("dataset"), tag(-2).alias("context")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("score"))


@query("running_ids", "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS id, conv_id AS title, md5(role || text) AS digest FROM conversations")
def running_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed corpus of articles whose text is a list of sentences; ids run in file order."""
    path = index_path(spark)
    c = table(spark, sf_dir, "conversations").repartitionByRange(3, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    c.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("title"), F.array("role", "text").alias("text"))).alias("value")).write.option("compression", "bzip2").text(path)
    return files.articles(spark, path).select("id", F.col("title").cast("long").alias("title"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "offset_index",
    "SELECT page_id // 200 AS part, row_number() OVER w - 1 AS line, coalesce(sum(octet_length(encode(url)) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at, octet_length(encode(url))::BIGINT AS bytes FROM pages WINDOW w AS (PARTITION BY page_id // 200 ORDER BY page_id)",
)
def offset_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line of text files of 200 addresses begins, in bytes."""
    path = index_path(spark)
    p = table(spark, sf_dir, "pages").select(F.expr("page_id DIV 200").alias("part"), "page_id", F.col("url").alias("value"))
    p.repartition("part").sortWithinPartitions("part", "page_id").drop("page_id").write.partitionBy("part").text(path)
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long")
    return files.line_offsets(spark, path).select(part.alias("part"), "line", F.col("offset").alias("start_at"), "bytes")


TRAINING = T.StructType([T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("split", T.StringType())])


@query(
    "config_datasets",
    "SELECT 'd' || doc_id AS id, source, CAST(n_chars AS INT) AS n, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents UNION ALL SELECT 'p' || page_id, NULL, NULL, 'train' FROM pages UNION ALL SELECT 'b' || item_id, 'benchmark', CAST(length(text) AS INT), 'validation' FROM benchmark",
)
def config_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of several configurations as one, cast to the declared types and written as a file for training and one for validation."""
    split = F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train")
    parts = [
        table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "source", F.col("n_chars").alias("n"), split.alias("split")),
        table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.lit("train").alias("split")),
        table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.lit("benchmark").alias("source"), F.length("text").alias("n"), F.lit("validation").alias("split")),
    ]
    path, every = index_path(spark), files.union_configs(parts)
    for name in ("train", "validation"):
        files.write_typed(every.where(F.col("split") == name), TRAINING, f"{path}/{name}.parquet")
    return files.scan(spark, [f"{path}/train.parquet", f"{path}/validation.parquet"])


@query("step_files", "SELECT event_id // 1000 AS step, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def step_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON lines by step, in two waves of which the second is appended, and what a reader finds."""
    path = index_path(spark)
    e = table(spark, sf_dir, "events").select(F.expr("event_id DIV 1000").alias("step"), "event_id", "value")
    for wave in (0, 1):
        files.write_steps(e.where(F.col("event_id") % 2 == wave), path)
    rows = spark.read.schema("event_id bigint, value double, step bigint").json(path)
    return rows.groupBy("step").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("saved_batches", "SELECT event_id, value, 'events' AS origin FROM events")
def saved_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch saved with what is known of it, copied to a cache and loaded."""
    path = index_path(spark)
    files.save_batch(table(spark, sf_dir, "events").select("event_id", "value"), path, {"origin": "events"})
    rows, meta = files.load_batch(spark, files.cached_copy(spark, path, path + "-cache"))
    return rows.withColumn("origin", F.lit(meta["origin"]))


@query("grown_datasets", "SELECT conv_id, text FROM conversations WHERE turn = 0 AND len(string_split_regex(trim(text), '\\s+')) <= 30 UNION ALL SELECT item_id, text FROM benchmark WHERE len(string_split_regex(trim(text), '\\s+')) <= 30")
def grown_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset with generated rows behind it, without prompts of more than 30 words."""
    own = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", "text")
    return files.grown(own, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("conv_id"), "text"), "text", 30)


# --- drawn rows ---

DRAWS = 2000


@query(
    "weighted_draws",
    f"""WITH c AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) AS hi, n_chars FROM documents), t AS (SELECT max(hi) AS total FROM c),
    u AS (SELECT j, CAST('0x' || substr(md5('draw:' || j), 1, 8) AS BIGINT) * total // 4294967296 AS x FROM (SELECT unnest(range({DRAWS})) AS j), t)
    SELECT doc_id, count(*) AS copies FROM u JOIN c ON u.x >= c.hi - c.n_chars AND u.x < c.hi GROUP BY doc_id""",
)
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn with replacement by their length: each draw is a point on the line of all characters and meets the document there by a join on bins."""
    from weftline.operators.groupstats import exclusive_running_total
    from weftline.operators.relational import interval_join

    line = exclusive_running_total(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    line = line.select("doc_id", F.col("start_at").alias("r_lo"), (F.col("start_at") + F.col("n_chars")).alias("r_hi"))
    total = F.broadcast(table(spark, sf_dir, "documents").agg(F.sum("n_chars").alias("total")))
    draws = spark.range(DRAWS).crossJoin(total).select(F.floor(number("draw", F.col("id")).cast("decimal(20, 0)") * F.col("total") / F.lit(4294967296).cast("decimal(20, 0)")).cast("long").alias("l_lo"))
    both = interval_join(draws.withColumn("l_hi", F.col("l_lo") + 1), line, 65536)
    return both.groupBy("doc_id").agg(F.count("*").alias("copies"))


@query(
    "templates_by_batch",
    "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN ['Seen: ' || event_type || '.', event_type || ' was seen.'][CAST(user_id % 2 + 1 AS INT)] ELSE 'Done: ' || event_type || '.' END AS prompt FROM events",
)
def templates_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template of a row's batch, of several the one that the row chooses; a batch without templates is an error."""
    x = F.col("event_type")
    templates = {"shown": [F.concat(F.lit("Seen: "), x, F.lit(".")), F.concat(x, F.lit(" was seen."))], "other": [F.concat(F.lit("Done: "), x, F.lit("."))]}
    batch = F.when(x.isin("click", "view"), "shown").otherwise("other")
    prompt = F.when(F.lit(False), F.lit(""))
    for name, forms in templates.items():
        prompt = prompt.when(batch == name, F.get(F.array(*forms), (F.col("user_id") % len(forms)).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", prompt.otherwise(F.raise_error(F.concat(F.lit("no template for "), batch)).cast("string")).alias("prompt"))


@query(
    "shuffled_places",
    "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CAST('0x' || substr(md5('10:' || event_id), 1, 8) AS BIGINT), event_id) AS INT) AS new_place, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS old_place FROM events",
)
def shuffled_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permutation of each user's rows, both ways: where each goes, and where it came from."""
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return e.select("event_id", F.row_number().over(w.orderBy(number("10", F.col("event_id")), "event_id")).alias("new_place"), F.row_number().over(w.orderBy("event_id")).alias("old_place"))


@query("half_by_chance", "SELECT doc_id FROM documents WHERE (CAST('0x' || substr(md5('half:' || doc_id), 1, 8) AS BIGINT) + 1) / 4294967296.0 <= 0.5")
def half_by_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the training rows by a hash of their keys."""
    return table(spark, sf_dir, "documents").where(chance("half", F.col("doc_id")) <= 0.5).select("doc_id")
