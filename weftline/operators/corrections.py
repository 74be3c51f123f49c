"""Rejection by divergence of two policies, messages cut at marks, nested questions, votes, moments of many metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import tokens
from weftline.operators.groupstats import RO, rollouts
from weftline.plans.registry import query
from weftline.sources.tables import table

#: The statistics that a rollout may be rejected by.
STATISTICS = ["token_k1", "token_k2", "token_k3", "seq_sum_k1", "seq_sum_k2", "seq_sum_k3", "seq_mean_k1", "seq_mean_k2", "seq_mean_k3", "seq_max_k2", "seq_max_k3"]
BOUND = 20.0


def divergence(log_ratio: Column, kind: str) -> Column:
    r = F.least(F.greatest(log_ratio, F.lit(-BOUND)), F.lit(BOUND))
    return {"k1": -r, "k2": 0.5 * r * r, "k3": F.exp(r) - 1.0 - r}[kind]


def kept(log_ratio: Column, options: dict[str, tuple[float | None, float]], sequence: Window) -> Column:
    """Whether a token passes all options: a statistic's name with its lower and upper threshold, for k1 both, for the others the upper one. A sequence's statistic holds for all its tokens."""
    passes = F.lit(True)
    for name, (low, high) in options.items():
        if name not in STATISTICS:
            raise ValueError(f"no statistic {name}; there are {STATISTICS}")
        level, *how, kind = name.split("_")
        x = divergence(log_ratio, kind)
        x = x if level == "token" else {"sum": F.sum, "mean": F.avg, "max": F.max}[how[0]](x).over(sequence)
        passes = passes & (x <= high) & ((x >= low) if kind == "k1" and low is not None else F.lit(True))
    return passes


LIMITS = {
    "token_k1": (-0.9, 0.4), "token_k2": (None, 0.4), "token_k3": (None, 0.7), "seq_sum_k1": (-3.0, 3.0), "seq_sum_k2": (None, 2.0), "seq_sum_k3": (None, 3.0),
    "seq_mean_k1": (-0.3, 0.2), "seq_mean_k2": (None, 0.1), "seq_mean_k3": (None, 0.12), "seq_max_k2": (None, 0.6), "seq_max_k3": (None, 1.0),
}


def _limit(name: str) -> str:
    low, high = LIMITS[name]
    level, *how, kind = name.split("_")
    x = kind if level == "token" else f"({'max' if how[0] == 'max' else 'avg' if how[0] == 'mean' else 'sum'}({kind}) OVER (PARTITION BY user_id, event_type))"
    return f"{x} <= {high}" + (f" AND {x} >= {low}" if low is not None else "")


@query(
    "rejection_masks",
    f"SELECT event_id, {', '.join(f'{_limit(n)} AS {n}' for n in STATISTICS)}, {' AND '.join(_limit(n) for n in STATISTICS)} AS keep FROM (SELECT *, -d AS k1, d * d / 2 AS k2, exp(d) - 1 - d AS k3 FROM (SELECT event_id, user_id, event_type, (value - 30) / 60e0 AS d FROM {RO}))",
)
def rejection_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens kept under each of the eleven statistics, and under all."""
    # a threshold may be met exactly: sums are in the order of events, however the rows are dealt
    d, s = (F.col("value") - 30) / 60.0, Window.partitionBy("user_id", "event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rollouts(spark, sf_dir).select("event_id", *(kept(d, {n: LIMITS[n]}, s).alias(n) for n in STATISTICS), kept(d, LIMITS, s).alias("keep"))


# --- messages ---


def segments(content: Column) -> Column:
    """Content cut at <image> and <video> into typed parts, without empty ones; an image's or video's part has no text."""
    parts = F.filter(F.split(content, r"(?=<image>|<video>)|(?<=<image>|<video>)"), lambda p: p != "")
    kind = lambda p: F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text")
    return F.transform(parts, lambda p: F.struct(kind(p).alias("type"), F.when(~p.isin("<image>", "<video>"), p).alias("text")))


@query(
    "placeholder_segments",
    """WITH c AS (SELECT conv_id, turn, left(text, 10) AS a, substr(text, 11) AS b FROM conversations), s AS (SELECT conv_id, turn, list_filter([{'t': 'text', 'x': a}, {'t': 'image', 'x': '-'}] || CASE WHEN turn % 2 = 0 THEN [{'t': 'text', 'x': b}, {'t': 'video', 'x': '-'}] ELSE [{'t': 'image', 'x': '-'}, {'t': 'text', 'x': b}] END, lambda p: p.x <> '') AS ps FROM c)
    SELECT conv_id, turn, CAST(i - 1 AS INT) AS place, ps[i].t AS type, nullif(ps[i].x, '-') AS text FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM s)""",
)
def placeholder_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with an image after ten characters and a video at the end, or a second image."""
    a, b = F.left("text", F.lit(10)), F.substring(F.col("text"), F.lit(11), F.length("text"))
    content = F.when(F.col("turn") % 2 == 0, F.concat(a, F.lit("<image>"), b, F.lit("<video>"))).otherwise(F.concat(a, F.lit("<image><image>"), b))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(segments(content)).alias("place", "p"))
    return c.select("conv_id", "turn", "place", "p.type", "p.text")


CALL = T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.MapType(T.StringType(), T.StringType()))])


def tool_calls(s: Column) -> Column:
    """The calls between <tool_call> marks that are JSON with a name; others are left out."""
    found = F.transform(F.regexp_extract_all(s, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1)), lambda x: F.from_json(x, CALL))
    return F.filter(found, lambda c: c.isNotNull() & c["name"].isNotNull())


@query(
    "tool_calls",
    "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS place, event_type AS name, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 5 <> 0",
)
def tool_calls_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as one text of calls, every fifth of them malformed: the calls in order and an argument."""
    e = table(spark, sf_dir, "events")
    call = F.concat(F.lit('{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.lit("}")))
    text = F.concat(F.lit("so\n<tool_call>\n"), call, F.lit("\n</tool_call> then "))
    said = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", text.alias("t")))), lambda x: x["t"]), "").alias("s"))
    return said.select("user_id", F.posexplode(tool_calls(F.col("s"))).alias("place", "c")).select("user_id", "place", "c.name", F.col("c.arguments")["k"].alias("k"))


@query(
    "flattened_questions",
    "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS question, turn % 4 AS gold, role = 'user' AS difficult, md5(text) AS digest FROM conversations",
)
def flattened_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a list of questions, a row for each: gold options counted from 0 rather than 1, difficulty as a truth value."""
    q = F.struct("turn", (F.col("turn") % 4 + 1).alias("gold_label"), F.when(F.col("role") == "user", 1).otherwise(0).alias("difficult"), "text")
    articles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(q)).alias("questions"))
    rows = articles.select("conv_id", F.posexplode("questions").alias("question", "q"))
    return rows.select("conv_id", "question", (F.col("q.gold_label") - 1).alias("gold"), (F.col("q.difficult") == 1).alias("difficult"), F.md5(F.col("q.text").cast("binary")).alias("digest"))


def all_true(votes: Column) -> Column:
    """-1 if a vote is, 1 if all are 1, else 0; other votes than -1, 0 and 1 are an error."""
    odd = F.exists(votes, lambda v: ~F.coalesce(v.isin(-1, 0, 1), F.lit(False)))
    return F.when(odd, F.raise_error(F.lit("a vote is -1, 0 or 1")).cast("int")).when(F.array_contains(votes, -1), -1).when(F.forall(votes, lambda v: v == 1), 1).otherwise(0)


@query(
    "vote_combiner",
    f"SELECT user_id, event_type, CASE WHEN min(v) = -1 THEN -1 WHEN min(v) = 1 THEN 1 ELSE 0 END AS vote FROM (SELECT user_id, event_type, CASE WHEN k < 3 THEN -1 WHEN k < 20 THEN 0 ELSE 1 END AS v FROM {RO}) GROUP BY user_id, event_type",
)
def vote_combiner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judges' votes on each answer as one."""
    v = F.when(F.col("k") < 3, -1).when(F.col("k") < 20, 0).otherwise(1)
    return rollouts(spark, sf_dir).groupBy("user_id", "event_type").agg(F.collect_list(v).alias("votes")).select("user_id", "event_type", all_true(F.col("votes")).alias("vote"))


@query(
    "reference_answers",
    "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN CAST(length(text) AS VARCHAR) || CAST(conv_id % 10 AS VARCHAR) WHEN turn % 3 = 1 THEN '-' || length(text) || '.5' END AS answer FROM conversations",
)
def reference_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number after the mark at a solution's end, without commas; none where the mark is missing."""
    n = F.length("text").cast("string")
    mark = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\n#### "), n, F.lit(","), (F.col("conv_id") % 10).cast("string"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(" #### 7\n#### -"), n, F.lit(".5"))).otherwise("")
    s = F.concat("text", mark)
    found = F.regexp_extract(s, r"(?s).*#### (-?[0-9.,]+)", 1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(found != "", F.replace(found, F.lit(","), F.lit(""))).alias("answer"))


# --- arrays and moments ---


def truncated(df: DataFrame, n: int) -> DataFrame:
    """Every list column cut to its first ``n`` elements; other columns stay."""
    return df.select(*(F.slice(f.name, 1, n).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema))


@query(
    "truncate_arrays",
    "SELECT vec_id, label, round(list_sum(list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE))), 5) AS head_sum, CAST(16 AS INT) AS n_first, CAST(16 AS INT) AS n_second FROM embeddings",
)
def truncate_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All list columns at once."""
    v = table(spark, sf_dir, "embeddings").withColumn("places", F.sequence(F.lit(1), F.size("embedding")))
    t = truncated(v, 16)
    return t.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("head_sum"), F.size("embedding").alias("n_first"), F.size("places").alias("n_second"))


_FIFTEEN = [f"({a} {op} {b}) / 7e0" for a in ("value", "k", "value * 0.5") for op, b in (("+", "1"), ("*", "2"), ("-", "k * 0.25"), ("*", "k"), ("+", "value"))]


@query(
    "fifteen_moments",
    f"SELECT event_type, {', '.join(f'round(sum({e}) / count(*), 6) AS mean_{i}, round(sqrt(greatest(var_pop({e}) * count(*) / (count(*) - 1), 0)), 5) AS std_{i}' for i, e in enumerate(_FIFTEEN))} FROM {RO} GROUP BY event_type",
)
def fifteen_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sample deviation of fifteen metrics in one aggregate."""
    both = [x for i, e in enumerate(_FIFTEEN) for x in (F.round(F.avg(F.expr(e)), 6).alias(f"mean_{i}"), F.round(F.stddev_samp(F.expr(e)), 5).alias(f"std_{i}"))]
    return rollouts(spark, sf_dir).groupBy("event_type").agg(*both)


@query(
    "value_types",
    "SELECT kind, count(*) AS n, count(DISTINCT v) AS distinct_values FROM (SELECT CASE WHEN regexp_full_match(v, '-?[0-9]+') THEN 'integer' WHEN regexp_full_match(v, '-?[0-9]*\\.[0-9]+') THEN 'decimal' WHEN v = '' THEN 'empty' ELSE 'text' END AS kind, v FROM (SELECT unnest([lang, CAST(n_chars AS VARCHAR), CAST(n_chars AS VARCHAR) || '.5', CASE WHEN n_chars % 2 = 0 THEN '' ELSE source END]) AS v FROM documents)) GROUP BY kind",
)
def value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by their type, with how many there are and how many differ."""
    n = F.col("n_chars").cast("string")
    v = F.explode(F.array(F.col("lang"), n, F.concat(n, F.lit(".5")), F.when(F.col("n_chars") % 2 == 0, "").otherwise(F.col("source"))))
    d = table(spark, sf_dir, "documents").select(v.alias("v"))
    kind = F.when(F.col("v").rlike("^-?[0-9]+$"), "integer").when(F.col("v").rlike(r"^-?[0-9]*\.[0-9]+$"), "decimal").when(F.col("v") == "", "empty").otherwise("text")
    return d.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("v").alias("distinct_values"))


@query(
    "tiled_rows",
    "SELECT doc_id, r, doc_id * 3 + r AS interleaved, r * (SELECT max(doc_id) + 1 FROM documents) + doc_id AS tiled FROM documents, (SELECT unnest(range(3)) AS r)",
)
def tiled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row three times, with its place where copies follow their row and where the whole table is repeated; ids run from 0."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    top = F.broadcast(d.agg((F.max("doc_id") + 1).alias("n")))
    rows = d.select("doc_id", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("r")).crossJoin(top)
    return rows.select("doc_id", "r", (F.col("doc_id") * 3 + F.col("r")).alias("interleaved"), (F.col("r") * F.col("n") + F.col("doc_id")).alias("tiled"))


@query(
    "split_rows",
    "SELECT vec_id * 4 + i AS row_id, vec_id, label, round(list_sum(list_transform(embedding[i * 16 + 1:i * 16 + 16], lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings, (SELECT unnest(range(4)) AS i)",
)
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's list in four parts, a row for each, with its other columns repeated; lists that four doesn't divide are an error."""
    n = F.size("embedding")
    part = F.when(n % 4 != 0, F.raise_error(F.lit("four doesn't divide the list")).cast("int")).otherwise((n / 4).cast("int"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.cast("long").alias("i"), F.slice("embedding", i * part + 1, part).alias("e")))
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(rows).alias("r"))
    return v.select((F.col("vec_id") * 4 + F.col("r.i")).alias("row_id"), "vec_id", "label", F.round(F.aggregate("r.e", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(
    "word_f1",
    r"""WITH p AS (SELECT c.conv_id, c.turn, regexp_extract_all(lower(c.text), '[\p{L}\p{N}_]+') AS a, regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]+') AS b FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND d.turn = c.turn + 2)
    SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 0e0 ELSE 2e0 * coalesce(list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))), 0) / (len(a) + len(b)) END, 6) AS f1 FROM p""",
)
def word_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of the words, without punctuation, of a turn and the one after the next."""
    from weftline.functions.text import multiset_f1
    from weftline.operators.articles import words_of

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", words_of(F.col("text")).alias("a"))
    other = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("a").alias("b"))
    return c.join(other, ["conv_id", "turn"]).select("conv_id", "turn", F.round(multiset_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query(
    "answer_penalties",
    "SELECT conv_id, turn, round(CASE WHEN n > 60 THEN -0.5e0 WHEN n > 40 THEN -(n - 40) / 40e0 ELSE 0e0 END + CASE WHEN turn % 2 = 0 THEN 1e0 ELSE 0e0 END, 6) AS score FROM (SELECT conv_id, turn, least(len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')), 60) AS n FROM conversations)",
)
def answer_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and the additive penalty for what is over 40 words, in full at 20 more with half weight, of answers cut at 60."""
    n = F.least(F.size(tokens(F.col("text"))), F.lit(60))
    penalty = F.least(-(n - 40) / 20.0 * 0.5, F.lit(0.0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round((F.col("turn") % 2 == 0).cast("double") + penalty, 6).alias("score"))
