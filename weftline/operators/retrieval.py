"""Retrieval: BM25 over a kept index, exact vector top-k, ranking measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.nearest import FOUND, Best, matrix
from weftline.operators.postings import STOP_WORDS, bm25
from weftline.plans.registry import query, sql_query
from weftline.sources.tables import table

#: Queries of a block, which is broadcast: some MB of vectors.
QUERY_BLOCK = 20_000
#: Vectors that one task multiplies with a block of queries, at least; their number grows where tasks(), for all blocks together, are enough.
TASK_VECTORS = 8192
_TERMS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND t NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "))"
_BM25 = f"""q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark), d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), z AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d),
    s AS (SELECT q.item_id, tf.doc_id, round(sum(ln(1 + (z.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len(d.ts) / z.mean))), 6) AS score
    FROM q JOIN tf USING (term) JOIN df USING (term) JOIN d ON d.doc_id = tf.doc_id, z GROUP BY q.item_id, tf.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@query("bm25_top_k", f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 10")
def bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text"), 10)


@query("bm25_minus_judged", f"WITH {_BM25} SELECT item_id, doc_id, rank FROM r WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.doc_id)")
def bm25_minus_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked list without judged documents, its order kept."""
    top = bm25_top_k(spark, sf_dir)
    return top.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("item_id", "doc_id", "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _plain(c: str, dim: int) -> Column:
    """Whether a vector has ``dim`` finite components."""
    return F.coalesce((F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def _row_by_row(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, vec_id, score) of all pairs, whatever their vectors are."""
    q = queries.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qe"))
    return vectors.crossJoin(F.broadcast(q)).where("vec_id <> qid").select("qid", "vec_id", F.round(dot(F.col("qe"), F.col("embedding")), 6).alias("score"))


def tasks(spark: SparkSession) -> int:
    """Tasks that keep a cluster busy: what leaves a search is the best of each query from each of them."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, score, rank): the best ``k`` by inner product.

    The queries are counted and meet all vectors in blocks of about QUERY_BLOCK
    of them, each of which is broadcast and multiplied with a block of vectors
    as matrices; a partial top-k leaves each task before the shuffle. Vectors
    with missing or infinite components, or of another length, have scores
    without a number and are few: they are paired row by row.
    """
    spark = vectors.sparkSession
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    blocks, dim = max(1, -(-size["n"] // QUERY_BLOCK)), max(size["dim"] or 0, 1)
    of = lambda rows, plain: rows.where(_plain("embedding", dim) if plain else ~_plain("embedding", dim)).select("vec_id", "embedding")
    n = vectors.agg(F.count("*").alias("n"), F.sum((~_plain("embedding", dim)).cast("long")).alias("odd")).first()
    parts = max(1, min(-(-n["n"] // TASK_VECTORS), -(-tasks(spark) // blocks)))
    dealt = of(vectors, True).where("vec_id IS NOT NULL").repartition(parts, "vec_id")
    out = _row_by_row(of(queries, False), vectors) if of(queries, False).limit(1).count() else None
    if n["odd"]:
        odd = _row_by_row(of(queries, True), of(vectors, False))
        out = odd if out is None else out.union(odd)
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        block = of(mine, True).where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").toArrow().combine_chunks()
        held = (block.column("vec_id").to_numpy(), matrix(block.column("embedding").combine_chunks(), dim)) if block.num_rows else (np.empty(0, np.int64), np.empty((0, dim)))
        found = dealt.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_best_of(spark.sparkContext.broadcast(held), k, dim), FOUND)
        out = found if out is None else out.union(found)
    return out.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def _best_of(held, k: int, dim: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*held.value, k)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"), dim))
        yield best.found()

    return of


_DOT = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


@query(
    "vector_top_k",
    f"""SELECT qid, vec_id, score, rank FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM
    (SELECT q.vec_id AS qid, v.vec_id, round({_DOT}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id)) WHERE rank <= 10""",
)
def vector_top_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_top_k(v.where("vec_id % 20 = 0"), v, 10)


@query(
    "filtered_vector_top_n",
    f"""SELECT qid, vec_id, score, rank FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM
    (SELECT q.vec_id AS qid, v.vec_id, round({_DOT}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.label % 2 = 1 AND v.vec_id <> q.vec_id)) WHERE rank <= 5""",
)
def filtered_vector_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter before ranking: no doubling of k is needed."""
    v = table(spark, sf_dir, "embeddings")
    return vector_top_k(v.where("vec_id % 20 = 0").select("vec_id", "embedding"), v.where("label % 2 = 1").select("vec_id", "embedding"), 5)


def ndcg(ranking: Column, grades: Column, k: int) -> Column:
    """NDCG at ``k`` of an array of grades in ranked order against all grades; 0 where the ideal is 0."""
    gain = lambda g: F.aggregate(F.transform(F.slice(g, 1, k), lambda x, i: x / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)
    ideal = gain(F.reverse(F.array_sort(grades)))
    return F.when(ideal == 0, F.lit(0.0)).otherwise(gain(ranking) / ideal)


@query(
    "ndcg_at_10",
    """WITH g AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS grade,
    row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 DESC, event_id) AS i FROM events)
    SELECT user_id, round(CASE WHEN sum(CASE WHEN i <= 10 THEN grade / log2(i + 1) ELSE 0 END) = 0 THEN 0 ELSE sum(CASE WHEN r <= 10 THEN grade / log2(r + 1) ELSE 0 END) / sum(CASE WHEN i <= 10 THEN grade / log2(i + 1) ELSE 0 END) END, 6) AS ndcg FROM g GROUP BY user_id""",
)
def ndcg_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings are cut to ten per user before anything is collected."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.get_json_object("props", "$.k").cast("int") % 4).alias("grade"))
    top = lambda *order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    e = e.withColumn("r", top(F.desc("value"), "event_id")).withColumn("i", top(F.desc("grade"), "event_id")).where("r <= 10 OR i <= 10")
    gain = lambda c: F.sum(F.when(F.col(c) <= 10, F.col("grade") / F.log2(F.col(c) + 1.0)).otherwise(0.0))
    g = e.groupBy("user_id").agg(gain("r").alias("dcg"), gain("i").alias("ideal"))
    return g.select("user_id", F.round(F.when(F.col("ideal") == 0, F.lit(0.0)).otherwise(F.col("dcg") / F.col("ideal")), 6).alias("ndcg"))


sql_query("gold_ranking", "SELECT user_id, array_join(transform(slice(array_sort(collect_list(struct(-grade AS g, event_id))), 1, 5), s -> CAST(s.event_id AS STRING)), ' > ') AS ranking FROM (SELECT user_id, event_id, CAST(get_json_object(props, '$.k') AS INT) % 4 AS grade FROM {events}) GROUP BY user_id", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ' > ' ORDER BY rn) AS ranking FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 DESC, event_id) AS rn FROM events) WHERE rn <= 5 GROUP BY user_id")
sql_query("best_n_candidates", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM {events}) WHERE rn <= 3")
sql_query("query_max_depth", "SELECT source, max(n_chars) AS depth FROM {documents} GROUP BY source")
sql_query("integer_thirds", "SELECT doc_id, CAST(floor(doc_id / 3) + CASE WHEN doc_id % 3 >= 1 THEN 1 ELSE 0 END AS BIGINT) AS dense, CAST(floor(doc_id / 3) + CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END AS BIGINT) AS sparse, CAST(floor(doc_id / 3) AS BIGINT) AS rest FROM {documents}")
sql_query("over_fetch", "SELECT doc_id, CAST(ceil(1.6 * doc_id) AS BIGINT) AS depth FROM {documents}")
