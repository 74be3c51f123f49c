"""A vector index that grows: an inverted file whose lists are found in two levels.

A few coarse cells are fitted on a sample, and within each cell its lists. Both
levels are tables beside the vectors, so an index of tens of thousands of lists
puts no centroid into a plan. A vector meets the coarse cells, whose number is
bounded, and then by a join the lists of its cell alone. New vectors are
appended with the centroids that are there.

    path/cells    cell, centre
    path/lists    cell, list, centre
    path/vectors  a folder for each cell; list, vec_id, embedding
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.nearest import FOUND, streamed
from weftline.operators.postings import stored
from weftline.operators.retrieval import _DOT, TASK_VECTORS, tasks, vector_top_k
from weftline.plans.registry import query
from weftline.sources.files import shared_path
from weftline.sources.tables import table

#: Fewer vectors are searched one by one. A list has so many vectors at least.
FLAT, LEAST = 1_000_000, 40
#: Vectors that the coarse cells are fitted on, and for each list so many of its cell's: the bounds of the sample.
COARSE_SAMPLE, LIST_SAMPLE = 50_000, 64
#: Vectors of a cell that one task assigns; a cell of more is dealt over several.
TASK_ROWS = 200_000
#: Queries that one task holds; those of a list that more ask are dealt over several.
TASK_QUERIES = 50_000


def ivf_lists(n: int) -> int:
    """Lists of an inverted file: the root of n, from 4096 to 65536, rounded up to a power of two."""
    lists = 1
    while lists < min(max(n**0.5, 4096), 65536):
        lists *= 2
    return lists


def unit(c: Column) -> Column:
    """A vector at length one; a vector of zeros stays."""
    x = F.transform(c, lambda v: v.cast("double"))
    length = F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)), F.lit(1e-12))
    # bound by a lambda of its own: inside that of the components the length would be summed again for each of them
    return F.get(F.transform(F.array(length), lambda n: F.transform(x, lambda v: (v / n).cast("float"))), F.lit(0))


def prepared(vectors: DataFrame) -> DataFrame:
    """(id, vec) at length one; rows without a vector or id are left out."""
    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), unit(F.col("embedding")).alias("vec"))


def fitted(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres of ``points`` (unit length) by rounds of nearest centre and mean, begun at points spread evenly over them; at most ``k``, as many as there are distinct ones."""
    points = np.unique(points, axis=0)
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(points @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def write_cells(spark: SparkSession, path: str, centres: np.ndarray) -> None:
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<float>").write.mode("overwrite").parquet(f"{path}/cells")


def fit(vectors: DataFrame, path: str, lists: int | None = None, seed: int = 3) -> None:
    """Write the two levels of centres for about ``lists`` lists (ivf_lists() unless given, one for each LEAST vectors at most) and an empty index.

    Cells are as many as the root of the lists, fitted by k-means on at most
    COARSE_SAMPLE vectors chosen by a hash; the lists of a cell on at most
    LIST_SAMPLE of its vectors each, in a task of its own.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = stored(prepared(vectors))
    spark, n = v.sparkSession, v.count()
    lists = max(1, min(lists or ivf_lists(n), n // LEAST))
    cells = max(1, round(lists**0.5))
    each = -(-lists // cells)
    below = lambda most: F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) < F.lit(int(min(1.0, 1.1 * most / max(n, 1)) * 2**53))
    sample = stored(v.where(below(COARSE_SAMPLE)).limit(COARSE_SAMPLE)).repartition(spark.sparkContext.defaultParallelism, "id")
    drawn = sample.select("id", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    if not n:
        raise ValueError("no vectors to fit an index on")
    centres = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(drawn).clusterCenters(), dtype=np.float32)
    write_cells(spark, path, centres)
    # twice the rows that are needed on average, then the first of each cell: cells of few vectors have all of theirs
    share = v.where(below(4 * lists * LIST_SAMPLE)).withColumn("cell", F.get(nearest_cells(spark, path, 1), F.lit(0)))
    first = share.withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(seed)), "id"))).where(F.col("i") <= each * LIST_SAMPLE)
    first = stored(first.select("cell", "vec"))

    def of_cell(found: pa.Table) -> pa.Table:
        vec = found.column("vec").combine_chunks()
        centres = fitted(vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1), each).astype(np.float32)
        return pa.table({"cell": pa.array([found.column("cell")[0].as_py()] * len(centres), pa.int32()), "list": pa.array(range(len(centres)), pa.int32()), "centre": pa.array(list(centres), pa.list_(pa.float32()))})

    found = first.select("cell", "vec").groupBy("cell").applyInArrow(of_cell, "cell int, list int, centre array<float>")
    # a cell that the sample missed has its own centre as its list
    whole = spark.read.parquet(f"{path}/cells")
    bare = whole.join(first.select("cell").distinct(), "cell", "left_anti").select("cell", F.lit(0).alias("list"), "centre")
    found.unionByName(bare).write.mode("overwrite").parquet(f"{path}/lists")
    spark.createDataFrame([], "list int, vec_id bigint, embedding array<float>, cell int").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")


def nearest_cells(spark: SparkSession, path: str, top: int, vec: str = "vec") -> Column:
    """The ``top`` nearest cells of a vector. Cells are the root of the lists, 256 at most for the largest index."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    if not rows:
        raise ValueError(f"the index {path} was fitted on no vectors")
    packed = spark.sparkContext.broadcast(([r["cell"] for r in rows], np.array([r["centre"] for r in rows], dtype=np.float32)))

    def of(vectors: pa.Array) -> pa.Array:
        ids, centres = packed.value
        if not len(vectors):
            return pa.array([], pa.list_(pa.int32()))
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        order = np.argsort(0.5 * (centres * centres).sum(axis=1) - x @ centres.T, axis=1, kind="stable")[:, :top]
        return pa.array(list(np.array(ids, dtype=np.int32)[order]), pa.list_(pa.int32()))

    return F.arrow_udf(of, "array<int>")(F.col(vec))


def nearest_lists(rows: DataFrame, path: str, top: int, parts: int) -> DataFrame:
    """(id, vec, cell, list, near) of ``rows`` (id, vec, cell): the ``top`` lists of their cell that are nearest.

    A cell's lists are one row, which each of the cell's ``parts`` gets; it is
    sorted before the vectors, which stream past it.
    """
    spark = rows.sparkSession
    lists = spark.read.parquet(f"{path}/lists").groupBy("cell").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("list", "centre"))), lambda x: x["centre"])).alias("vec"))
    lists = lists.select("cell", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("id"), "vec")
    mine = rows.select("cell", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "id", "vec")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = half = None
        for batch in batches:
            vec, kind, cell = batch.column("vec"), batch.column("kind").to_numpy(), batch.column("cell").to_numpy()
            flat, ends = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
            seams = sorted({0, len(kind), *np.flatnonzero(kind == 0).tolist(), *(np.flatnonzero(kind == 0) + 1).tolist()})
            for a, b in zip(seams, seams[1:], strict=False):
                values = flat[ends[a] : ends[b]]
                if kind[a] == 0:
                    held = values
                    centres = None
                    continue
                x = values.reshape(b - a, -1)
                if centres is None:
                    centres = held.reshape(-1, x.shape[1])
                    half = 0.5 * (centres * centres).sum(axis=1)
                far = half - x @ centres.T
                order = np.argsort(far, axis=1, kind="stable")[:, :top]
                k = order.shape[1]
                at = pa.array(np.repeat(np.arange(a, b), k))
                yield pa.record_batch([batch.column("id").take(at), vec.take(at), pa.array(np.repeat(cell[a:b], k)), pa.array(order.ravel().astype(np.int32)), pa.array(-np.take_along_axis(far, order, axis=1).ravel().astype(np.float64))], names=["id", "vec", "cell", "list", "near"])

    dealt = lists.unionByName(mine).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    return dealt.mapInArrow(assign, "id bigint, vec array<float>, cell int, list int, near double")


def append(vectors: DataFrame, path: str) -> None:
    """Add vectors to the index; its centres stay as they are."""
    v = stored(prepared(vectors))
    n = v.count()
    placed = v.withColumn("cell", F.get(nearest_cells(v.sparkSession, path, 1), F.lit(0)))
    found = nearest_lists(placed, path, 1, 1 + n // TASK_ROWS)
    found.select("list", F.col("id").alias("vec_id"), F.col("vec").alias("embedding"), "cell").sortWithinPartitions("cell", "list").write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int, cells: int | None = None) -> DataFrame:
    """(qid, vec_id, score, rank): the best ``k`` by cosine in the ``probes`` lists nearest to a query, chosen from those of its ``cells`` nearest cells (four times what the probes fill, unless given). The vector with a query's id is left out."""
    n_cells, n_lists = spark.read.parquet(f"{path}/cells").count(), spark.read.parquet(f"{path}/lists").count()
    cells = min(n_cells, cells or max(4, -(-4 * probes * n_cells // max(n_lists, 1))))
    q = prepared(queries)
    asked = q.select("id", "vec", F.explode(nearest_cells(spark, path, cells)).alias("cell"))
    near = nearest_lists(asked, path, probes, 1)
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("near"), "cell", "list"))
    kept = shared_path(spark)
    near.withColumn("r", best).where(F.col("r") <= probes).select(F.col("id").alias("qid"), F.col("vec").alias("qe"), "cell", "list").write.parquet(kept)
    chosen = spark.read.parquet(kept)
    index = spark.read.schema("list int, vec_id bigint, embedding array<float>, cell int").parquet(f"{path}/vectors")
    # a list is dealt over tasks by vectors and by queries; few parts, since each has a best of each of its queries
    parts = min(1 + index.count() // (max(n_lists, 1) * TASK_VECTORS), -(-tasks(spark) // max(n_lists, 1)))
    turns = 1 + q.count() // TASK_QUERIES
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<int>"))
    turn = lambda c: F.pmod(F.xxhash64(c), F.lit(turns)).cast("int")
    asking = chosen.select("cell", "list", numbers(parts).alias("part"), turn("qid").alias("turn"), F.lit(0).alias("kind"), F.col("qid").alias("id"), F.col("qe").alias("vec"))
    held = index.select("cell", "list", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), numbers(turns).alias("turn"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    keys = ["cell", "list", "part", "turn"]
    dealt = asking.unionByName(held).repartition(tasks(spark), *keys).sortWithinPartitions(*keys, "kind")
    scored = dealt.mapInArrow(streamed(k, *keys), FOUND)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def recall(spark: SparkSession, path: str, vectors: DataFrame, queries: DataFrame, k: int, probes: int) -> float:
    """The share of the true best ``k`` of each query, found by a scan of all vectors, that the index finds."""
    flat = lambda d: prepared(d).select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding"))
    want = vector_top_k(flat(queries), flat(vectors), k).select("qid", "vec_id")
    both = want.join(search(spark, path, queries, k, probes).select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    found = both.agg(F.count("hit").alias("hits"), F.count("*").alias("n")).first()
    return found["hits"] / max(found["n"], 1)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, probes: int = 64) -> DataFrame:
    """vector_top_k() for up to FLAT vectors, an inverted file for more; recall() measures what its probes find."""
    if vectors.limit(FLAT + 1).count() <= FLAT:
        return vector_top_k(queries, vectors, k)
    path = shared_path(vectors.sparkSession)
    fit(vectors, path)
    append(vectors, path)
    return search(vectors.sparkSession, path, queries, k, probes)


@query("ivf_top_k")
def ivf_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against the index of all, 13 of 16 lists.

    These vectors have little structure, so recall 0.9 (measured against the exact search in the tests) takes most lists.
    """
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = shared_path(spark)
    fit(v, path, 16)
    append(v, path)
    return search(spark, path, v.where("vec_id % 20 = 0"), 10, 13)


_COSINE = f"({_DOT}) / sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))) / sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * x)))"


@query(
    "grown_vector_index",
    f"""SELECT qid, vec_id, rank FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM
    (SELECT q.vec_id AS qid, v.vec_id, round({_COSINE}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id)) WHERE rank <= 10""",
)
def grown_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index fitted on a third of the vectors, to which the others are appended in two steps; with all lists probed it finds what a scan finds."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = shared_path(spark)
    fit(v.where("vec_id % 3 = 0"), path, 25)
    for part in range(3):
        append(v.where(F.col("vec_id") % 3 == part), path)
    return search(spark, path, v.where("vec_id % 20 = 0"), 10, 10_000).select("qid", "vec_id", "rank")
