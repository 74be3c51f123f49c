"""What the operators of this subpackage share: tables cut off from their lineage, words, and components of a graph."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a regular expression and as characters to trim.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\f\r"


#: Bytes of a batch between the JVM and a Python worker, so that long texts come few at a time.
BATCH_BYTES = "4m"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``. Unless the session says otherwise, Python workers then get batches of BATCH_BYTES."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local session may leave it unset (tests) and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` in whatever store it is. A session that has ended has nothing left to delete with."""
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is None or jvm is None:
        return
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the gateway may be gone when the interpreter ends
        return


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once, and free of lineage that a lost executor could break.

    The shuffle files of the evaluation go when it ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables of written() before the driver ends."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            remove(t.sparkSession, path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` also folds other alphabets)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often the body (or a lambda in it) names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of ``text`` in order, repeats included; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def fingerprint_of(pairs: DataFrame) -> tuple:
    """Numbers that two sets of pairs share only if they are equal, but by a chance of about 2**-64."""
    h = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has two columns of one ordered type. Returns (node, component):
    every node that has an edge, with the smallest node that it can reach.
    Alternates large-star and small-star steps; each is a grouping by key, all
    state is a table in the shared folder, which goes when the next round has
    its own, and only three numbers of it reach the driver. A node of very high
    degree is reduced by a partial minimum before its shuffle; no list of its
    neighbours is ever built.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = fingerprint_of(now)
    for _ in range(rounds):
        # large-star: every neighbour above a node goes to the smallest of the node and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written first: then both sides of the joins are plain shuffles, and a node of very high degree can be split over tasks
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        # small-star: the neighbours below a node, and the node, go to the smallest of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        after = written(small, "edges")
        drop(now, low, large, least)
        now, was, before = after, before, fingerprint_of(after)
        if was == before:
            break
    else:
        raise RuntimeError("the components have not settled")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)


#: A side of at most this many ids may be broadcast (a few dozen MB); beyond it the join shuffles both sides.
BROADCAST_IDS = 500_000


def join_ids(rows: DataFrame, ids: DataFrame, how: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """``rows`` joined with ``ids`` (a table already written) on its one id column; ``how`` is left_semi or left_anti.

    The ids are counted first and broadcast only if they are few.
    """
    key = ids.columns[0]
    return rows.join(F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids, key, how)
