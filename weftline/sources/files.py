"""File sources and sinks: declared schemas, path tags, delimited judgements, JSON lines, casts."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

JUDGEMENTS = T.StructType([T.StructField("qid", T.StringType()), T.StructField("pid", T.StringType()), T.StructField("grade", T.IntegerType())])


def scan(spark: SparkSession, paths: list[str], schema: T.StructType | None = None, head: int | None = None, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Parquet or JSON files by their ending, as one table; other endings are an error. ``head``: the first rows in file order; ``sample``: that many by a hash of their values, the same on every run."""
    kinds = {"parquet" if p.endswith(".parquet") else "json" if p.endswith((".json", ".jsonl", ".gz", ".bz2")) else "" for p in paths}
    if len(kinds) != 1 or "" in kinds:
        raise ValueError(f"not all Parquet or all JSON: {paths}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.format(kinds.pop()).load(paths)
    if head is not None:
        return in_file_order(df).orderBy("_file", "_block", "_row").limit(head).select(*df.columns)
    if sample is not None:
        return df.orderBy(F.xxhash64(F.lit(seed), *(F.col(c).cast("string") for c in df.columns))).limit(sample)
    return df


def in_file_order(df: DataFrame) -> DataFrame:
    """A scan with _file, _block and _row, by which its rows are in the order of their files: a row's number grows within a block, blocks by their place."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))


def numbered(df: DataFrame, name: str = "id") -> DataFrame:
    """A scan with a running number from 0 in file order. Counts of blocks give offsets, so no task sees all rows."""
    d = in_file_order(df)
    counts = d.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_row")) - 1
    return d.withColumn("_own", own).join(F.broadcast(before), ["_file", "_block"]).select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text) of JSON lines, plain or compressed, whose text is a list of sentences; ids run in file order."""
    schema = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.ArrayType(T.StringType()))])
    return numbered(spark.read.schema(schema).json(path)).select("id", "title", F.array_join("text", "").alias("text"))


def line_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, offset, bytes) of each line of text files: where a reader finds it without the lines before.

    A file is read in blocks of spark.sql.files.maxPartitionBytes, a line at a
    seam once. Lines are counted within their block; where a block begins is
    the sum over the blocks before it, of which a window sees one row each.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    d = in_file_order(lines).select("_file", "_block", "_row", (F.octet_length("value") + 1).cast("long").alias("bytes"))
    blocks = d.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_file", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("_file", "_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("line", F.count("*").over(own)).withColumn("offset", F.coalesce(F.sum("bytes").over(own), F.lit(0)))
    return placed.join(starts, ["_file", "_block"]).select(F.col("_file").alias("file"), (F.col("lines") + F.col("line")).alias("line"), (F.col("start") + F.col("offset")).alias("offset"), (F.col("bytes") - 1).alias("bytes"))


def messages(df: DataFrame, column: str = "messages") -> DataFrame:
    """Rows with a list of messages, nested or as JSON, one row for each message with its turn."""
    kind = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
    value = F.from_json(column, kind) if isinstance(df.schema[column].dataType, T.StringType) else F.col(column)
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(value).alias("turn", "message")).select(*rest, "turn", F.col("message.role").alias("role"), F.col("message.content").alias("content"))


def preference_pairs(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(prompt, chosen, rejected) of rows that name them otherwise; the scan reads no more."""
    return df.select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def named_split(spark: SparkSession, name: str, context: str) -> DataFrame:
    """A Parquet file if the name is one, else the validation split for a context length in that folder."""
    return spark.read.parquet(name if name.endswith(".parquet") else f"{name}/val_{context}.parquet")


def _store(spark: SparkSession, path: str):
    """(Hadoop path, its file system): any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store it is. A session that has ended has nothing left to delete with."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jvm is None:
        return
    try:
        target, store = _store(spark, path)
        store.delete(target, True)
    except Exception:  # noqa: BLE001  the gateway may be gone when the interpreter ends
        return


def shared_path(spark: SparkSession) -> str:
    """An unused path in a folder of its own in spark.checkpoint.dir, which all executors share; the folder goes when the driver ends. A local session may leave the setting unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="weftline-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    own = f"{folder.rstrip('/')}/weftline-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, own)
    return f"{own}/data"


def exists(spark: SparkSession, path: str) -> bool:
    target, store = _store(spark, path)
    return store.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it isn't there."""
    target, store = _store(spark, path)
    return [f.getPath().getName() for f in store.listStatus(target)] if store.exists(target) else []


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not be there yet; False if it is. One of several writers succeeds."""
    target, store = _store(spark, path)
    try:
        out = store.create(target, False)
    except Exception:  # noqa: BLE001  whatever a store says of a file that is there
        if store.exists(target):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def folder_digest(spark: SparkSession, paths: list[str]) -> str:
    """A digest of names, sizes and times of all files in the folders of ``paths``: another one when a file is written anew."""
    rows = []
    for folder in sorted({p.rsplit("/", 1)[0] for p in paths}):
        target, store = _store(spark, folder)
        rows += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in store.listStatus(target)]
    return hashlib.sha256("\n".join(sorted(rows)).encode()).hexdigest()


def first_source(spark: SparkSession, paths: list[str]) -> str:
    """The first of several places that exists: a cache, raw files, a mirror. None is an error."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {paths}")


def cached_copy(spark: SparkSession, path: str, cache: str, again: bool = False) -> str:
    """A copy of a file or folder in the shared folder ``cache``, named by the MD5 of its path; made once, or ``again``."""
    target = f"{cache.rstrip('/')}/{hashlib.md5(path.encode()).hexdigest()}/{path.rstrip('/').rsplit('/', 1)[-1]}"
    if again or not exists(spark, target):
        (a, from_store), (b, to_store) = _store(spark, path), _store(spark, target)
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(from_store, a, to_store, b, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    return target


def nested(df: DataFrame, path: str, name: str) -> DataFrame:
    """The value at a dotted path as a column; the scan reads no more than that."""
    return df.select(F.col(path).alias(name))


def results(spark: SparkSession, path: str | list[str], schema: T.StructType, per_file: int = 200) -> DataFrame:
    """JSON-line results with model, dataset and context taken from .../model/dataset/context.jsonl; malformed lines are dropped, the first ``per_file`` kept of each file. Of several aliases of a folder the first that exists is read."""
    path = first_source(spark, path) if isinstance(path, list) else path
    df = in_file_order(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path))
    first = F.row_number().over(Window.partitionBy("_file").orderBy("_block", "_row"))
    part = F.split("_file", "/")
    tagged = df.withColumn("n", first).where(F.col("n") <= per_file)
    return tagged.select(*schema.fieldNames(), F.element_at(part, -3).alias("model"), F.element_at(part, -2).alias("dataset"), F.regexp_extract(F.element_at(part, -1), r"^([^.]*)", 1).alias("context"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pid, grade) of white-space-delimited lines "qid 0 pid grade"; lines without four fields are dropped."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(f) == 4)
    return rows.select(f[0].alias("qid"), f[2].alias("pid"), f[3].cast("int").alias("grade"))


def judged(parts: list[DataFrame], items: DataFrame, key: str = "qid") -> DataFrame:
    """The judgements of several years as one table, and of the items those that any of them judges."""
    every = union_configs(parts).distinct()
    return items.join(every.select(key).distinct(), key, "left_semi")


def append_lines(df: DataFrame, path: str) -> None:
    """A wave of results as further JSON lines; what was written before stays, whatever becomes of this one."""
    df.write.mode("append").json(path)


def write_metrics(spark: SparkSession, path: str, step: int, metrics: dict[str, float]) -> None:
    """One JSON line of a step's metrics."""
    append_lines(spark.createDataFrame([(step, {k: float(v) for k, v in metrics.items()})], "step bigint, metrics map<string, double>"), path)


def save_batch(df: DataFrame, path: str, meta: dict[str, str] | None = None) -> None:
    """A batch with what is known about it, as tables rather than pickled objects: any engine reads them and reading runs no code."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(meta or {},)], "meta map<string, string>").write.mode("overwrite").parquet(f"{path}/meta")


def load_batch(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/meta").first()["meta"]


def grown(rows: DataFrame, generated: DataFrame, prompt: str, most: int) -> DataFrame:
    """A dataset with generated rows behind its own, without prompts of more than ``most`` words."""
    return union_configs([rows, generated]).where(F.size(F.split(F.trim(prompt), r"\s+")) <= most)


def write_steps(df: DataFrame, path: str, step: str = "step") -> None:
    """JSON lines, a folder for each step."""
    df.write.mode("append").partitionBy(step).json(path)


def write_typed(df: DataFrame, schema: T.StructType, path: str) -> None:
    """Cast to the declared types, in their order, and write Parquet; a value that doesn't fit is an error."""
    df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)).write.mode("overwrite").parquet(path)


def union_configs(parts: list[DataFrame]) -> DataFrame:
    """The union of tables by column name; missing columns are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
