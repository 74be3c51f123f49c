"""Which texts contain which of very many strings.

The strings are cut into blocks of some MB; of each block every worker builds
one automaton that finds all its strings in one pass over a text, whatever
their number and length. Texts are read once for each block, and only pairs
that hold leave a task: there is no candidate to verify.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.postings import stored
from weftline.plans.registry import query
from weftline.sources.tables import table

#: Characters of the strings of a block: an automaton of some hundred MB at most.
BLOCK_CHARS = 4_000_000


def contained(texts: DataFrame, strings: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(string_id, text_id) for each of ``strings`` (id, string) and each of ``texts`` (id, text) that contains it, as it is written.

    Equal strings are looked for once. Every text contains the empty string;
    null strings and texts match nothing. Ids are kept as they are; rows that
    repeat give a pair once.
    """
    (sid, string), (tid, text) = strings.columns, texts.columns
    wanted = stored(strings.where(F.col(string).isNotNull()).select(F.col(sid).alias("string_id"), F.col(string).alias("string")).distinct())
    t = texts.where(F.col(text).isNotNull()).select(F.col(tid).cast("string").alias("text_id"), F.col(text).alias("text"))
    kind = texts.schema[tid].dataType
    every = wanted.where("string = ''").select("string_id").crossJoin(t.select("text_id")) if wanted.where("string = ''").limit(1).count() else None
    parts = stored(wanted.where("string <> ''").select("string").distinct())
    blocks = -(-int(parts.agg(F.sum(F.length("string"))).first()[0] or 0) // block_chars)
    spark, found = texts.sparkSession, None
    for b in range(blocks):
        mine = parts if blocks == 1 else parts.where(F.pmod(F.xxhash64("string"), F.lit(blocks)) == b)
        packed = spark.sparkContext.broadcast([r["string"] for r in mine.collect()])  # BLOCK_CHARS of them

        def look(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for s in packed.value:
                automaton.add_word(s, s)
            if len(automaton):
                automaton.make_automaton()
            for batch in batches:
                for key, text in zip(batch.column(0), batch.column(1), strict=True):
                    hit = sorted({s for _, s in automaton.iter(text.as_py())}) if len(automaton) else []
                    if hit:
                        yield pa.record_batch([pa.array([key.as_py()] * len(hit), pa.string()), pa.array(hit, pa.string())], names=["text_id", "string"])

        pairs = t.mapInArrow(look, "text_id string, string string")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        found = spark.createDataFrame([], "text_id string, string string")
    out = found.join(wanted, "string").select("string_id", "text_id")
    out = out if every is None else out.unionByName(every)
    return out.select("string_id", F.col("text_id").cast(kind).alias("text_id")).distinct()


@query(
    "answer_document_map",
    "SELECT b.item_id, string_agg(CAST(d.doc_id AS VARCHAR), ',' ORDER BY d.doc_id) AS ids FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY b.item_id",
)
def answer_document_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that contain each answer text, in any case."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("answer"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    pairs = contained(d, b)
    return pairs.groupBy(F.col("string_id").alias("item_id")).agg(F.array_join(F.array_sort(F.collect_list("text_id")).cast("array<string>"), ",").alias("ids"))


_SHORT = "SELECT item_id, n, lower(string_split(text, ' ')[n + 1]) AS answer FROM benchmark, range(12) t(n) WHERE n < len(string_split(text, ' '))"


@query(
    "short_answer_counts",
    f"SELECT item_id, CAST(n AS INT) AS n, answer, count(d.doc_id) AS docs FROM ({_SHORT}) a LEFT JOIN documents d ON contains(lower(d.text), answer) GROUP BY ALL",
)
def short_answer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents contain each of an item's first twelve words as a string, parts of longer words included: answers of a few letters, thousands of them."""
    words = F.posexplode(F.transform(F.slice(F.split("text", " "), 1, 12), lambda w: F.lower(w)))
    a = table(spark, sf_dir, "benchmark").select("item_id", words.alias("n", "answer"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    keyed = a.select(F.col("answer").alias("key"), "answer").distinct()
    docs = contained(d, keyed).groupBy("string_id").agg(F.count("*").alias("docs"))
    return a.join(docs.withColumnRenamed("string_id", "answer"), "answer", "left").select("item_id", "n", "answer", F.coalesce("docs", F.lit(0)).cast("long").alias("docs"))
