"""The corpus pipeline: five stages, each over all documents that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps;
run() writes them as Parquet in the shared folder and reads them again as the
next one's input. The last stage returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import new_path, read_table
from weftline.llm.decontamination import drop_contaminated
from weftline.llm.mixing import mix_sources
from weftline.llm.simhash import drop_near_copies
from weftline.llm.suffixes import cut_repeats
from weftline.llm.toxicity import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model is trained on the labelled documents of the tables; ``docs`` may be any others."""
    reference = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_toxic(docs.select(*COLUMNS), reference, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays, that with the smallest id."""
    return drop_near_copies(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words stay in the first document that has them and are cut from the others."""
    return cut_repeats(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each document, how many copies and words the mix of the sources takes."""
    return mix_sources(docs.select(*COLUMNS)).select("doc_id", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Scores of trained models, fingerprints and suffixes are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
