"""Row generators as table functions of SQL: over a whole partitioned table, or beside each row with LATERAL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

from weftline.plans.registry import query
from weftline.sources.tables import table

#: Characters of a generated row's prompt at most, and rows of a batch.
MOST, BATCH = 20_000, 512


@udtf(returnType="batch bigint, doc_id bigint, n_chars bigint, generated boolean")
class GrownBatch:
    """The rows of a batch, each passed on as it comes, and behind them the row that the generator adds: the batch's first. A row is held, not the batch."""

    def __init__(self) -> None:
        self.first: Row | None = None

    def eval(self, row: Row):
        self.first = self.first or row
        yield row["batch"], row["doc_id"], row["n_chars"], False

    def terminate(self):
        if self.first is not None and (self.first["n_chars"] or 0) <= MOST:
            yield self.first["batch"], self.first["doc_id"], self.first["n_chars"], True


@udtf(returnType="k int, seed bigint")
class Seeds:
    """``n`` numbered seeds of a name."""

    def eval(self, name: str, n: int):
        for k in range(n or 0):
            yield k, int(hashlib.md5(f"{name}:{k}".encode()).hexdigest()[:8], 16)


def register(spark: SparkSession) -> None:
    """Make the generators callable in SQL as grown_batch(TABLE(...)) and seeds(name, n)."""
    spark.udtf.register("grown_batch", GrownBatch)
    spark.udtf.register("seeds", Seeds)


@query(
    "grown_batches",
    f"""WITH d AS (SELECT doc_id // {BATCH} AS batch, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id // {BATCH} ORDER BY doc_id) AS r FROM documents)
    SELECT batch, doc_id, n_chars, false AS generated FROM d UNION ALL SELECT batch, doc_id, n_chars, true FROM d WHERE r = 1 AND n_chars <= {MOST}""",
)
def grown_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch of documents with a generated row behind it, unless that is overlong."""
    register(spark)
    rows = table(spark, sf_dir, "documents").selectExpr(f"doc_id DIV {BATCH} AS batch", "doc_id", "n_chars")
    return spark.sql("SELECT * FROM grown_batch(TABLE(SELECT * FROM {rows}) PARTITION BY batch ORDER BY doc_id)", rows=rows)


@query(
    "seeded_variants",
    "SELECT doc_id, CAST(k AS INT) AS k, CAST('0x' || substr(md5(source || '-' || doc_id || ':' || k), 1, 8) AS BIGINT) AS seed FROM documents, range(4) t(k) WHERE k < doc_id % 4",
)
def seeded_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three seeds for variants of each document, generated beside its row."""
    register(spark)
    return spark.sql("SELECT d.doc_id, s.k, s.seed FROM {docs} d, LATERAL seeds(concat(d.source, '-', d.doc_id), CAST(d.doc_id % 4 AS INT)) s", docs=table(spark, sf_dir, "documents"))
