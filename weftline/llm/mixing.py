"""Mixing sources to target weights by systematic sampling.

Within a source the documents are laid in a row, largest first, and each takes
its expected number of copies, target over source size, of the line. One random
offset moves the line; a document is taken once for each integer boundary that
its stretch crosses. Since the order is by size, what a source misses of its
target is below its largest document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import WORD, read_table, written

#: The weights of the sources in order, and the most copies of one document.
WEIGHTS = (5, 2, 1)
MOST = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target words of each source.

    ``sizes``: (source, source_size), a row for each source. The k-th source by
    code point, null last, weighs ``weights[k % len(weights)]``. The sources
    share the sum of all sizes by weight; a target stops at ``most`` times its
    source's size and the excess is shared anew by weight, until none is above.
    Sharing anew fills the sources that stop in the order of size over weight,
    so the sources that stop are a prefix of that order. All windows are over
    one row for each source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    w = sizes.withColumn("place", place).withColumn("weight", weigh)
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "place")
    before, everyone = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (
        w.withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("left_words", F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("stops", F.col("weight") * F.col("left_words") > most * F.col("source_size") * F.col("left_weight"))
        # the first that doesn't stop fixes the share of a unit of weight for all after it
        .withColumn("share", F.first(F.when(~F.col("stops"), F.col("left_words") / F.col("left_weight")), ignorenulls=True).over(everyone))
    )
    target = F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("share"))
    return w.select("source", "source_size", target.alias("target"))


def offset(source, seed: int):
    """A number from 0 up to 1 that depends on the source and the seed alone: 32 bits of an MD5."""
    hexed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """How many copies of each document a mix takes.

    Returns (id, size, source_size, target, copies, taken), a row for each row
    of ``docs``. Size is the number of words; a null or blank text has none. A
    null source is a source of its own. Rows with the same id are rows like any
    others; ties in size and id are equal rows, and which of them gets a copy
    more can't be told. An empty table gives an empty result. A source without
    words has target 0 and its documents aren't taken.

    The place of a document within its source comes from one range partition by
    (source, size, id): a hot source spans as many partitions as it needs, the
    places within a partition are counted from a table of one row for each
    partition and source, and no window holds a source.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    sized = written(sized, "sizes")  # words are counted once, though a sort by range reads its input twice
    ranged = sized.repartitionByRange(F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("id").asc_nulls_last())
    ranged = ranged.sortWithinPartitions(F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("id").asc_nulls_last())
    placed = written(ranged.withColumn("at", F.monotonically_increasing_id()), "mix")
    part = F.shiftright("at", 33)
    runs = placed.groupBy("source", part.alias("part")).agg(F.min("at").alias("first_at"), F.count("*").alias("n"), F.sum("size").alias("words"))
    runs = written(runs, "mixruns")
    sizes = runs.groupBy("source").agg(F.sum("words").alias("source_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    plan = starts.join(source_targets(sizes).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    plan = plan.select("part", F.col("source").alias("s"), "first_at", "start", "source_size", "target", offset(F.col("source"), seed).alias("u"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    d = placed.withColumn("p", part).join(plan, (F.col("p") == F.col("part")) & F.col("source").eqNullSafe(F.col("s")))
    d = d.withColumn("rate", rate).withColumn("i", F.col("start") + F.col("at") - F.col("first_at"))
    d = d.withColumn("copies", (F.floor((F.col("i") + 1) * F.col("rate") + F.col("u")) - F.floor(F.col("i") * F.col("rate") + F.col("u"))).cast("long"))
    return d.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; see mix_sources."""
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s1),
s3 AS (SELECT *,
    CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0) AS BIGINT) AS left_words,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS BIGINT) AS left_weight
  FROM s2 WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, weight * left_words > 3 * source_size * left_weight AS stops FROM s3),
s5 AS (SELECT *, (SELECT CAST(left_words AS DOUBLE) / left_weight FROM s4 WHERE NOT stops ORDER BY CAST(source_size AS DOUBLE) / weight, place LIMIT 1) AS share FROM s4),
s6 AS (SELECT source, source_size, CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE) ELSE weight * share END AS target,
    CAST(CAST('0x' || substr(md5('7:' || coalesce('=' || source, 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM s5),
r AS (SELECT d.*, s6.source_size, s6.target, s6.u, CASE WHEN s6.source_size > 0 THEN s6.target / s6.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) - 1 AS i
  FROM sized d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target, CAST(floor((i + 1) * rate + u) - floor(i * rate + u) AS BIGINT) * size AS taken FROM r
"""
