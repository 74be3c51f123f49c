"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash in the lowest ``1 / SCALE`` of the hash
range. The threshold is the same for all texts, so sketches of any two texts
can be merged by union and compared by intersection, however unequal the texts
are: the share of a small sketch found in a large one estimates containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import bind, read_table, words, written

SHINGLE = 5
SCALE = 8


def sketch(text: Column, k: int = SHINGLE, scale: int = SCALE) -> Column:
    """The sorted distinct hashes kept of a text's ``k``-word shingles.

    A text of fewer than ``k`` words is one shingle, a text without words (or
    null) has an empty sketch. Where no hash is below the threshold, the
    smallest stands in, so that only wordless texts have empty sketches;
    merging stays exact: unite, then drop what is above the threshold unless
    nothing else is left.
    """
    def hashes(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.least(F.size(w), F.lit(1))))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, k))))

    def kept(h: Column, low: Column) -> Column:
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(F.when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(low))

    return bind(words(F.lower(text)), lambda w: bind(hashes(w), lambda h: bind(F.filter(h, lambda x: x < top(scale)), lambda low: kept(h, low))))


def top(scale: int = SCALE) -> Column:
    """The threshold: hashes below it are retained."""
    return F.lit(-(2**63) + 2**64 // scale)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of the first text's shingles that the second has; a wordless text is contained in any.

    Only hashes below the threshold are compared: of a stand-in no larger text
    could tell whether it has it. A text that has nothing but a stand-in is
    contained in an equal sketch; else there is no estimate (null).
    """
    low = lambda s: F.filter(s, lambda x: x < top(scale))
    known = bind(low(a), lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, b)) / F.size(x)))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(a == b, F.lit(1.0)).otherwise(known)


def as_string(s: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash, in order."""
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def next_ids(keys: DataFrame) -> DataFrame:
    """(key, need) to (key, need, next_key): the following key, the smallest after the largest.

    Keys are range-partitioned; a window sees one partition and the seams come
    from a table of one row for each partition.
    """
    ranged = written(keys.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "keys")
    seams = ranged.groupBy("part").agg(F.min("key").alias("first_key"))
    after, whole = Window.orderBy("part"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seams = seams.select("part", F.coalesce(F.lead("first_key").over(after), F.min("first_key").over(whole)).alias("beyond"))
    inner = ranged.withColumn("next_in", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    return inner.join(seams, "part").select("key", "need", F.coalesce("next_in", "beyond").alias("next_key"))


def fingerprint_pairs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Sketches of every text, of its edited text and of the next document.

    The edited text has the last quarter of the code points (rounded down)
    replaced by as many first ones of the next document by ascending id, or by
    all of it where it is shorter; after the last id comes the first. A null
    text counts as empty and a null id as the largest. Where rows share an id,
    each is a row of the result and the smallest of their texts is the one that
    the previous id sees. A single document is its own next one. An empty table
    gives an empty result.

    Returns (id, text, edited, sketch, edited_sketch, next_sketch). Texts are
    shuffled once, by id; beside them travel the sketches and the prefixes, of
    a quarter of the previous text's length at most.
    """
    last = F.lit(2**63 - 1)
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = d.groupBy("key").agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("need"))
    links = written(next_ids(keys), "links")
    d = d.withColumn("sketch", sketch(F.col("text"), k, scale)).repartition("key")
    first = d.groupBy("key").agg(F.min(F.struct("text", "sketch")).alias("f"))
    gives = links.select(F.col("next_key").alias("key"), F.col("key").alias("to"), "need")
    gives = first.join(gives, "key").select(F.col("to").alias("key"), F.expr("left(f.text, need)").alias("head"), F.col("f.sketch").alias("next_sketch"))
    both = d.join(gives, "key")
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("left(head, cast(floor(length(text) / 4) as int))"))
    both = both.withColumn("edited", F.when(cut == 0, F.col("text")).otherwise(edited))
    both = both.withColumn("edited_sketch", sketch(F.col("edited"), k, scale))
    return both.select(F.when(F.col("key") != last, F.col("key")).alias(id_col), "text", "edited", "sketch", "edited_sketch", "next_sketch")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; see fingerprint_pairs."""
    f = fingerprint_pairs(read_table(spark, sf_dir, "documents"))
    return f.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("inside_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("inside_next"),
    )
