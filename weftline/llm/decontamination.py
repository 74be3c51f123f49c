"""Benchmark decontamination by SimHash over windows of an item's size. DataFrame functions only.

A window is as long as some benchmark item. Only windows that hold most of the
shingles that such an item must share with them are fingerprinted, which no
window of the wanted similarity fails (see windows_of). Their SimHashes are
looked up among those of all items of that size by a multi-index: the 64 bits
are cut into one block more than the radius, so that whatever is within the
radius agrees in some block. What is within it is verified by the exact
weighted similarity of the shingles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bind, join_ids, read_table, written

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 two SimHashes differ in about 10 bits, give or take 3; this is nearly four of these away.
RADIUS = 20
#: Up to so many benchmark shingles are broadcast (16 MB); more are joined by a shuffle.
BROADCAST_SHINGLES = 500_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased: punctuation and layout don't hide a passage."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column, k: int) -> Column:
    """Hashes of the ``k``-word shingles of an array of words, in order; none for fewer words. ``w`` must be bound."""
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, k))))


def shingles_of(words_: Column, size: Column) -> Column:
    """The shingles of an array of words, of five words or, where ``size`` is less, of as many."""
    of = lambda k: bind(words_, lambda w: shingles(w, k))
    return reduce(lambda rest, k: F.when(size == k, of(k)).otherwise(rest), range(1, SHINGLE), of(SHINGLE))


def simhash(h: Column) -> Column:
    """64 bits, each set where over half of the hashes of an array have it. ``h`` must be bound.

    Up to 127 hashes are counted eight bits at a time, each bit in a byte of its own of a long.
    """
    long = lambda x: F.lit(x).cast("bigint")
    every = long(0x0101010101010101)
    lane = lambda j: F.aggregate(h, long(0), lambda a, x: a + F.shiftrightunsigned(x, j).bitwiseAND(every))
    lanes = F.array(*(lane(j) for j in range(8)))
    count = lambda c, b: F.shiftrightunsigned(F.get(c, F.lit(b % 8)), b - b % 8).bitwiseAND(long(255))

    def few(c: Column) -> Column:
        return reduce(lambda a, x: a.bitwiseOR(x), (F.when(count(c, b) * 2 > F.size(h), long((1 << b) - (1 << 64 if b == 63 else 0))).otherwise(long(0)) for b in range(64)))

    one = lambda b: F.size(F.filter(h, lambda x: F.call_function("getbit", x, b) == 1)) * 2 > F.size(h)
    bit = lambda b: F.when(one(b), F.call_function("shiftleft", long(1), b)).otherwise(long(0))
    many = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), long(0), lambda a, x: a.bitwiseOR(x))
    return F.when(F.size(h) <= 127, bind(lanes, few)).otherwise(many)


def numbered(h: Column) -> Column:
    """A multiset of hashes as a set: the first of equal ones as it is, each further one hashed with its number. ``h`` must be bound."""

    def step(a: Column, x: Column) -> Column:
        run = F.when(F.size(a["out"]) == 0, 0).when(a["last"] == x, a["run"] + 1).otherwise(0)
        return F.struct(x.alias("last"), run.alias("run"), F.array_append(a["out"], F.when(run == 0, x).otherwise(F.xxhash64(x, run))).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.lit(0).alias("run"), F.array().cast("array<bigint>").alias("out"))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), h).otherwise(F.aggregate(F.array_sort(h), start, step, lambda a: a["out"]))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two multisets of shingles, a shingle's weight being how often it occurs. Both must be bound."""
    common = F.size(F.array_intersect(numbered(a), numbered(b)))
    return common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1))


def blocks(fp: Column, radius: int) -> Column:
    """(number, bits) of ``radius + 1`` blocks of 64 bits."""
    cuts = [i * 64 // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("bits")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))))


def items_of(benchmark: DataFrame, text: str, item_col: str) -> DataFrame:
    """(item_id, m, k, hs, fp) of every benchmark item that has words: its length, its shingle size (5, or all its words) and its shingles in order."""
    b = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), tokens(F.col(text)).alias("w")).where("size(w) > 0")
    b = b.dropDuplicates(["item_id", "w"]).withColumn("m", F.size("w")).withColumn("k", F.least("m", F.lit(SHINGLE)))
    return b.withColumn("hs", shingles_of(F.col("w"), F.col("k"))).withColumn("fp", bind(F.col("hs"), simhash)).select("item_id", "m", "k", "hs", "fp")


def windows_of(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(id, m, start, ws): windows of ``m`` words of ``docs`` (id, text) that may be similar to an item of that size; ``ws`` are their shingles.

    A window of similarity t to an item of n shingles shares at least t * n of
    them, so it holds that many positions whose shingle some item of its size
    has. Moving its start to the first of these loses none and changes nothing
    else, so windows that start there are enough; one that would pass the end
    of the text is moved back to end with it.
    """
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())
    spread = written(items.select("m", "k", F.explode("hs").alias("h")).distinct(), "itemshingles")
    few = spread.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES
    hits = docs.limit(0).select("id", F.lit(0).alias("m"), F.lit(0).alias("n"), F.lit(0).alias("pos"))
    for k in sizes:
        here = docs.select("id", F.posexplode(shingles_of(tokens(F.col("text")), F.lit(k))).alias("pos", "h"))
        mine = spread.where(F.col("k") == k).drop("k")
        hits = hits.union(here.join(F.broadcast(mine) if few else mine, "h").select("id", "m", F.col("m") - (k - 1), "pos"))
    need = F.ceil(similarity * F.col("n") - 1e-9).cast("int")
    # the window from a position holds enough if the position that is need - 1 places on is still within it
    listed = hits.groupBy("id", "m", "n").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    starts = listed.select("id", "m", "n", F.filter("p", lambda x, i: F.coalesce(F.get("p", i + need - 1), F.lit(2**31 - 1)) < x + F.col("n")).alias("p")).where("size(p) > 0")
    starts = written(starts, "starts")
    holders = written(starts.select("id").distinct(), "holders")
    words_ = join_ids(docs, holders, "left_semi").select("id", tokens(F.col("text")).alias("w"))
    both = starts.join(words_, "id").withColumn("at", F.array_distinct(F.transform("p", lambda x: F.greatest(F.least(x, F.size("w") - F.col("m")), F.lit(0)))))
    cut = both.select("id", "m", F.explode(F.transform("at", lambda x: F.struct(x.alias("start"), F.slice("w", x + 1, F.col("m")).alias("w")))).alias("x"))
    cut = cut.select("id", "m", "x.start", shingles_of(F.col("x.w"), F.least("m", F.lit(SHINGLE))).alias("ws")).where("size(ws) > 0")
    return cut.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_col: str = "item_id", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(id, item_id, start_word, n_words, distance, similarity): the best window of each document for each benchmark item that it holds.

    A document holds an item if a window of the item's length has a weighted
    shingle similarity of ``similarity`` or more and a SimHash within
    ``radius`` bits. Of equally similar windows the first is reported, among
    those that start at a shingle that an item of their size has. Words are
    runs of letters and digits. An item of fewer than five words is one shingle.
    Null and blank texts, on either side, hold nothing; rows with a null id are
    left out; rows that share an id are one document. Empty tables give an
    empty result.

    Documents are exploded into shingles only as far as the join with the
    benchmark's, so what is shuffled are the shared ones and, of the documents
    that have enough, the texts. Equal windows are one class, which is
    fingerprinted, looked up and verified once, however many documents have it.
    """
    items = written(items_of(benchmark, text, item_col), "items")
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    windows = written(windows_of(d, items, similarity).withColumn("c", F.xxhash64("m", "ws")), "windows")
    classes = windows.groupBy("c").agg(F.first("m").alias("m"), F.first("ws").alias("ws"))
    classes = written(classes.withColumn("wfp", bind(F.col("ws"), simhash)), "classes")
    near = classes.select("c", "m", "wfp", F.explode(blocks(F.col("wfp"), radius)).alias("b"))
    index = items.select("item_id", "m", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("wfp")))
    near = near.join(index, ["m", "b"]).where(distance <= radius).select("c", "item_id", distance.alias("distance")).distinct()
    both = near.join(classes.select("c", "ws"), "c").join(items.select("item_id", "hs"), "item_id")
    both = both.withColumn("similarity", bind(F.col("ws"), lambda a: bind(F.col("hs"), lambda b: weighted_similarity(a, b)))).where(F.col("similarity") >= similarity)
    found = windows.select("id", "m", "start", "c").join(written(both.select("c", "item_id", "distance", "similarity"), "verified"), "c")
    best = found.groupBy("id", "item_id").agg(F.max_by(F.struct("start", "m", "distance", "similarity"), F.struct("similarity", -F.col("start"))).alias("w"))
    return best.select(F.col("id").alias(id_col), "item_id", F.col("w.start").alias("start_word"), F.col("w.m").alias("n_words"), F.col("w.distance").alias("distance"), F.col("w.similarity").alias("similarity"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items; see contaminated."""
    return contaminated(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item. All columns are kept, and rows with a null id."""
    return join_ids(docs, written(contaminated(docs, benchmark).select("doc_id").distinct(), "leaks"), "left_anti").select(*docs.columns)
