"""Phrase collocations by packed n-grams.

Words are counted and the frequent ones get dense numbers, by language. Pieces
are broken at every other word: a phrase with a rarer word can't be frequent.
The numbers of each two and three words in a row are packed into a key of fixed
width, a 64-bit integer while the numbers have 21 bits and two such integers
beyond. Keys are counted within a task, spread by range, sorted there (Spark
sorts one integer by radix) and counted as runs of equal keys.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import drop, read_table, written
from weftline.llm.pyworker import release

#: What ends a piece, how often a phrase must occur, the share of a longer phrase that makes a shorter one needless (percent), and the length of the report.
MARKS = b".,;:!?\n\x0b\x0c\r"
LEAST = 10
COVERED = 50
TOP = 2000

FLAT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + MARKS, b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(MARKS))
EDGE = re.compile(rb"[ \t.,;:!?\n-\r]")
#: What stands between pieces in a list of words; no word has this character.
BREAK = b"."
BLOCK = 1 << 22
#: Distinct words, or packed keys, that a task holds before it passes on their counts.
HELD_WORDS, HELD_KEYS = 400_000, 3_000_000
#: Bits of a word's number in the narrow key, and the most words of which every worker gets the whole dictionary.
NARROW = 21
DICTIONARY_WORDS = 1_000_000


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """The lower-cased (A-Z) words of a text with BREAK between its pieces, some MB of it at a time."""
    data, at = (text or "").encode("utf-8", "surrogatepass"), 0
    while at < len(data):
        cut = EDGE.search(data, at + BLOCK) if at + BLOCK < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end].translate(FLAT).replace(b"\n", b" . ").split()
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of ``docs`` (lang, text), and of each language a row whose word is null: the number of all its words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w or None, n) for lang, c in held.items() for w, n in c.items()]
            held.clear()
            lang, w, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.record_batch([pa.array(lang, pa.string()), pa.array(w, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = held.setdefault(lang, Counter())
                for found in tokens(text.as_py()):
                    c.update(found)
                    c[b""] += len(found) - c.pop(BREAK, 0)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield out()
        yield out()
        release()

    return docs.mapInArrow(count, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def numbered(words: DataFrame) -> DataFrame:
    """``words`` (lang, word, f) with ``id``, their place from 1 in the order of language and word: sorted by range, with the sizes of the ranges summed."""
    ranged = written(words.repartitionByRange("lang", "word").sortWithinPartitions("lang", "word").withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("size"), F.min("at").alias("first_at"))  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first_at") + 1).alias("shift"))
    found = written(ranged.join(F.broadcast(starts), part == F.col("part")).select((F.col("at") + F.col("shift")).alias("id"), "lang", "word", "f"), "dictionary")
    drop(ranged)
    return found


def encoded_by_broadcast(docs: DataFrame, dictionary: DataFrame):
    """A function from batches of (lang, text) to arrays of the words' numbers, 0 at each break, with the dictionary in every worker, and the table to map."""
    rows = dictionary.orderBy("id").toArrow()
    langs, words, ids = rows["lang"].to_pylist(), rows["word"].to_pylist(), rows["id"].to_pylist()
    seams = [i for i in range(len(ids)) if i == 0 or langs[i] != langs[i - 1]] + [len(ids)]
    packed = docs.sparkSession.sparkContext.broadcast([(langs[a], ids[a], b"\n".join(words[a:b])) for a, b in zip(seams, seams[1:], strict=False)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        known = {lang: {w: first + i for i, w in enumerate(joined.split(b"\n"))} for lang, first, joined in packed.value}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                get, last = known.get(lang, {}).get, np.zeros(1, dtype=np.int64)
                for found in tokens(text.as_py()):
                    ids = np.fromiter((get(w, 0) for w in found), dtype=np.int64, count=len(found))
                    yield np.concatenate([last, ids])  # the last two words before a block begin it, and their own pair isn't counted again
                    last = np.concatenate([last, ids])[-2:]

    return docs, encode


def encoded_by_join(docs: DataFrame, dictionary: DataFrame):
    """The same for a dictionary of any size: each block of text is a list of places for each of its words, which a join with the dictionary numbers."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tail: list[bytes] = []
                for block, found in enumerate(tokens(text.as_py())):
                    places: dict[bytes, list[int]] = {}
                    for i, w in enumerate(tail + found):
                        if w != BREAK:
                            places.setdefault(w, []).append(i)
                    keys = list(places)
                    yield pa.record_batch(
                        [pa.array([lang] * len(keys), pa.string()), pa.array([key] * len(keys), pa.int64()), pa.array([block] * len(keys), pa.int32()), pa.array([len(tail)] * len(keys), pa.int32()), pa.array(keys, pa.binary()), pa.array(places.values(), pa.list_(pa.int32()))],
                        names=["lang", "key", "block", "tail", "word", "places"],
                    )
                    tail = (tail + found)[-2:]

    keyed = written(docs.select("lang", F.monotonically_increasing_id().alias("key"), "text"), "texts")
    inverted = written(keyed.mapInArrow(invert, "lang string, key bigint, block int, tail int, word binary, places array<int>"), "places")
    drop(keyed)
    rows = inverted.join(dictionary.select("lang", "word", "id"), ["lang", "word"]).groupBy("key", "block", "tail").agg(F.collect_list(F.struct("id", "places")).alias("words"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for tail, words in zip(batch.column("tail").to_pylist(), batch.column("words"), strict=True):
                at = words.values.field("places")
                flat, ids = at.flatten().to_numpy(), words.values.field("id").to_numpy()
                out = np.zeros(flat.max() + 1, dtype=np.int64)
                out[flat] = np.repeat(ids, at.value_lengths().to_numpy())
                yield np.concatenate([np.zeros(2 - tail, dtype=np.int64), out]) if tail else np.concatenate([np.zeros(1, dtype=np.int64), out])

    return rows, encode


def packed_grams(ids: np.ndarray, narrow: bool) -> list[np.ndarray]:
    """The keys of all pairs and triples of numbers in a row without a break. The first two numbers were there before: their own pair isn't counted if both are words."""
    a, b, c = ids[:-1], ids[1:], np.concatenate([ids[2:], np.zeros(1, dtype=np.int64)])[: len(ids) - 1]
    pair = (a > 0) & (b > 0)
    three = pair & (c > 0)
    pair[:1] = False
    low = (np.zeros(pair.sum(), dtype=np.int64), c[three])
    if narrow:
        high = [x << 2 * NARROW | y << NARROW for x, y in ((a[pair], b[pair]), (a[three], b[three]))]
        return [np.concatenate([h | k for h, k in zip(high, low, strict=True)])]
    high = [x << 32 | y for x, y in ((a[pair], b[pair]), (a[three], b[three]))]
    return [np.concatenate(high), np.concatenate(low)]


def run_counts(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Runs of equal keys in sorted arrays, and the sums of ``n`` over them."""
    if not len(n):
        return keys, n
    new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    return [k[new] for k in keys], np.add.reduceat(n, new)


def gram_counts(rows: DataFrame, encode, narrow: bool, least: int) -> DataFrame:
    """(w1, w2, w3, a): all pairs (w3 = 0) and triples of numbers that occur ``least`` times or more."""
    names = ["key"] if narrow else ["key", "more"]
    schema = ", ".join(f"{c} bigint" for c in [*names, "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys = [np.concatenate(k) for k in zip(*held, strict=True)]
            held.clear()
            if narrow:
                keys[0].sort()
            else:
                at = np.lexsort(keys[::-1])
                keys = [k[at] for k in keys]
            keys, n = run_counts(keys, np.ones(len(keys[0]), dtype=np.int64))
            for at in range(0, len(n), 1 << 17):
                yield pa.record_batch([pa.array(x[at : at + (1 << 17)]) for x in (*keys, n)], names=[*names, "n"])

        for ids in encode(batches):
            held.append(packed_grams(ids, narrow))
            size += len(held[-1][0])
            if size > HELD_KEYS:
                yield from out()
                size = 0
        if held:
            yield from out()
        release()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] = []
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names) + 1)]
            *keys, n = [np.concatenate(x) for x in zip(last, now, strict=True)] if last else now
            keys, n = run_counts(keys, n)
            last = [x[-1:].copy() for x in (*keys, n)]  # its run may go on in the next batch
            use = np.flatnonzero(n[:-1] >= least)
            if len(use):
                yield pa.record_batch([pa.array(x[use]) for x in (*keys, n)], names=[*names, "n"])
        if last and last[-1][0] >= least:
            yield pa.record_batch([pa.array(x) for x in last], names=[*names, "n"])
        release()

    packed = written(rows.mapInArrow(pack, schema), "grams")  # a sort by range reads its input twice
    counted = packed.repartitionByRange(*names).sortWithinPartitions(*names).mapInArrow(runs, schema)
    if narrow:
        mask = F.lit((1 << NARROW) - 1).cast("bigint")
        ids = [F.shiftright("key", 2 * NARROW), F.shiftright("key", NARROW).bitwiseAND(mask), F.col("key").bitwiseAND(mask)]
    else:
        ids = [F.shiftright("key", 32), F.col("key").bitwiseAND(F.lit((1 << 32) - 1).cast("bigint")), F.col("more")]
    found = written(counted.select(*(x.alias(f"w{i}") for i, x in enumerate(ids, 1)), F.col("n").alias("a")), "phrases")
    drop(packed)
    return found


def cut_score(a, left, right):
    """floor(1000000 a a / (left right)), exactly: a up to 10**15, so no product passes 38 digits."""
    whole = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole(a) * whole(a)), whole(left) * whole(right))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covered: int = COVERED, top: int = TOP, dictionary_words: int = DICTIONARY_WORDS, narrow_bits: int = NARROW) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two and three words of each language, by score.

    Texts are lower-cased (A-Z) and split at . , ; : ! ? and line ends into
    pieces, these at spaces and tabs into words. ``n`` is the number of words of
    the language, ``a`` how often the phrase occurs within pieces, ``least`` at
    least. Cut after a word, its parts occur ``l`` and ``r`` times; of its cuts
    the one with the lowest score counts, of equal ones the first. A phrase of
    two words isn't reported if one of three words that contains it (reported or
    not) has ``covered`` percent of its occurrences or more. Ties in score and
    ``a`` go by the phrase's bytes. A null language is ``und``; null, blank and
    one-word texts add no phrases; repeated rows are rows like any others;
    further columns are ignored; an empty table gives an empty result.

    A dictionary of up to ``dictionary_words`` frequent words goes to every
    worker; a larger one is joined with the places of each block's words. Keys
    are one integer while numbers fit ``narrow_bits``. Neither changes a result.
    """
    d = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counts = written(word_counts(d).where(F.col("word").isNull() | (F.col("f") >= least)), "wordcounts")
    totals = counts.where("word IS NULL").select("lang", F.col("f").alias("n"))
    dictionary = numbered(counts.where("word IS NOT NULL"))
    size = dictionary.count()
    how = encoded_by_broadcast if size <= dictionary_words else encoded_by_join
    found = gram_counts(*how(d, dictionary), size < 1 << narrow_bits, least)

    def named(i: int, *more: str) -> DataFrame:
        side = dictionary.select(F.col("id").alias(f"w{i}"), F.col("word").cast("string").alias(f"t{i}"), F.col("f").alias(f"f{i}"), *more)
        return F.broadcast(side) if size <= dictionary_words // 2 else side

    pairs = found.where("w3 = 0").drop("w3")
    triples = found.where("w3 > 0")
    part = lambda x, y, f: pairs.select(F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(f))
    triples = triples.join(part("w1", "w2", "f12"), ["w1", "w2"]).join(part("w2", "w3", "f23"), ["w2", "w3"])
    triples = triples.join(named(1, "lang"), "w1").join(named(2), "w2").join(named(3), "w3")
    one, two = cut_score(F.col("a"), F.col("f1"), F.col("f23")), cut_score(F.col("a"), F.col("f12"), F.col("f3"))
    cuts = F.least(F.struct(one.alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f23").alias("r")), F.struct(two.alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f3").alias("r")))
    triples = triples.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", cuts.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    inside = found.where("w3 > 0").select("a", F.explode(F.array(F.struct(F.col("w1").alias("w1"), F.col("w2").alias("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    inside = written(inside.groupBy("p.w1", "p.w2").agg(F.max("a").alias("longer")), "inside")
    pairs = pairs.join(inside, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    pairs = pairs.join(named(1, "lang"), "w1").join(named(2), "w2")
    pairs = pairs.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), cut_score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))

    # the best of each part of a language first: of N phrases no task ranks more than about sqrt(N top)
    parts = math.ceil(math.sqrt(found.count() / top)) or 1
    scored = pairs.unionByName(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents; see collocations."""
    return collocations(read_table(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(ws) AS g FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS (SELECT lang, size, g, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(g, ' ') AS p FROM f WHERE size > 1 AND a >= 10),
cuts AS (
  SELECT lang, size, g, a, k, array_to_string(p[:k], ' ') AS x, array_to_string(p[k + 1:], ' ') AS y
  FROM c, (VALUES (1), (2)) AS t(k) WHERE k < size),
scored AS (
  SELECT cuts.lang, cuts.size, cuts.g, cuts.a, k, fx.a AS l, fy.a AS r, (1000000::HUGEINT * cuts.a * cuts.a) // (fx.a::HUGEINT * fy.a) AS score
  FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.g = x JOIN f fy ON fy.lang = cuts.lang AND fy.g = y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (
  SELECT lang, g, max(a) AS a FROM (
    SELECT lang, a, array_to_string(p[:2], ' ') AS g FROM c WHERE size = 3
    UNION ALL SELECT lang, a, array_to_string(p[2:], ' ') FROM c WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN longer ON lowest.size = 2 AND longer.lang = lowest.lang AND longer.g = lowest.g
  WHERE longer.a IS NULL OR 100 * longer.a < 50 * lowest.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
