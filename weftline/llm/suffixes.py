"""Repeated passages by sparse suffix arrays.

Of the suffixes of a text (at its words) those are retained that begin at a
minimiser: the smallest hash of ten words among any 41 neighbours, so chosen by
content that two texts which share 50 words retain a suffix at the same place
of the shared passage. Retained suffixes are sorted by the hash of these ten
words and neighbours are compared. Where they agree across documents the match
is extended to the left and right in the texts: to every stretch of 50 words
whose own minimiser it is. The stretches are sorted and neighbours compared
again, and runs of adjacent matches with one other document are joined to
passages.

A sort is by range, with the document after the hash, so that a passage that a
third of all documents share spans as many partitions as it needs. What meets
at a seam between partitions is told from two rows of each; see neighbours().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import join_ids, read_table, written
from weftline.llm.pyworker import WORD, gram_hashes, release, word_hashes

PASSAGE = 50
GRAM = 10


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """For every ``window`` consecutive hashes the place of the smallest (the first of equal ones)."""
    if len(grams) < window:
        return np.empty(0, dtype=np.int64)
    views, found = np.lib.stride_tricks.sliding_window_view(grams, window), []
    for at in range(0, len(views), 1 << 14):
        found.append(np.argmin(views[at : at + (1 << 14)], axis=1) + np.arange(at, min(at + (1 << 14), len(views))))
    return np.concatenate(found)


def retained(text: str | None, passage: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text and, for each stretch of ``passage`` words, the hash that its retained suffix begins with."""
    words = word_hashes(text)
    grams = gram_hashes(words, gram) if len(words) >= passage else np.empty(0, dtype=np.uint64)
    return words, grams[minimisers(grams, passage - gram + 1)]


def neighbours(suffixes: DataFrame) -> DataFrame:
    """(h, id, start, first_id, first_start): of ``suffixes`` (h, id, start) those that agree in h with one of a smaller id, and the first that they agree with.

    Rows are sorted by (h, id, start) over range partitions and each is
    compared with the one before it, which passes on the first row of its run.
    Rows of a partition's first run may belong to a run that began in an
    earlier partition; they get the smallest of the rows that a run begins or
    ends a partition with.
    """
    kinds = "h bigint, id bigint, start int, first_id bigint, first_start int, kind int"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = run = None
        for batch in batches:
            h, ids, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(h):
                continue
            lead = h[0] if run is None else lead
            new = np.r_[run is None or h[0] != run[0], h[1:] != h[:-1]]
            at = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            old = at < 0
            first_id, first_start = np.where(old, run[1] if run else 0, ids[at]), np.where(old, run[2] if run else 0, start[at])
            if not old[-1]:
                run = (h[-1], ids[at[-1]], start[at[-1]])
            kind = (h == lead).astype(np.int32)
            use = (kind == 1) | (ids != first_id)
            yield pa.record_batch([pa.array(x[use]) for x in (h, ids, start, first_id.astype(np.int64), first_start.astype(np.int32), kind)], names=[x.split()[0] for x in kinds.split(", ")])
        if run is not None:
            ends = [np.array([x]) for x in (*run, *run[1:], 2)]
            yield pa.record_batch([pa.array(x.astype(t)) for x, t in zip(ends, "i8 i8 i4 i8 i4 i4".split(), strict=True)], names=[x.split()[0] for x in kinds.split(", ")])

    ranged = suffixes.select("h", "id", "start").repartitionByRange("h", "id", "start").sortWithinPartitions("h", "id", "start")
    found = written(ranged.mapInArrow(compare, kinds), "neighbours")
    seams = found.where("kind = 2 OR (kind = 1 AND id = first_id AND start = first_start)").groupBy("h").agg(F.min(F.struct("id", "start")).alias("f"))
    firsts = {r["h"]: (r["f"]["id"], r["f"]["start"]) for r in seams.toLocalIterator()}  # two rows of each partition at most
    packed = found.sparkSession.sparkContext.broadcast(firsts)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ids, start, first_id, first_start, kind = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in range(6))
            for x in np.unique(h[kind == 1]):
                mine = (kind == 1) & (h == x)
                first_id[mine], first_start[mine] = packed.value[x]
            use = (kind < 2) & (ids != first_id)
            yield pa.record_batch([pa.array(x[use]) for x in (h, ids, start, first_id, first_start)], names=batch.schema.names[:5])

    return found.mapInArrow(settle, kinds.rsplit(",", 1)[0])


def repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """(id, start_word, n_words, first_id, first_start_word) of all passages of ``passage`` or more words that an earlier document has too.

    Words are lower-cased (A-Z) runs without white space, counted from 0. Every
    stretch of ``passage`` words that two or more documents share is covered in
    all of them but the one with the smallest id, against which it is reported;
    what only repeats within a document isn't. Adjacent stretches that lie alike
    in the same first document are one passage. A whole text that equals an
    earlier one is a single passage from word 0. Null, blank and shorter texts
    have none. Rows with a null id are left out; rows that share an id are one
    document. Empty tables give an empty result.
    """
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = written(d.select("id", F.md5(F.col("text").cast("binary")).alias("same"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")), "texts")
    twice = marked.where(F.col("n") >= passage).groupBy("same").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id")
    twice = written(twice, "twice")  # so that a text of very many copies can be split over tasks
    copies = written(marked.join(twice, "same").where("id > first_id").groupBy("id").agg(F.min("first_id").alias("first_id"), F.max("n").alias("n")), "copies")
    singles = join_ids(d, copies.select("id"), "left_anti")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_numpy(zero_copy_only=False), [np.unique(retained(t.as_py(), passage, gram)[1]) for t in batch.column(1)]
            rows = np.repeat(ids, [len(x) for x in found]).astype(np.int64)
            yield pa.record_batch([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)), pa.array(rows), pa.array(np.zeros(len(rows), np.int32))], names=["h", "id", "start"])
        release()

    agree = neighbours(written(singles.mapInArrow(suffixes, "h bigint, id bigint, start int"), "suffixes"))
    agree = written(agree.select("id", "h").union(agree.select("first_id", "h").distinct()), "agree")
    mine = written(agree.groupBy("id").agg(F.collect_set("h").alias("grams")), "agreeing")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for i, t, g in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                words, grams = retained(t.as_py(), passage, gram)
                starts = np.flatnonzero(np.isin(grams, np.array(g.values.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)))
                found.append((np.full(len(starts), i.as_py(), dtype=np.int64), starts.astype(np.int32), gram_hashes(words, passage)[starts].view(np.int64)))
                if sum(len(x) for x, *_ in found) > 50_000:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["id", "start", "h"])
                    found = []
            if found:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["id", "start", "h"])
        release()

    some = join_ids(singles, mine.select("id"), "left_semi")
    stretches = written(some.join(mine, "id").mapInArrow(extend, "id bigint, start int, h bigint"), "stretches")
    again = neighbours(stretches).select("id", "start", "first_id", "first_start").distinct().withColumn("shift", F.col("first_start") - F.col("start"))
    line = Window.partitionBy("id", "first_id", "shift").orderBy("start")
    again = again.withColumn("run", F.col("start") - F.row_number().over(line))
    spans = again.groupBy("id", "first_id", "shift", "run").agg(F.min("start").alias("start_word"), (F.max("start") - F.min("start") + passage).alias("n_words"))
    spans = spans.select("id", "start_word", "n_words", "first_id", (F.col("start_word") + F.col("shift")).alias("first_start_word"))
    whole = copies.select("id", F.lit(0).alias("start_word"), F.col("n").alias("n_words"), "first_id", F.lit(0).alias("first_start_word"))
    return spans.union(whole).withColumnRenamed("id", id_col).withColumnRenamed("first_id", f"first_{id_col}")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of 50 or more words that repeat across documents; see repeats."""
    return repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of ``spans`` (start, number), each with the white space after it."""
    data = text.encode("utf-8", "surrogatepass")
    drop = np.zeros(max(s + n for s, n in spans) + 1, dtype=bool)
    for s, n in spans:
        drop[s : s + n] = True
    out, last = [], 0
    for k, m in enumerate(WORD.finditer(data)):
        gone = k < len(drop) and drop[k]
        if gone and last >= 0:
            out.append(data[last : m.start()])
            last = -1
        elif not gone and last < 0:
            last = m.start()
    if last >= 0:
        out.append(data[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def cut_repeats(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """``docs`` (the columns of documents) without the passages that an earlier document has too.

    A passage stays in the document with the smallest id and is cut from the
    others; n_chars follows. A document of which no word is left goes. Texts
    that have no such passage stay as they are, blank and null ones included.
    """
    found = written(repeats(docs, passage=passage).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans")), "spans")
    ids = found.select("doc_id")

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([without_words(t.as_py(), [(r["start_word"], r["n_words"]) for r in s.as_py()]) for t, s in zip(texts, spans, strict=True)], pa.string())

    cut = F.arrow_udf(cut, "string")

    whole = join_ids(docs, ids, "left_anti")
    rest = join_ids(docs, ids, "left_semi").where(F.col("text").isNotNull()).join(found, "doc_id").withColumn("text", cut("text", "spans"))
    rest = rest.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long"))
    return whole.select(*docs.columns).unionByName(rest.select(*docs.columns))
