"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into blocks of 32 bits. Two fingerprints that differ in
few bits differ in one bit at most in some block: of two blocks, if they differ
in three bits or fewer. In a block, 31 bits are covered by the perfect Hamming
code of that length (radius 1) and one bit stands for itself, so every value
lies within 1 of exactly one anchor that has its last bit, its home. Each
fingerprint goes to every anchor within 1 + 1 bits of it, 17 at most; whatever
is within one bit of it has its home among these, and the fingerprints of an
anchor are compared there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import BROADCAST_IDS, WORD, components, drop, join_ids, read_table, written
from weftline.llm.pyworker import gram_hashes, majority, release, simhash64, word_hashes

NEAR_BITS = 3
#: The syndrome of a bit set at place p (from 0) in the Hamming code of length 31 is p + 1.
PLACES = np.arange(1, 32, dtype=np.uint32)


def homes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 32-bit values: the syndrome of the low 31 bits, and the home anchor."""
    low = block & np.uint32(0x7FFFFFFF)
    syndrome = np.zeros_like(low)
    for p in range(31):
        syndrome ^= np.where((low >> np.uint32(p)) & np.uint32(1), PLACES[p], np.uint32(0)).astype(np.uint32)
    flip = np.where(syndrome > 0, np.left_shift(np.uint32(1), np.maximum(syndrome, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)
    return syndrome, block ^ flip


def anchors(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``block``, anchor) of every anchor within two bits of each value, the home first for each."""
    syndrome, home = homes(block)
    every = np.arange(len(block))
    index, found = [every, every], [home, home ^ np.uint32(0x80000000)]
    off = np.flatnonzero(syndrome)  # values on an anchor have no other one within two bits
    for i in range(1, 32):
        j = syndrome[off] ^ np.uint32(i)
        use = off[(j > i) & (j < 32)]  # bits i and j together undo the syndrome; each pair once
        index.append(use)
        found.append(block[use] ^ np.uint32(1 << (i - 1)) ^ np.left_shift(np.uint32(1), (syndrome[use] ^ np.uint32(i)) - np.uint32(1)))
    return np.concatenate(index), np.concatenate(found)


def anchor_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor with the block's number, whether it is the home) of fingerprints, one row of 64-bit numbers each."""
    blocks = np.ascontiguousarray(fps.astype("<u8")).view("<u4").reshape(len(fps), -1)
    rows, keys, home = [], [], []
    for b in range(blocks.shape[1]):
        index, found = anchors(np.ascontiguousarray(blocks[:, b]))
        rows.append(index)
        keys.append(found.astype(np.int64) | np.int64(b << 32))
        first = np.zeros(len(index), dtype=bool)
        first[: len(fps)] = True
        home.append(first)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def fingerprints(docs: DataFrame, text: str = "text", k: int = 3) -> DataFrame:
    """``docs`` with a column ``fp``: the SimHash of its ``k``-word shingles as a signed 64-bit number."""

    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(np.array([simhash64(t.as_py(), k) for t in batch], dtype=np.uint64).view(np.int64))
        release()

    return docs.withColumn("fp", F.arrow_udf(of, "bigint")(F.col(text)))


def near_links(fps: DataFrame, near: int = NEAR_BITS) -> DataFrame:
    """(a, b) of all pairs of different fingerprints, of the distinct ones in ``fps.fp``, that differ in at most ``near`` (3 at most) bits.

    A pair differs in at most one bit in one of its halves, so one's home in
    that half is an anchor of the other. The join is by anchor; only pairs that
    pass the comparison leave it, and each of its sides is an ordinary shuffle,
    so the session may split a hot anchor over tasks.
    """
    if near > 3:
        raise ValueError("two blocks with one bit each cover three bits")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                row, key, home = anchor_rows(part.view(np.uint64).reshape(-1, 1))
                yield pa.record_batch([pa.array(key), pa.array(part[row]), pa.array(home)], names=["anchor", "fp", "home"])

    rows = written(fps.select("fp").mapInArrow(expand, "anchor bigint, fp bigint, home boolean"), "anchors")
    a = rows.where("home").select("anchor", F.col("fp").alias("a"))
    b = rows.select("anchor", F.col("fp").alias("b"))
    pairs = a.join(b.hint("merge"), (a.anchor == b.anchor) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= near))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", near: int = NEAR_BITS) -> DataFrame:
    """(id, fp, component_id) of every document.

    Fingerprints link at ``near`` or fewer differing bits; component_id is the
    smallest id that is reachable, its own included. Equal fingerprints are one
    node, so copies are never paired. A null or blank text has fingerprint zero
    and is linked like any other. A null id is carried along; a component of
    null ids alone has a null component_id. Repeated rows are separate rows of
    the result. An empty table gives an empty result.
    """
    marked = written(fingerprints(docs.select(F.col(id_col), F.col(text).alias("text"))).select(id_col, "fp"), "fps")
    nodes = written(marked.groupBy("fp").agg(F.min(id_col).alias("low")), "fpnodes")
    linked = written(components(near_links(nodes)), "fpcomps")
    lows = nodes.join(linked, F.col("fp") == F.col("node"))
    lows = lows.select("fp", "component").join(lows.groupBy("component").agg(F.min("low").alias("low_all")), "component").select("fp", "low_all")
    # written, so that a fingerprint that very many documents share can be split over tasks
    named = written(nodes.join(lows, "fp", "left").select("fp", F.coalesce("low_all", "low").alias("component_id")), "fpnamed")
    return marked.join(named, "fp").select(id_col, "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see simhash_components."""
    c = simhash_components(read_table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by similarity, for the pipeline ---

#: MinHash bands beside the anchors: sets of Jaccard similarity 0.8 share one with a chance of 1 - (1 - 0.8**4)**16 = 0.9998, others that are more alike with a higher one.
BANDS, BAND_ROWS = 16, 4
PARITY_LONGS = 8
PARITIES = [f"p{i}" for i in range(PARITY_LONGS)]
SKETCH = "id bigint, same binary, n int, fp bigint, bands array<bigint>, s array<int>, " + ", ".join(f"{x} bigint" for x in PARITIES)
#: Odd multipliers, one for each MinHash.
MULTIPLIERS = (np.random.default_rng(3).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's ``k``-word shingles; fewer words are one shingle, none is the empty set."""
    w = word_hashes(text)
    return np.unique(gram_hashes(w, min(k, len(w)))) if len(w) else w


def spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(32))


def sketch_rows(ids: list[int], texts: list[str | None], k: int) -> pa.RecordBatch:
    """Rows of SKETCH: what near_copies needs of each text. Texts without words are equal."""
    sets = [shingle_set(t, k) for t in texts]
    same = [hashlib.md5((t or "").encode("utf-8", "surrogatepass") if len(s) else b"").digest() for t, s in zip(texts, sets, strict=True)]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    every = np.concatenate([np.empty(0, np.uint64), *sets])
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    keys = np.zeros((len(some), BANDS), dtype=np.uint64)
    fps = np.zeros(len(sets), dtype=np.uint64)
    odd = np.zeros((len(sets), 64 * PARITY_LONGS), dtype=np.uint8)
    if len(some):
        with np.errstate(over="ignore"):
            for i, m in enumerate(MULTIPLIERS):
                low = np.minimum.reduceat((every * m) >> np.uint64(24), starts)
                band = i // BAND_ROWS
                keys[:, band] = spread(keys[:, band] + low + np.uint64(band))
        for i in some:
            s = sets[i]
            fps[i] = np.packbits(majority((s[at : at + (1 << 16)] for at in range(0, len(s), 1 << 16)), 64), bitorder="little").view("<u8")[0]
        bins = (spread(every) >> np.uint64(64 - (64 * PARITY_LONGS).bit_length() + 1)).astype(np.int64)
        np.bitwise_xor.at(odd.reshape(-1), np.repeat(np.arange(len(sets)), sizes) * (64 * PARITY_LONGS) + bins, np.uint8(1))
    longs = np.packbits(odd, axis=1, bitorder="little").view("<i8")
    bands: list = [[]] * len(sets)
    for i, row in zip(some, keys.view(np.int64), strict=True):
        bands[i] = row
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    members = pa.ListArray.from_arrays(pa.array(ends), pa.array((every >> np.uint64(32)).astype(np.uint32).view(np.int32)))
    columns = [pa.array(ids, pa.int64()), pa.array(same, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(fps.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), members]
    columns += [pa.array(np.ascontiguousarray(longs[:, i])) for i in range(PARITY_LONGS)]
    return pa.record_batch(columns, names=[x.split()[0] for x in SKETCH.split(", ")])


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """SKETCH rows of ``docs`` (id, text), one for each."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at, size = 0, 0
            for i in range(len(ids)):
                size += len(texts[i].as_buffer() or b"")
                if size > 1 << 21 or i - at >= 1000 or i == len(ids) - 1:
                    yield sketch_rows(ids[at : i + 1], texts.slice(at, i + 1 - at).to_pylist(), k)
                    at, size = i + 1, 0
        release()

    return docs.mapInArrow(expand, SKETCH)


def may_be_similar(similarity: float) -> Column:
    """Whether sets with sizes n_a, n_b and parities p0_a, p0_b and so on may be similar.

    Parities say of each bit whether an odd number of members fall on it. A
    member that only one of two sets has flips one, so the sets differ in at
    least as many members as their parities in bits; with similarity t these
    are at most (1 - t) / (1 + t) of the sum of the sizes. Nor can sets be
    similar that are too far apart in size.
    """
    bits = sum((F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in PARITIES), F.lit(0))
    most = (F.col("n_a") + F.col("n_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6) & (bits <= most)


def sided(rows: DataFrame, side: str) -> DataFrame:
    """``rows`` with ``_side`` after all names."""
    return rows.select(*(F.col(c).alias(f"{c}_{side}") for c in rows.columns))


def anchor_stars(fps: DataFrame, near: int) -> DataFrame:
    """(row, centre): each of ``fps`` (fp, row) with, at every anchor that it goes to, the smallest row whose home that is, if they differ in ``near`` bits at most."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for at in range(0, len(fp), 20_000):
                part, mine = fp[at : at + 20_000], rows[at : at + 20_000]
                index, key, home = anchor_rows(part.view(np.uint64).reshape(-1, 1))
                yield pa.record_batch([pa.array(key), pa.array(part[index]), pa.array(mine[index]), pa.array(home)], names=["anchor", "fp", "row", "home"])
        release()

    spreaded = written(fps.select("fp", "row").mapInArrow(expand, "anchor bigint, fp bigint, row bigint, home boolean"), "nearanchors")
    centres = spreaded.where("home").groupBy("anchor").agg(F.min(F.struct("row", "fp")).alias("c"))
    centres = written(centres.select("anchor", F.col("c.row").alias("centre"), F.col("c.fp").alias("cfp")), "nearhomes")
    close = spreaded.join(centres, "anchor").where((F.col("row") != F.col("centre")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("cfp"))) <= near))
    out = written(close.select("row", "centre").distinct(), "nearstars")
    drop(spreaded, centres)
    return out


def similar(pairs: DataFrame, sets: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets in ``sets`` (row, s) have a Jaccard similarity of ``similarity`` or more."""
    both = pairs.distinct().join(sided(marks, "a"), F.col("a") == F.col("row_a")).join(sided(marks, "b"), F.col("b") == F.col("row_b"))
    left = written(both.where(may_be_similar(similarity)).select("a", "b"), "nearpairs")
    ids = written(left.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "nearids")
    used = written(join_ids(sets, ids, "left_semi"), "nearsets")
    a, b = used.select(F.col("row").alias("a"), F.col("s").alias("sa")), used.select(F.col("row").alias("b"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    kept = left.join(a, "a").join(b, "b").where(common >= similarity * (F.size("sa") + F.size("sb") - common) - 1e-9)
    found = written(kept.select("a", "b"), "nearlinks")
    drop(left, ids, used)
    return found


def crossing(members: DataFrame, named: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every pair that shares a key in ``members`` (key, row), crosses two components and may be similar by ``marks``."""
    tagged = members.join(named, members.row == named.node, "left").select("key", "row", F.coalesce("component", "row").alias("component"))
    tagged = written(tagged, "neartagged")
    ends = written(tagged.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "nearopen")
    rows = written(tagged.join(ends, "key", "left_semi").join(marks, "row"), "nearcross")
    a, b = sided(rows, "a"), sided(rows, "b")
    pairs = a.join(b.hint("merge"), (F.col("key_a") == F.col("key_b")) & (F.col("row_a") < F.col("row_b")) & (F.col("component_a") != F.col("component_b")) & may_be_similar(similarity))
    out = written(pairs.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")).distinct(), "nearrest")
    drop(tagged, ends, rows)
    return out


def near_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", similarity: float = 0.8, k: int = 5, near: int = NEAR_BITS) -> DataFrame:
    """(id, same, keeper): every document that is a copy of another, the MD5 of its text and the smallest id of its group.

    Equal texts are one text; null and blank texts are equal. Different texts
    link if the Jaccard similarity of their ``k``-word shingle sets, which come
    from the whole texts, is ``similarity`` or more; texts of fewer words are
    one shingle. Groups are the components of these links. Of the rows of a
    group the one with the smallest id (of these, with the smallest MD5) is not
    in the result, all others are; repeated rows are one. Rows with a null id
    are left out. An empty table gives an empty result.

    Candidates are texts that share an anchor within ``near`` bits of a SimHash
    or, since sets of similarity 0.8 may differ in many more bits, a MinHash
    band. First each text is compared with two others of a band, and with one
    at each anchor. Then every pair that shares a band and lies in two
    components of what that links is compared, so no rejected pair costs a link
    and a large group no square of its size unless its texts are alike only in
    part.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    marked = written(sketches(d, k).withColumn("row", F.monotonically_increasing_id()), "nearmarked")
    classes = marked.groupBy("same").agg(F.min(F.struct("id", "row")).alias("m"))
    classes = written(classes.select("same", F.col("m.id").alias("low"), F.col("m.row").alias("row")), "nearclasses")
    reps = classes.select("row")
    small = written(join_ids(marked.drop("s", "same", "id"), reps, "left_semi"), "nearreps")
    marks, sets = small.select("row", "n", *PARITIES), marked.select("row", "s")
    every = small.select(F.explode("bands").alias("key"), "row")
    centres = every.groupBy("key").agg(F.count("*").alias("members"), F.min("row").alias("x"), F.min_by("row", F.xxhash64("key", "row")).alias("y")).where("members > 1")
    centres = written(centres.select("key", "x", "y"), "nearcentres")
    members = written(every.join(centres, "key"), "nearmembers")
    stars = members.select("row", F.explode(F.array("x", "y")).alias("centre")).where("row <> centre")
    fps = written(small.groupBy("fp").agg(F.min("row").alias("row")), "nearfps")
    equal = small.join(fps.select("fp", F.col("row").alias("centre")), "fp").where("row <> centre").select("row", "centre")
    stars = stars.union(anchor_stars(fps, near)).union(equal)
    first = stars.select(F.least("row", "centre").alias("a"), F.greatest("row", "centre").alias("b"))
    found = similar(first, sets, marks, similarity)
    named = written(components(found), "nearcomps")
    more = similar(crossing(members.select("key", "row"), named, marks, similarity), sets, marks, similarity)
    groups = written(components(found.union(more)), "neargroups") if not more.isEmpty() else named
    tied = written(classes.join(groups, classes.row == groups.node, "left").select("same", "low", F.coalesce("component", "row").alias("component")), "neartied")
    best = written(tied.groupBy("component").agg(F.min(F.struct("low", "same")).alias("k")), "nearbest")
    keys = written(tied.join(best, "component").select("same", F.col("k.low").alias("keeper"), (F.col("same") == F.col("k.same")).alias("stays")), "nearkeys")
    copies = marked.select("id", "same").distinct().join(keys, "same").where(~(F.col("stays") & (F.col("id") == F.col("keeper"))))
    out = written(copies.select(F.col("id").alias(id_col), "same", "keeper"), "nearcopies")
    drop(marked, small, members, centres)
    return out


def drop_near_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the near copies: of each group the row with the smallest id stays. All columns are kept.

    Rows that repeat an id and its text are one document and one of them stays.
    Rows with a null id can't be told apart and all stay.
    """
    gone = near_copies(docs, text, id_col).select(id_col, "same")
    value = F.coalesce(F.col(text), F.lit(""))
    mark = F.unhex(F.md5(F.when(value.rlike(WORD), value).otherwise(F.lit("")).cast("binary")))
    kept = docs
    if not gone.isEmpty():
        few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        other = gone.select(F.col(id_col).alias("gone_id"), F.col("same").alias("gone_same"))
        kept = docs.join(F.broadcast(other) if few else other, (F.col(id_col).cast("long") == F.col("gone_id")) & (mark == F.col("gone_same")), "left_anti")
    again = written(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "nearagain")
    if again.isEmpty():
        return kept
    once = join_ids(kept, again, "left_semi").dropDuplicates([id_col, text])
    return join_ids(kept, again, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
