"""Vector compression by product codes, with codebooks from Lloyd's rounds over heaps.

A vector is cut into equal parts, each with a codebook of its own. Vectors are
kept as blocks, a row each: the components, the entry of every part, and for
each position and entry a heap of the block's parts that are assigned to it. A
part's key is its slack, lower minus upper bound: how much nearer the nearest
entry is than the second nearest, at the time of its last scan. When entries
move, an entry's drift grows by its own step and the largest step of the
others; a part whose key is above its entry's drift since then can't have
another nearest entry and isn't touched. The others are popped and scanned
exactly.

A round reads the blocks, writes them anew to the shared folder with what the
moved parts add to and take from the sums of their entries, and ends with one
row for each position and entry on the driver: codebooks are bounded by
positions x entries x components, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import drop, new_path, read_table, written
from weftline.llm.pyworker import release

#: Components times this, rounded down, are the integers; parts of a vector, entries of a codebook, rounds.
UNIT = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors of a block.
BLOCK = 4096
#: Components as integers stay below this in size, so that squared distances are exact in 64 bits.
WIDEST = 1 << 24
#: A label table of at most this many rows is broadcast.
LABELS = 100_000

STATE = "ids array<bigint>, labels array<string>, width int, vectors binary, entries binary, rows binary, keys binary, ends binary"
SUMS = "part int, entry int, n bigint, total array<bigint>"


def squared(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``parts`` to each entry: all terms are integers below 2**53 where doubles are used."""
    if max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0))) ** 2 * 4 * max(parts.shape[1], 1) < 1 << 53:
        x, c = parts.astype(np.float64), book.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    out = np.empty((len(parts), len(book)), dtype=np.int64)
    for k, c in enumerate(book):
        d = parts - c
        out[:, k] = (d * d).sum(axis=1)
    return out


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part its nearest entry, the lowest of equal ones, and its slack, rounded down by more than the error of the roots."""
    entry, slack = np.empty(len(parts), dtype=np.int64), np.full(len(parts), np.inf)
    for at in range(0, len(parts), 1024):
        d = squared(parts[at : at + 1024], book)
        rows = np.arange(len(d))
        entry[at : at + 1024] = best = d.argmin(axis=1)
        if len(book) > 1:
            upper = np.sqrt(d[rows, best].astype(np.float64))
            d = d.astype(np.float64)
            d[rows, best] = np.inf
            lower = np.sqrt(d.min(axis=1))
            slack[at : at + 1024] = lower - upper - 1e-10 * (lower + upper) - 1e-9
    return entry, slack


class Heaps:
    """The heaps of a block at one position, by entry."""

    def __init__(self, rows: np.ndarray, keys: np.ndarray, ends: np.ndarray) -> None:
        pairs = list(zip(keys.tolist(), rows.tolist(), strict=True))
        self.heaps = [pairs[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def violated(self, drift: np.ndarray) -> np.ndarray:
        """Pop all rows whose key the drift of their entry has reached."""
        out = []
        for heap, most in zip(self.heaps, (drift * (1 + 1e-12)).tolist(), strict=True):
            while heap and heap[0][0] <= most:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), dtype=np.int64)

    def push(self, entry: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        for e, k, r in zip(entry.tolist(), keys.tolist(), rows.tolist(), strict=True):
            heapq.heappush(self.heaps[e], (k, r))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = [x for h in self.heaps for x in h]
        return np.array([r for _, r in flat], dtype=np.int32), np.array([k for k, _ in flat], dtype=np.float64), np.cumsum([len(h) for h in self.heaps], dtype=np.int32)


def kept(vectors: DataFrame, vector: str, id_col: str, label: str) -> DataFrame:
    """(id, label, x) of ``vectors`` without null vectors and those with a null or non-finite component; x as integers."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.where(F.col("x").isNotNull() & ~odd).withColumn("x", F.transform("x", lambda c: F.floor(c * UNIT)))


def blocks(v: DataFrame, size: int, parts: int) -> DataFrame:
    """``v`` (id, label, x) as blocks without entries. Another length than ``size``, or a component of WIDEST or more, is an error."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                if (odd := np.asarray(b.column("x").value_lengths())[np.asarray(b.column("x").value_lengths()) != size]).size:
                    raise ValueError(f"a vector has {odd[0]} components, the first of all has {size}")
                x = b.column("x").flatten().to_numpy(zero_copy_only=False)
                if np.abs(x).max(initial=0) >= WIDEST:
                    raise ValueError(f"components must be below {WIDEST // UNIT} in size")
                width = 2 if np.abs(x).max(initial=0) < 1 << 15 else 4
                one = [b.column("id").to_pylist(), b.column("label").to_pylist(), width, x.astype(f"<i{width}").tobytes(), b"", b"", b"", b""]
                yield pa.record_batch([pa.array([c], t) for c, t in zip(one, [pa.list_(pa.int64()), pa.list_(pa.string()), pa.int32(), *[pa.binary()] * 5], strict=True)], names=[c.split()[0] for c in STATE.split(", ")])
        release()

    return v.mapInArrow(pack, STATE)


def unpacked(row: dict, size: int) -> np.ndarray:
    return np.frombuffer(row["vectors"], dtype=f"<i{row['width']}").reshape(-1, size).astype(np.int64)


def assign(state: DataFrame, books: list[np.ndarray], drift: np.ndarray, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The blocks with every part at the nearest entry of ``books``, and what that changes in the sums of the entries, by position and entry."""
    spark = state.sparkSession
    parts = len(books)
    step = size // parts
    packed = spark.sparkContext.broadcast((books, drift))
    names = [c.split()[0] for c in STATE.split(", ")]
    sums = [c.split()[0] for c in SUMS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, drift = packed.value
        n = [np.zeros(len(b), dtype=np.int64) for b in books]
        total = [np.zeros((len(b), step), dtype=np.int64) for b in books]
        for batch in batches:
            for row in batch.to_pylist():
                x = unpacked(row, size)
                known = np.frombuffer(row["entries"], dtype="<i4").reshape(parts, -1) if row["entries"] else None
                entries, out = np.empty((parts, len(x)), dtype="<i4"), ([], [], [])
                count = [len(b) for b in books]
                old = [np.frombuffer(row[c], dtype=t) for c, t in (("rows", "<i4"), ("keys", "<f8"), ("ends", "<i4"))] if row["ends"] else None
                for p, book in enumerate(books):
                    mine = x[:, p * step : (p + 1) * step]
                    if known is None:
                        heaps, rows = Heaps(np.empty(0), np.empty(0), np.zeros(count[p], dtype=np.int32)), np.arange(len(x))
                    else:
                        here = slice(p * len(x), (p + 1) * len(x))
                        heaps = Heaps(old[0][here], old[1][here], old[2][sum(count[:p]) : sum(count[: p + 1])])
                        rows = heaps.violated(drift[p])
                        entries[p] = known[p]
                    entry, slack = nearest(mine[rows], book)
                    heaps.push(entry, slack + drift[p][entry], rows)
                    moved = np.ones(len(rows), dtype=bool) if known is None else entry != known[p][rows]
                    for sign, e in ((1, entry[moved]), *([(-1, known[p][rows[moved]])] if known is not None else [])):
                        np.add.at(n[p], e, sign)
                        np.add.at(total[p], e, sign * mine[rows[moved]])
                    entries[p, rows] = entry
                    for o, a in zip(out, heaps.arrays(), strict=True):
                        o.append(a)
                now = row | {"entries": entries.tobytes(), **{c: np.concatenate(o).tobytes() for c, o in zip(("rows", "keys", "ends"), out, strict=True)}}
                yield pa.RecordBatch.from_pylist([now | dict.fromkeys(sums) | {"kind": 0}], schema=schema)
        found = [dict.fromkeys(names) | {"part": p, "entry": e, "n": int(n[p][e]), "total": total[p][e].tolist(), "kind": 1} for p in range(parts) for e in np.flatnonzero((n[p] != 0) | total[p].any(axis=1)).tolist()]
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=schema)
        release()

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    text = f"{STATE}, {SUMS}, kind int"
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in text.split(", ")])
    path = new_path(spark, name)
    state.mapInArrow(run, text).write.parquet(path)
    both = spark.read.schema(text).parquet(path)  # the sums are read without the blocks' columns
    return both.where("kind = 0").select(*names), both.where("kind = 1").select(*sums)


def code_vectors(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code array<int>, error) of ``vectors``, and the codebooks.

    Vectors that are null or hold a null or non-finite component are left out.
    Components are floor(1024 x). Each position's codebook starts as that part
    of the ``entries`` rows with the smallest ids (nulls last; of equal ids the
    smaller vector first; fewer rows, fewer entries). Each round assigns every
    part to its nearest entry, the lowest of equal ones, and moves each entry to
    the floors of its parts' means; an entry without parts stays. ``error`` is
    the sum of squared distances to the final entries. Rows with the same id are
    rows like any others; labels are text here; further columns are ignored; an
    empty table gives an empty result and no codebooks. All vectors must have
    one length, which ``parts`` divides, and components below 16384 in size;
    others raise an error.
    """
    spark = vectors.sparkSession
    v = kept(vectors, vector, id_col, label)
    first = [r["x"] for r in v.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()]
    if not first:
        return spark.createDataFrame([], "id bigint, label string, code array<int>, error bigint"), []
    size = len(first[0])
    if size % parts or any(len(x) != size for x in first):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    step = size // parts
    start = np.array(first, dtype=np.int64).reshape(len(first), size)
    if np.abs(start).max(initial=0) >= WIDEST:
        raise ValueError(f"components must be below {WIDEST // UNIT} in size")
    books = [start[:, p * step : (p + 1) * step].copy() for p in range(parts)]
    n, total = np.zeros((parts, len(first)), dtype=np.int64), np.zeros((parts, len(first), step), dtype=np.int64)
    drift = np.zeros((parts, len(first)))
    state = blocks(v, size, parts)
    for k in range(rounds + 1):
        before = state
        state, change = assign(before, books, drift, size, f"codes{k}")
        if k:
            drop(before)
        if k == rounds:
            break
        for r in change.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(step))).alias("total")).collect():  # positions x entries rows at most
            n[r["part"], r["entry"]] += r["n"]
            total[r["part"], r["entry"]] += np.array(r["total"], dtype=np.int64)
        for p, book in enumerate(books):
            used = n[p] > 0
            moved = book.copy()
            moved[used] = total[p][used] // n[p][used][:, None]
            steps = np.sqrt(((moved - book) ** 2).sum(axis=1).astype(np.float64))
            order = np.sort(steps)
            others = np.where(steps == order[-1], order[-2] if len(order) > 1 and (steps == order[-1]).sum() == 1 else order[-1], order[-1])
            drift[p] += steps + others
            books[p] = moved
    packed = spark.sparkContext.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, entries = unpacked(row, size), np.frombuffer(row["entries"], dtype="<i4").reshape(parts, -1)
                error = np.zeros(len(x), dtype=np.int64)
                for p, book in enumerate(packed.value):
                    d = x[:, p * step : (p + 1) * step] - book[entries[p]]
                    error += (d * d).sum(axis=1)
                yield pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(list(entries.T), pa.list_(pa.int32())), pa.array(error)], names=["id", "label", "code", "error"])
        release()

    found = written(state.mapInArrow(codes, "id bigint, label string, code array<int>, error bigint"), "codes")
    drop(state)
    return found, books


def op13_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors with their errors, summed by label too; see code_vectors. The label sums are broadcast if they are few, and joined by a shuffle otherwise."""
    coded, books = code_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join(str(c) for b in books for entry in b.tolist() for c in entry).encode()).hexdigest()
    sums = written(coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")), "labelsums")
    few = sums.limit(LABELS + 1).count() <= LABELS
    found = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("same")))
    code = F.concat(*(F.lpad(F.lower(F.hex(F.col("code")[p])), 2, "0") for p in range(PARTS)))
    return found.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
