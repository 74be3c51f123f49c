"""Language-model scoring under a hierarchical Pitman-Yor model.

Every context of two words, of which the farther one is known by one of CLASSES
hash classes, has a restaurant. Its parent is the restaurant of the nearer
word, which all contexts that end with it share, and the parent of these is one
root, whose base is uniform over the known words and one unknown. Dishes are
words; a new table sends a customer to the parent. Seatings are sampled by
Gibbs: in a sweep every customer is taken from its table and seated again, given
all others, a turn after the other. A dish is kept as its numbers of customers and
tables; the sizes of its tables, given these, are independent of all else, so
whether a customer sits alone is drawn from them exactly (see Alone).
Predictive probabilities are averaged over the last sweeps. Discounts come from
the counts of counts, strengths from the seatings.

Layout: texts are hashed once into blocks of some hundred thousand tokens. An
occurrence (context, word, document) goes to the bucket of its nearer context
word, so a bucket has whole restaurants of both levels. A word so frequent that
its contexts would overload a bucket has several restaurants, one for each part
of the classes. What a bucket needs of the root, a number for each of its
words, is asked for and answered in packed rows by the hash of the word, after
all buckets have said how many customers they send there. Blocks get back the
sums for their documents. Buckets are worked on in PASSES groups, so that only
a part of them is in flight at any time. Nothing that grows with the corpus
passes the driver but the list of split words, one for each SPLIT_TOKENS at
most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import drop, read_table, written
from weftline.llm.pyworker import release, word_lists

BLOCK_TOKENS, BLOCK_DOCS = 600_000, 30_000
BUCKET_TOKENS = 500_000
SPLIT_TOKENS = 300_000
PASSES = 3
CLASSES = 256
#: Sweeps before the root is sampled again, after that, and those that are averaged.
SWEEPS, BURN_IN, AVERAGED = 6, 3, 3
ROOT_SWEEPS = 12
#: Turns of a sweep. A dish of as many customers or fewer has one of them seated again in each of its turns, any other an equal part.
TURNS = 64
SEED = 10
NO_ID = np.iinfo(np.int64).min
MASK = np.uint64((1 << 48) - 1)
#: The end and the start of a text as tokens. No word has these hashes but by a chance of 2**-48.
END, START = np.uint64(0xE0D0E0D0E0D0), np.uint64(0x57A257A257A2)
BLOCK = "block bigint, keys binary, ids binary, sizes binary, before binary, words binary, tokens binary"
ROW = "kind int, block bigint, bucket int, part int, a binary, b binary, c binary, d binary, e binary, f binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]


# --- texts to blocks of tokens ---


def tokens(text: str | None) -> np.ndarray:
    """48-bit hashes of a text's words and of its end."""
    parts = [np.frombuffer(b"".join(map(xxhash.xxh64_digest, x)), dtype=">u8").astype(np.uint64) & MASK for x in word_lists(text)]
    return np.concatenate([*parts, np.array([END])])


def trains(doc_id: int) -> bool:
    """Whether a document is learned from: crc32 of its id as text, modulo 7, isn't 2. Null ids are held out."""
    return doc_id != NO_ID and zlib.crc32(str(doc_id).encode()) % 7 != 2


def pack(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of whole numbers, byte by byte, compressed."""
    raw = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def unpack(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(width, -1)
    out = raw[0].astype(np.int64)
    for k in range(1, width):
        if raw[k].any():  # the high bytes of most arrays are zeros
            out |= raw[k].astype(np.int64) << (8 * k)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def dealt(words: np.ndarray, parts: int) -> list[np.ndarray]:
    """The places of the words (hashes) of each part of the hashes, in order."""
    part = ((mixed(words) >> np.uint64(33)) % np.uint64(parts)).astype(np.int16)
    return np.split(np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))[:-1])


def tokenised(docs: DataFrame) -> DataFrame:
    """BLOCK rows of ``docs`` (id, text): for each document its key, id and number of tokens, the block's words and the tokens as places among them.

    A text that doesn't fit a block is cut into parts with the same key; each
    part has the two tokens before it.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        parts: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        size, number, key = 0, 0, task << 40

        def flush() -> pa.RecordBatch:
            nonlocal parts, size, number
            keys, ids, before, texts = zip(*parts, strict=True)
            words, at = np.unique(np.concatenate([*before, *texts]), return_inverse=True)
            row = [
                [(task << 24) | number], [pack(np.array(keys), 8)], [pack(np.array(ids, dtype=np.int64), 8)], [pack(np.array([len(t) for t in texts]), 4)],
                [pack(at[: 2 * len(parts)], 4)], [pack(words.view(np.int64), 6)], [pack(at[2 * len(parts) :], 4)],
            ]
            parts, size, number = [], 0, number + 1
            return pa.record_batch([pa.array(x, pa.int64() if i == 0 else pa.binary()) for i, x in enumerate(row)], names=[x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            for i, t in zip(ids, batch.column(1), strict=True):
                w = np.r_[START, START, tokens(t.as_py())]
                for at in range(2, len(w), BLOCK_TOKENS):
                    parts.append((key, int(i), w[at - 2 : at], w[at : at + BLOCK_TOKENS]))
                    size += len(parts[-1][3])
                    if size >= BLOCK_TOKENS or len(parts) >= BLOCK_DOCS:
                        yield flush()
                key += 1
        if parts:
            yield flush()
        release()

    return docs.mapInArrow(expand, BLOCK)


def rows_of(rows: list[dict]) -> pa.Table:
    """ROW rows; what is not given is null."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.table([pa.array([r.get(n) for r in rows], kinds[x.split()[1]]) for n, x in zip(NAMES, ROW.split(", "), strict=True)], names=NAMES)


def mapped(table: DataFrame, one) -> DataFrame:
    """ROW rows that ``one`` makes of each row of ``table`` (a dictionary)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = rows_of(one(batch.slice(i, 1).to_pylist()[0]))
                yield from found.to_batches()
        release()

    return table.mapInArrow(each, ROW)


# --- words and their counts ---


def word_rows(parts: int):
    """Of a block: for each part the words of its hash range and how often each is learned from (kind 0: part, a words, b counts)."""

    def one(r: dict) -> list[dict]:
        words, at = unpack(r["words"], 6), unpack(r["tokens"], 4)
        learn = np.array([trains(int(i)) for i in unpack(r["ids"], 8)], dtype=bool)
        n = np.bincount(at[np.repeat(learn, unpack(r["sizes"], 4))], minlength=len(words))
        return [{"kind": 0, "part": p, "a": pack(words[use], 6), "b": pack(n[use], 4)} for p, at in enumerate(dealt(words, parts)) if len(use := at[n[at] > 0])]

    return one


def summed(key: tuple, table: pa.Table) -> pa.Table:
    """The rows of a part as one: its sorted words and their sums."""
    words = np.concatenate([unpack(x.as_py(), 6) for x in table["a"]])
    words, at = np.unique(words, return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([unpack(x.as_py(), 4) for x in table["b"]]), minlength=len(words)).astype(np.int64)
    return rows_of([{"kind": 0, "part": key[0].as_py(), "a": pack(words, 6), "b": pack(n, 5)}])


def totals(r: dict) -> list[dict]:
    """The number of words of a part and the sum of their counts (kind 1), and its words to split (kind 2)."""
    words, n = unpack(r["a"], 6), unpack(r["b"], 5)
    often = n > SPLIT_TOKENS
    return [{"kind": 1, "block": len(n), "a": pack(np.array([n.sum()]), 8)}, {"kind": 2, "a": pack(words[often], 8), "b": pack(n[often], 8)}]


# --- seatings ---


class Alone:
    """The chance that a customer of a dish with c customers at t tables sits alone, under discount ``a``.

    That is S(c - 1, t - 1) / S(c, t) with S the generalised Stirling numbers:
    from their recursion up to EXACT customers, and beyond from table sizes
    drawn independently with the mean c / t, which is its limit.
    """

    EXACT = 160

    def __init__(self, a: float) -> None:
        self.a, n = a, self.EXACT
        logs = np.full((n + 1, n + 2), -np.inf)
        logs[0, 0] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            for c in range(1, n + 1):
                t = np.arange(1, n + 1)
                stay = np.where(c - 1 - a * t > 0, np.log(np.maximum(c - 1 - a * t, 1e-300)) + logs[c - 1, 1 : n + 1], -np.inf)
                logs[c, 1 : n + 1] = np.logaddexp(logs[c - 1, :n], stay)
            self.table = np.zeros((n + 1, n + 1))
            self.table[1:, 1:] = np.nan_to_num(np.exp(logs[:n, :n] - logs[1:, 1 : n + 1]), nan=0.0, posinf=0.0)
        self.flat = self.table.ravel()
        v = np.concatenate([np.logspace(-9, -2, 2000), np.linspace(0.01, 1.0, 4000)[1:-1]])
        z = 1 - v ** (1 / (1 - a))
        self.share, self.chance = np.r_[0.0, (1 - v ** (a / (1 - a))) * v / (a * z), 1.0], np.r_[0.0, v, 1.0]

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        at, many = c * (self.EXACT + 1) + t, (c > self.EXACT).nonzero()[0]
        if not len(many):
            return self.flat.take(at)
        at[many] = 0
        out, t = self.flat.take(at), t[many]
        out[many] = np.interp(t / c[many], self.share, self.chance) * (t > 1)
        return out


@lru_cache(maxsize=4)
def alone_of(a: float) -> Alone:
    """A worker's tables serve all its buckets."""
    return Alone(a)


def drawn(rng: np.random.Generator, m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binomial draws, and the places of more than one trial. One, which is what nearly all have, is a comparison: a binomial takes many times as long."""
    out, many = ((rng.random(len(m)) < p) & (m > 0)).astype(np.int64), (m > 1).nonzero()[0]
    if len(many):
        out[many] = rng.binomial(m[many], np.minimum(np.maximum(p[many], 0), 1))
    return out, many


def leave(rng: np.random.Generator, c: np.ndarray, t: np.ndarray, m: np.ndarray, alone: Alone) -> np.ndarray:
    """The tables that close when ``m`` customers of each dish leave; one stays open where customers stay, and no more than these can fill."""
    closed, many = drawn(rng, m, alone(c, t))
    if len(many):  # the chance of one customer keeps to both by itself
        c, t, m = c[many], t[many], m[many]
        closed[many] = np.minimum(np.maximum(closed[many], t - (c - m)), np.maximum(t - (c > m), 0))
    return closed


def arrive(rng: np.random.Generator, c: np.ndarray, t: np.ndarray, m: np.ndarray, new: np.ndarray, a: float) -> np.ndarray:
    """The tables that open when ``m`` customers join dishes of ``c`` customers at ``t`` tables; ``new`` is the weight of a new table. The first customer of a dish opens one."""
    first = 0
    if np.count_nonzero(c) < len(c):
        first = (c == 0) & (m > 0)
        c, t, m = c + first, t + first, m - first
    return first + drawn(rng, m, new / np.maximum(new + c - a * t, 1e-300))[0]


def due(c: np.ndarray, turn: int) -> np.ndarray:
    """How many customers of a dish are seated again in a turn; over the TURNS of a sweep these are all ``c``."""
    return (c + (TURNS - 1 - turn)) // TURNS


def reseat(rng: np.random.Generator, c: np.ndarray, t: np.ndarray, m: np.ndarray, new: np.ndarray, alone: Alone) -> tuple[np.ndarray, np.ndarray]:
    """(closed, opened) tables when ``m`` customers of each dish leave and are seated again."""
    closed = leave(rng, c, t, m, alone)
    return closed, arrive(rng, c - m, t - closed, m, new, alone.a)


def add(to: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """Add ``x`` at the places ``at``, which may repeat. Without a cast numpy is ten times as fast at it."""
    np.add.at(to, at, x.astype(to.dtype))


def falling(n: np.ndarray) -> np.ndarray:
    """The places of the numbers above 1, the largest first: the dishes that a turn still moves are a beginning of these."""
    at = np.flatnonzero(n > 1)
    return at[np.argsort(-n[at], kind="stable")]


def more_than(n: np.ndarray, least: int) -> int:
    """How many of the falling numbers ``n`` are above ``least``."""
    return len(n) - int(np.searchsorted(n[::-1], least, side="right"))


@dataclass(frozen=True)
class Setting:
    """Discounts and strengths of the root, the one-word and the two-word contexts; learned tokens and words; customers and tables of the root."""

    discounts: tuple[float, float, float]
    strengths: tuple[float, float, float]
    total: int
    distinct: int
    customers: float = 0.0
    tables: float = 0.0

    def root(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Predictive probability of words in the root."""
        a, s = self.discounts[0], self.strengths[0]
        return (c - a * t + (s + a * self.tables) / (self.distinct + 1)) / (s + self.customers)


def discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1.0), 0.05, 0.95))


def digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x, dtype=float)
    for _ in range(6):
        out -= np.where(x < 6, 1 / x, 0.0)
        x = np.where(x < 6, x + 1, x)
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def strength_terms(c: np.ndarray, t: np.ndarray, a: float, s: float) -> np.ndarray:
    """Of restaurants with c > 1 customers at t tables: the expected auxiliary counts and logarithms from which a strength is drawn under a Gamma(1, 1) prior."""
    c, t = c[c > 1], t[c > 1]
    if not len(c):
        return np.zeros(2)
    counts = (s / a) * (digamma(s / a + t) - digamma(np.full(len(t), s / a + 1)))
    return np.array([counts.sum(), (digamma(np.full(len(c), s + 1.0)) - digamma(s + c)).sum()])


class Bucket:
    """The restaurants of a bucket.

    Rows of its occurrences are sorted by (c1, far, w): the places in ``words``
    of the nearer context word and of the word, and the class of the farther
    one. ``q`` numbers the distinct ones, learned from ``n`` times each.
    """

    def __init__(self, words: np.ndarray, c1: np.ndarray, far: np.ndarray, w: np.ndarray, learn: np.ndarray, split: dict[str, np.ndarray]) -> None:
        self.words = words
        turn2 = np.r_[True, (c1[1:] != c1[:-1]) | (far[1:] != far[:-1])]
        new = turn2 | np.r_[True, w[1:] != w[:-1]]
        at = np.flatnonzero(new)
        self.q = (np.cumsum(new) - 1).astype(np.int32)
        self.n = np.add.reduceat(learn.astype(np.int64), at)
        self.w = w[at]
        self.r2 = (np.cumsum(turn2) - 1)[at].astype(np.int32)
        first = np.flatnonzero(turn2)
        _, parent = np.unique(c1[first].astype(np.int64) * CLASSES + part_of(words[c1[first]], far[first], split), return_inverse=True)
        dish, self.d = np.unique(parent[self.r2] * len(words) + self.w, return_inverse=True)
        self.d = self.d.astype(np.int32)
        self.d_r1, self.d_w = (dish // len(words)).astype(np.int32), (dish % len(words)).astype(np.int32)
        del turn2, new, at, dish
        self.c2 = np.bincount(self.r2, weights=self.n).astype(np.int64)
        self.t = np.minimum(self.n, 1)
        self.active = falling(self.n)
        self.c1 = np.bincount(self.d, weights=self.t, minlength=len(self.d_w)).astype(np.int64)
        self.t1 = np.minimum(self.c1, 1)
        self.sums()

    def sums(self) -> None:
        self.t2_sum = np.bincount(self.r2, weights=self.t, minlength=len(self.c2))
        self.c1_sum = np.bincount(self.d_r1, weights=self.c1)
        self.t1_sum = np.bincount(self.d_r1, weights=self.t1)

    def restore(self, t: np.ndarray, t1: np.ndarray) -> None:
        self.t[self.active], self.t1 = t, t1
        self.c1 = np.bincount(self.d, weights=self.t, minlength=len(self.t1)).astype(np.int64)
        self.sums()

    def prepare(self, s: Setting, p0: np.ndarray) -> None:
        """What a turn looks up of the dishes that move, side by side, so that those of a turn are the beginnings of these arrays."""
        self.s, self.p0 = s, p0[self.d_w]
        self.alone1, self.alone2 = alone_of(s.discounts[1]), alone_of(s.discounts[2])
        self.dishes2, self.n2, self.to_r2 = self.of(self.d[self.active]), self.n[self.active], self.r2[self.active].astype(np.intp)
        # the dishes above them, numbered as they first occur
        hit, first, at = np.unique(self.dishes2[0], return_index=True, return_inverse=True)
        order = np.argsort(first)
        self.above, number = self.of(hit[order]), np.empty_like(order)
        number[order] = np.arange(len(order))
        self.number = number[at]
        # a dish has no more customers than were learned from below it
        most = np.bincount(self.d, weights=self.n, minlength=len(self.d_w)).astype(np.int64)
        order = falling(most)
        self.dishes1, self.n1 = self.of(order), most[order]

    def of(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dishes ``d`` of the one-word contexts, their restaurants, and their probabilities in the root."""
        return d.astype(np.intp), self.d_r1[d].astype(np.intp), self.p0[d]

    def new1(self, r: np.ndarray, p0: np.ndarray) -> np.ndarray:
        """The weight of a new table for dishes of the one-word contexts."""
        return (self.s.strengths[1] + self.s.discounts[1] * self.t1_sum[r]) * p0

    def middle(self, d: np.ndarray | slice, r: np.ndarray, p0: np.ndarray) -> np.ndarray:
        """Predictive probability of dishes in their one-word contexts."""
        return (self.c1[d] - self.s.discounts[1] * self.t1[d] + self.new1(r, p0)) / (self.s.strengths[1] + self.c1_sum[r])

    def sweep(self, rng: np.random.Generator) -> None:
        """Every customer is seated again, a turn after the other."""
        self.t2 = self.t[self.active]
        for turn in range(min(TURNS, int(self.n1.max(initial=0)))):
            self.turn(rng, turn)
        self.t[self.active] = self.t2

    def turn(self, rng: np.random.Generator, turn: int) -> None:
        """What is due of every dish is seated again, in the two-word contexts first; tables that open and close there join and leave the one-word contexts."""
        s, k = self.s, more_than(self.n2, turn)
        if k:
            n, t, r2 = self.n2[:k], self.t2[:k], self.to_r2[:k]
            new = (s.strengths[2] + s.discounts[2] * self.t2_sum[r2]) * self.middle(*(x[:k] for x in self.dishes2))
            closed, opened = reseat(rng, n, t, due(n, turn), new, self.alone2)
            t += opened - closed
            add(self.t2_sum, r2, opened - closed)
            gone, come = (np.bincount(self.number[:k], weights=x).astype(np.int64) for x in (closed, opened))
            hit = (gone + come).nonzero()[0]
            gone, come, (d, r, p0) = gone[hit], come[hit], (x[hit] for x in self.above)
            c, t = self.c1[d], self.t1[d]
            left = t - leave(rng, c, t, gone, self.alone1)
            now = left + arrive(rng, c - gone, left, come, self.new1(r, p0), s.discounts[1])
            add(self.c1_sum, r, come - gone)
            add(self.t1_sum, r, now - t)
            self.c1[d], self.t1[d] = c - gone + come, now
        c = self.c1[self.dishes1[0][: more_than(self.n1, max(turn, 1))]]
        act = (c > max(turn, 1)).nonzero()[0]
        if len(act):
            c, (d, r, p0) = c[act], (x[act] for x in self.dishes1)
            closed, opened = reseat(rng, c, self.t1[d], due(c, turn), self.new1(r, p0), self.alone1)
            self.t1[d] += opened - closed
            add(self.t1_sum, r, opened - closed)

    def predict(self) -> np.ndarray:
        """Predictive probability of every distinct occurrence."""
        s = self.s
        new = (s.strengths[2] + s.discounts[2] * self.t2_sum[self.r2]) * self.middle(slice(None), self.d_r1, self.p0)[self.d]
        return (self.n - s.discounts[2] * self.t + new) / (s.strengths[2] + self.c2[self.r2])

    def to_root(self) -> np.ndarray:
        """By word: the customers that this bucket sends to the root."""
        return np.bincount(self.d_w, weights=self.t1, minlength=len(self.words)).astype(np.int64)


def part_of(c1: np.ndarray, far: np.ndarray, split: dict[str, np.ndarray]) -> np.ndarray:
    """The part of the classes ``far`` that a context is in: 0 but for nearer words (hashes) that are split."""
    words, number = split["words"], split["number"]
    if not len(words):
        return np.zeros(len(c1), dtype=np.int64)
    at = np.minimum(np.searchsorted(words, c1), len(words) - 1)
    return far % np.where(words[at] == c1, number[at], 1)


# --- blocks to buckets ---


def occurrence_rows(buckets: int, split: dict[str, np.ndarray], turn: int):
    """Of a block: for each bucket of a pass its occurrences (bucket, block, a words, b c1, c classes, d w, e steps of 2 * document + whether it is learned from)."""

    def one(r: dict) -> list[dict]:
        words, w = unpack(r["words"], 6), unpack(r["tokens"], 4).astype(np.int32)
        sizes, ids, before = unpack(r["sizes"], 4), unpack(r["ids"], 8), unpack(r["before"], 4).reshape(-1, 2)
        learn = np.array([trains(int(i)) for i in ids], dtype=np.int32)
        doc = np.repeat(2 * np.arange(len(sizes), dtype=np.int32) + learn, sizes)
        begin = np.cumsum(sizes) - sizes
        c1 = np.r_[np.int32(0), w[:-1]]
        c1[begin] = before[:, 1]
        c2 = np.r_[np.int32(0), c1[:-1]]
        c2[begin] = before[:, 0]
        far = ((mixed(words) >> np.uint64(40)) % np.uint64(CLASSES)).astype(np.uint8)[c2]
        part = part_of(words[c1], far, split)
        bucket = ((mixed(words[c1] + (part << 48)) >> np.uint64(21)) % np.uint64(buckets)).astype(np.int32)
        mine = np.flatnonzero(bucket % PASSES == turn)
        mine = mine[np.argsort(bucket[mine], kind="stable")]
        chosen, cut = np.unique(bucket[mine], return_index=True)
        out = []
        for b, at in zip(chosen, np.split(mine, cut[1:]) if len(mine) else [], strict=True):
            used = np.zeros(len(words), dtype=bool)
            used[c1[at]] = used[w[at]] = True
            place = np.cumsum(used, dtype=np.int32) - 1
            out.append({"kind": 0, "bucket": int(b), "block": r["block"], "a": pack(words[used], 6), "b": pack(place[c1[at]], 4), "c": pack(far[at], 1), "d": pack(place[w[at]], 4), "e": pack(np.diff(doc[at], prepend=0), 2)})
        return out

    return one


def load(r: dict) -> tuple[np.ndarray, ...]:
    """(words, c1, class, w, document, whether it is learned from, block number) of a gathered bucket."""
    doc = unpack(r["e"], 2)
    return unpack(r["a"], 6), np.cumsum(unpack(r["b"], 4)).astype(np.int32), unpack(r["c"], 1).astype(np.int32), unpack(r["d"], 4).astype(np.int32), doc >> 1, (doc & 1).astype(bool), unpack(r["f"], 4)


def asks(bucket: Bucket, number: int, parts: int) -> list[dict]:
    """Rows that tell each part the words of this bucket and the customers that it sends (kind 1: bucket, part, a words, b customers)."""
    sent = bucket.to_root()
    return [{"kind": 1, "bucket": number, "part": p, "a": pack(bucket.words[use], 6), "b": pack(sent[use], 4)} for p, use in enumerate(dealt(bucket.words, parts)) if len(use)]


def gathering(parts: int, split: dict[str, np.ndarray]):
    """The rows of a bucket as one (kind 0), its questions to the root (kind 1) and its counts of counts (kind 2)."""

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").to_pylist()
        words = [unpack(r["a"], 6) for r in rows]
        every = np.unique(np.concatenate(words))
        place = [np.searchsorted(every, x).astype(np.int32) for x in words]
        c1, w = (np.concatenate([p[unpack(r[x], 4)] for p, r in zip(place, rows, strict=True)]) for x in "bd")
        far = np.concatenate([unpack(r["c"], 1).astype(np.uint8) for r in rows])
        docs = [np.cumsum(unpack(r["e"], 2)).astype(np.int32) for r in rows]
        block = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in docs])
        doc = np.concatenate(docs)
        number, blocks = key[0].as_py(), np.array([r["block"] for r in rows], dtype=np.int64)
        del words, place, docs, rows
        if len(every) < 1 << 27:
            order = np.argsort((c1.astype(np.int64) << 35) | (far.astype(np.int64) << 27) | w)
        else:
            order = np.lexsort((w, far, c1))
        c1, far, w, doc, block = c1[order], far[order], w[order], doc[order], block[order]
        del order
        whole = {"kind": 0, "bucket": number, "a": pack(every, 6), "b": pack(np.diff(c1, prepend=0), 4), "c": pack(far, 1), "d": pack(w, 4), "e": pack(doc, 2), "f": pack(block, 4)}
        b = Bucket(every, c1, far.astype(np.int32), w, (doc & 1) > 0, split)
        counts = np.array([(b.n == 1).sum(), (b.n == 2).sum(), (b.c1 == 1).sum(), (b.c1 == 2).sum()])
        out = rows_of([whole, {"kind": 3, "bucket": number, "a": pack(blocks, 8)}, *asks(b, number, parts), {"kind": 2, "a": pack(counts, 8)}])
        del b, c1, far, w, doc, block, whole
        release()
        return out

    return gather


# --- the root ---


def rooting(setting: Setting | None, step: int):
    """A part of the root (kind 0: part, a words, b counts, c customers, d tables) after the buckets have sent their customers, and its counts of counts (kind 2).

    ``setting``: None for the first time, with a table for each word; then the
    tables there were are sampled on.
    """

    def root(key: tuple, sent: pa.Table, known: pa.Table) -> pa.Table:
        if not known.num_rows:
            return rows_of([])
        r = known.to_pylist()[0]
        words = unpack(r["a"], 6)
        c = np.zeros(len(words), dtype=np.int64)
        for x in sent.select(["a", "b"]).to_pylist():
            w, n = unpack(x["a"], 6), unpack(x["b"], 4)
            use = n > 0
            c[np.searchsorted(words, w[use])] += n[use]
        t = np.minimum(c, 1)
        if setting is not None:
            rng = np.random.default_rng([SEED, step, key[0].as_py()])
            alone, tables = alone_of(setting.discounts[0]), setting.tables
            t = np.clip(unpack(r["d"], 5), np.minimum(c, 1), c)
            act = falling(c)
            n, seated, new = c[act], t[act], np.full(len(act), (setting.strengths[0] + setting.discounts[0] * tables) / (setting.distinct + 1))
            for turn in range(ROOT_SWEEPS * TURNS if len(act) else 0):
                k = more_than(n, max(turn % TURNS, 1))
                closed, opened = reseat(rng, n[:k], seated[:k], due(n[:k], turn % TURNS), new[:k], alone)
                seated[:k] += opened - closed
            t[act] = seated
        counts = np.array([(c == 1).sum(), (c == 2).sum(), c.sum(), t.sum()])
        release()
        return rows_of([{"kind": 0, "part": key[0].as_py(), "a": r["a"], "b": r["b"], "c": pack(c, 5), "d": pack(t, 5)}, {"kind": 2, "a": pack(counts, 8)}])

    return root


def answer(key: tuple, sent: pa.Table, known: pa.Table) -> pa.Table:
    """A part's answers (kind 1: bucket, part, a counts, b customers, c tables) to each row of questions, in the order of its words; words that aren't known have zeros."""
    r = known.to_pylist()[0] if known.num_rows else None
    words, *values = (unpack(r["a"], 6), *(unpack(r[x], 5) for x in "bcd")) if r else (np.empty(0, np.int64),) * 4
    out = []
    for x in sent.select(["bucket", "part", "a"]).to_pylist():
        asked = unpack(x["a"], 6)
        at = np.searchsorted(words, asked)
        found = np.zeros(len(asked), dtype=bool)
        inside = at < len(words)
        found[inside] = words[at[inside]] == asked[inside]
        given = [np.zeros(len(asked), dtype=np.int64) for _ in values]
        for to, v in zip(given, values, strict=True):
            to[found] = v[at[found]]
        out.append({"kind": 1, "bucket": x["bucket"], "part": x["part"], **{n: pack(v, 5) for n, v in zip("abc", given, strict=True)}})
    release()
    return rows_of(out)


def told(b: Bucket, answers: list[dict], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, customers and tables in the root) of each word of a bucket."""
    places = dealt(b.words, parts)
    out = [np.zeros(len(b.words), dtype=np.int64) for _ in range(3)]
    for r in answers:
        use = places[r["part"]]
        for x, name in zip(out, "abc", strict=True):
            x[use] = unpack(r[name], 5)
    return tuple(out)


# --- sampling and scoring ---


def sampling(setting: Setting, parts: int, split: dict[str, np.ndarray]):
    """SWEEPS sweeps over a bucket: its seating (kind 4: a, b tables), its customers for the root (kind 1) and the terms of its strengths (kind 2)."""

    def sample(key: tuple, whole: pa.Table, answers: pa.Table) -> pa.Table:
        words, c1, far, w, _, learn, _ = load(whole.to_pylist()[0])
        b = Bucket(words, c1, far, w, learn, split)
        del c1, far, w, learn
        number = key[0].as_py()
        _, c, t = told(b, answers.to_pylist(), parts)
        b.prepare(setting, setting.root(c, t))
        rng = np.random.default_rng([SEED, 1, number])
        for _ in range(SWEEPS):
            b.sweep(rng)
        terms = np.r_[strength_terms(b.c1_sum, b.t1_sum, setting.discounts[1], setting.strengths[1]), strength_terms(b.c2, b.t2_sum, setting.discounts[2], setting.strengths[2])]
        out = rows_of([{"kind": 4, "bucket": number, "a": pack(b.t[b.active], 5), "b": pack(b.t1, 5)}, *asks(b, number, parts), {"kind": 2, "a": terms.tobytes()}])
        del b
        release()
        return out

    return sample


UNIT = 1e-6


def scoring(setting: Setting, parts: int, split: dict[str, np.ndarray]):
    """Sums of a bucket for each block (kind 0: block, a documents, b known tokens, c and d base and model scores in units of UNIT), the model averaged over AVERAGED sweeps."""

    def score(key: tuple, whole: pa.Table, answers: pa.Table) -> pa.Table:
        words, c1, far, w, doc, learn, block = load(whole.to_pylist()[0])
        b = Bucket(words, c1, far, w, learn, split)
        del c1, far, w, learn
        rest = answers.to_pylist()
        n, c, t = told(b, [r for r in rest if r["kind"] == 1], parts)
        state, blocks = (next(r for r in rest if r["kind"] == k) for k in (4, 3))
        b.restore(unpack(state["a"], 5), unpack(state["b"], 5))
        b.prepare(setting, setting.root(c, t))
        rng = np.random.default_rng([SEED, 2, key[0].as_py()])
        p = np.zeros(len(b.n))
        for k in range(BURN_IN + AVERAGED):
            b.sweep(rng)
            if k >= BURN_IN:
                p += b.predict()
        model = np.log10(p / AVERAGED)[b.q]
        base = np.log10((n[b.w] + 1) / (setting.total + setting.distinct + 1))[b.q]
        known = (n[b.w] > 0)[b.q]
        del p, n, c, t, b
        each, at = np.unique((block << 15) | doc, return_inverse=True)
        sums = [np.bincount(at, weights=x, minlength=len(each)) for x in (known, base, model)]
        out, number = [], each >> 15
        for i, name in enumerate(unpack(blocks["a"], 8)):
            lo, hi = np.searchsorted(number, [i, i + 1])
            if hi > lo:
                out.append({"kind": 0, "block": int(name), "a": pack(each[lo:hi] & 0x7FFF, 2), "b": pack(sums[0][lo:hi], 4), "c": pack(np.rint(sums[1][lo:hi] / UNIT), 8), "d": pack(np.rint(sums[2][lo:hi] / UNIT), 8)})
        del each, at, sums, block, doc, model, base, known
        release()
        return rows_of(out)

    return score


SCORES = "key bigint, id bigint, n_tokens bigint, n_known bigint, base double, model double"


def per_document(key: tuple, sums: pa.Table, block: pa.Table) -> pa.Table:
    """SCORES of the documents of a block."""
    r = block.to_pylist()[0]
    keys, ids, sizes = unpack(r["keys"], 8), unpack(r["ids"], 8), unpack(r["sizes"], 4)
    out = np.zeros((3, len(keys)), dtype=np.int64)
    for x in sums.select(["a", "b", "c", "d"]).to_pylist():
        out[:, unpack(x["a"], 2)] += [unpack(x["b"], 4), unpack(x["c"], 8), unpack(x["d"], 8)]
    columns = [keys, ids, sizes.astype(np.int64), out[0], out[1] * UNIT, out[2] * UNIT]
    return pa.table([pa.array(c) for c in columns], names=[x.split()[0] for x in SCORES.split(", ")])


def numbers(df: DataFrame, kind: int, floats: bool = False) -> np.ndarray:
    """The sum of the small arrays of a kind, of which there is one for each task or bucket."""
    rows = df.where(F.col("kind") == kind).select("a").toLocalIterator()
    read = (lambda x: np.frombuffer(x, dtype=float)) if floats else (lambda x: unpack(x, 8))
    return sum((read(bytes(r["a"])) for r in rows), np.zeros(4))


def score_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    Learns from the documents of which trains() is true and scores all, by
    their whole texts. A null or blank text is its end alone. Rows that share
    an id, null ids among them, are documents of their own; null ids are held
    out. Without training tokens every token is unknown. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1000))
    blocks = written(tokenised(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))), "blocks")
    vocabulary = written(mapped(blocks, word_rows(parts)).groupBy("part").applyInArrow(summed, ROW), "vocabulary")
    found = written(mapped(vocabulary, totals), "totals")
    distinct, total, often = 0, 0, [np.empty((2, 0), dtype=np.int64)]
    for r in found.select("kind", "block", "a", "b").toLocalIterator():
        if r["kind"] == 1:
            distinct, total = distinct + r["block"], total + int(unpack(bytes(r["a"]), 8)[0])
        else:
            often.append(np.array([unpack(bytes(r[x]), 8) for x in "ab"]))
    often = np.concatenate(often, axis=1)
    often = often[:, np.argsort(often[0])]
    split = {"words": often[0], "number": np.minimum(-(-often[1] // SPLIT_TOKENS), CLASSES)}
    buckets = max(parts, -(-total // BUCKET_TOKENS))

    union = lambda tables: reduce(DataFrame.union, tables)
    joined = lambda left, right, key, f: left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(f, ROW)
    gathered = [written(mapped(blocks, occurrence_rows(buckets, split, k)).groupBy("bucket").applyInArrow(gathering(parts, split), ROW), "buckets") for k in range(PASSES)]
    heads = written(blocks.select("block", "keys", "ids", "sizes"), "heads")
    drop(blocks)
    asked = union(gathered).where("kind = 1")
    ones3, twos3, ones2, twos2 = numbers(union(gathered), 2)
    root = written(joined(asked, vocabulary, "part", rooting(None, 0)), "root")
    ones1, twos1, customers, tables = numbers(root, 2)
    setting = Setting((discount(ones1, twos1), discount(ones2, twos2), discount(ones3, twos3)), (1.0, 1.0, 1.0), total, distinct, customers, tables)
    answers = written(joined(asked, root.where("kind = 0"), "part", answer), "answers")
    of = lambda table, k: table.where(F.col("bucket") % PASSES == k)
    sampled = union([written(joined(g.where("kind = 0"), of(answers, k), "bucket", sampling(setting, parts, split)), "sampled") for k, g in enumerate(gathered)])
    counts1, logs1, counts2, logs2 = numbers(sampled, 2, floats=True)
    strengths = (1.0, (1 + counts1) / (1 - logs1), (1 + counts2) / (1 - logs2))
    asked = sampled.where("kind = 1")
    again = written(joined(asked, root.where("kind = 0"), "part", rooting(setting, 1)), "root")
    _, _, customers, tables = numbers(again, 2)
    setting = replace(setting, strengths=tuple(float(np.clip(s, 0.01, 100.0)) for s in strengths), customers=customers, tables=tables)
    drop(answers)
    answers = written(joined(asked, again.where("kind = 0"), "part", answer), "answers")
    sums = []
    for k, g in enumerate(gathered):
        rest = of(answers, k).union(of(sampled.where("kind = 4"), k)).union(g.where("kind = 3"))
        sums.append(written(joined(g.where("kind = 0"), rest, "bucket", scoring(setting, parts, split)), "sums"))
        drop(g)
    drop(answers, sampled)
    sums, blocks = union(sums), heads
    scored = sums.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(per_document, SCORES)
    scored = scored.groupBy("key", "id").agg(*(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "model")))
    ident = F.when(F.col("id") != int(NO_ID), F.col("id"))
    held = F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 7 == 2, F.lit(True))
    return scored.select(ident.alias(id_col), held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"))


def op10_pitmanyor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; see score_texts."""
    return score_texts(read_table(spark, sf_dir, "documents"))
