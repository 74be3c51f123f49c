"""Toxicity by compression distance.

Two zstandard dictionaries, one of ordinary and one of ordinary and toxic text.
Every window of a document is compressed with both; what the second saves over
the first is how much nearer the window is to toxic text. How many windows save
how much, for the number of windows, gives a score through a calibrated
logistic function.

The ordinary dictionary is trained by zstandard. The toxic part is not: what
zstandard's own training takes from toxic documents is what all text has most
of (see the README for figures). It is chosen from the labelled documents
instead: the beginnings of words (whole words included) that documents labelled
toxic have far more often. Every window ends with a mark that both dictionaries
know, so that the fixed cost of a first match is paid on both sides and a
single further match shows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import read_table, written
from weftline.llm.pyworker import release, word_lists

#: Bounds of the training sample: documents of each class, and of each at most so many stretches of so many characters, spread evenly over a longer text.
TRAIN_DOCS = 2000
STRETCHES, STRETCH_CHARS = 12, 4000
WINDOW_WORDS = 8
ORDINARY_BYTES = 2048
STEM_SHARE, STEM_ODDS = 0.03, 5.0
#: How much more frequent a beginning must be, as a two-proportion z; which of these, the labels decide.
STEM_Z = (6.5, 8.0, 9.5, 11.0, 13.0)
MARK = bytes(range(1, 9)) + bytes(range(14, 30))
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def encoders(self) -> tuple[zs.ZstdCompressor, zs.ZstdCompressor]:
        return encoder(self.ordinary), encoder(self.toxic)

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - np.array(self.mean)) / np.array(self.scale)
        z = x @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def encoder(content: bytes) -> zs.ZstdCompressor:
    """A compressor whose dictionary is ``content``, with a search that finds every match of 5 bytes."""
    how = zs.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=5, target_length=32, strategy=zs.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=how)


def windows(text: str | None, size: int = WINDOW_WORDS) -> Iterator[bytes]:
    """Every word of the text, ``size`` to a window, space-joined with a space at each end."""
    for found in word_lists(text):
        for at in range(0, len(found), size):
            yield b" " + b" ".join(found[at : at + size]) + b" " + MARK


def features(text: str | None, ordinary: zs.ZstdCompressor, toxic: zs.ZstdCompressor) -> list[float]:
    """Counts of windows by what the toxic dictionary saves: 1, 2, 3, more bytes; as shares and logarithms."""
    n, saved = 0, [0, 0, 0, 0]
    a, b = ordinary.compress, toxic.compress
    for w in windows(text):
        n += 1
        d = len(a(w)) - len(b(w))
        if d > 0:
            saved[min(d, 4) - 1] += 1
    per = max(n, 1)
    return [*(s / per for s in saved), *(math.log1p(s) for s in saved), sum(saved[1:]) / per, math.log1p(sum(saved[1:])), math.log1p(n)]


def stems(toxic: list[str], ordinary: list[str]) -> list[tuple[float, bytes]]:
    """Beginnings of words that are far more frequent among toxic documents, with their z, the least telling first.

    Of nested beginnings the one with the highest two-proportion z stays.
    """

    def frequency(docs: list[str]) -> Counter:
        out: Counter = Counter()
        for t in docs:
            seen: set[bytes] = set()
            for found in word_lists(t):
                for w in set(found):
                    w = b" " + w
                    seen.update(w[:n] for n in range(4, min(len(w), 12) + 1))
                    seen.add(w + b" ")
            out.update(seen)
        return out

    a, b, na, nb = frequency(toxic), frequency(ordinary), max(len(toxic), 1), max(len(ordinary), 1)
    found = []
    for s, x in a.items():
        p, q = x / na, b[s] / nb
        both = (x + b[s]) / (na + nb)
        z = (p - q) / math.sqrt(max(both * (1 - both), 1e-12) * (1 / na + 1 / nb))
        if z > STEM_Z[0] and p > STEM_ODDS * q and p >= STEM_SHARE:
            found.append((z, s))
    kept: list[tuple[float, bytes]] = []
    for z, s in sorted(found, reverse=True):
        if not any(s.startswith(k) or k.startswith(s) for _, k in kept):
            kept.append((z, s))
    return kept[::-1]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge * max(len(x), 1) / 100)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def log_loss(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    z = np.clip(np.c_[x, np.ones(len(x))] @ w, -40, 40)
    return float(np.sum(np.logaddexp(0, z) - y * z))


def train(labelled: list[tuple[str, int]], prior: float) -> Model:
    """A model from (text, label) rows. Dictionaries come from two thirds of each class, the calibration from the rest, which also decides how telling a beginning must be.

    ``prior``: the share of toxic documents, to which the calibration is
    weighted back. Without rows of both classes every score is the prior.
    """
    toxic, ordinary = [t for t, y in labelled if y == 1], [t for t, y in labelled if y == 0]
    base_of = lambda rows: [t for i, t in enumerate(rows) if i % 3 < 2]
    names = len(features("", encoder(MARK), encoder(MARK)))
    if len(toxic) < 4 or len(ordinary) < 4:
        constant = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return Model(MARK, MARK, (0.0,) * names, (1.0,) * names, (0.0,) * names + (constant,))
    try:
        base = zs.train_dictionary(ORDINARY_BYTES, [b" ".join(x) for t in base_of(ordinary) for x in word_lists(t)]).as_bytes()
    except zs.ZstdError:  # too little text to train on
        base = b" ".join(x for t in base_of(ordinary) for f in word_lists(t) for x in f)[-ORDINARY_BYTES:]
    found = stems(base_of(toxic), base_of(ordinary))
    held = [(s, 1) for s in toxic[2::3]] + [(s, 0) for s in ordinary[2::3]]
    y = np.array([y for _, y in held], dtype=float)
    best: tuple = ()
    for telling in dict.fromkeys(b"".join(s for z, s in found if z > least) for least in STEM_Z):
        o, t = encoder(base + MARK), encoder(base + telling + MARK)
        x = np.array([features(s, o, t) for s, _ in held])
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        x = (x - mean) / scale
        # each half is told by weights from the other
        loss = sum(log_loss(fit_logistic(x[1 - k :: 2], y[1 - k :: 2]), x[k::2], y[k::2]) for k in (0, 1))
        if not best or loss < best[0]:
            best = (loss, telling, mean, scale, fit_logistic(x, y))
    _, telling, mean, scale, w = best
    model = Model(base + MARK, base + telling + MARK, (), (), ())
    odds = lambda p: math.log(max(p, 1e-6) / max(1 - p, 1e-6))
    w[-1] += odds(prior) - odds(y.mean())
    return Model(model.ordinary, model.toxic, tuple(mean), tuple(scale), tuple(w))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, use: Column, text: str, id_col: str) -> tuple[list[tuple[str, int]], float]:
    """At most TRAIN_DOCS labelled texts of each class, chosen by a hash of the id, and the share of toxic rows among all that ``use`` lets in.

    An id with several labels is toxic if one of them says so; of several texts
    the smallest is learned from.
    """
    lab = labels.where(use & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("y"))
    counts = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    by_hash = [F.xxhash64(id_col, F.lit(9)), id_col]

    def draw(y: int) -> DataFrame:
        # twice as many as needed pass a threshold on the hash, so that tasks send few rows however many tasks there are
        share = min(1.0, (2 * TRAIN_DOCS + 200) / max(counts.get(y, 0), 1))
        passing = F.shiftrightunsigned(F.xxhash64(id_col, F.lit(9)), 11) < F.lit(int(share * 2**53))
        return lab.where((F.col("y") == y) & passing).orderBy(*by_hash).limit(TRAIN_DOCS)

    chosen = written(draw(1).union(draw(0)), "toxtrain")
    texts = docs.where(F.col(text).isNotNull()).select(id_col, F.col(text).alias("t")).join(F.broadcast(chosen), id_col)
    gap = (F.length("t") - STRETCH_CHARS) / (STRETCHES - 1)
    spread = F.concat_ws(" ", *(F.substring(F.col("t"), (F.floor(gap * i) + 1).cast("int"), F.lit(STRETCH_CHARS)) for i in range(STRETCHES)))
    texts = texts.withColumn("t", F.when(F.length("t") <= STRETCHES * STRETCH_CHARS, F.col("t")).otherwise(spread)).groupBy(id_col).agg(F.min("t").alias("t"), F.first("y").alias("y"))
    rows = sorted((r[id_col], r["t"], r["y"]) for r in texts.collect())
    return [(t, y) for _, t, y in rows], counts.get(1, 0) / max(sum(counts.values()), 1)


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score``, the chance (0 to 1) that a text is toxic, from its whole text. Null and blank texts get the score of no windows."""
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = packed.value
        o, t = m.encoders()
        for batch in texts:
            x = np.array([features(s.as_py(), o, t) for s in batch]).reshape(len(batch), -1)
            yield pa.array(m.score(x) if len(x) else np.empty(0))
        release()

    of = F.arrow_udf(of, "double")
    return docs.withColumn("score", of(F.col(text)))


def in_training(id_col: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text isn't 1 modulo 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id_col: str = "doc_id") -> Model:
    """A model trained on the labelled documents of the training fold."""
    return train(*training_rows(docs, labels, label, in_training(id_col), text, id_col))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document. A null id counts as held out; repeated rows are scored alike; extra columns are ignored."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", (~F.coalesce(in_training(), F.lit(False))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, reference: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more under a model trained on ``reference`` and ``labels``. All columns are kept."""
    names = docs.columns
    model = fit(reference, labels)
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("text").alias("text"))
    return score_documents(boxed, model).where(F.col("score") < threshold).select(*(F.col("row").getField(c).alias(c) for c in names))
