"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each
place of a text; dynamic programming carries the best score and its number of
pieces, and nothing else. The rules are those of the tokenizer: text begins
with a mark for white space and spaces are such marks; a character without a
piece of its own may be an unknown one, at the lowest score less 10; of equal
scores the path that was found first, from the earlier start, stays; a run of
unknown characters counts as the bytes that stand for it.

Pieces of this vocabulary hold the mark only at their beginning, so a best path
passes every place where a mark follows another character. Stretches between
such places are counted once each and remembered. With scores that are whole
numbers, as here, the sums are exact in either way of adding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import read_table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 500_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and scores, and whether all 256 byte pieces are there for what has no piece."""

    pieces: dict[str, float] = field(repr=False)
    byte_fallback: bool = True

    @property
    def unknown_score(self) -> float:
        return min(self.pieces.values(), default=0.0) - UNKNOWN_PENALTY


def load_vocabulary(path: str) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model file and their scores, taken as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    return Vocabulary(plain, sum(map(model.is_byte, ids)) == 256)


def default_vocabulary() -> str:
    """The path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """Counts of texts under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.unknown = vocabulary.unknown_score
        self.bytes = vocabulary.byte_fallback
        # where a mark is inside a piece, stretches can't be cut in front of it
        self.cuts = not any(MARK in p.lstrip(MARK) for p in vocabulary.pieces)
        self.seen: dict[str, int] = {}

    def best(self, text: str) -> int:
        """The number of tokens of the best path over ``text``, which has its marks already."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (size, score) in self.automaton.iter(text):
            ends[end].append((end - size + 1, score))
        score, count, was_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            char = text[end]
            found = ends[end]
            found.sort()
            top, start = None, -1
            for s, x in found:
                total = score[s] + x
                if top is None or total > top:
                    top, start = total, s
            if char not in self.single and (top is None or score[end] + self.unknown > top):
                top = score[end] + self.unknown
                start = end
                size = len(char.encode("utf-8", "surrogatepass")) if self.bytes else (0 if was_unknown[end] else 1)
                count[end + 1], was_unknown[end + 1] = count[end] + size, True
            else:
                count[end + 1] = count[start] + 1
            score[end + 1] = top
        return count[n]

    def stretches(self, text: str) -> Iterator[str]:
        """The text cut in front of every mark that follows another character."""
        at, n = 0, len(text)
        while at < n:
            end = at
            while end < n and text[end] == MARK:
                end += 1
            nxt = text.find(MARK, end)
            nxt = n if nxt < 0 else nxt
            yield text[at:nxt]
            at = nxt

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.cuts:
            return self.best(marked)
        total, seen = 0, self.seen
        parts = marked.split(MARK) if MARK * 2 not in marked and MARK not in text else None
        for part in parts[1:] if parts is not None else self.stretches(marked):
            got = seen.get(part)
            if got is None:
                got = self.best(part if parts is None else MARK + part)
                if len(seen) >= REMEMBERED:
                    seen.clear()
                if len(part) < 100:
                    seen[part] = got
            total += got
        return total


def count_tokens(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with a column ``n_tokens``: the tokens of each whole text under the vocabulary file ``vocabulary`` (read by the driver).

    Null and empty texts have none. Repeated rows are counted alike. A text
    that is one long stretch is counted in memory in proportion to it.
    """
    packed = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary or default_vocabulary()))

    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(packed.value)
        for batch in texts:
            yield pa.array([counter.count(t.as_py()) for t in batch], pa.int64())

    return docs.withColumn("n_tokens", F.arrow_udf(of, "bigint")(F.col(text)))


def op4_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_tokens")
