"""Secrets in texts: fixed patterns, and strings that compression finds new.

Patterns find what looks like a credential by its form. Beside them every long
string of letters and digits that follows a sensitive word is measured: zstandard,
primed with a dictionary of identifiers (words of code, and the names that most
documents of the corpus use), compresses the text around the string with and
without it. The difference are the string's marginal bytes. Names, repeated ids
and words cost few, as they are copied from what is known; a random key costs
a byte or more for each character and is reported.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import read_table
from weftline.llm.pyworker import release

#: The kinds in the order of a report, with their patterns and least lengths.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

#: Strings that may be new, and the words that make their context sensitive, at most CONTEXT code points before them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|key|cred|auth|bearer|private|signature|session", re.ASCII | re.IGNORECASE)
CONTEXT = 64
#: Code points of text on either side with which a string is compressed, characters of a piece, and marginal bytes for each character from which a string is new.
AROUND = 400
PIECE = 32
NOVELTY = 0.98
#: An identifier, and how many of the corpus the dictionary has.
IDENTIFIER = re.compile(r"[A-Za-z_]{5,40}")
IDENTIFIERS = 2000
HELD = 400_000
CODE_WORDS = """
abstract argument array assert async await boolean break buffer callback catch class client config connection const constructor content context
continue count data database date debug default delete description double element else encoding enum error event example except exception export
extends false field file filter final finally float format from function global handler hash header height host http https implements import index
input instance integer interface item iterator label length library limit list load local location logger long main match message method module name
namespace network none null number object offset option output override package param parent parse path pattern pointer port position prefix print
private process property protected protocol public query queue random range read record reference register remote request require resource response
result return root schema scope script select self sequence server service session setting short signature size socket source start state static
status stdout stream string struct struct suffix super switch system table target task template test text this thread throw time timeout timestamp
title token transaction transform true type undefined unit update upload user username utils value variable vector version virtual void volatile while
width window with worker write yield access_token api_key client_id client_secret private_key public_key secret_key user_id
""".split()  # fmt: skip


def encoder(content: bytes) -> zs.ZstdCompressor:
    """A compressor whose dictionary is ``content``, with a search that finds matches of 4 bytes."""
    how = zs.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=5, min_match=4, target_length=32, strategy=zs.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=how)


def marginal_bytes(candidate: str, before: str, after: str, known: zs.ZstdCompressor) -> int:
    """What ``candidate`` adds to the compressed size of the text around it, summed over pieces that are too short for an entropy code of their own."""
    a, b, c = (x.encode("utf-8", "surrogatepass") for x in (before, after, candidate))
    without, pieces = len(known.compress(a + b)), -(-len(c) // PIECE)
    cuts = [len(c) * i // pieces for i in range(pieces + 1)]
    return sum(len(known.compress(a + c[i:j] + b)) - without for i, j in zip(cuts, cuts[1:], strict=False))


def scan(text: str | None, known: zs.ZstdCompressor, novelty: float = NOVELTY) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, marginal bytes a character) of a text's secrets, by start and then kind; offsets are code points, end exclusive."""
    text = text or ""
    low = text.lower()
    found: list[tuple[str, int, int, float | None]] = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    taken, at = sorted((s, e) for _, s, e, _ in found), 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if any(a < e for a, _ in taken[at : at + 1]) or not SENSITIVE.search(text, max(0, s - CONTEXT), s):
            continue
        if not (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])):
            continue
        share = marginal_bytes(m[0], text[max(0, s - AROUND) : s], text[e : e + AROUND], known) / (e - s)
        if share >= novelty:
            found.append(("novel", s, e, share))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def common_identifiers(docs: DataFrame, text: str = "text", top: int = IDENTIFIERS) -> list[str]:
    """The ``top`` names that most texts have, counted over all of them; at most so many reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            names = pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["name", "n"])
            held.clear()
            return names

        for batch in batches:
            for t in batch.column(0):
                held.update(set(IDENTIFIER.findall(t.as_py() or "")))
            if len(held) > HELD:
                yield out()
        yield out()
        release()

    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    return [r["name"] for r in counts.orderBy(F.col("n").desc(), "name").limit(top).collect()]


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", novelty: float = NOVELTY, identifiers: int = IDENTIFIERS) -> DataFrame:
    """(id, secrets array<struct<kind, start, end, novelty>>), a row for each row of ``docs``.

    Kinds are ``assign``, ``access`` and ``hex`` by their patterns, leftmost and
    without overlap within a kind, and ``novel``: a string of 16 or more letters
    and digits that overlaps none of these, has a sensitive word at most 64 code
    points before it, and takes ``novelty`` or more marginal bytes a character.
    Secrets are ordered by start, then kind. Null, empty and blank texts have
    none; repeated rows and ids are rows like any others; further columns are
    ignored; an empty table gives an empty result.
    """
    known = " ".join([*common_identifiers(docs, text, identifiers)[::-1], *CODE_WORDS]).encode()
    packed = docs.sparkSession.sparkContext.broadcast(known)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))

    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = encoder(packed.value)
        for batch in texts:
            yield pa.array([[dict(zip(("kind", "start", "end", "novelty"), f, strict=True)) for f in scan(t.as_py(), known, novelty)] for t in batch], kind)
        release()

    of = F.arrow_udf(of, "array<struct<kind: string, start: int, end: int, novelty: double>>")
    return docs.select(F.col(id_col), of(F.col(text)).alias("secrets"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document's secrets by pattern, a digest of these, and all spans; see find_secrets."""
    found = find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), number("novel"))
