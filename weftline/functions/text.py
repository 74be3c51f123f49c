"""Text functions of answer scoring, as Column to Column builders. Overlaps of texts and word lists, which no built-in finds in linear time, run in Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACES = r"[ \t\n\r\f\x0B]+"


def collapse(s: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(s, SPACES, " "))


def normalize_answer(s: Column) -> Column:
    """Lower case, without ASCII punctuation and the articles a, an, the; white space collapsed."""
    bare = F.translate(F.lower(s), PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "))


def tokens(s: Column) -> Column:
    """White-space tokens."""
    return F.array_remove(F.split(F.trim(F.regexp_replace(s, SPACES, " ")), " "), "")


def contains_either_way(a: Column, b: Column) -> Column:
    """1 where either normalised text contains the other; an empty one is contained in any."""
    x, y = normalize_answer(a), normalize_answer(b)
    return ((F.instr(x, y) > 0) | (F.instr(y, x) > 0)).cast("double")


def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else sum((Counter(x) & Counter(y)).values()) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


def multiset_f1(a: Column, b: Column) -> Column:
    """Token F1 of two arrays with repeats counted; 0 where either is empty."""
    common = F.arrow_udf(_common, "int")(a, b)
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(2.0 * common / (F.size(a) + F.size(b)))


def longest_border(head: str, tail: str) -> int:
    """Characters of the longest beginning of ``head`` that ends ``tail``: the state in which the prefix function of ``head`` leaves ``tail``, in linear time."""
    n = min(len(head), len(tail))
    head, tail = head[:n], tail[len(tail) - n :]
    back, k = [0] * n, 0
    for i in range(1, n):
        while k and head[i] != head[k]:
            k = back[k - 1]
        k += head[i] == head[k]
        back[i] = k
    k = 0
    for c in tail:
        while k and (k == n or c != head[k]):
            k = back[k - 1]
        k += c == head[k]
    return k


def overlap_length(a: str, b: str) -> int:
    """All of the shorter text where the other contains it, else the longest end of one that begins the other."""
    return min(len(a), len(b)) if a in b or b in a else max(longest_border(b, a), longest_border(a, b))


def _overlaps(a: pa.Array, b: pa.Array) -> pa.Array:
    def one(xs: list | None, ys: list | None) -> list | None:
        return None if xs is None or ys is None else [[None if x is None or y is None else overlap_length(x, y) for y in ys] for x in xs]

    return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.list_(pa.list_(pa.int32())))


def edge_overlaps(a: Column, b: Column) -> Column:
    """edge_overlap() of each text of one array with each of another, a list for each of the first."""
    return F.arrow_udf(_overlaps, "array<array<int>>")(a, b)


def edge_overlap(a: Column, b: Column) -> Column:
    """Characters of the longest suffix of one text that begins the other; all of the shorter where it is contained."""
    return edge_overlaps(F.array(a), F.array(b))[0][0]


def last_number_mark(s: Column) -> Column:
    """The number after the last "####" in the last 300 characters, without commas; null if there is none."""
    found = F.regexp_extract_all(F.right(s, F.lit(300)), F.lit(r"#### (-?[0-9.,]+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit("")))


def between(s: Column, start: str, end: str) -> Column:
    """All texts between two marks, shortest first match, over line ends."""
    return F.regexp_extract_all(s, F.lit(f"(?s){start}(.*?){end}"), F.lit(1))


def context_size(s: Column) -> Column:
    """"4k" or "1m" as a number."""
    n = F.regexp_extract(F.lower(s), r"^([0-9.]+)", 1).cast("double")
    return F.when(F.lower(s).endswith("k"), n * 1000).when(F.lower(s).endswith("m"), n * 1_000_000).otherwise(n).cast("long")


def geometric_mean(values: list[Column], eps: float = 0.01) -> Column:
    """The geometric mean of values raised by ``eps``, less ``eps``."""
    product = F.lit(1.0)
    for v in values:
        product = product * (v + eps)
    return F.pow(product, F.lit(1.0 / len(values))) - eps


def overlong_penalty(length: Column, expected: int, buffer: int, factor: float) -> Column:
    """0 up to ``expected``, then falling in proportion over ``buffer``."""
    return F.least(-(length - expected) / float(buffer) * factor, F.lit(0.0))


def density_penalty(spans: Column, tokens_: Column, free: int, per: int, threshold: float, half_life: float) -> Column:
    """1 up to ``threshold`` spans for ``per`` tokens beyond the first ``free``, then halved by every ``half_life``."""
    density = F.greatest(spans - free, F.lit(0)) * float(per) / F.greatest(tokens_, F.lit(1))
    return F.when(density <= threshold, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), -(density - threshold) / half_life))


def divisors(n: Column) -> Column:
    return F.filter(F.sequence(F.lit(1).cast("long"), n.cast("long")), lambda x: n % x == 0)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once for a row, however often the lambdas in ``f`` refer to it; as a plain expression it would be computed again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
