import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names operators might use themselves.
EXTRA = ["id", "key", "h", "w", "fp", "bucket", "start", "size", "score", "row", "keeper"]


def words(seed, n):
    r = random.Random(seed)
    return [r.choice("abcdefghij") + r.choice("klmnop") + str(r.randrange(40)) for _ in range(n)]


def table_of(rows, spark, extra=False):
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(7).alias(c) for c in EXTRA))
    return df


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, copies, repeated rows, ties, a long text, near copies and a passage that is shared."""
    base, shared = words(1, 120), words(2, 60)
    near = base.copy()
    near[60] = "changed"
    long = " ".join(words(3, 30_000))
    return [
        (1, " ".join(base), "a"), (2, " ".join(near), "a"), (3, " ".join(base), None), (3, " ".join(base), None),
        (4, None, "a"), (5, "", "b"), (6, "  \n\t ", "b"), (7, "one", "b"), (8, "x y", None), (None, "no id here", "a"), (None, None, None),
        (9, long, "a"), (10, " ".join(words(4, 80) + shared + words(5, 50)), "b"), (11, " ".join(words(6, 20) + shared + words(7, 90)), "b"),
        (12, "ünï çödé 日本語 😀 " * 30, "c"), (13, "A" * 3000, "c"), (14, "same same same same same same same", "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table_of(odd_rows, spark, extra=True)


@pytest.fixture(scope="session")
def nothing(spark):
    return table_of([], spark)
