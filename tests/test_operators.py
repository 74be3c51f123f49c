"""Literal cases and properties of operators that SQL can't check."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import groupstats, packing, retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_singletons(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "a", 3.0)], "id int, g string, s double")
    rows = {r["id"]: r for r in df.select("id", groupstats.group_norm(F.col("s"), ["g"], False).alias("c"), groupstats.leave_one_out(F.col("s"), ["g"]).alias("raw"), groupstats.leave_one_out(F.col("s"), ["g"], "zero").alias("zero")).collect()}
    assert [rows[i]["c"] for i in (1, 2, 3)] == [-1.0, 2.0, 1.0]
    assert [rows[i]["raw"] for i in (1, 2, 3)] == [-2.0, 2.0, 2.0]
    assert rows[2]["zero"] == 0.0


def test_estimator_names_are_unique():
    with pytest.raises(ValueError):
        groupstats.estimator("group_norm")(lambda: None)


def test_text_functions(spark):
    assert one(spark, T.normalize_answer(F.lit("The  Quick, a fox!"))) == "quick fox"
    assert one(spark, T.contains_either_way(F.lit(""), F.lit("x"))) == 1.0
    assert one(spark, T.multiset_f1(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c")))) == pytest.approx(2 / 5)
    assert one(spark, T.edge_overlap(F.lit("abcd"), F.lit("cdef"))) == 2
    assert one(spark, T.last_number_mark(F.lit("x #### 1,000 y #### 2,500"))) == "2500"
    assert one(spark, T.context_size(F.lit("1.5k"))) == 1500


def test_discounted_over_blocks(spark, monkeypatch):
    rows = [("a", i, float(i % 7)) for i in range(100)] + [("b", i, 1.0) for i in range(3)]
    want = {}
    for g in "ab":
        run = 0.0
        for _, i, v in sorted((r for r in rows if r[0] == g), reverse=True):
            run = want[g, i] = v + 0.9 * run
    monkeypatch.setattr(groupstats, "BLOCK", 8)
    got = groupstats.discounted(spark.createDataFrame(rows, "g string, i int, v double"), ["g"], "i", "v", 0.9).collect()
    assert {(r["g"], r["i"]): pytest.approx(r["ret"]) for r in got} == want


def test_discounted_returns(spark):
    got = one(spark, groupstats.discounted_returns(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), 0.5))
    assert got == [3.0, 4.0, 4.0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40), st.integers(2, 5))
def test_packing_invariants(costs, k):
    bins = packing.best_fit(costs, 60)
    load = {}
    for c, b in zip(costs, bins, strict=True):
        load[b] = load.get(b, 0) + min(c, 60)
    assert all(v <= 60 for v in load.values())
    for solve in (packing.balanced, packing.least_loaded):
        parts = solve(costs, k)
        assert len(parts) == len(costs) and all(0 <= p < k for p in parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=60), st.integers(1, 6))
def test_checked_partitions(costs, k):
    if len(costs) < k:
        with pytest.raises(ValueError):
            packing.checked(costs, k)
        return
    parts = packing.checked(costs, k)
    assert all(parts) and sorted(i for p in parts for i in p) == list(range(len(costs))) and all(p == sorted(p) for p in parts)
    equal = costs[: len(costs) - len(costs) % k]
    if equal:
        assert {len(p) for p in packing.checked(equal, k, equal=True)} == {len(equal) // k}
        assert sorted(packing.rank_order(equal, k)) == list(range(len(equal)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=60), st.integers(1, 4))
def test_dynamic_batches_keep_their_cap(lengths, multiple):
    found = packing.dynamic_batches(lengths, 1000, multiple)
    load = {}
    for n, b in zip(lengths, found, strict=True):
        load[b] = load.get(b, 0) + n
    assert max(load.values()) <= 1000 and (len(load) % multiple == 0 or len(load) == len(lengths))
    costs = [packing.workload(n) for n in lengths]
    work = [sum(c for c, b in zip(costs, found, strict=True) if b == k) for k in range(len(load))]
    top = work.index(max(work))
    assert work[: top + 1] == sorted(work[: top + 1]) and work[top:] == sorted(work[top:], reverse=True)


def test_batches_that_cannot_be_made():
    with pytest.raises(ValueError):
        packing.dynamic_batches([5, 2000], 1000)
    with pytest.raises(ValueError):
        packing.balanced([1, 2, 3], 2, equal=True)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=2, max_size=12), st.integers(1, 3))
def test_groups_stay_together(sizes, k):
    sizes = sizes[: len(sizes) - len(sizes) % k]
    if not sizes:
        return
    uids = [g for g in range(len(sizes)) for _ in range(3)]
    parts = packing.group_balanced([sizes[g] + i for g in range(len(sizes)) for i in range(3)], uids, k)
    of = {}
    for u, p in zip(uids, parts, strict=True):
        assert of.setdefault(u, p) == p
    assert {list(of.values()).count(p) for p in range(k)} == {len(sizes) // k}


def test_balanced_is_near_best():
    costs = [8, 7, 6, 5, 4]
    best = min(max(sum(c for c, p in zip(costs, ps, strict=True) if p == q) for q in (0, 1)) for ps in itertools.product((0, 1), repeat=5))
    parts = packing.balanced(costs, 2)
    assert max(sum(c for c, p in zip(costs, parts, strict=True) if p == q) for q in (0, 1)) <= best + 1


@given(st.text("ab", max_size=12), st.text("ab", max_size=12))
def test_overlap_length(a, b):
    n = min(len(a), len(b))
    want = n if a in b or b in a else max(i for i in range(n + 1) if i == 0 or a[-i:] == b[:i] or b[-i:] == a[:i])
    assert T.overlap_length(a, b) == want


def test_overlap_of_long_texts():
    import time

    for a, b in (("ab" * 50_000, "ba" * 50_000), ("a" * 99_999 + "b", "a" * 99_999 + "c"), ("x" + "abc" * 33_333, "abc" * 33_333 + "y")):
        start = time.perf_counter()
        got = T.overlap_length(a, b)
        assert time.perf_counter() - start < 1 and got == (99_999 if a[0] != "a" or a[1] == "b" else 0)


def test_random_draws_are_uniform(spark):
    """Rows in proportion to items x draws; every document is as likely as any other."""
    from weftline.operators import negatives

    docs = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    places = negatives.placed(docs.repartition(4))
    assert [(r["doc_id"], r["place"]) for r in places.orderBy("place").collect()] == [(3 * i, i) for i in range(1000)]
    asked = spark.range(500).withColumnRenamed("id", "item_id")
    rows = negatives.random_draws(asked, places, 0, 40).collect()
    each = {}
    for r in rows:
        each.setdefault(r["item_id"], []).append(r["draw"])
    assert len(each) == 500 and all(35 <= len(set(d)) == len(d) <= 40 for d in each.values())
    n = [0] * 1000
    for r in rows:
        n[r["doc_id"] // 3] += 1
    mean = len(rows) / 1000
    assert 850 < sum((x - mean) ** 2 / mean for x in n) < 1150  # chi-square of 999 degrees, six deviations of 45 would be 268
    assert negatives.random_draws(asked, negatives.placed(docs.limit(0)), 0, 5).count() == 0
