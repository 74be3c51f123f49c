"""Exact nearest vectors by blocks of products against a plain sum of each pair."""

import re

import numpy as np

from weftline.operators import nearest, retrieval

VEC = "vec_id bigint, embedding array<float>"


def plain(queries, vectors, k):
    found = set()
    for q, x in queries:
        scores = []
        for v, y in vectors:
            if v != q:
                s = 0.0
                for a, b in zip(x, y, strict=True):
                    s += float(np.float32(a)) * float(np.float32(b))
                scores.append((-round(s, 6), v))
        found |= {(q, v, -s, i + 1) for i, (s, v) in enumerate(sorted(scores)[:k])}
    return found


def vectors(n, seed):
    r = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(r.normal(size=(n, 8)))]
    return rows + [(n + i, rows[3][1]) for i in range(60)]  # a group of copies larger than k


def test_top_k_by_products(spark):
    rows = vectors(400, 1)
    v = spark.createDataFrame(rows, VEC)
    asked = [r for r in rows if r[0] % 20 == 0] + [rows[3]]
    got = retrieval.vector_top_k(spark.createDataFrame(asked, VEC), v, 7)
    assert "NestedLoopJoin" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert {tuple(r) for r in got.collect()} == plain(asked, rows, 7)


def test_top_k_in_blocks_and_odd_vectors(spark, monkeypatch):
    rows = vectors(100, 2)
    v = spark.createDataFrame([*rows, (500, None), (501, [1.0, None] * 4), (None, rows[0][1])], VEC)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "TASK_VECTORS", 16)
    monkeypatch.setattr(nearest, "SCORES", 50)
    got = {tuple(r) for r in retrieval.vector_top_k(v.where("vec_id % 20 = 0"), v, 7).collect()}
    asked = [r for r in rows if r[0] % 20 == 0]
    assert {r for r in got if r[0] != 500} == plain(asked, rows, 7)
    assert {r[1:] for r in got if r[0] == 500} == {(i, None, i + 1) for i in range(7)}


def test_index_search_streams_vectors(spark, tmp_path):
    """No pair of a query and a vector is a row of a join, and a vector's length is summed once."""
    from weftline.operators import vectorindex

    rows = vectors(400, 3)
    v, path = spark.createDataFrame(rows, VEC), str(tmp_path / "index")
    vectorindex.fit(v, path, 4)
    vectorindex.append(v, path)
    found = vectorindex.search(spark, path, v.where("vec_id % 20 = 0"), 7, 100)
    assert "Join" not in found._jdf.queryExecution().toString()
    unit = {i: (np.array(x) / np.sqrt((np.array(x) ** 2).sum())).astype(np.float32).tolist() for i, x in rows}
    units = list(unit.items())
    got = {(r["qid"], r["rank"]): r["score"] for r in found.collect()}
    want = {(q, rank): s for q, _, s, rank in plain([u for u in units if u[0] % 20 == 0], units, 7)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 3e-6 for k in got)


def test_parts_do_not_grow_with_the_vectors(spark, monkeypatch):
    """A search's tasks each send on a best of each query, so there are no more of them than a cluster needs."""
    monkeypatch.setattr(retrieval, "TASK_VECTORS", 1)
    rows = vectors(400, 4)
    v = spark.createDataFrame(rows, VEC)
    found = retrieval.vector_top_k(v.where("vec_id % 20 = 0"), v, 7)
    parts = [int(n) for n in re.findall(r"hashpartitioning\(vec_id#\d+L?, (\d+)\)", found._jdf.queryExecution().toString())]
    assert parts and max(parts) <= max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert {tuple(r) for r in found.collect()} == plain([r for r in rows if r[0] % 20 == 0], rows, 7)


def test_candidates_are_ranked_in_few_sorts(monkeypatch):
    """Blocks of vectors gather candidates; a sort over all queries for each of them took most of a search's time."""
    r, sorts = np.random.default_rng(5), []
    x, q = r.normal(size=(3000, 8)), r.normal(size=(40, 8))
    # products in single precision that don't tell these apart
    x[1::2] = x[::2] * (1 + 1e-7)
    real = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, *a, **k: sorts.append(len(keys)) or real(keys, *a, **k))
    best = nearest.Best(np.arange(40) + 10_000, q, 5)
    for a in range(0, 3000, 100):
        best.add(np.arange(a, a + 100), x[a : a + 100])
    got = best.found().to_pydict()
    assert sorts.count(3) < 15
    for n, row in enumerate(q):
        scores = [(-round(sum(a * b for a, b in zip(row.tolist(), y, strict=True)), 6), i) for i, y in enumerate(x.tolist())]
        assert got["vec_id"][5 * n : 5 * n + 5] == [i for _, i in sorted(scores)[:5]]
