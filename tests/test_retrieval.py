"""Kept indexes, string containment, bootstraps and quantiles against plain versions."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from weftline.operators import bootstrap, containment, postings, quantiles, retrieval, vectorindex

VEC = "vec_id bigint, embedding array<float>"


def clustered(n, dim, centres, seed, spread=0.05):
    """Vectors around so many centres: what an index is for."""
    r = np.random.default_rng(seed)
    c = np.random.default_rng(99).normal(size=(centres, dim))
    x = c[r.integers(centres, size=n)] + spread * r.normal(size=(n, dim))
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def test_vector_index_grows(spark, tmp_path):
    rows = clustered(6000, 16, 150, 1)
    every = spark.createDataFrame(rows, VEC)
    path = str(tmp_path / "index")
    vectorindex.fit(every.where("vec_id < 4000"), path, 100)
    vectorindex.append(every.where("vec_id < 4000"), path)
    before = {f.name for f in (tmp_path / "index" / "lists").iterdir()}
    vectorindex.append(every.where("vec_id >= 4000"), path)
    assert {f.name for f in (tmp_path / "index" / "lists").iterdir()} == before  # no centre was fitted anew
    asked = every.where("vec_id % 20 = 0")
    assert vectorindex.recall(spark, path, every, asked, 10, 8) >= 0.9
    found = vectorindex.search(spark, path, asked, 10, 8).collect()
    assert {r["rank"] for r in found} == set(range(1, 11)) and any(r["vec_id"] >= 4000 for r in found)
    lists = spark.read.parquet(f"{path}/vectors").groupBy("cell", "list").count().collect()
    assert sum(r["count"] for r in lists) == 6000 and len(lists) > 60
    assert vectorindex.search(spark, path, asked.limit(0), 10, 8).count() == 0
    # null and zero vectors: the first are left out, the others are found nowhere near
    vectorindex.append(spark.createDataFrame([(9001, None), (None, [1.0] * 16), (9002, [0.0] * 16)], VEC), path)
    assert spark.read.parquet(f"{path}/vectors").count() == 6001


def test_very_many_lists_plan_fast(spark, tmp_path):
    """65,536 lists: centres are tables, so a plan's size doesn't depend on their number."""
    r, path = np.random.default_rng(3), str(tmp_path / "index")
    cells = r.normal(size=(256, 8)).astype(np.float32)
    cells /= np.linalg.norm(cells, axis=1)[:, None]
    vectorindex.write_cells(spark, path, cells)
    near = (cells[:, None] + 0.2 * r.normal(size=(256, 256, 8))).astype(np.float32)
    spark.createDataFrame([(c, i, near[c, i].tolist()) for c in range(256) for i in range(256)], "cell int, list int, centre array<float>").write.parquet(f"{path}/lists")
    v = spark.createDataFrame(clustered(3000, 8, 40, 5), VEC)
    vectorindex.append(v, path)
    start = time.time()
    found = vectorindex.search(spark, path, v.where("vec_id % 100 = 0"), 5, 64)
    plan = found._jdf.queryExecution().toString()
    assert time.time() - start < 40 and len(plan) < 100_000
    assert found.select("qid").distinct().count() > 20


def test_inverted_file_recall(spark):
    sf = "/root/testdata/sf0.01"
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    want = {(r["qid"], r["vec_id"]) for r in retrieval.vector_top_k(v.where("vec_id % 20 = 0"), v, 10).collect()}
    got = {(r["qid"], r["vec_id"]) for r in vectorindex.ivf_top_k(spark, sf).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_vector_search_switches_to_an_index(spark, monkeypatch):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    q = v.where("vec_id % 50 = 0")
    flat = {(r["qid"], r["vec_id"]) for r in vectorindex.vector_search(v, q, 5).collect()}
    monkeypatch.setattr(vectorindex, "FLAT", 100)
    monkeypatch.setattr(vectorindex, "LEAST", 100)
    found = {(r["qid"], r["vec_id"]) for r in vectorindex.vector_search(v, q, 5).collect()}
    assert found == flat  # all lists are probed where there are few


def test_ivf_lists():
    assert vectorindex.ivf_lists(10) == 4096
    assert vectorindex.ivf_lists(10**12) == 65536


def plain_bm25(docs, asked, k):
    ts = {i: [w for w in (t or "").lower().split() if w not in postings.STOP_WORDS] for i, t in docs}
    n, mean = len(ts), sum(map(len, ts.values())) / len(ts)
    tf, df = {i: Counter(w) for i, w in ts.items()}, Counter(w for x in ts.values() for w in set(x))
    out = []
    for q, text in asked:
        scores = {}
        for w in set(text.lower().split()) - set(postings.STOP_WORDS):
            idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
            for i in ts:
                if tf[i][w]:
                    scores[i] = scores.get(i, 0) + idf * tf[i][w] * 2.5 / (tf[i][w] + 1.5 * (0.25 + 0.75 * len(ts[i]) / mean))
        out += [(q, i, rank) for rank, (_, i) in enumerate(sorted((-round(s, 6), i) for i, s in scores.items())[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    """Words by Zipf's law, so that few terms have most postings."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    docs = [(i * 7, " ".join(r.choices(words, weights, k=r.randrange(5, 120)))) for i in range(1500)]
    asked = [(q, " ".join(r.choices(words, weights, k=4) + r.choices(docs[r.randrange(1500)][1].split(), k=8))) for q in range(25)]
    return [*docs, (20_000, None), (20_001, ""), (20_002, "of the")], asked


def test_pruned_search_equals_full_scoring(spark, corpus, tmp_path, monkeypatch):
    docs, asked = corpus
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(asked, "item_id bigint, text string")
    monkeypatch.setattr(postings, "BIN", 32)
    index = postings.write_index(d, str(tmp_path / "narrow"))
    got = sorted((r["item_id"], r["doc_id"], r["rank"]) for r in postings.search(index, q, 10).collect())
    assert got == plain_bm25(docs, asked, 10)
    read, every = postings.postings_read(index, q, 10)
    assert 0 < read < every / 2
    monkeypatch.setattr(postings, "BIN", 4096)
    index = postings.write_index(d, str(tmp_path / "wide"))
    assert sorted((r["item_id"], r["doc_id"], r["rank"]) for r in postings.search(index, q, 5000).collect()) == plain_bm25(docs, asked, 5000)
    assert postings.search(index, q.limit(0), 3).count() == 0


def test_sums_of_queries_and_documents_stay_in_their_task(spark, corpus, tmp_path, monkeypatch):
    """A block has all postings of its documents, so what leaves a task is the best of each query."""
    docs, asked = corpus
    docs = [*docs, (30_000, " ".join(f"w{i}" for i in range(900))), (30_001, docs[5][1]), (30_002, docs[5][1])]
    monkeypatch.setattr(postings, "TOKENS", 700)  # one document is longer
    monkeypatch.setattr(postings, "ASKING", 7)
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(asked, "item_id bigint, text string")
    index = postings.write_index(d, str(tmp_path / "index"))
    assert sorted(i for r in index.blocks.select("ids").collect() for i in r["ids"]) == sorted(i for i, _ in docs)
    parts = list(postings.asking(index, q, "item_id", "text"))
    assert len(parts) > 1
    assert all("Exchange" not in postings.scored(index, a, 6)._jdf.queryExecution().toString() for a in parts)
    assert sorted((r["item_id"], r["doc_id"], r["rank"]) for r in postings.search(index, q, 6).collect()) == plain_bm25(docs, asked, 6)


def test_index_is_built_once(spark, tmp_path, monkeypatch):
    docs = [(1, "red apple pie"), (2, "green apple"), (3, "of the"), (4, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    asked = spark.createDataFrame([(7, "apple pie")], "item_id bigint, text string")
    built = []
    monkeypatch.setattr(postings, "write_index", lambda *a, f=postings.write_index: built.append(1) or f(*a))
    read = lambda: spark.read.parquet(f"{tmp_path}/docs")
    for _ in range(3):
        assert [(r["doc_id"], r["rank"]) for r in postings.bm25(asked, read(), 5).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert len(built) == 1
    postings.bm25(asked, read().where("doc_id > 1"), 5)
    assert len(built) == 2  # other rows, another index
    spark.createDataFrame([(5, "apple pie pie")], "doc_id bigint, text string").write.mode("append").parquet(f"{tmp_path}/docs")
    assert {r["doc_id"] for r in postings.bm25(asked, read(), 5).collect()} == {1, 2, 5} and len(built) == 3


def test_containment_of_many_strings(spark):
    r = random.Random(4)
    texts = ["".join(r.choices("abcde ", k=r.randrange(400))) for _ in range(300)]
    strings = ["".join(r.choices("abcde ", k=r.randrange(1, 12))) for _ in range(100_000)] + [texts[3], texts[4] + "!", ""]
    d = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc int, body string")
    s = spark.createDataFrame([*enumerate(strings), (5, strings[5]), (-1, None)], "id int, word string")
    want = {(i, j) for i, p in enumerate(strings) for j, t in [*enumerate(texts), (901, "")] if p in t}
    for block in (10**9, 200_000):
        got = containment.contained(d, s, block)
        assert {(x["string_id"], x["text_id"]) for x in got.collect()} == want and got.count() == len(want)
    assert containment.contained(d, s.limit(0)).count() == 0 and containment.contained(d.limit(0), s).count() == 0


def test_bootstrap_equals_a_loop(spark):
    r = np.random.default_rng(6)
    values, votes = r.normal(size=(7, 9)).round(2), r.integers(0, 3, size=(7, 9))
    for size in (2, 4, 9):
        got = bootstrap.replicated(values, votes, size, draws=200)
        at = bootstrap.places(9, size, 200, bootstrap.SEED)
        for i in range(7):
            best, worst, maj = [], [], []
            for row in at.tolist():
                n = Counter(votes[i][j] for j in row)
                best.append(max(values[i][j] for j in row))
                worst.append(min(values[i][j] for j in row))
                maj.append(next(values[i][j] for j in row if n[votes[i][j]] == max(n.values())))
            for k, x in zip(bootstrap.KINDS, (best, worst, maj), strict=True):
                assert got[k][0][i] == pytest.approx(np.mean(x)) and got[k][1][i] == pytest.approx(np.std(x))
    assert [bootstrap.sizes_of(n) for n in (1, 2, 3, 8, 9)] == [[], [2], [2, 3], [2, 4, 8], [2, 4, 8, 9]]


def test_validation_of_odd_samples(spark):
    rows = [("a", 1, i, v, p) for i, (v, p) in enumerate([(0.8, "A"), (0.9, "B"), (0.7, "A")])] + [("a", 2, 0, 0.5, None), ("b", 1, 0, None, "A"), ("b", 1, 1, 0.25, "B"), (None, None, 0, 1.0, "A"), (None, None, 1, 3.0, "A")]
    samples = spark.createDataFrame(rows, "source string, uid int, i int, score double, pred string")
    got = {(r["source"], r["metric"]): r["value"] for r in bootstrap.validation(samples, "source", "uid", "i", "score", "pred", 100).collect()}
    assert got["a", "mean@3"] == pytest.approx(0.8) and got["a", "mean@1"] == 0.5 and ("a", "std@1") not in got
    assert 0.7 <= got["a", "worst@2/mean"] < got["a", "best@2/mean"] <= 0.9 and "maj@3/std" in {m for s, m in got if s == "a"}
    assert got[None, "mean@2"] == 2.0 and got[None, "best@2/mean"] > 2.0
    assert ("b", "mean@2") in got  # the mean of what is there
    assert bootstrap.validation(samples.limit(0), "source", "uid", "i", "score", "pred").count() == 0


QS = [0.0, 0.1, 0.333, 0.5, 0.9, 0.999, 1.0]


def test_quantiles_equal_percentiles(spark):
    r = np.random.default_rng(2)
    groups = {
        "normal": r.normal(size=5001), "ties": r.integers(0, 3, size=900).astype(float), "one": np.array([4.5]), "same": np.full(50, -2.0), "two": np.array([1.0, 2.0]),
        "near": 1 + r.random(3000) * 1e-12, "wide": np.exp(r.normal(size=2000) * 200), "signs": np.r_[-(10.0 ** r.integers(-300, 300, 200)), 10.0 ** r.integers(-300, 300, 200)], "ends": np.r_[-1.7e308, 1.7e308, r.normal(size=99)], None: r.random(100),
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("normal", None), ("normal", float("nan")), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {(x["g"], x["q"]): x["quantile"] for x in quantiles.exact_quantiles(df, ["g"], "x", QS).collect()}
    assert len(got) == len(groups) * len(QS)
    for g, x in groups.items():
        s = np.sort(x)
        for q in QS:
            at = q * (len(s) - 1)
            a, b = s[math.floor(at)], s[math.ceil(at)]
            assert got[g, q] == (a if a == b else pytest.approx(a + (b - a) * (at - math.floor(at)), rel=1e-12)), (g, q)
    infinite = spark.createDataFrame([("i", v) for v in (float("-inf"), 1.0, 2.0, 3.0, float("inf"), float("inf"))], "g string, x double")
    assert [x["quantile"] for x in quantiles.exact_quantiles(infinite, ["g"], "x", [0.0, 0.4, 1.0]).orderBy("q").collect()] == [float("-inf"), 2.0, float("inf")]


def test_quantiles_of_each_groups_own(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(300)], "g int, x double")
    own = spark.createDataFrame([(0, 0.5), (2, 0.25), (2, 0.75), (7, 0.5)], "g int, q double")
    got = {(x["g"], x["q"]): x["quantile"] for x in quantiles.exact_quantiles(df, ["g"], "x", own).collect()}
    want = {(0, 0.5): np.percentile(range(0, 300, 3), 50), (2, 0.25): np.percentile(range(2, 300, 3), 25), (2, 0.75): np.percentile(range(2, 300, 3), 75)}
    assert got == pytest.approx(want)
