"""Every stage of the pipeline on a small corpus, held against a plain version of it that runs on what the stage before kept."""

import collections
import hashlib
import math
import random

from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import mixing, toxicity

from .conftest import DOCS, words
from .test_dedup import closure, plain_words, similarity
from .test_models import plain_similarity
from .test_records import plain_targets


def corpus():
    """Clean documents, near and exact copies, a shared passage, benchmark items, toxic documents, blanks."""
    r, shared, item = random.Random(1), words(9001, 60), words(9002, 30)
    rows, toxic = [], set()
    for i in range(260):
        w = words(i, 90)
        if i % 10 == 1:
            w = rows[-1][1].split()
            if i % 20 == 1:
                w[40] = "edited"
        elif i % 10 == 3:
            w = w[:20] + shared + w[20:50]
        elif i % 10 == 5:
            w = w[:30] + item + w[30:]
        elif i % 10 == 7:
            toxic.add(i)
            for j in r.sample(range(90), 7):
                w[j] = r.choice(["villainous", "wretched", "despicable", "loathsome"])
        rows.append((i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "one two"), (303, "A" * 5000)]
    return rows, toxic, " ".join(item)


def plain_toxicity(docs, model):
    o, t = model.encoders()
    return {i: x for i, x in docs.items() if model.score(toxicity.np.array([toxicity.features(x, o, t)]))[0] < 0.7}


def plain_near(docs):
    """Of each group of equal or similar texts the smallest id; null and blank texts are equal."""
    have = {i: (t if plain_words(t) else "") or "" for i, t in docs.items()}
    pairs = [(a, b) for a in have for b in have if a < b and (have[a] == have[b] or (have[a] and have[b] and similarity(have[a], have[b]) >= 0.8))]
    root = closure(have, pairs)
    return {i: t for i, t in docs.items() if root[i] == i}


def plain_passages(docs):
    where = collections.defaultdict(list)
    for i in sorted(docs):
        w = plain_words(docs[i])
        for p in range(len(w) - 49):
            where[tuple(w[p : p + 50])].append((i, p))
    gone = collections.defaultdict(set)
    for at in where.values():
        for i, p in at:
            if i != at[0][0]:
                gone[i] |= set(range(p, p + 50))
    out = {}
    for i, t in docs.items():
        if i not in gone:
            out[i] = t
        elif kept := [w for k, w in enumerate(t.split()) if k not in gone[i]]:
            out[i] = " ".join(kept)
    return out


def plain_clean(docs, item):
    want = item.split()
    best = lambda t: max((plain_similarity(t[at : at + len(want)], want) for at in range(max(len(t) - len(want), 0) + 1)), default=0)
    return {i: t for i, t in docs.items() if best((t or "").lower().split()) < 0.8}


def plain_mix(docs, source):
    sizes = {i: len(plain_words(t)) for i, t in docs.items()}
    total = collections.Counter()
    for i, n in sizes.items():
        total[source[i]] += n
    targets, out = plain_targets(total), {}
    for s in total:
        rate = targets[s] / total[s] if total[s] else 0.0
        u = int(hashlib.md5(f"7:{'null' if s is None else '=' + s}".encode()).hexdigest()[:8], 16) / 2**32
        for k, i in enumerate(sorted((i for i in docs if source[i] == s), key=lambda i: (-sizes[i], i))):
            out[i] = math.floor((k + 1) * rate + u) - math.floor(k * rate + u)
    return out, targets


def test_stages_match_plain_versions(spark, tmp_path):
    rows, toxic, item = corpus()
    source = {i: None if i % 11 == 0 else f"s{i % 4}" for i, _ in rows}
    spark.createDataFrame([(i, t, "en", source[i], None if t is None else len(t)) for i, t in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    plain = [lambda d: plain_toxicity(d, model), plain_near, plain_passages, lambda d: plain_clean(d, item)]
    docs, now = spark.read.parquet(f"{sf}/documents.parquet"), dict(rows)
    for (name, stage), f in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        want = f(now)
        got = stage(spark, docs, sf)
        kept = {r["doc_id"]: r["text"] for r in got.collect()}
        assert set(kept) == set(want), name
        squeeze = lambda d: {i: t if t is None else " ".join(t.split()) for i, t in d.items()}
        assert squeeze(kept) == squeeze(want), name
        assert want != now, name
        got.write.parquet(str(tmp_path / name))
        docs, now = spark.read.parquet(str(tmp_path / name)), kept
    copies, targets = plain_mix(now, source)
    mixed = corpus_pipeline.mixing(spark, docs, sf).collect()
    assert {r["doc_id"]: r["copies"] for r in mixed} == copies
    assert {round(r["target"], 6) for r in mixed} == {round(t, 6) for t in targets.values()}
    run = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"]: r["copies"] for r in run.collect()} == copies
    assert mixing.mix_sources(docs).agg(F.sum("taken")).first()[0] > 0
