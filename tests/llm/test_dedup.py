"""Fingerprints, SimHash components, near copies and repeated passages against plain versions."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import fingerprints, simhash, suffixes
from weftline.llm.common import components
from weftline.llm.pyworker import shingle_lists, simhash64, word_lists

from .conftest import table_of, words


def plain_words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain_simhash(t):
    w = plain_words(t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(500, i) for i in range(300, 340)]
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    want = closure(nodes, [p for p in pairs if p[0] != p[1]])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == want


def test_anchors_cover_three_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 500, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, 3, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    rows, keys, home = simhash.anchor_rows(x.reshape(-1, 1))
    homes = collections.defaultdict(set)
    for i, k, h in zip(rows, keys, home, strict=True):
        if h:
            homes[i].add(k)
    rows, keys, _ = simhash.anchor_rows(y.reshape(-1, 1))
    every = collections.defaultdict(set)
    for i, k in zip(rows, keys, strict=True):
        every[i].add(k)
    assert all(homes[i] & every[i] for i in range(len(x)))


def test_simhash_of_blocks_is_that_of_the_whole(odd_rows, monkeypatch):
    whole = [simhash64(t) for _, t, _ in odd_rows]
    assert whole == [plain_simhash(t) if t is None or len(t) < 50_000 else w for (_, t, _), w in zip(odd_rows, whole, strict=True)]
    t = odd_rows[0][1]
    assert [w for x in word_lists(t, 50) for w in x] == [w for x in word_lists(t) for w in x]
    assert sum(len(x) for x in shingle_lists(t, 3)) == len(plain_words(t)) - 2


def test_simhash_components(odd, odd_rows, nothing):
    got = simhash.simhash_components(odd).collect()
    fps = [(i, plain_simhash(t) if t is None or len(t) < 50_000 else simhash64(t)) for i, t, _ in odd_rows]
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64) for r in got) == sorted((str(i), f) for i, f in fps)
    distinct = sorted({f for _, f in fps})
    roots = closure(distinct, [(a, b) for a in distinct for b in distinct if a < b and bin(a ^ b).count("1") <= 3])
    low = {}
    for i, f in fps:
        if i is not None:
            low[roots[f]] = min(i, low.get(roots[f], i))
    for r in got:
        assert r["component_id"] == low.get(roots[r["fp"] % 2**64])
    assert simhash.simhash_components(nothing).count() == 0


def similarity(a, b):
    x, y = ({s for part in shingle_lists(t, 5) for s in part} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_copies_match_brute_force(spark):
    rows = []
    for k in range(40):
        base = words(k, 150)
        rows.append((10 * k, " ".join(base), "s"))
        for c in range(k % 4):
            copy = base.copy()
            for j in random.Random(k * 7 + c).sample(range(150), c + 1):
                copy[j] = f"edit{j}"
            rows.append((10 * k + c + 1, " ".join(copy), "s"))
    texts = {i: t for i, t, _ in rows}
    pairs = [(a, b) for a in texts for b in texts if a < b and similarity(texts[a], texts[b]) >= 0.8]
    want = {(i, r) for i, r in closure(texts, pairs).items() if i != r}
    got = {(r["doc_id"], r["keeper"]) for r in simhash.near_copies(table_of(rows, spark)).collect()}
    assert got == want


def test_near_copies_that_hang_on_their_base_alone(spark):
    """Scattered edits: the copies are like the base, and unlike each other."""
    base, texts = words(900, 300), {}
    for c in range(80):
        copy = base.copy()
        for j in random.Random(c).sample(range(300), 6):
            copy[j] = f"edit{c}x{j}"
        texts[c] = " ".join(copy)
    texts[80] = " ".join(base)
    pairs = [(a, b) for a in texts for b in texts if a < b and similarity(texts[a], texts[b]) >= 0.8]
    want = {(i, r) for i, r in closure(texts, pairs).items() if i != r}
    assert len(want) > 60 and sum(80 in p for p in pairs) > 0.8 * len(pairs)
    got = {(r["doc_id"], r["keeper"]) for r in simhash.near_copies(table_of([(i, t, "s") for i, t in texts.items()], spark)).collect()}
    assert got == want


def test_near_copies_with_one_contiguous_change(spark):
    """Appended and replaced passages at similarities from 0.78 to 0.9: all that reach 0.8 are found and no others."""
    rows = []
    for k in range(120):
        base, other = words(3000 + k, 300), words(5000 + k, 80)
        n = 20 + k % 60
        at = random.Random(k).randrange(300 - n)
        copy = base + other[:n] if k % 2 else base[:at] + other[: n // 2] + base[at + n // 2 :]
        rows += [(2 * k, " ".join(base), "s"), (2 * k + 1, " ".join(copy), "s")]
    texts = {i: t for i, t, _ in rows}
    want = {(i + 1, i) for i in range(0, 240, 2) if similarity(texts[i], texts[i + 1]) >= 0.8}
    assert 80 < len(want) < 120
    assert {(r["doc_id"], r["keeper"]) for r in simhash.near_copies(table_of(rows, spark)).collect()} == want


def test_sketches_of_any_batch(odd_rows):
    rows = [(i, t) for i, t, _ in odd_rows if i is not None]
    whole = simhash.sketch_rows(*map(list, zip(*rows, strict=True)), 5).to_pylist()
    assert whole == [simhash.sketch_rows([i], [t], 5).to_pylist()[0] for i, t in rows]
    for (_, t), r in zip(rows, whole, strict=True):
        shingles = {s for part in shingle_lists(t, 5) for s in part}
        assert r["n"] == len(shingles) == len(r["s"]) and len(r["bands"]) == (16 if shingles else 0)


def test_parities_never_part_similar_sets(spark):
    r = random.Random(8)
    texts = []
    for c in range(60):
        base = words(c, r.randrange(30, 400))
        at, n = r.randrange(len(base)), r.randrange(1, 1 + len(base) // 6)
        texts += [" ".join(base), " ".join(base[:at] + words(c + 900, n) + base[at + n :])]
    rows = spark.createDataFrame(simhash.sketch_rows(list(range(120)), texts, 5).to_pandas().drop(columns=["same"])[["id", "n", *simhash.PARITIES]].rename(columns={"id": "row"}))
    pairs = simhash.sided(rows, "a").join(simhash.sided(rows, "b"), (F.col("row_a") % 2 == 0) & (F.col("row_b") == F.col("row_a") + 1))
    may = {x["row_a"] for x in pairs.where(simhash.may_be_similar(0.8)).collect()}
    assert may >= {i for i in range(0, 120, 2) if similarity(texts[i], texts[i + 1]) >= 0.8} and len(may) < 60


def test_one_id_with_two_texts(spark):
    a, b = words(1, 100), words(2, 100)
    near = [*a[:-1], "other"]
    rows = [(5, " ".join(a), "s"), (5, " ".join(b), "s"), (6, " ".join(near), "s"), (6, " ".join(near), "s"), (7, " ".join(b), "s"), (8, " ".join(near), "s")]
    kept = simhash.drop_near_copies(table_of(rows, spark)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(5, " ".join(a)), (5, " ".join(b))])


def test_drop_near_copies_keeps_all_else(odd, nothing):
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["1", "4", "None", "None", "7", "8", "9", "10", "11", "12", "13", "14"])
    assert simhash.drop_near_copies(nothing).count() == 0


def plain_fingerprint_edit(rows):
    key = lambda i: 2**63 - 1 if i is None else i
    text = {}
    for i, t, _ in rows:
        text[key(i)] = min(text.get(key(i), t or ""), t or "", key=lambda s: s.encode())
    order = sorted(text)
    out = []
    for i, t, _ in rows:
        t = t or ""
        n = text[order[(order.index(key(i)) + 1) % len(order)]]
        cut = len(t) // 4
        out.append((str(i), len(t), hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest()))
    return sorted(out)


def test_fingerprints(odd, odd_rows, nothing):
    f = fingerprints.fingerprint_pairs(odd)
    rows = f.select("doc_id", F.length("text").alias("n"), F.sha2(F.col("edited").cast("binary"), 256).alias("x"), "sketch", fingerprints.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near")).collect()
    assert sorted((str(r["doc_id"]), r["n"], r["x"]) for r in rows) == plain_fingerprint_edit(odd_rows)
    assert all(0 <= r["near"] <= 1 for r in rows)
    assert all(r["sketch"] for r in rows if r["doc_id"] in (1, 7, 8, 13))
    assert fingerprints.fingerprint_pairs(nothing).count() == 0


def test_sketches_merge_and_estimate(spark):
    a, b = words(11, 8000), words(12, 1000)
    df = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a[2000:4000]))], "a string, b string, part string")
    s = df.select(*(fingerprints.sketch(F.col(c)).alias(c) for c in df.columns))
    r = s.select(fingerprints.containment(F.col("part"), F.col("a")).alias("inside"), fingerprints.containment(F.col("b"), F.col("a")).alias("outside"), fingerprints.likeness(F.col("part"), F.col("a")).alias("like")).first()
    assert r["inside"] > 0.97 and r["outside"] < 0.03 and r["like"] == pytest.approx(0.25, abs=0.04)


def test_neighbours_over_seams(spark):
    """Runs that begin, fill and end partitions; the first of a run is found wherever it lies."""
    r = random.Random(4)
    rows = [(7, i, r.randrange(5)) for i in range(3000)] + [(r.randrange(300), r.randrange(200), r.randrange(9)) for _ in range(2000)] + [(10**15, 5, 1), (10**15, 5, 2), (-(10**15), 3, 0)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = [tuple(x) for x in suffixes.neighbours(spark.createDataFrame(rows, "h bigint, id bigint, start int")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    first = {}
    for h, i, s in sorted(rows):
        first.setdefault(h, (i, s))
    assert sorted(got) == sorted((h, i, s, *first[h]) for h, i, s in rows if first[h][0] != i)
    assert suffixes.neighbours(spark.createDataFrame([], "h bigint, id bigint, start int")).count() == 0


def test_short_parts_are_contained(spark):
    """Twelve words out of 3,000: contained where there is an estimate, which is in most cases, and nowhere else."""
    whole, other = words(21, 3000), words(22, 3000)
    rows = [(" ".join(whole), " ".join(other), " ".join(whole[i : i + 12])) for i in range(0, 3000, 15)]
    s = spark.createDataFrame(rows, "a string, b string, part string").select(*(fingerprints.sketch(F.col(c)).alias(c) for c in ("a", "b", "part")))
    got = s.select(fingerprints.containment(F.col("part"), F.col("a")).alias("x"), fingerprints.containment(F.col("part"), F.col("b")).alias("y")).collect()
    known = [r for r in got if r["x"] is not None]
    assert len(known) > 100 and all(r["x"] == 1.0 and r["y"] < 0.1 for r in known) and all(r["y"] is None for r in got if r["x"] is None)


def test_sketch_values(spark, odd_rows):
    """Every shingle's hash below an eighth of the range, by another implementation."""

    def hashed(ws):
        h = 42
        for w in ws:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h - 2**64 if h >= 2**63 else h

    texts = [t for _, t, _ in odd_rows if t and t.isascii()]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprints.sketch(F.col("t")).alias("s")).collect()
    for r in got:
        w = r["t"].lower().split()
        h = {hashed(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}
        low = sorted(x for x in h if x < -(2**63) + 2**61)
        assert r["s"] == (low or ([min(h)] if h else []))


def test_repeats_match_brute_force(odd, odd_rows, nothing):
    got = suffixes.repeats(odd).collect()
    texts = {}
    for i, t, _ in odd_rows:
        if i is not None:
            texts[i] = plain_words(t)
    where = collections.defaultdict(list)
    for i in sorted(texts):
        for p in range(len(texts[i]) - 49):
            where[tuple(texts[i][p : p + 50])].append((i, p))
    want = {(i, p + j) for at in where.values() if len({i for i, _ in at}) > 1 for i, p in at if i != at[0][0] for j in range(50)}
    assert {(r["doc_id"], r["start_word"] + j) for r in got for j in range(r["n_words"])} == want
    for r in got:
        s, f = r["start_word"], r["first_start_word"]
        assert texts[r["doc_id"]][s : s + r["n_words"]] == texts[r["first_doc_id"]][f : f + r["n_words"]]
    assert suffixes.repeats(nothing).count() == 0


def test_cut_repeats(odd, odd_rows):
    before = {i: t for i, t, _ in odd_rows}
    rows = suffixes.cut_repeats(odd.select("doc_id", "text", "lang", "source", "n_chars")).collect()
    after = {r["doc_id"]: r["text"] for r in rows}
    assert 3 not in after and all(after[i] == before[i] for i in (1, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14))
    assert after[11].split() == words(6, 20) + words(7, 90)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)


def test_without_words():
    assert suffixes.without_words("a b  c\nd", [(1, 2)]) == "a d"
    assert suffixes.without_words("a b", [(0, 2)]) == ""
