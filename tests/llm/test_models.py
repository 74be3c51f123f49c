"""Token counts, decontamination, licences, toxicity and language-model scores."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontamination, licenses, pitmanyor, pyworker, tokencount, toxicity

from .conftest import table_of, words
from .test_dedup import plain_words


@pytest.fixture(scope="module")
def vocabulary():
    return tokencount.load_vocabulary(tokencount.default_vocabulary())


def test_token_counts_match_the_tokenizer(spark, odd, odd_rows, vocabulary):
    from tokenizers import Tokenizer, models

    low = min(vocabulary.pieces.values())
    entries = [("<unk>", 0.0), *vocabulary.pieces.items(), *((f"<0x{i:02X}>", low) for i in range(256))]
    tokenizer = Tokenizer(models.Unigram(entries, unk_id=0, byte_fallback=True))
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [t for _, t, _ in odd_rows] + ["  a  b", "\n\n x", "a▁b  ▁", "   "]
    counter = tokencount.Counter(vocabulary)
    for t in docs:
        want = len(tokenizer.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
        assert counter.count(t) == want
    assert sorted(r["n_tokens"] for r in tokencount.count_tokens(odd).collect()) == sorted(counter.count(t) for _, t, _ in odd_rows)


def test_token_counts_with_fractional_scores():
    """A vocabulary with log-probabilities, not whole numbers: stretches counted apart give what the tokenizer gives for the whole text."""
    from tokenizers import Tokenizer, models

    r = random.Random(12)
    pieces = {"▁": -3.3, **{c: -5.0 - r.random() for c in "abcdefgh"}}
    while len(pieces) < 300:
        body = "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 6)))
        pieces[("▁" if r.random() < 0.4 else "") + body] = -2.0 - 8 * r.random()
    vocabulary = tokencount.Vocabulary(pieces, False)
    tokenizer = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], unk_id=0, byte_fallback=False))
    counter = tokencount.Counter(vocabulary)
    assert counter.cuts
    for _ in range(200):
        t = " ".join("".join(r.choice("abcdefghé") for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(1, 15)))
        assert counter.count(t) == len(tokenizer.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids)


def test_token_ties_go_to_the_earlier_start():
    v = tokencount.Vocabulary({"a": -1.0, "b": -1.0, "ab": -2.0, "▁": 0.0}, False)
    assert tokencount.Counter(v).best("▁ab") == 2  # the whole piece was found first; its score equals that of two
    v = tokencount.Vocabulary({"x▁y": -1.0, "x": -5.0, "y": -5.0, "▁": -1.0}, False)
    counter = tokencount.Counter(v)
    assert not counter.cuts and counter.count("x y") == 2


def test_decontamination(spark, nothing):
    items = [(1, " ".join(words(50, 30))), (2, " ".join(words(51, 12))), (3, "short one"), (4, None), (5, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    edited = words(50, 30)
    edited[29] = "other"
    rows = [
        (1, " ".join(words(60, 40)) + " " + items[0][1].upper() + ", " + " ".join(words(61, 40)), "a"),
        (2, items[1][1].replace(" ", " -- "), "a"), (3, " ".join(words(62, 100)), "a"), (4, " ".join([*words(63, 20), *edited]), "a"),
        (5, "this is a Short, one!", "a"), (6, None, "a"), (7, "", "a"), (None, items[0][1], "a"), (8, " ".join(words(50, 30)[:15] + words(64, 60)), "a"), (1, items[1][1], "a"),
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(table_of(rows, spark, extra=True), bench).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 2), (4, 1), (5, 3)}
    assert got[1, 1]["start_word"] == 40 and got[1, 1]["similarity"] == 1.0 and got[1, 1]["distance"] == 0
    assert got[4, 1]["similarity"] == pytest.approx(25 / 27)
    kept = decontamination.drop_contaminated(table_of(rows, spark), bench)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "6", "7", "8", "None"]
    assert decontamination.contaminated(nothing, bench).count() == 0
    assert decontamination.contaminated(table_of(rows, spark), bench.limit(0)).count() == 0


def plain_similarity(a, b):
    x, y = (collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    return sum((x & y).values()) / max(sum((x | y).values()), 1)


def test_decontamination_matches_a_scan_of_all_windows(spark):
    """Moved halves, scattered and contiguous edits, repeated words, items at either end: every window of every text is looked at."""
    r = random.Random(17)
    items = {k: words(700 + k, r.randrange(12, 60)) for k in range(25)}
    items[25] = ["so", "it", "goes", "on", "and"] * 8
    items[26] = words(726, 200)
    rows = []
    for d in range(220):
        w = items[d % 27].copy()
        kind = d // 27
        if kind == 1:
            w = w[len(w) // 2 :] + w[: len(w) // 2]
        elif kind in (2, 3, 4):
            for j in r.sample(range(len(w)), kind - 1):
                w[j] = f"edit{j}"
        elif kind == 5:
            w = w[len(w) // 8 :]
        elif kind == 6:
            w = w[: -max(len(w) // 10, 1)] + words(d, 5)
        around = words(3 * d, r.randrange(40)), words(3 * d + 1, r.randrange(40))
        rows.append((d, " ".join(around[0] + w + around[1]), "s"))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontamination.contaminated(table_of(rows, spark), bench).collect()}
    want = {}
    for d, t, _ in rows:
        t = t.split()
        for k, w in items.items():
            best = max(plain_similarity(t[at : at + len(w)], w) for at in range(max(len(t) - len(w), 0) + 1))
            if best >= 0.8:
                want[d, k] = best
    assert len(want) > 100 and set(got) == set(want)
    assert all(x == pytest.approx(want[pair]) for pair, x in got.items())
    assert (27 + 26, 26) in got  # halves of a long item in the other order


def test_weighted_similarity(spark):
    pair = spark.createDataFrame([([1, 1, 2], [1, 2, 3]), ([5, 5, 5, 5], [5, 5]), ([7, 8], [8, 7])], "a array<bigint>, b array<bigint>")
    got = [x["x"] for x in pair.select(decontamination.weighted_similarity(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [pytest.approx(2 / 4), pytest.approx(2 / 4), 1.0]


def test_simhash_of_few_and_many_hashes(spark):
    r = random.Random(2)
    rows = [([r.getrandbits(64) - 2**63 for _ in range(n)],) for n in (1, 2, 7, 127, 128, 400)]
    for x in spark.createDataFrame(rows, "h array<bigint>").select("h", decontamination.simhash(F.col("h")).alias("fp")).collect():
        h = [v % 2**64 for v in x["h"]]
        assert x["fp"] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_multi_index_finds_all_within_the_radius(spark):
    r = random.Random(5)
    pairs = []
    for d in range(0, 21):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), d):
            y ^= 1 << b
        pairs.append(tuple(v - 2**64 if v >= 2**63 else v for v in (x, y)))
    df = spark.createDataFrame(pairs, "x bigint, y bigint")
    both = df.select(F.arrays_overlap(decontamination.blocks(F.col("x"), 20), decontamination.blocks(F.col("y"), 20)).alias("o"))
    assert all(r["o"] for r in both.collect())


def test_licenses(spark, nothing):
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nmore", "a"), (2, "Licensed under CC BY-NC 4.0.", "a"), (3, "The license plate was lost in the general public garden.", "a"),
        (4, None, "a"), (5, "", "a"), (None, "Licensed under the Apache License, Version 2.0.", "a"), (6, " ".join(words(70, 3000)), "a"),
        (7, "word " * 30 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "a"),
        (8, "This work is licensed under the GNU General Public License, version 3.\nThis work is licensed under the GNU General Public License, version 2.", "a"),
    ] + [(100 + i, " ".join(words(100 + i, 60)), "a") for i in range(40)]
    got = {(r["doc_id"], r["paragraph"], r["line"]): (r["family"], r["confirmed"]) for r in licenses.licenses(table_of(rows, spark, extra=True)).collect()}
    assert got == {(1, 0, 1): ("mit", True), (2, 0, 0): ("cc-by-nc-4.0", True), (None, 0, 0): ("apache-2.0", True), (7, 0, 0): ("mit", True), (8, 0, 0): ("gpl-3.0", True), (8, 0, 1): ("gpl-2.0", True)}
    assert licenses.licenses(nothing).count() == 0


def test_licenses_of_rows_and_wrapped_notices(spark):
    """Repeated rows and null ids are documents of their own; a notice over several lines is found as a paragraph."""
    mit = licenses.NOTICES["mit"][1].split()
    wrapped = "\n".join(" ".join(mit[i : i + 7]) for i in range(0, len(mit), 7))
    rows = [
        (1, "Released under the MIT License.", "a"), (1, "Released under the MIT License.", "a"),
        (None, "Released under the MIT License.", "a"), (None, "prose of no weight", "a"), (None, "SPDX-License-Identifier: GPL-2.0-only", "a"),
        (2, "A first paragraph.\n\n" + wrapped + "\n \nand a last one.", "a"),
    ] + [(100 + i, " ".join(words(100 + i, 60)), "a") for i in range(40)]
    got = licenses.licenses(table_of(rows, spark)).collect()
    assert all(r["notice_share"] <= 1.0 for r in got)
    found = collections.Counter((r["doc_id"], r["family"]) for r in got if r["confirmed"])
    assert found == {(1, "mit"): 2, (None, "mit"): 1, (None, "gpl-2.0"): 1, (2, "mit"): 1}
    assert [(r["paragraph"], r["line"]) for r in got if r["doc_id"] == 2 and r["confirmed"]] == [(1, None)]


def test_unseen_notices_and_prose():
    """Wordings that are in no training row are told; prose, some of it about licences, hardly ever."""
    r = random.Random(3)
    unseen = {
        "mit": "This project is distributed under the MIT license; see the file for details.", "apache-2.0": "Distributed under the Apache License 2.0",
        "gpl-3.0": "This file is covered by the GNU General Public License version 3 only", "agpl-3.0": "The server is covered by the GNU Affero General Public License version 3",
        "mpl-2.0": "This file is subject to the Mozilla Public License version 2.0", "cc0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
        "isc": "Available under the ISC License", "lgpl": "The library is covered by the GNU Lesser General Public License", "bsd": "Distributed under the BSD 3-Clause License",
        "gpl-2.0": "it may be copied under the GNU General Public License version 2", "unlicense": "SPDX-License-Identifier: Unlicense and nothing else",
    }
    ordinary = [words(i, r.randrange(5, 40)) for i in range(600)] + [licenses.plain_tokens(t) for t in licenses.NOT_NOTICES]
    weights, constant = licenses.train(ordinary[:400])

    def told(w):
        p = licenses.softmax((constant + sum((weights[g] for g in licenses.grams(w) if g in weights), np.zeros(len(constant))))[None])[0]
        k = int(np.argmax(p))
        return licenses.FAMILIES[k] if k < len(licenses.FAMILIES) and p[-1] <= licenses.UNKNOWN else None

    assert np.mean([told(licenses.plain_tokens(t)) == name for name, t in unseen.items()]) >= 0.9
    assert np.mean([told(w) is not None for w in ordinary[400:]]) <= 0.01


def labelled(n):
    out = []
    for i in range(n):
        w = words(1000 + i, 80)
        if i % 5 == 0:
            for j in random.Random(i).sample(range(80), 4):
                w[j] = random.Random(i * 80 + j).choice(["villainous", "wretched", "despicable"])
        out.append((i, " ".join(w), int(i % 5 == 0)))
    return out


def test_toxicity(spark, odd, nothing):
    rows = labelled(600)
    docs, labels = table_of([(i, t, "s") for i, t, _ in rows], spark, extra=True), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    toxic = [scores[i] for i, _, y in rows if y and i in held]
    clean = [scores[i] for i, _, y in rows if not y and i in held]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.95
    # labels of held-out rows aren't looked at
    other = labels.withColumn("toxic", F.when(F.col("doc_id").isin(*held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, other) == model
    odd_scores = [r["score"] for r in toxicity.score_documents(odd, model).collect()]
    assert len(odd_scores) == odd.count() and all(0 <= s <= 1 for s in odd_scores)
    kept = toxicity.drop_toxic(docs, docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, s in scores.items() if s < 0.7}
    assert toxicity.drop_toxic(nothing, docs, labels).count() == 0


def test_toxicity_without_labels(spark, odd):
    model = toxicity.fit(odd, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert all(r["score"] == pytest.approx(1e-6) for r in toxicity.score_documents(odd, model).collect())


def test_language_model_base(spark, odd, odd_rows, nothing):
    rows = pitmanyor.score_texts(odd).collect()
    got = collections.Counter((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), r["held_out"]) for r in rows)
    tokens = [(i, [*plain_words(t), None]) for i, t, _ in odd_rows]
    train = [x for i, w in tokens if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for x in w]
    c, n, v = collections.Counter(train), len(train), len(set(train))
    want = collections.Counter(
        (str(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4), i is None or zlib.crc32(str(i).encode()) % 7 == 2) for i, w in tokens
    )
    assert got == want and all(r["score"] < 0 for r in rows)
    assert pitmanyor.score_texts(nothing).count() == 0


def test_language_model_learns_context(spark, monkeypatch):
    rows = [(i, " ".join(x for _ in range(40) for x in random.Random(i * 100 + _).choice([("alpha", "beta"), ("gamma", "delta")])), "s") for i in range(120)]
    got = {r["doc_id"]: r["score"] for r in pitmanyor.score_texts(table_of(rows, spark)).collect()}
    base = {r["doc_id"]: r["base_score"] for r in pitmanyor.score_texts(table_of(rows, spark)).where("held_out").collect()}
    assert base and all(got[i] > base[i] + 5 for i in base)
    # many blocks, buckets and classes of split words: other restaurants for the words that are split, the same documents and nearly the same scores
    for name, value in (("BLOCK_TOKENS", 100), ("BUCKET_TOKENS", 500), ("SPLIT_TOKENS", 1500)):
        monkeypatch.setattr(pitmanyor, name, value)
    other = {r["doc_id"]: r["score"] for r in pitmanyor.score_texts(table_of(rows, spark)).collect()}
    assert set(other) == set(got) and all(other[i] == pytest.approx(got[i], rel=0.05) for i in got)


def test_packed_numbers():
    for width in (1, 2, 4, 6, 8):
        x = np.array([0, 1, (1 << (8 * width - 1)) - 1, 7], dtype=np.int64)
        assert (pitmanyor.unpack(pitmanyor.pack(x, width), width) == x).all()
    assert (pitmanyor.unpack(pitmanyor.pack(np.array([-5, 3]), 8), 8) == [-5, 3]).all()
    assert len(pitmanyor.unpack(pitmanyor.pack(np.empty(0), 6), 6)) == 0


def partitions(c):
    """All set partitions of c customers as lists of table sizes, with the number of each customer's table."""
    def grow(k, tables):
        if k == c:
            yield list(tables)
            return
        for i in range(len(tables)):
            tables[i] += 1
            yield from grow(k + 1, tables)
            tables[i] -= 1
        yield from grow(k + 1, [*tables, 1])

    return grow(0, [])


@pytest.mark.parametrize("a", [0.2, 0.5, 0.8])
def test_chance_to_sit_alone(a):
    for c in range(1, 8):
        total, alone = collections.Counter(), collections.Counter()
        for sizes in partitions(c):
            weight = math.prod(math.prod(i - a for i in range(1, n)) for n in sizes)
            total[len(sizes)] += weight
            alone[len(sizes)] += weight * sum(n == 1 for n in sizes) / c
        for t in total:
            got = pitmanyor.Alone(a)(np.array([c]), np.array([t]))[0]
            assert got == pytest.approx(alone[t] / total[t] if t > 1 or c == 1 else 0.0)
    # beyond the exact table: near its last row, and without a jump
    alone = pitmanyor.Alone(a)
    t = np.arange(5, 155, 10)
    exact = alone(np.full(len(t), 160), t)
    limit = np.interp(t / 160, alone.share, alone.chance)
    assert np.abs(exact - limit).max() < 0.02


class Plain:
    """The same model, customer by customer, with every table: two-word contexts over one-word contexts over fixed probabilities."""

    def __init__(self, triples, p0, a, s, seed):
        self.r, self.p0, self.a, self.s = random.Random(seed), p0, a, s
        self.low, self.high = collections.defaultdict(lambda: collections.defaultdict(list)), collections.defaultdict(lambda: collections.defaultdict(list))
        self.customers = triples
        for x in triples:
            self.add(*x)

    def high_p(self, c1, w):
        d = self.high[c1]
        tables = sum(map(len, d.values()))
        return (sum(d[w]) - self.a[0] * len(d[w]) + (self.s[0] + self.a[0] * tables) * self.p0[w]) / (self.s[0] + sum(map(sum, d.values())))

    def p(self, c2, c1, w):
        d = self.low[c2, c1]
        tables = sum(map(len, d.values()))
        return (sum(d[w]) - self.a[1] * len(d[w]) + (self.s[1] + self.a[1] * tables) * self.high_p(c1, w)) / (self.s[1] + sum(map(sum, d.values())))

    def seat(self, tables, new, a):
        k = self.r.choices(range(len(tables) + 1), [n - a for n in tables] + [new])[0]
        if k < len(tables):
            tables[k] += 1
            return False
        tables.append(1)
        return True

    def unseat(self, tables):
        k = self.r.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def add(self, c2, c1, w):
        d = self.low[c2, c1]
        if self.seat(d[w], (self.s[1] + self.a[1] * sum(map(len, d.values()))) * self.high_p(c1, w), self.a[1]):
            h = self.high[c1]
            self.seat(h[w], (self.s[0] + self.a[0] * sum(map(len, h.values()))) * self.p0[w], self.a[0])

    def sweep(self):
        for x in self.customers:
            if self.unseat(self.low[x[0], x[1]][x[2]]):
                self.unseat(self.high[x[1]][x[2]])
            self.add(*x)


def test_a_sweep_seats_every_customer(monkeypatch):
    assert all(sum(int(pitmanyor.due(np.array([c]), k)[0]) for k in range(pitmanyor.TURNS)) == c for c in (1, 2, 63, 64, 65, 1000))
    n = [1, 2, 5, 64, 700]
    w = np.repeat(np.arange(5), n)
    none = {"words": np.empty(0, np.int64), "number": np.empty(0, np.int64)}
    b = pitmanyor.Bucket(np.arange(5), np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), w, np.ones(len(w), bool), none)
    b.prepare(pitmanyor.Setting((0.5, 0.6, 0.7), (1.0, 0.8, 1.5), 0, 0), np.full(5, 0.2))
    moved = []
    real = pitmanyor.reseat
    monkeypatch.setattr(pitmanyor, "reseat", lambda rng, c, t, m, new, alone: (alone is b.alone2 and moved.append(m.sum())) or real(rng, c, t, m, new, alone))
    b.sweep(np.random.default_rng(1))
    assert sum(moved) == sum(n) - 1  # the customer of a dish of one keeps its table


class Draws:
    """A generator that notes how many binomials are drawn."""

    def __init__(self, seed):
        self.rng, self.binomials = np.random.default_rng(seed), 0

    def random(self, n):
        return self.rng.random(n)

    def binomial(self, m, p):
        self.binomials += len(m)
        return self.rng.binomial(m, p)


def test_single_customers_take_no_binomials():
    n = np.array([1, 2, 5, 64] * 50)
    w = np.repeat(np.arange(len(n)), n)
    none = {"words": np.empty(0, np.int64), "number": np.empty(0, np.int64)}
    b = pitmanyor.Bucket(np.arange(len(n)), np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), w, np.ones(len(w), bool), none)
    b.prepare(pitmanyor.Setting((0.5, 0.6, 0.7), (1.0, 0.8, 1.5), 0, 0), np.full(len(n), 1 / len(n)))
    rng = Draws(1)
    for _ in range(3):
        b.sweep(rng)
    assert rng.binomials == 0 and b.t.sum() > len(n)
    # none to leave, one, and several: the same means as a binomial's, within the same limits
    m, p = np.repeat([0, 1, 1, 5], 20_000), np.repeat([0.9, 0.3, 1.0, 0.4], 20_000)
    got, many = pitmanyor.drawn(rng, m, p)
    assert got.reshape(4, -1).mean(axis=1) == pytest.approx([0, 0.3, 1, 2], abs=0.05) and (got <= m).all()
    assert rng.binomials == len(many) == 20_000
    c, t = (x.ravel() for x in np.meshgrid(np.arange(1, 300), np.arange(1, 300), indexing="ij"))
    c, t = c[t <= c], t[t <= c]
    for k in (1, 3):
        m = np.minimum(c, k)
        closed = pitmanyor.leave(rng, c, t, m, pitmanyor.Alone(0.7))
        assert (closed >= np.maximum(t - (c - m), 0)).all() and (closed <= np.maximum(t - (c > m), 0)).all()
        opened = pitmanyor.arrive(rng, c - m, t - closed, m, np.full(len(c), 0.5), 0.7)
        assert (opened <= m).all() and (opened[c == m] > 0).all()


def test_words_end_at_the_same_bytes_as_their_pattern():
    text = "".join(f"A{chr(i)}b" for i in range(0x3001))
    assert [w for x in pyworker.word_lists(text, 50) for w in x] == pyworker.WORD.findall(text.encode().translate(pyworker.LOWER))


def test_sampler_agrees_with_customer_by_customer_gibbs():
    r = random.Random(6)
    triples = [(r.choice([0, 1, 1]), r.choice([2, 3]), r.choice([0, 0, 0, 0, 1, 1, 4, 5])) for _ in range(150)]
    p0, a, s = np.array([0.3, 0.2, 0.1, 0.1, 0.1, 0.2]), (0.6, 0.7), (0.8, 1.5)
    queries = sorted({(c2, c1, w) for c2 in (0, 1) for c1 in (2, 3) for w in range(6)})
    plain = Plain(triples, p0, a, s, 1)
    want = np.zeros(len(queries))
    for k in range(1500):
        plain.sweep()
        want += [plain.p(*x) for x in queries] if k >= 100 else 0
    want /= 1400
    rows = sorted([(c1, c2, w, True) for c2, c1, w in triples] + [(c1, c2, w, False) for c2, c1, w in queries])
    c1, c2, w, learn = (np.array(x) for x in zip(*rows, strict=True))  # two farther words, in a class each
    none = {"words": np.empty(0, np.int64), "number": np.empty(0, np.int64)}
    b = pitmanyor.Bucket(np.arange(6), c1, c2, w, learn, none)
    b.prepare(pitmanyor.Setting((0.5, *a), (1.0, *s), 0, 0), p0)
    rng = np.random.default_rng(2)
    got = np.zeros(len(b.n))
    for k in range(6000):
        b.sweep(rng)
        got += b.predict() if k >= 200 else 0
        if k == 200:
            p = b.predict()  # over all words, a context's probabilities sum to one
            assert np.allclose(np.bincount(b.r2, weights=p), 1.0)
    got = dict(zip(zip(c2[np.searchsorted(b.q, np.arange(len(b.n)))], c1[np.searchsorted(b.q, np.arange(len(b.n)))], b.w, strict=True), got / 5800, strict=True))
    assert [got[x] for x in queries] == [pytest.approx(x, rel=0.04, abs=0.004) for x in want]
    assert (b.t >= (b.n > 0)).all() and (b.t <= b.n).all() and (b.t1 <= b.c1).all() and (np.bincount(b.d, weights=b.t) == b.c1).all()
    assert (np.bincount(b.d_r1, weights=b.t1) == b.t1_sum).all() and (np.bincount(b.r2, weights=b.t) == b.t2_sum).all()
