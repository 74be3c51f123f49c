"""Generated tasks: their answers can be found in their prompts, budgets hold, and every run makes the same rows."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions import maths
from weftline.operators import articles, tasks
from weftline.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    assert got
    if name in ("key_value_tasks", "vote_tables", "multi_needle_tasks"):
        key = df.columns[0]
        again = {r[key]: r["prompt"] for r in catalog.queries()[name](spark, SF).repartition(3).collect()}
        assert {r[key]: r["prompt"] for r in got} == again
    return got


def test_stores(spark):
    depths = set()
    for r in rows(spark, "key_value_tasks"):
        pairs = dict(line.split(": ") for line in r["store"].split("\n"))
        assert len(pairs) == 8 and pairs[r["question"]] == r["answer"] and list(pairs)[r["at"]] == r["question"]
        assert 1 <= r["prompt"].count("Your key: " + r["question"]) <= 2
        depths.add(r["at"])
    assert len(depths) == 8


def test_needles(spark):
    for r in rows(spark, "multi_needle_tasks"):
        right, wrong = r["answer"].split(), r["neg_answer"].split()
        assert r["k"] * r["v"] <= 16 and r["q"] <= min(r["k"], 6)
        assert len(right) == r["q"] * r["v"] and len(wrong) == (r["k"] - r["q"]) * r["v"] and len({*right, *wrong}) == r["k"] * r["v"]
        assert all(w in r["prompt"] for w in right + wrong)


def test_problems(spark):
    for r in rows(spark, "integer_expressions"):
        assert maths.value(r["expression"], 1.0) == r["value"]
    for r in rows(spark, "linear_equations"):
        a, b, c = map(int, re.fullmatch(r"(-?\d+) x \+ (-?\d+) = (-?\d+)", r["equation"]).groups())
        assert a * r["solution"] + b == c
    for r in rows(spark, "solve_and_look_up"):
        store = dict(re.findall(r"^(-?\d+): (\w+)$", r["prompt"], re.MULTILINE))
        assert len(store) == 10 and store[r["math_answer"]] == r["answer"]


def test_choices(spark):
    for r in rows(spark, "multiple_choice_tasks"):
        assert f"\n{r['answer']}. {r['value']}" in r["prompt"] and len(set(re.findall(r"^[A-D]\. (.*)$", r["prompt"], re.MULTILINE))) == 4
    assert {r["answer"] for r in rows(spark, "multiple_choice_tasks")} == set("ABCD")
    for r in rows(spark, "long_document_tasks"):
        right = re.search(rf"begins the text\?\n(?:.*\n)*?{r['answer']}\. ", r["prompt"])
        assert right and r["turn"] <= 3
    for r in rows(spark, "shuffled_options"):
        order = [int(x) for x in r["order"].split(",")]
        assert sorted(order) == [0, 1, 2, 3] and "ABCD"[order.index(0)] == r["letter"]


def test_demonstrations(spark):
    for r in rows(spark, "demonstration_tasks"):
        assert len(re.findall(r"^label: \d", r["prompt"], re.MULTILINE)) == r["n_demos"] and len(r["prompt"].split()) <= 240
        assert r["prompt"].endswith("label:") and len(r["pos_docs"]) <= 6


def test_votes(spark):
    for r in rows(spark, "vote_tables"):
        votes = re.findall(r"^Delegate \d+: (.*)$", r["prompt"], re.MULTILINE)
        assert len(votes) == r["total"] and all(votes.count(r["answer"]) > votes.count(x) for x in r["neg_answer"].split("|||"))
    for r in rows(spark, "top_vote_tables"):
        votes = re.findall(r"^Delegate \d+: (.*)$", r["prompt"], re.MULTILINE)
        count = lambda s: [votes.count(x) for x in s.split("|||")]
        assert min(count(r["answer"])) >= 1.3 * max(count(r["neg_answer"])) and len(votes) == r["total"]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 300), st.integers(1, 9), st.floats(0.1, 0.9), st.integers(0, 10**6))
def test_votes_sum(total, options, share, seed):
    votes = tasks.split_votes(total, options, share, np.random.default_rng(seed))
    assert sum(votes) == total and len(votes) == options and min(votes) >= 0
    assert options == 1 or total < 3 or votes[0] > max(votes[1:])
    top = max(1, options // 2)
    ranked = tasks.ranked_votes(total, options, top, 0.8, 1.3, np.random.default_rng(seed))
    assert sum(ranked) == total and min(ranked) >= 0 and (top == options or ranked[top] == 0 or ranked[top - 1] >= 1.3 * ranked[top])


def test_thresholds(spark):
    for r in rows(spark, "threshold_tasks"):
        cap, least = map(int, re.search(r"cost up to (\d+) and score of at least (\d+)", r["prompt"]).groups())
        entries = [(int(s), n) for n, c, s in re.findall(r"^(Entry \w): cost (\d+), score (\d+)$", r["prompt"], re.MULTILINE) if int(c) <= cap and int(s) >= least]
        assert 2 <= len(entries) <= 9 and max(entries)[1] == r["answer"]


@pytest.mark.parametrize("name", ["ranking_tasks", "citation_tasks", "window_tasks", "multi_hop_tasks"])
def test_document_tasks(spark, name):
    for r in rows(spark, name):
        assert len(r["prompt"].split()) <= tasks.BUDGET + 20 and r["n_docs"] > 0
        numbers = r["gold_numbers"] if "gold_numbers" in r else [int(x) for x in r["relevance_grades"]] if "relevance_grades" in r else eval(r["settings"])["gold_doc_ids"]
        assert numbers and all(1 <= n <= r["n_docs"] for n in numbers)
        if name == "ranking_tasks":
            grades = [r["relevance_grades"][x] for x in r["answer"].split(" > ")]
            assert grades == sorted(grades, reverse=True) and len(grades) == len(numbers)


def test_window_ranges_are_hashed_lengths(spark):
    from pyspark.sql import functions as F

    ranges = articles.window_ranges(1000, 42, "a1")
    assert ranges[0][0] == 0 and ranges[-1][1] == 1000 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert all(80 <= e - s <= 100 for s, e in ranges[:-1]) and articles.window_ranges(0, 42, "a") == []
    got = spark.range(1).select(articles.blake_windows(F.lit(1000), F.lit("a1")).alias("w")).first()["w"]
    assert [(x["start"], x["end"]) for x in got] == ranges

