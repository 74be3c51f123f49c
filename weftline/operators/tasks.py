"""Tasks for training and evaluation, made from tables: a row for each, with its prompt and what the answer is scored by.

Chance is a hash of the row's key and a salt, so every run and every
partitioning makes the same rows. All of a task is made in its own row;
documents that several tasks use reach them by joins on ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import once, tokens
from weftline.operators.articles import articles, expanded
from weftline.operators.negatives import items, mixed_negatives, random_candidates, ranked_negatives
from weftline.operators.sampling import chance, number
from weftline.plans.registry import query
from weftline.sources.tables import table

BUDGET = 600


def _picked(low: int, high: int, salt: str, key: str) -> str:
    """pick() in the oracle's SQL."""
    return f"({low} + CAST('0x' || substr(md5('{salt}:' || {key}), 1, 8) AS BIGINT) % {high - low + 1})"


def pick(low: int, high: int, *parts: Column | str) -> Column:
    """A whole number from ``low`` to ``high``."""
    return (F.lit(low) + number(*parts) % (high - low + 1)).cast("int")


def numbered_hash(x: Column, salt: str, i: Column) -> Column:
    """number() of an element of an array; safe inside a lambda."""
    return number(salt, x, i)


def shuffled(values: Column, salt: str, key: Column) -> Column:
    """An array in an order that depends on the key."""
    keyed = F.array_sort(F.transform(values, lambda x, i: F.struct(numbered_hash(key, salt, i).alias("h"), i.alias("i"), x.alias("x"))))
    return F.transform(keyed, lambda s: s["x"])


def inserted(values: Column, extra: Column, depths: Column) -> Column:
    """``values`` with each of ``extra`` at its relative depth, from 0 to 1."""

    def of(b: Column) -> Column:
        n = F.greatest(F.size(b["values"]), F.lit(1))
        own = F.transform(b["values"], lambda x, i: F.struct(((i + 0.5) / n).alias("d"), F.lit(1).alias("k"), i.alias("i"), x.alias("x")))
        more = F.transform(b["extra"], lambda x, i: F.struct(F.get(b["depths"], i).alias("d"), F.lit(0).alias("k"), i.alias("i"), x.alias("x")))
        return F.transform(F.array_sort(F.concat(own, more)), lambda s: s["x"])

    return once(F.struct(values.alias("values"), extra.alias("extra"), depths.alias("depths")), of)


def fitting(parts: Column, fixed: Column, budget: int) -> Column:
    """How many of ``parts``, from the first, fit beside ``fixed`` words into ``budget`` words."""
    start = F.struct(fixed.cast("int").alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(a: Column, p: Column) -> Column:
        used = a["used"] + F.size(tokens(p))
        full = a["full"] | (used > budget)
        return F.struct(used.alias("used"), F.when(full, a["n"]).otherwise(a["n"] + 1).alias("n"), full.alias("full"))

    return F.aggregate(parts, start, step, lambda a: a["n"])


#: Where a question stands and how often.
POSITIONS = (("end", 0.6), ("beginning", 0.2), ("both", 0.2))


def with_question(body: Column, question: Column, u: Column) -> Column:
    """The question after the body, before it, or at both ends, by a number from 0 to 1."""
    after, before = F.concat(body, F.lit("\n\n"), question), F.concat(question, F.lit("\n\n"), body)
    return F.when(u <= POSITIONS[0][1], after).when(u <= POSITIONS[0][1] + POSITIONS[1][1], before).otherwise(F.concat(before, F.lit("\n\n"), question))


FORMS = {
    "bracket": lambda i, d: F.concat(F.lit("Document ["), i, F.lit("] (Title: "), d["title"], F.lit(") "), d["text"]),
    "numbered": lambda i, d: F.concat(F.lit("["), i, F.lit("] "), d["title"], F.lit("\n"), d["text"]),
    "named": lambda i, d: F.concat(i, F.lit(". "), d["title"], F.lit(": "), d["text"]),
}


def prompt_of(rows: DataFrame, key: str, form: str = "bracket", budget: int = BUDGET) -> DataFrame:
    """The prompt layer of tasks over documents.

    ``rows``: (key, question, gold, others, ...), where gold and others are
    arrays of (id, title, text). Other documents are shuffled and kept as far
    as all fit ``budget`` words beside the gold ones, which always stay; gold
    ones are put at random depths; documents are numbered from 1 in the order
    of the prompt. Adds prompt, gold_numbers, n_docs. A task whose gold
    documents alone don't fit is dropped.
    """
    k = F.col(key)
    words = lambda d: F.size(tokens(d["title"])) + F.size(tokens(d["text"])) + 4
    total = lambda ds: F.aggregate(ds, F.lit(0), lambda a, d: a + words(d))
    mixed = rows.withColumn("others", shuffled(F.col("others"), "order", k)).withColumn("fixed", total(F.col("gold")) + 2 * F.size(tokens(F.col("question"))))
    mixed = mixed.where(F.col("fixed") <= budget)
    texts = F.transform("others", lambda d: F.concat_ws(" ", d["title"], d["text"], F.lit("a b c d")))
    mixed = mixed.withColumn("others", F.slice("others", F.lit(1), fitting(texts, F.col("fixed"), budget)))
    marked = lambda ds, gold: F.transform(ds, lambda d: F.struct(d["id"].alias("id"), d["title"].alias("title"), d["text"].alias("text"), F.lit(gold).alias("gold")))
    depths = F.transform("gold", lambda d, i: (numbered_hash(k, "depth", i) + 1) / float(2**32))
    mixed = mixed.withColumn("docs", inserted(marked(F.col("others"), False), marked(F.col("gold"), True), depths))
    lines = F.transform("docs", lambda d, i: FORMS[form]((i + 1).cast("string"), d))
    numbers = F.filter(F.transform("docs", lambda d, i: F.when(d["gold"], i + 1)), lambda i: i.isNotNull())
    return mixed.select(*rows.drop("gold", "others").columns, with_question(F.array_join(lines, "\n"), F.col("question"), chance("place", k)).alias("prompt"), numbers.alias("gold_numbers"), F.size("docs").alias("n_docs"))


# --- stores and needles ---


@query("key_value_tasks")
def key_value_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of eight pairs with distinct keys and one key asked for, at a uniform depth; the answer is its value."""
    i = F.col("doc_id")
    base, step = pick(0, 9999, "base", i), pick(0, 1998, "step", i) * 5 + 1  # steps prime to 10,000 and keys differ
    step = F.when(step % 2 == 0, step + 5).otherwise(step)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.struct(((base + j * step) % 10_000).cast("string").alias("k"), F.substring(F.md5(F.concat_ws(":", i.cast("string"), j.cast("string")).cast("binary")), 1, 8).alias("v")))
    d = table(spark, sf_dir, "documents").select("doc_id", pairs.alias("pairs"), pick(0, 7, "asked", i).alias("at"))
    store = F.array_join(F.transform("pairs", lambda p: F.concat_ws(": ", p["k"], p["v"])), "\n")
    asked = F.get("pairs", F.col("at"))
    return d.select("doc_id", store.alias("store"), with_question(store, F.concat(F.lit("Your key: "), asked["k"]), chance("place", i)).alias("prompt"), asked["k"].alias("question"), asked["v"].alias("answer"), "at")


@query("multi_needle_tasks")
def multi_needle_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needles of k keys with v values each (k * v at most 16) among a document's shuffled sentences; up to six keys are asked for, the others' values are wrong answers."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", r"(?<=[.!?])\s+").alias("sentences")).where("size(sentences) >= 3")
    d = d.withColumn("k", pick(1, 4, "k", i)).withColumn("v", pick(1, 4, "v", i)).withColumn("q", F.least(pick(1, 6, "q", i), F.col("k")))
    word = lambda salt, a, b: F.concat(F.lit(salt), F.substring(F.md5(F.concat_ws(":", F.lit(salt), i.cast("string"), a.cast("string"), b.cast("string")).cast("binary")), 1, 7))
    needles = F.flatten(F.transform(F.sequence(F.lit(1), F.col("k")), lambda a: F.transform(F.sequence(F.lit(1), F.col("v")), lambda b: F.struct(a.alias("a"), word("key", a, F.lit(0)).alias("key"), word("val", a, b).alias("value")))))
    d = d.withColumn("needles", needles)
    lines = F.transform("needles", lambda n: F.concat(F.lit("One of the values for "), n["key"], F.lit(" is: "), n["value"], F.lit(".")))
    depths = F.transform("needles", lambda n, j: (numbered_hash(i, "depth", j) + 1) / float(2**32))
    body = F.array_join(inserted(shuffled(F.col("sentences"), "essay", i), lines, depths), " ")
    of = lambda wanted: F.array_join(F.transform(F.filter("needles", lambda n: (n["a"] <= F.col("q")) if wanted else (n["a"] > F.col("q"))), lambda n: n["value"]), " ")
    keys = F.array_join(F.array_distinct(F.transform(F.filter("needles", lambda n: n["a"] <= F.col("q")), lambda n: n["key"])), ", ")
    return d.select("doc_id", with_question(body, F.concat(F.lit("All values for: "), keys), chance("place", i)).alias("prompt"), of(True).alias("answer"), of(False).alias("neg_answer"), "k", "v", "q")


def expression(i: Column) -> tuple[Column, Column]:
    """An integer expression of three numbers and its value."""
    a, b, c, kind = pick(2, 40, "a", i), pick(2, 40, "b", i), pick(2, 9, "c", i), number("kind", i) % 3
    text = F.when(kind == 0, F.format_string("(%d + %d) * %d", a, b, c)).when(kind == 1, F.format_string("%d * %d + %d", a, c, b)).otherwise(F.format_string("%d * %d + %d", b, c, a))
    return text, F.when(kind == 0, (a + b) * c).when(kind == 1, a * c + b).otherwise(b * c + a)


def equation(i: Column) -> tuple[Column, Column]:
    """a x + b = c with one whole solution."""
    a, x, b = pick(2, 9, "ea", i), pick(1, 400, "ex", i), pick(-50, 50, "eb", i)
    return F.format_string("%d x + %d = %d", a, b, a * x + b), x


_A, _XX, _B = (_picked(lo, hi, salt, "doc_id") for lo, hi, salt in ((2, 9, "ea"), (1, 400, "ex"), (-50, 50, "eb")))


@query("linear_equations", f"SELECT doc_id, {_A} || ' x + ' || {_B} || ' = ' || ({_A} * {_XX} + {_B}) AS equation, CAST({_XX} AS INT) AS solution FROM documents")
def linear_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, x = equation(F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("equation"), x.alias("solution"))


_E = [_picked(lo, hi, salt, "doc_id") for lo, hi, salt in ((2, 40, "a"), (2, 40, "b"), (2, 9, "c"), (0, 2, "kind"))]


@query(
    "integer_expressions",
    f"SELECT doc_id, CASE kind WHEN 0 THEN '(' || a || ' + ' || b || ') * ' || c WHEN 1 THEN a || ' * ' || c || ' + ' || b ELSE b || ' * ' || c || ' + ' || a END AS expression, CAST(CASE kind WHEN 0 THEN a * c + b * c WHEN 1 THEN b + c * a ELSE a + c * b END AS INT) AS value FROM (SELECT doc_id, {_E[0]} AS a, {_E[1]} AS b, {_E[2]} AS c, {_E[3]} AS kind FROM documents)",
)
def integer_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, value = expression(F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("expression"), value.alias("value"))


@query("solve_and_look_up")
def solve_and_look_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids get an expression, odd ones an equation; its value is the key of a store whose other keys lie around it."""
    i = F.col("doc_id")
    (e, v), (q, x) = expression(i), equation(i)
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 2 == 0, e).otherwise(q).alias("problem"), F.when(i % 2 == 0, v).otherwise(x).alias("key"), pick(0, 9, "at", i).alias("at"))
    value = lambda j: F.substring(F.md5(F.concat_ws(":", F.lit("value"), i.cast("string"), j.cast("string")).cast("binary")), 1, 8)
    lines = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.concat((F.col("key") - F.col("at") + j).cast("string"), F.lit(": "), value(j)))
    return d.select("doc_id", F.concat(F.array_join(shuffled(lines, "store", i), "\n"), F.lit("\n\nSolve "), F.col("problem"), F.lit(" and give the value of the result.")).alias("prompt"), value(F.col("at")).alias("answer"), F.col("key").cast("string").alias("math_answer"))


# --- short context ---


@query(
    "filtered_prompts",
    f"SELECT doc_id, 'Solve: ' || text AS prompt, split FROM (SELECT *, CASE WHEN {_picked(0, 9, 'split', 'doc_id')} = 0 THEN 'validation' ELSE 'train' END AS split FROM documents WHERE NOT regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]')) WHERE split = 'validation' OR (CAST('0x' || substr(md5('half:' || doc_id), 1, 8) AS BIGINT) + 1) / 4294967296.0 <= 0.5",
)
def filtered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts without CJK characters, a tenth by hash for validation, and of the rest the first half in a random order for training."""
    d = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[\x{4e00}-\x{9fff}]")).select("doc_id", "text")
    d = d.withColumn("split", F.when(number("split", F.col("doc_id")) % 10 == 0, "validation").otherwise("train"))
    return d.where((F.col("split") == "validation") | (chance("half", F.col("doc_id")) <= 0.5)).select("doc_id", F.concat(F.lit("Solve: "), "text").alias("prompt"), "split")


LETTERS = "ABCD"


def multiple_choice(options: Column, key: Column, salt: str) -> tuple[Column, Column]:
    """(lines, letter): four options, the right one first, in a random order with letters, and the right one's letter."""
    order = shuffled(F.sequence(F.lit(0), F.lit(3)), salt, key)
    lines = F.transform(order, lambda o, j: F.concat(F.substring(F.lit(LETTERS), j + 1, F.lit(1)), F.lit(". "), F.get(options, o)))
    return F.array_join(lines, "\n"), F.substring(F.lit(LETTERS), F.array_position(order, 0).cast("int"), F.lit(1))


@query("multiple_choice_tasks")
def multiple_choice_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts with three wrong ones, of parts whose brand ends in 2 to 4 and whose type isn't steel."""
    p, i = F.col("p_retailprice"), F.col("p_partkey")
    options = F.transform(F.array(F.lit(0.0), F.lit(1.5), F.lit(-2.25), F.lit(10.0)), lambda d: F.format_number(p + d, 2))
    lines, letter = multiple_choice(options, i, "letters")
    d = table(spark, sf_dir, "part").where("substr(p_brand, length(p_brand), 1) BETWEEN '2' AND '4' AND p_type NOT LIKE '%STEEL%'")
    return d.select("p_partkey", F.concat(F.lit("The price of "), F.col("p_name"), F.lit("?\n"), lines).alias("prompt"), letter.alias("answer"), F.format_number(p, 2).alias("value"))


@query(
    "shuffled_options",
    "WITH o AS (SELECT item_id, list(k ORDER BY h, k) AS ks FROM (SELECT item_id, k, CAST('0x' || substr(md5('options:' || item_id || ':' || k), 1, 8) AS BIGINT) AS h FROM benchmark, (SELECT CAST(unnest(range(4)) AS INT) AS k)) GROUP BY item_id) SELECT item_id, array_to_string(ks, ',') AS \"order\", substr('ABCD', list_position(ks, 0), 1) AS letter FROM o",
)
def shuffled_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four options in a random order, and the letter of the one that was first."""
    order = shuffled(F.sequence(F.lit(0), F.lit(3)), "options", F.col("item_id"))
    b = table(spark, sf_dir, "benchmark").withColumn("order", order)
    return b.select("item_id", F.array_join("order", ",").alias("order"), F.substring(F.lit(LETTERS), F.array_position("order", 0).cast("int"), F.lit(1)).alias("letter"))


# --- demonstrations ---


@query("demonstration_tasks")
def demonstration_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to label with demonstrations: the first six of each label, labels taking turns, their names permuted, as many as fit; those of the right label are noted. The demonstrations are one small row."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.left("text", F.lit(60)).alias("text"))
    first = d.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(number("demo", F.col("doc_id")), "doc_id"))).where("rn <= 6")
    names = d.select("lang").distinct().select("lang", (F.row_number().over(Window.orderBy(number("label", F.col("lang")))) - 1).alias("label"))
    shown = first.join(names, "lang").agg(F.array_sort(F.collect_list(F.struct("rn", "label", "doc_id", "text", "lang"))).alias("demos"))
    test = d.join(first.select("doc_id"), "doc_id", "left_anti").join(F.broadcast(names), "lang").crossJoin(F.broadcast(shown))
    line = lambda x: F.concat(x["text"], F.lit("\nlabel: "), x["label"].cast("string"))
    n = fitting(F.transform("demos", line), F.size(tokens(F.col("text"))) + 2, 240)
    used = F.slice("demos", F.lit(1), n)
    same = F.transform(F.filter(used, lambda x: x["label"] == F.col("label")), lambda x: x["doc_id"])
    return test.select("doc_id", F.concat(F.array_join(F.transform(used, line), "\n\n"), F.lit("\n\n"), F.col("text"), F.lit("\nlabel:")).alias("prompt"), F.col("label").cast("string").alias("answer"), F.size(used).alias("n_demos"), same.alias("pos_docs"))


# --- long documents ---


@query("long_document_tasks")
def long_document_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on documents of 200 to 2,000 characters of length: which of four lines begins it; at most three documents of each source, in turns."""
    d = table(spark, sf_dir, "documents").where("n_chars BETWEEN 200 AND 2000").select("doc_id", "source", "text", "n_chars")
    d = d.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy(number("turn", F.col("doc_id")), "doc_id"))).where("turn <= 3")
    part = lambda at: F.substring(F.col("text"), F.lit(at), F.lit(24))
    lines, letter = multiple_choice(F.array(part(1), part(60), part(110), part(160)), F.col("doc_id"), "quality")
    return d.select("doc_id", "turn", F.concat(F.col("text"), F.lit("\n\nWhich of these begins the text?\n"), lines).alias("prompt"), letter.alias("answer"))


# --- aggregation ---


def split_votes(total: int, options: int, share: float, rng: np.random.Generator) -> list[int]:
    """Votes whose first option wins with about ``share`` of the total; the others split the rest by a flat Dirichlet draw. They sum to the total."""
    if options <= 1:
        return [total]
    first = max(1, round(total * share))
    rest = np.floor(rng.dirichlet(np.ones(options - 1)) * (total - first)).astype(int)
    rest[: total - first - rest.sum()] += 1
    while rest.max() >= first:  # a vote at a time from the strongest rival
        rest[rest.argmax()] -= 1
        first += 1
    return [first, *map(int, rest)]


def ranked_votes(total: int, options: int, top: int, alpha: float, gap: float, rng: np.random.Generator) -> list[int]:
    """Votes in falling order by Zipf weights with Dirichlet noise; the last of the ``top`` has at least ``gap`` times the votes of the next. They sum to the total."""
    weights = 0.7 / np.arange(1, options + 1) ** alpha + 0.3 * rng.dirichlet(np.full(options, 0.3))
    weights = np.sort(weights / weights.sum())[::-1]
    votes = np.floor(weights * total).astype(int)
    votes[: total - votes.sum()] += 1
    votes = np.sort(votes)[::-1]
    while top < options and votes[top] > 0 and votes[top - 1] < gap * votes[top]:
        votes[top] -= 1  # the first that is out gives to the last that is in
        votes[top - 1] += 1
        votes = np.r_[np.sort(votes[:top])[::-1], np.sort(votes[top:])[::-1]]
    return list(map(int, votes))


def _vote_tasks(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """A task for each document, its table made by ``make(rng, doc_id)``: a batch of ids at a time."""

    def batches(parts):
        for part in parts:
            yield pd.DataFrame([{"doc_id": int(i), **make(np.random.default_rng([11, int(i)]), int(i))} for i in part["doc_id"]], columns=["doc_id", "prompt", "answer", "neg_answer", "total"])

    return table(spark, sf_dir, "documents").select("doc_id").mapInPandas(batches, "doc_id bigint, prompt string, answer string, neg_answer string, total int")


def _ballots(names: list[str], votes: list[int], rng: np.random.Generator) -> list[str]:
    cast = np.repeat(np.arange(len(votes)), votes)
    rng.shuffle(cast)
    return [f"Delegate {k + 1}: {names[v]}" for k, v in enumerate(cast)]


@query("vote_tables")
def vote_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ballots with one winner; there are fewer where the text wouldn't fit."""

    def make(rng: np.random.Generator, _: int) -> dict:
        names, total = [f"Proposal {c}" for c in "ABCDE"[: rng.integers(2, 6)]], int(rng.integers(20, 160))
        while True:
            votes = split_votes(total, len(names), 0.4, rng)
            lines = _ballots(names, votes, rng)
            if sum(len(x.split()) for x in lines) <= 400:
                return {"prompt": "\n".join(lines) + "\n\nWhich proposal has the most votes?", "answer": names[0], "neg_answer": "|||".join(names[1:]), "total": total}
            total = total * 3 // 4

    return _vote_tasks(spark, sf_dir, make)


@query("top_vote_tables")
def top_vote_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ballots whose first two or three options are well ahead of the others."""

    def make(rng: np.random.Generator, _: int) -> dict:
        names, total, top = [f"Option {c}" for c in rng.permutation(list("PQRSTUVW"))], int(rng.integers(60, 120)), int(rng.integers(2, 4))
        votes = ranked_votes(total, len(names), top, 0.8, 1.3, rng)
        return {"prompt": "\n".join(_ballots(names, votes, rng)) + f"\n\nThe {top} options with the most votes?", "answer": "|||".join(names[:top]), "neg_answer": "|||".join(names[top:]), "total": total}

    return _vote_tasks(spark, sf_dir, make)


@query("threshold_tasks")
def threshold_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of numbers in steps: which entry passes both thresholds with the highest score. Tables where none or nearly all pass are left out."""
    i = F.col("doc_id")
    rows = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda j: F.struct(F.concat(F.lit("Entry "), F.substring(F.lit("ABCDEFGHIJKL"), j, F.lit(1))).alias("name"), (numbered_hash(i, "cost", j) % 20 * 5).alias("cost"), (numbered_hash(i, "score", j) % 997).alias("score")))
    d = table(spark, sf_dir, "documents").select("doc_id", rows.alias("rows"), (number("cap", i) % 10 * 5 + 25).alias("cap"), (number("floor", i) % 400).alias("least"))
    d = d.withColumn("passing", F.filter("rows", lambda r: (r["cost"] <= F.col("cap")) & (r["score"] >= F.col("least")))).where(F.size("passing").between(2, 9))
    best = F.array_max(F.transform("passing", lambda r: F.struct(r["score"], r["name"])))
    lines = F.array_join(F.transform("rows", lambda r: F.concat(r["name"], F.lit(": cost "), r["cost"].cast("string"), F.lit(", score "), r["score"].cast("string"))), "\n")
    tie = F.size(F.filter("passing", lambda r: r["score"] == best["score"]))
    return d.where(tie == 1).select("doc_id", F.format_string("%s\n\nHighest score with cost up to %d and score of at least %d?", lines, "cap", "least").alias("prompt"), best["name"].alias("answer"))


# --- tasks over documents ---


def found(spark: SparkSession, sf_dir: str, pairs: DataFrame, name: str, least: int = 160) -> DataFrame:
    """(item_id, name): the documents of ``pairs`` (item_id, doc_id, place) in that order, by id, title and beginning."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "source", "lang").alias("title"), F.left("text", F.lit(least)).alias("text"))
    both = pairs.join(d, "doc_id").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "title", "text"))).alias("ds"))
    return both.select("item_id", F.transform("ds", lambda x: F.struct(x["doc_id"].alias("id"), x["title"].alias("title"), x["text"].alias("text"))).alias(name))


def gold_pairs(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(item_id, doc_id, place): the ``k`` documents that stand for an item's own."""
    return random_candidates(spark, sf_dir).where(f"rank <= {k} AND doc_id % 7 = 0").select("item_id", "doc_id", F.col("rank").alias("place"))


def grounded(spark: SparkSession, sf_dir: str, gold: DataFrame, others: DataFrame) -> DataFrame:
    """(item_id, question, gold, others); items without gold documents are left out, those without others keep an empty list."""
    asked = items(spark, sf_dir).select("item_id", F.concat(F.lit("Which documents go with: "), F.left("text", F.lit(60))).alias("question"), "answers")
    own = found(spark, sf_dir, gold, "gold")
    rest = found(spark, sf_dir, others, "others")
    empty = F.array().cast("array<struct<id: bigint, title: string, text: string>>")
    return asked.join(own, "item_id").join(rest, "item_id", "left").withColumn("others", F.coalesce("others", empty))


@query("ranking_tasks")
def ranking_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query and a pool of graded and other passages: the answer ranks them by grade, of equal ones by their place in the prompt."""
    gold, others = gold_pairs(spark, sf_dir, 40), ranked_negatives(spark, sf_dir).select("item_id", "doc_id", "place")
    p = prompt_of(grounded(spark, sf_dir, gold, others), "item_id", "numbered")
    grades = F.transform("gold_numbers", lambda n, j: F.struct((-(numbered_hash(F.col("item_id"), "grade", j) % 3 + 1)).alias("g"), n.alias("n")))
    p = p.withColumn("grades", grades)
    return p.select("item_id", "prompt", F.array_join(F.transform(F.array_sort("grades"), lambda s: s["n"].cast("string")), " > ").alias("answer"), F.map_from_arrays(F.transform("grades", lambda s: s["n"].cast("string")), F.transform("grades", lambda s: (-s["g"]).cast("int"))).alias("relevance_grades"), "n_docs")


@query("citation_tasks")
def citation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with several answers, each in documents that are cited by their numbers: gold documents first, others as far as they fit."""
    gold, others = gold_pairs(spark, sf_dir, 60), ranked_negatives(spark, sf_dir).select("item_id", "doc_id", "place")
    p = prompt_of(grounded(spark, sf_dir, gold, others), "item_id")
    settings = F.to_json(F.struct(F.col("gold_numbers").alias("gold_doc_ids"), F.transform("answers", lambda a: F.array(a)).alias("answer_variants")))
    return p.select("item_id", "prompt", F.to_json("answers").alias("answer"), settings.alias("settings"), "n_docs")


@query("window_tasks")
def window_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop: an item's own document gives the window that its span lies in, others come ranked; aliases of the answer are merged, new ones last."""
    pairs = gold_pairs(spark, sf_dir, 20).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    used = table(spark, sf_dir, "documents").select("doc_id", "text").join(pairs.select("doc_id"), "doc_id", "left_semi")
    w = expanded(articles(used)).select("doc_id", "win", "start_char", "end_char", "text")
    span = number("span", F.col("item_id")) % 400
    hit = pairs.join(w, "doc_id").withColumn("over", F.least("end_char", span + 60) - F.greatest("start_char", span))
    chosen = hit.groupBy("item_id").agg(F.max_by(F.struct(F.col("doc_id").alias("id"), F.concat(F.lit("window "), F.col("win").cast("string")).alias("title"), "text"), F.struct("over", -F.col("win"))).alias("g"))
    others = found(spark, sf_dir, ranked_negatives(spark, sf_dir).select("item_id", "doc_id", "place"), "others")
    asked = items(spark, sf_dir).select("item_id", F.left("text", F.lit(60)).alias("question"), F.array_distinct(F.concat("answers", F.array(F.lower(F.element_at(F.split("text", " "), 1))))).alias("aliases"))
    rows = asked.join(chosen.select("item_id", F.array("g").alias("gold")), "item_id").join(others, "item_id")
    p = prompt_of(rows, "item_id", "named")
    return p.select("item_id", "prompt", F.array_join("aliases", "|||").alias("answer"), "gold_numbers", "n_docs")


@query("multi_hop_tasks")
def multi_hop_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several hops: two or more own documents, found by the titles that the question's facts name, and others from all sources."""
    own = gold_pairs(spark, sf_dir, 40)
    hops = own.union(own.withColumn("item_id", F.col("item_id") - 1)).groupBy("item_id", "doc_id").agg(F.min("place").alias("place"))  # an item's second hop is its successor's document
    gold = hops.withColumn("n", F.count("*").over(Window.partitionBy("item_id"))).where("n >= 2")
    titles = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "source", "lang").alias("title"))
    facts = gold.join(titles, "doc_id").groupBy("item_id").agg(F.array_sort(F.collect_set("title")).alias("facts"))
    others = mixed_negatives(spark, sf_dir).select("item_id", "doc_id", "place")
    rows = grounded(spark, sf_dir, gold.select("item_id", "doc_id", "place"), others).join(facts, "item_id")
    # of the own documents those whose title is a fact; all are, by construction, as in a plan whose facts are complete
    rows = rows.withColumn("gold", F.filter("gold", lambda d: F.array_contains(F.col("facts"), d["title"])))
    p = prompt_of(rows, "item_id")
    return p.select("item_id", "prompt", F.array_join("facts", "|||").alias("answer"), "gold_numbers", "n_docs")
