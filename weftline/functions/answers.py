"""Answer extraction, formats and scores, as Column to Column builders; only accents need Python (see aggressive)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as T


def answer_of(s: Column) -> Column:
    """What follows the last "Answer:" that anything follows, to the end; null without one."""
    found = F.regexp_extract(s, r"(?s).*Answer:\s*(\S.*)\s*$", 1)
    return F.when(found != "", found)


def after_thinking(s: Column) -> Column:
    return F.element_at(F.split(s, "</think>"), -1)


def boxed(s: Column) -> Column:
    r"""The contents of the first \boxed{...} with the braces in it balanced; null if there is none or it doesn't close."""
    rest = F.regexp_extract(s, r"(?s)^.*?\\boxed(.*)$", 1)
    here = F.regexp_like(rest, F.lit(r"^\s*\{"))
    first = F.regexp_replace(rest, r"^\s*\{", "")
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        end = F.when((a["end"] < 0) & (depth == 0), a["at"]).otherwise(a["end"])
        return F.struct(depth.alias("depth"), (a["at"] + 1).alias("at"), end.alias("end"))

    end = F.aggregate(F.split(first, ""), start, step, lambda a: a["end"])
    return F.when(here & (end >= 0), F.substring(first, F.lit(1), end))


def right_format(s: Column) -> Column:
    """Whether there is one </think>, no <think>, and after it one "Answer:" that something follows."""
    rest = after_thinking(s)
    return (F.regexp_count(s, F.lit("</think>")) == 1) & (F.regexp_count(s, F.lit("<think>")) == 0) & (F.regexp_count(rest, F.lit("Answer:")) == 1) & answer_of(rest).isNotNull()


def think_format(s: Column) -> Column:
    """1 for a text that begins with its only <think>, which is closed."""
    return F.regexp_like(s, F.lit(r"(?s)\A<think>(?!.*<think>).*?</think>")).cast("double")


def _unaccented(texts: pd.Series) -> pd.Series:
    """Compatibility forms without combining marks, in one case."""
    import unicodedata

    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)).casefold())


def aggressive(s: Column) -> Column:
    """Without [n], accents, case, ASCII punctuation and articles; "&" is "and", white space collapsed. Null is empty."""
    bare = F.replace(F.pandas_udf(_unaccented, "string")(F.regexp_replace(F.coalesce(s, F.lit("")), r"\[\d+\]", " ")), F.lit("&"), F.lit(" and "))
    bare = F.translate(bare, T.PUNCTUATION, " " * len(T.PUNCTUATION))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def variant_found(variant: Column, answer: Column) -> Column:
    """Whether a normalised answer contains a normalised variant; one word of four letters or fewer must be a word of it."""
    short = (F.length(variant) <= 4) & ~F.contains(variant, F.lit(" "))
    return (variant != "") & F.when(short, F.array_contains(F.split(answer, " "), variant)).otherwise(F.contains(answer, variant))


def capped_coverage(covered: Column, available: Column, cap: int = 5) -> Column:
    return F.when(available == 0, F.lit(0.0)).otherwise(F.least(covered, F.lit(cap)) / F.least(available, F.lit(cap)))


def f1_of(overlap: Column, a: Column, b: Column) -> Column:
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(2.0 * overlap / (F.length(a) + F.length(b)))


def overlap_f1(a: Column, b: Column) -> Column:
    """2 * overlap / (|a| + |b|) of containment or the longest edge overlap; 0 where either is empty."""
    return f1_of(T.edge_overlap(a, b), a, b)


def overlap_coverage(copied: Column, source: Column) -> Column:
    return F.when((F.length(copied) == 0) | (F.length(source) == 0), F.lit(0.0)).otherwise(T.edge_overlap(copied, source) / F.length(source))


def overlap_scores(spans: Column, golds: Column) -> Column:
    """overlap_f1() of each gold text with each span."""
    each = F.zip_with(golds, T.edge_overlaps(golds, spans), lambda g, row: F.struct(g.alias("g"), row.alias("row")))
    return F.transform(each, lambda x: F.zip_with(spans, x["row"], lambda s, o: f1_of(o, x["g"], s)))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def gold_scores(spans: Column, golds: Column, hit: float) -> Column:
    """Of each gold text the overlap of its best span, as a share of ``hit``, 1 at most."""
    return F.transform(overlap_scores(spans, golds), lambda row: F.least(F.lit(1.0), F.coalesce(F.array_max(row), F.lit(0.0)) / hit))


def labelled_gold_scores(spans: Column, golds: Column, labels: Column, hit: float, penalty: float = 0.5) -> Column:
    """As gold_scores, times ``penalty`` where the best span, the first of equal ones, doesn't hold the gold text's label."""

    def one(row: Column, label: Column) -> Column:
        best = F.array_max(F.transform(F.arrays_zip(row.alias("f"), spans.alias("s")), lambda x, i: F.struct(x["f"].alias("f"), (-i).alias("i"), x["s"].alias("s"))))
        return F.least(F.lit(1.0), best["f"] / hit) * F.when((best["f"] > 0) & ~F.contains(best["s"], label), F.lit(penalty)).otherwise(F.lit(1.0))

    return F.zip_with(overlap_scores(spans, golds), labels, one)


def gold_summary(scores: Column, spans: Column, golds: Column, mode: str, k: int = 3) -> Column:
    """``mode``: always_1; used_recall, whether there is a span; standard, the mean; top_k_gold, the mean of the k best. Without gold texts 1, without spans 0."""
    if mode == "always_1":
        return F.lit(1.0)
    if mode == "used_recall":
        return (F.size(spans) > 0).cast("double")
    if mode not in ("standard", "top_k_gold"):
        raise ValueError(f"unknown mode {mode}")
    used = scores if mode == "standard" else F.slice(F.reverse(F.array_sort(scores)), 1, k)
    return F.when(F.size(golds) == 0, F.lit(1.0)).when(F.size(spans) == 0, F.lit(0.0)).otherwise(mean(used))


def cited(s: Column) -> Column:
    """The distinct numbers in square brackets."""
    return F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def citation_f1(answer: Column, spans: Column | None, gold: Column, cap: int = 5) -> Column:
    """F1 of cited against gold numbers, recall over ``cap`` at most. With ``spans``, citations that no span holds count half."""
    c, g = cited(answer), F.array_distinct(gold)
    if spans is None:
        right, all_ = F.size(F.array_intersect(c, g)).cast("double"), F.size(c).cast("double")
    else:
        seen = cited(F.array_join(spans, " "))
        half = lambda x: F.size(F.array_intersect(x, seen)) + 0.5 * F.size(F.array_except(x, seen))
        right, all_ = half(F.array_intersect(c, g)), half(c)
    most = F.least(F.lit(cap), F.size(g))
    recall, precision = F.least(right, most) / most, right / all_
    return F.when((F.size(c) == 0) | (F.size(g) == 0) | (right == 0), F.lit(0.0)).otherwise(2 * recall * precision / (recall + precision))


def citation_format(answer: Column) -> Column:
    """1 for text with a citation, 0 without one or for citations alone."""
    bare = F.trim(F.regexp_replace(answer, r"\[\d+\]", ""))
    return ((bare != "") & F.regexp_like(answer, F.lit(r"\[\d+\]"))).cast("double")


def ranking(s: Column) -> Column:
    """The ids of "a > b > c" in order, the first of equal ones; brackets, colons and the words id, doc and passage don't count."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(s, r"[\[\]:]", "")), "id", ""), "doc", ""), "passage", "")
    return F.array_distinct(F.filter(F.transform(F.split(bare, ">"), lambda x: F.trim(x)), lambda x: x != ""))


def ranking_format(s: Column, grades: Column) -> Column:
    """The root of the share of a map's ids that a ranking has; 1 for an empty map."""
    have = F.size(F.array_intersect(ranking(s), F.map_keys(grades)))
    return F.when(F.size(grades) == 0, F.lit(1.0)).otherwise(F.sqrt(have / F.size(grades)))


def ranking_ndcg(s: Column, grades: Column, k: int = 10) -> Column:
    """NDCG at ``k`` of a ranking under a map of grades; ids that it doesn't have count 0."""
    gain = lambda g: F.aggregate(F.transform(F.slice(g, 1, k), lambda x, i: x / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)
    got = gain(F.transform(ranking(s), lambda x: F.coalesce(F.try_element_at(grades, x), F.lit(0))))
    ideal = gain(F.reverse(F.array_sort(F.map_values(grades))))
    return F.when((F.size(grades) == 0) | (ideal == 0), F.lit(0.0)).otherwise(got / ideal)


def span_quality(s: Column, start: str, end: str, least: int) -> Column:
    """1 - errors / sqrt(spans), 0 at least: errors are unbalanced marks and spans of fewer than ``least`` characters. Without spans 1."""
    spans = T.between(s, start, end)
    wrong = F.abs(F.regexp_count(s, F.lit(start)) - F.regexp_count(s, F.lit(end))) + F.size(F.filter(spans, lambda x: F.length(x) < least))
    return F.when(F.size(spans) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - wrong / F.sqrt(F.size(spans).cast("double"))))


def word_in(word: Column, s: Column) -> Column:
    """Whether ``word`` is in ``s`` with no letter, digit or underscore next to it."""
    return F.regexp_like(s, F.concat(F.lit(r"(?U)(?<!\w)\Q"), word, F.lit(r"\E(?!\w)")))


def any_alias(answer: Column, aliases: Column) -> Column:
    """1 where one of the aliases that "|||" parts contains the answer or is contained in it, both normalised."""
    a = T.normalize_answer(answer)
    return F.exists(F.split(aliases, r"\|\|\|"), lambda x: F.contains(a, T.normalize_answer(x)) | F.contains(T.normalize_answer(x), a)).cast("double")


def chosen_option(answer: Column, gold: Column) -> Column:
    """1 where the answer is the gold option or its identifier (the last word), holds it as whole words, or begins or ends with the identifier."""
    g = F.trim(F.regexp_replace(F.lower(gold), r"\s+", " "))
    a = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(answer)), r"[.,;:!?]+$", ""), r"\s+", " "))
    key, words = F.element_at(F.split(g, " "), -1), F.split(a, " ")
    return ((a == g) | (a == key) | word_in(g, a) | (F.element_at(words, 1) == key) | (F.element_at(words, -1) == key)).cast("double")


def option_set(answer: Column, right: Column, wrong: Column) -> Column:
    """(right options named - wrong ones named) / right options, 0 at least. An option is named in any case, or by its last word as it is written."""
    a = F.trim(answer)
    named = lambda o: word_in(F.lower(F.trim(o)), F.lower(a)) | word_in(F.element_at(F.split(F.trim(o), " "), -1), a)
    count = lambda s: F.size(F.filter(F.filter(F.split(s, r"\|\|\|"), lambda o: o != ""), named))
    return F.greatest(F.lit(0.0), (count(right) - count(wrong)) / F.size(F.split(right, r"\|\|\|")))


def needles(answer: Column, right: Column, wrong: Column) -> Column:
    """(right words held - wrong words held) / right words, 0 at least."""
    held = lambda s: F.size(F.filter(T.tokens(s), lambda x: F.contains(answer, x)))
    return F.greatest(F.lit(0.0), (held(right) - held(wrong)) / F.size(T.tokens(right)))


def held(answer: Column, gold: Column) -> Column:
    return F.contains(answer, gold).cast("double")


#: The rule of each source of answers. Functions of the answer and the columns gold, second and wrong, and grades.
RULES = {
    **dict.fromkeys(["hotpotqa", "musique", "2wikimultihopqa", "nq", "triviaqa"], lambda a, c: any_alias(a, c["gold"])),
    **dict.fromkeys(["math_retrieval", "retrieval_math"], lambda a, c: F.when(F.contains(a, c["gold"]), 1.0).when(F.contains(a, c["second"]), 0.25).otherwise(0.0)),
    "retrieval": lambda a, c: held(a, c["gold"]),
    "multi_niah": lambda a, c: needles(a, c["gold"], c["wrong"]),
    "mcqa_math": lambda a, c: F.coalesce((F.contains(boxed(a), c["gold"]) | F.contains(boxed(a), c["second"])).cast("double"), F.lit(0.0)),
    "dapo_math": lambda a, c: F.coalesce(held(boxed(a), c["gold"]), F.lit(0.0)),
    **dict.fromkeys(["banking77", "massive"], lambda a, c: (T.normalize_answer(a) == T.normalize_answer(c["gold"])).cast("double")),
    "quality": lambda a, c: (F.regexp_extract(a, "([A-D])", 1) == c["gold"]).cast("double"),
    **dict.fromkeys(["majority_vote", "threshold_filter"], lambda a, c: chosen_option(a, c["gold"])),
    "top_n_vote": lambda a, c: option_set(a, c["gold"], c["wrong"]),
    "msmarco_v2": lambda a, c: ranking_ndcg(a, c["grades"]),
    "qampari": lambda a, c: F.lit(0.0),
}


def source_score(origin: Column, answer: Column, columns: dict[str, Column]) -> Column:
    """The score of an answer by the rule of its source; an unknown source is an error, no answer is 0."""
    chain = reduce(lambda c, rule: c.when(origin == rule[0], rule[1](answer, columns)), RULES.items(), F.when(F.lit(False), F.lit(0.0)))
    return F.when(answer.isNull(), F.lit(0.0)).otherwise(chain.otherwise(F.raise_error(F.concat(F.lit("no rule for source "), origin)).cast("double")))


def tagged_answer(s: Column) -> Column:
    """The last text between <answer> marks, trimmed; null without one."""
    found = T.between(s, "<answer>", "</answer>")
    return F.when(F.size(found) > 0, F.trim(F.try_element_at(found, F.lit(-1)), F.lit(" \n\t")))


def tagged_exact_match(s: Column, golds: Column, most: int = 10) -> Column:
    """1 where the tagged answer equals a gold one, both normalised; a quarter of it where more than ``most`` tags open or close."""
    a = T.normalize_answer(tagged_answer(s))
    right = F.exists(golds, lambda g: T.normalize_answer(g) == a)
    many = (F.regexp_count(s, F.lit("<answer>")) > most) | (F.regexp_count(s, F.lit("</answer>")) > most)
    return F.when(right, F.when(many, F.lit(0.25)).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))


def boxed_format(s: Column) -> Column:
    r"""1 for a text of <think>...</think> and then a \boxed{...}."""
    return F.regexp_like(s, F.lit(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z")).cast("double")
