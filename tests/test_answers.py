"""Literal cases of answer extraction, formats and equality."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import answers as A
from weftline.functions import maths
from weftline.operators import scoring


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [
    (r"so \boxed{4}", "4"), (r"\boxed  {\frac{1}{2}} and \boxed{3}", r"\frac{1}{2}"), (r"\boxed{a{b}c}d}", "a{b}c"), (r"\boxed{a", None), (r"\boxed 4", None), ("none", None), (r"\boxed{}", ""),
])
def test_boxed(spark, text, want):
    assert one(spark, A.boxed(F.lit(text))) == want


def test_answer_extraction(spark):
    assert one(spark, A.answer_of(F.lit("Answer: a Answer:  b c"))) == "b c"
    assert one(spark, A.answer_of(F.lit("Answer: a\nb"))) == "a\nb"
    assert one(spark, A.answer_of(F.lit("no"))) is None
    assert one(spark, A.tagged_answer(F.lit("<answer>x</answer> <answer> y\n</answer>"))) == "y"
    assert one(spark, A.right_format(F.lit("thoughts</think> Answer: x"))) is True
    assert one(spark, A.right_format(F.lit("<think>thoughts</think> Answer: x"))) is False
    assert one(spark, A.right_format(F.lit("thoughts</think> Answer: x Answer: y"))) is False


@pytest.mark.parametrize(("text", "want"), [
    ("<think>This is my reasoning.</think>This is my answer.", 1.0), ("<think>\nThis is\nmy reasoning.\n</think>\nThis is my answer.", 1.0), ("<think></think>", 1.0),
    ("This is my reasoning.</think>This is my answer.", 0.0), ("<think>This is my reasoning. This is my answer.", 0.0), ("This is <think>my reasoning</think>", 0.0), ("<think>a<think>b</think>c", 0.0), ("", 0.0),
])
def test_think_format(spark, text, want):
    assert one(spark, A.think_format(F.lit(text))) == want


def test_aggressive(spark):
    assert one(spark, A.aggressive(F.lit("The [3] Café & Crème/brûlée, a_b"))) == "cafe and creme brulee b"
    assert one(spark, A.aggressive(F.lit(None).cast("string"))) == ""


def test_gold_texts(spark):
    spans, golds = F.array(F.lit("abcdef"), F.lit("xyz label")), F.array(F.lit("abcd"), F.lit("label"), F.lit("nothing"))
    got = one(spark, A.gold_scores(spans, golds, 1.0))
    assert got == [pytest.approx(8 / 10), pytest.approx(10 / 14), 0.0]
    got = one(spark, A.labelled_gold_scores(spans, golds, F.array(F.lit("zz"), F.lit("xyz"), F.lit("q")), 1.0))
    assert got == [pytest.approx(4 / 10), pytest.approx(10 / 14), 0.0]
    none = F.array().cast("array<string>")
    assert one(spark, A.gold_summary(F.array().cast("array<double>"), spans, none, "standard")) == 1.0
    assert one(spark, A.gold_summary(F.array(F.lit(0.5)), none, golds, "top_k_gold")) == 0.0
    with pytest.raises(ValueError):
        A.gold_summary(none, none, none, "other")


def test_citations(spark):
    gold = F.array(*map(F.lit, (1, 2, 3)))
    # cited 1 (in a span) and 7 (not): recall 1/3, precision 1/1.5
    got = one(spark, A.citation_f1(F.lit("x [1] y [7] [1]"), F.array(F.lit("doc [1]")), gold))
    assert got == pytest.approx(2 * (1 / 3) * (1 / 1.5) / (1 / 3 + 1 / 1.5))
    assert one(spark, A.citation_f1(F.lit("none"), F.array(F.lit("[1]")), gold)) == 0.0
    assert one(spark, A.citation_format(F.lit(" [1] [2] "))) == 0.0
    assert one(spark, A.citation_format(F.lit("x [1]"))) == 1.0


def test_unknown_origins_are_errors(spark):
    columns = {k: F.lit("a") for k in ("gold", "second", "wrong")} | {"grades": F.create_map(F.lit("1"), F.lit(1))}
    with pytest.raises(Exception, match="no rule for source"):
        one(spark, A.source_score(F.lit("other"), F.lit("a"), columns))
    with pytest.raises(Exception, match="no scorer for"):
        one(spark, scoring.routed_score(F.lit("other"), F.lit("a"), F.lit("b")))


@pytest.mark.parametrize(("a", "want"), [
    ("k = $5$ units", "5"), ("1,000", "1000"), (r"\frac12", r"\frac{1}{2}"), (r"\sqrt3", r"\sqrt{3}"), (r"\text{yes}", "yes"), ("an answer of $x$", "x"), (r"90^\circ", "90"), ("12 inches", "12"),
])
def test_final_form(a, want):
    assert maths.final_form(a) == want


@pytest.mark.parametrize(("a", "b", "want"), [
    (r"\frac12", r"\frac{1}{2}", True), ("0.5", "1/2", True), (r"\dfrac{3}{4}", r"\frac34", True), (".5", "0.5", True), (r"5\text{ cm}", "5", True), ("x=3", "3", True), (r"\sqrt3", r"\sqrt{3}", True), ("4", "5", False), (None, None, True), ("1", None, False),
])
def test_plain_form(a, b, want):
    assert maths.same_text(a, b) is want


@pytest.mark.parametrize(("a", "b", "want"), [
    ("0.50", r"\frac{1}{2}", True), ("50%", "50", True), ("0.5", "50", True), ("$3", "3", True), ("(1, 2)", "(1,2)", True), ("(1,2)", "(2,1)", False), ("[1,2]", "(1,2)", False), ("1,2", "(1,2)", True),
    (r"2\pi", "6.2832", True), (r"x^2+2x+1", "(x+1)^2", True), ("x+1", "x+2", False), (r"\sqrt{8}", r"2\sqrt{2}", True), (r"\begin{pmatrix}1&2\\3&4\end{pmatrix}", r"\begin{pmatrix}1.0&2\\3&4\end{pmatrix}", True),
    ("1000", "1,000", True), ("101_2", "101", True), ("abc", "", False), ("9^9^9^9", "3", False), ("__import__('os')", "1", False),
])
def test_same_answer(a, b, want):
    assert maths.same_answer(a, b) is want


def test_signed_scores():
    assert maths.signed_score("thus Answer: $\\frac{1}{2}$", "\\frac12") == 1.0
    assert maths.signed_score("Answer: 1\nAnswer: 2", "1") == -1.0
    assert maths.signed_score("x \\boxed{7}", "7", strict=True) == 1.0
    assert maths.signed_score("x \\boxed{7", "7", strict=True) == -1.0
