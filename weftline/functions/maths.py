"""Answers in LaTeX: one form for each, and whether two are equal as text, as numbers, or as expressions.

Single answers are short and few forms are regular, so these are plain Python,
run over batches of texts.
"""

from __future__ import annotations

import ast
import math
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units and other words that say nothing in a final answer.
UNITS = """
square ways integers dollars mph inches hours km units sue points feet minutes digits cents degrees cm gm pounds meters meals edges students childrentickets multiples
""".split()
#: What becomes of commands, by the form that is wanted: DROP says nothing, OPEN stands for its argument alone, PARTS prints so many arguments in braces.
LAYOUT = {"!", " ", "$", "left", "right"}
FINAL = {"drop": LAYOUT | {";", "ldots", "dots"}, "open": {"text", "mbox", "textbf", "overline", "boxed"}, "parts": {"frac": 2, "sqrt": 1}}
PLAIN = {"drop": LAYOUT | {"%", "\\"}, "open": set(), "parts": {"frac": 2, "dfrac": 2, "tfrac": 2, "sqrt": 1}}
#: Commands that mean another.
SAME = {"dfrac": "frac", "tfrac": "frac"}
TOKEN = re.compile(r"\\[A-Za-z]+|\\.|\\|[A-Za-z]+|[^\\A-Za-z]", re.DOTALL)


def replaced(s: str, pairs) -> str:
    for old, new in pairs:
        s = s.replace(old, new)
    return s


def tree(s: str) -> list:
    """A LaTeX text as commands, words, characters, and lists for what braces hold. Braces that don't match are characters."""
    stack: list[list] = [[]]
    for t in TOKEN.findall(s):
        if t == "{":
            stack.append([])
        elif t == "}" and len(stack) > 1:
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            stack[-1].append(t)
    while len(stack) > 1:
        inner = stack.pop()
        stack[-1] += ["{", *inner]
    return stack[0]


def argument(nodes: list, at: int) -> tuple[list | None, int, list]:
    """The argument that begins at a place, where it ends, and what is left of its token: braces, a command, or one character."""
    while at < len(nodes) and nodes[at] == " ":
        at += 1
    if at >= len(nodes):
        return None, at, []
    x = nodes[at]
    if isinstance(x, list):
        return x, at + 1, []
    if x[0] == "\\":
        return [x], at + 1, []
    return [x[0]], at + 1, [x[1:]] if x[1:] else []


def degrees(nodes: list, at: int) -> bool:
    """Whether a raised circle begins at a place."""
    return nodes[at] == "^" and at + 1 < len(nodes) and nodes[at + 1] in ("\\circ", ["\\circ"])


def printed(nodes: list, form: dict, units: bool) -> str:
    """A tree in one spelling: without spaces, layout and degrees, fractions and roots with braces; ``units``: without words of UNITS and what they are raised to."""
    out: list[str] = []
    silent = re.compile("(?:%s)+" % "|".join(UNITS))
    nodes, at = list(nodes), 0
    while at < len(nodes):
        x, at = nodes[at], at + 1
        if isinstance(x, list):
            inner = printed(x, form, units)
            out.append("" if units and inner == "," else "{%s}" % inner)
        elif degrees(nodes, at - 1):
            at += 1
        elif x[0] == "\\" and len(x) > 1:
            name = x[1:]
            n = form["parts"].get(name, 0)
            if name in form["drop"]:
                continue
            if name in form["open"] and at < len(nodes) and isinstance(nodes[at], list):
                inner, at = printed(nodes[at], form, units), at + 1
                if inner in ("", "s", ".", "m") and name in ("text", "mbox"):
                    at += 2 * (nodes[at : at + 2] in (["^", "2"], ["^", "3"]))
                elif inner == "and":
                    out.append("" if out and out[-1] == "," else ",")
                else:
                    out.append(inner)
                continue
            found, end, rest = [], at, []
            for _ in range(n):
                one, end, rest = argument(nodes, end)
                nodes[end:end] = rest
                found.append(one)
            if n and None not in found:
                out.append("\\" + SAME.get(name, name) + "".join("{%s}" % printed(y, form, units) for y in found))
                at = end
            else:
                out.append("\\" + SAME.get(name, name))
        elif x.isspace() or (units and x == '"'):
            continue
        elif not (units and silent.fullmatch(x)):
            out.append(x)
    return "".join(out)


def final_form(answer: str) -> str:
    """What stands after the last "=", without articles, units and layout; of text in dollars that alone; \\frac and \\sqrt with braces; numbers without commas."""
    said = answer.rpartition("=")[2].replace("\\$", "")
    if said.count("$") > 1:
        said = said.split("$")[1]
    form = printed(tree(re.sub(r"(?<![\\A-Za-z])an?\s+", "", said.replace("$", ""))), FINAL, True)
    whole = form.replace(",", "")
    return whole if whole.isdigit() else form


def last_boxed(s: str) -> str | None:
    """The contents of the last \\boxed{...}, braces balanced."""
    at = s.rfind("\\boxed{")
    depth = 0
    for i in range(at + 6, len(s)) if at >= 0 else ():
        depth += {"{": 1, "}": -1}.get(s[i], 0)
        if not depth:
            return s[at + 7 : i]
    return None


def last_answer(s: str) -> str | None:
    """The line after the last "Answer:" that has one, in any case."""
    lines = [x.split("\n")[0] for x in re.split(r"(?i)answer\s*:\s*", s)[1:]]
    return next((x for x in reversed(lines) if x), None)


def signed_score(solution: str, truth: str, strict: bool = False) -> float:
    """1 or -1. Of the last 300 characters the last line after "Answer:" in its final form; ``strict``: the last box of the last 100, as it is."""
    tail = (solution or "")[-300:]
    if strict:
        return 1.0 if last_boxed(tail[-100:]) == truth else -1.0
    said = last_answer(tail)
    return 1.0 if said is not None and final_form(said) == final_form(truth) else -1.0


def plain_form(s: str) -> str:
    """One spelling of a LaTeX answer: units after \\text and names before "=" go, fractions and roots get braces, a/b and 0.5 are fractions."""
    nodes = tree(s.replace("\\\\", "\\"))
    units = [i for i, x in enumerate(nodes) if x == "\\text" and i + 1 < len(nodes) and isinstance(nodes[i + 1], list) and nodes[i + 1][:1] == [" "]]
    if len(units) > 1:
        raise ValueError("more than one unit")
    form = printed(nodes[: units[0]] if units else nodes, PLAIN, False)
    name, sign, rest = form.partition("=")
    form = rest if sign and "=" not in rest and len(name) <= 2 else form
    form = re.sub(r"(^|\{)\.", r"\g<1>0.", form)
    if form == "0.5":
        form = "1/2"
    ratio = re.fullmatch(r"(0|-?[1-9]\d*)/(0|-?[1-9]\d*)", form)
    return "\\frac{%s}{%s}" % ratio.groups() if ratio else form


def same_text(a: str | None, b: str | None) -> bool:
    """Whether two answers have one plain form; two missing ones are the same."""
    if a is None or b is None:
        return a is b
    try:
        return plain_form(a) == plain_form(b)
    except ValueError:
        return a == b


def number(s: str) -> float | None:
    try:
        return float(s.replace("{,}", "").replace(",", ""))
    except ValueError:
        return None


OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}


def arithmetic(s: str) -> str:
    """A LaTeX expression in operators; unknown commands stay and won't parse."""
    s = replaced(s, [("\\left", ""), ("\\right", ""), ("\\cdot", "*"), ("\\times", "*"), ("\\div", "/"), ("\\pi", "(pi)"), ("\\,", ""), ("\\ ", ""), ("$", ""), ("dfrac", "frac"), ("tfrac", "frac"), ("\\%", "")])
    group = r"\{([^{}]*)\}"
    for _ in range(20):  # innermost braces first
        new = re.sub(r"\\frac\s*" + group + r"\s*" + group, r"((\1)/(\2))", s)
        new = re.sub(r"\\sqrt\[(\w+)\]" + group, r"((\2)**(1/(\1)))", new)
        new = re.sub(r"\\sqrt\s*" + group, r"((\1)**(1/2))", new)
        new = re.sub(r"\^\s*" + group, r"**(\1)", new)
        if new == s:
            break
        s = new
    s = re.sub(r"\\frac(\w)(\w)", r"((\1)/(\2))", s)
    s = replaced(s, [("^", "**"), ("{", "("), ("}", ")")])
    s = re.sub(r"(?<![A-Za-z])(?!pi\b)([A-Za-z])(?=[A-Za-z])", r"\1*", s.replace("(pi)", "(_)")).replace("(_)", "(pi)")
    return re.sub(r"(?<=[\w)])(?=\()|(?<=\))(?=\w)|(?<=\d)(?=[A-Za-z])", "*", s.replace(" ", ""))


def value(s: str, at: float) -> float:
    """An expression's value with its letters set to numbers that depend on them and ``at``."""

    def of(n):
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return float(n.value)
        if isinstance(n, ast.Name):
            return math.pi if n.id == "pi" else at + sum(map(ord, n.id)) % 17 / 7
        if isinstance(n, ast.BinOp) and type(n.op) in OPERATORS:
            x, y = of(n.left), of(n.right)
            if isinstance(n.op, ast.Pow) and abs(y) > 64:
                raise ValueError("power too large")
            out = OPERATORS[type(n.op)](x, y)
            if isinstance(out, complex):
                raise ValueError("not a real number")
            return out
        if isinstance(n, ast.UnaryOp) and type(n.op) in OPERATORS:
            return OPERATORS[type(n.op)](of(n.operand))
        raise ValueError("not arithmetic")

    return of(ast.parse(arithmetic(s), mode="eval").body)


def same_value(a: str, b: str, tolerance: float) -> bool:
    """Whether two expressions have the same value at several points."""
    try:
        return all(math.isclose(value(a, x), value(b, x), rel_tol=tolerance, abs_tol=1e-9) for x in (0.37, 1.91, 3.13))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return False


def parts_of(s: str) -> list[str]:
    """The parts that commas outside any bracket divide."""
    out, depth = [""], 0
    for c in s:
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def same_answer(a: str, b: str, percent: bool = True, tolerance: float = 1e-4) -> bool:
    """Whether an answer equals the reference ``b``.

    As text without case or spaces; as numbers within ``tolerance``, with
    ``percent`` also off by 100; part by part for tuples, intervals (whose
    brackets count only if both have them) and matrices; as expressions. A
    dollar in front, a percent sign behind and a base in an index don't count.
    """
    a, b = (re.sub(r"_\{?\d+\}?$", "", re.sub(r"\\?%$", "", re.sub(r"^\$(?=\d)", "", x.strip()))) for x in (a[:1000], b))
    if a.lower() == b.lower() or a.replace(" ", "") == b.replace(" ", ""):
        return True
    x, y = number(a), number(b)
    if x is not None and y is not None:
        return any(math.isclose(x, r, rel_tol=tolerance) for r in ([y / 100, y, y * 100] if percent else [y]))
    if not a or not b:
        return False
    matrix = r"\\begin\{[bp]matrix\}(.*)\\end\{[bp]matrix\}"
    rows = [re.fullmatch(matrix, t, re.DOTALL) for t in (a, b)]
    if all(rows):
        cells = [[c for line in m.group(1).split("\\\\") for c in line.split("&")] for m in rows]
        return len(cells[0]) == len(cells[1]) and all(same_answer(p, q, percent, tolerance) for p, q in zip(*cells, strict=True))
    bracketed = [t[0] in "([" and t[-1] in ")]" for t in (a, b)]
    if all(bracketed):
        if a[0] + a[-1] != b[0] + b[-1]:
            return False
        a, b = a[1:-1], b[1:-1]
    elif any(bracketed):
        a, b = (t[1:-1] if k else t for t, k in zip((a, b), bracketed, strict=True))
    left, right = parts_of(a), parts_of(b)
    if len(left) > 1 or len(right) > 1:
        return len(left) == len(right) and all(same_answer(p, q, percent, tolerance) for p, q in zip(left, right, strict=True))
    if (a, b) != (left[0], right[0]) or any(bracketed):
        return same_answer(left[0], right[0], percent, tolerance)
    return same_value(a, b, tolerance)


def pairwise(f, kind: str):
    """``f`` of two texts as a Column builder over batches."""

    def of(a: Column, b: Column) -> Column:
        def batch(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([f(p, q) for p, q in zip(x, y, strict=True)])

        return F.pandas_udf(batch, kind)(a, b)

    return of


signed = pairwise(signed_score, "double")
strictly_signed = pairwise(lambda s, t: signed_score(s, t, True), "double")
latex_equal = pairwise(same_text, "boolean")
answers_equal = pairwise(lambda a, b: a is not None and b is not None and same_answer(a, b), "boolean")


def boxed_equal(s: Column, truth: Column) -> Column:
    """1 where the last box has the plain form of ``truth``."""
    return pairwise(lambda x, t: float((box := last_boxed(x or "")) is not None and same_text(box, t)), "double")(s, truth)
