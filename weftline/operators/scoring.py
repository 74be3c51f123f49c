"""Scores of answers: documents stand for completions, built with marks, answers and citations from their own texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import answers as A
from weftline.functions import text as T
from weftline.plans.registry import query
from weftline.sources.tables import table

#: A completion of each document, in SQL that both engines read: thoughts, one to three copied spans, an answer.
SOLUTIONS = """(SELECT doc_id, source, lang, n_chars, text, substr(text, 1, 60) AS gold_a, substr(text, 21, 80) AS gold_b, substr(text, 400, 50) AS gold_c,
CASE WHEN doc_id % 5 = 0 THEN '<think>' ELSE '' END || substr(text, 1, 120) || '<recall>' || substr(text, 1 + CAST(doc_id % 40 AS INT), 30 + CAST(doc_id % 60 AS INT)) || '</recall>' ||
CASE WHEN doc_id % 3 = 0 THEN '<recall>' || source || ' [' || (doc_id % 6) || ']</recall>' ELSE '' END || CASE WHEN doc_id % 13 = 0 THEN '<recall>' ELSE '' END ||
CASE WHEN doc_id % 17 = 0 THEN '<recall>ab</recall>' ELSE '' END || CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '</think> x </think>' ELSE '</think>' END ||
' Answer: ' || source || ' [' || (doc_id % 6) || '] and [' || (doc_id % 4) || '] ' || lang || CASE WHEN doc_id % 11 = 0 THEN ' Answer: ' || lang || ' the ' || source ELSE '' END AS solution FROM {documents})"""
DUCK = SOLUTIONS.replace("{documents}", "documents")
ANSWER = "ltrim(string_split(string_split(solution, '</think>')[-1], 'Answer:')[-1])"
DUCK_SPANS = "regexp_extract_all(solution, '(?s)<recall>(.*?)</recall>', 1)"
PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT * FROM " + SOLUTIONS, documents=table(spark, sf_dir, "documents"))


def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the answer and the spans of each completion."""
    s = solutions(spark, sf_dir)
    return s.withColumn("answer", A.answer_of(A.after_thinking(F.col("solution")))).withColumn("spans", T.between(F.col("solution"), "<recall>", "</recall>"))


@query("greedy_answers", f"SELECT doc_id, {ANSWER} AS answer FROM {DUCK}")
def greedy_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(spark, sf_dir).select("doc_id", "answer")


_BOX = "substr(text, 1, 30) || CASE doc_id % 4 WHEN 0 THEN chr(92) || 'boxed{' || source || '}' WHEN 1 THEN chr(92) || 'boxed  {' || chr(92) || 'frac{' || lang || '}{2}} and ' || chr(92) || 'boxed{no}' WHEN 2 THEN chr(92) || 'boxed ' || source ELSE chr(92) || 'boxed{{' || source || '}' END"


@query(
    "boxed_answers",
    f"""WITH b AS (SELECT doc_id, regexp_extract(s, '(?s)^.*?\\\\boxed(.*)$', 1) AS rest FROM (SELECT doc_id, {_BOX} AS s FROM documents)),
    c AS (SELECT doc_id, regexp_matches(rest, '^\\s*\\{{') AS opens, regexp_replace(rest, '^\\s*\\{{', '') AS body FROM b),
    e AS (SELECT doc_id, opens, body, list_min(list_filter(range(1, length(body) + 1), lambda i: length(replace(left(body, i), '}}', '')) < length(replace(left(body, i), '{{', '')))) AS stop FROM c)
    SELECT doc_id, CASE WHEN opens AND stop IS NOT NULL THEN left(body, stop - 1) END AS answer FROM e""",
)
def boxed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BOX).alias("s"))
    return d.select("doc_id", A.boxed(F.col("s")).alias("answer"))


@query(
    "answer_formats",
    f"""SELECT doc_id, len(p) = 2 AND NOT contains(solution, '<think>') AND len(string_split(p[-1], 'Answer:')) = 2 AND trim(string_split(p[-1], 'Answer:')[-1]) <> '' AS ok,
    CASE WHEN starts_with(solution, '<think>') AND contains(substr(solution, 8), '</think>') AND NOT contains(substr(solution, 8), '<think>') THEN 1e0 ELSE 0e0 END AS thinks
    FROM (SELECT *, string_split(solution, '</think>') AS p FROM {DUCK})""",
)
def answer_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solutions(spark, sf_dir).select("doc_id", A.right_format(F.col("solution")).alias("ok"), A.think_format(F.col("solution")).alias("thinks"))


_AGG = f"list_filter(string_split_regex(translate(replace(replace(strip_accents(lower(regexp_replace(s, '\\[[0-9]+\\]', ' ', 'g'))), 'ß', 'ss'), '&', ' and '), {PUNCT}, '{' ' * 32}'), '\\s+'), lambda w: w NOT IN ('a', 'an', 'the', ''))"


@query("aggressive_answers", f"SELECT doc_id, array_to_string({_AGG}, ' ') AS answer FROM (SELECT doc_id, 'The [12] ' || text || ' & a/b_c' AS s FROM documents)")
def aggressive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("The [12] "), "text", F.lit(" & a/b_c")).alias("s"))
    return d.select("doc_id", A.aggressive(F.col("s")).alias("answer"))


def _edge(a: str, b: str) -> str:
    return f"""CASE WHEN contains({a}, {b}) THEN length({b}) WHEN contains({b}, {a}) THEN length({a}) ELSE
    list_max(list_filter(range(0, least(length({a}), length({b})) + 1), lambda i: i = 0 OR right({a}, i) = left({b}, i) OR right({b}, i) = left({a}, i))) END"""


@query(
    "copy_overlaps",
    f"""SELECT doc_id, round(CASE WHEN length(gold_a) = 0 OR length(gold_b) = 0 THEN 0e0 ELSE 2e0 * ({_edge('gold_a', 'gold_b')}) / (length(gold_a) + length(gold_b)) END, 6) AS f1,
    round(CASE WHEN length(gold_a) = 0 OR length(gold_b) = 0 THEN 0e0 ELSE 1e0 * ({_edge('gold_a', 'gold_b')}) / length(gold_b) END, 6) AS coverage FROM {DUCK}""",
)
def copy_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("gold_a"), F.col("gold_b")
    return solutions(spark, sf_dir).select("doc_id", F.round(A.overlap_f1(a, b), 6).alias("f1"), F.round(A.overlap_coverage(a, b), 6).alias("coverage"))


_PAIRS = f"""x AS (SELECT *, {DUCK_SPANS} AS spans FROM {DUCK}), g AS (SELECT doc_id, unnest([1, 2, 3]) AS gi, unnest([gold_a, gold_b, gold_c]) AS gold, unnest([lang, source, 'nowhere']) AS label FROM x),
    s AS (SELECT doc_id, unnest(range(1, len(spans) + 1)) AS si, unnest(spans) AS span FROM x),
    o AS (SELECT doc_id, gi, gold, label, si, span, CASE WHEN length(gold) = 0 OR length(span) = 0 THEN 0e0 ELSE 2e0 * ({_edge('gold', 'span')}) / (length(gold) + length(span)) END AS f FROM g JOIN s USING (doc_id)),
    b AS (SELECT doc_id, gi, label, f, span, row_number() OVER (PARTITION BY doc_id, gi ORDER BY f DESC, si) AS r FROM o),
    d AS (SELECT doc_id, gi, least(1e0, f / 0.7e0) AS plain, least(1e0, f / 0.7e0) * CASE WHEN f > 0 AND NOT contains(span, label) THEN 0.5e0 ELSE 1e0 END AS marked FROM b WHERE r = 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY plain DESC) AS pr, row_number() OVER (PARTITION BY doc_id ORDER BY marked DESC) AS mr FROM d)"""


@query(
    "gold_doc_scores",
    f"""WITH {_PAIRS} SELECT x.doc_id, round(avg(plain), 6) AS standard, round(avg(plain) FILTER (WHERE pr <= 2), 6) AS top_2, round(avg(marked), 6) AS penalised,
    round(avg(marked) FILTER (WHERE mr <= 2), 6) AS penalised_top_2, CASE WHEN len(any_value(spans)) > 0 THEN 1e0 ELSE 0e0 END AS used FROM x JOIN t USING (doc_id) GROUP BY x.doc_id""",
)
def gold_doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of copied spans with three gold texts: their mean, the mean of the best two, and both with a penalty for a missing label."""
    golds, labels = F.array("gold_a", "gold_b", "gold_c"), F.array(F.col("lang"), F.col("source"), F.lit("nowhere"))
    s = answer(spark, sf_dir).select("doc_id", "spans", golds.alias("golds"), labels.alias("labels"))
    s = s.withColumn("plain", A.gold_scores(F.col("spans"), F.col("golds"), 0.7)).withColumn("marked", A.labelled_gold_scores(F.col("spans"), F.col("golds"), F.col("labels"), 0.7))
    of = lambda c, mode: F.round(A.gold_summary(F.col(c), F.col("spans"), F.col("golds"), mode, 2), 6)
    return s.select("doc_id", of("plain", "standard").alias("standard"), of("plain", "top_k_gold").alias("top_2"), of("marked", "standard").alias("penalised"), of("marked", "top_k_gold").alias("penalised_top_2"), of("plain", "used_recall").alias("used"))


_CITES = f"""a AS (SELECT doc_id, {ANSWER} AS answer, {DUCK_SPANS} AS spans, CAST(n_chars % 5 AS INT) AS g FROM {DUCK}),
    c AS (SELECT DISTINCT doc_id, CAST(unnest(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1)) AS INT) AS n FROM a),
    r AS (SELECT DISTINCT doc_id, CAST(unnest(regexp_extract_all(array_to_string(spans, ' '), '\\[([0-9]+)\\]', 1)) AS INT) AS n FROM a),
    m AS (SELECT a.doc_id, a.answer, a.g, count(c.n) AS cited, count(*) FILTER (WHERE c.n < a.g) AS hit, sum(CASE WHEN r.n IS NULL THEN 0.5e0 ELSE 1e0 END) FILTER (WHERE c.n IS NOT NULL) AS wall,
    sum(CASE WHEN r.n IS NULL THEN 0.5e0 ELSE 1e0 END) FILTER (WHERE c.n < a.g) AS whit FROM a LEFT JOIN c USING (doc_id) LEFT JOIN r ON r.doc_id = c.doc_id AND r.n = c.n GROUP BY a.doc_id, a.answer, a.g)"""


@query(
    "citation_scores",
    f"""WITH {_CITES} SELECT doc_id, round(CASE WHEN cited = 0 OR hit = 0 THEN 0e0 ELSE 2 * (least(whit, g) / g) * (whit / wall) / (least(whit, g) / g + whit / wall) END, 6) AS weighted,
    round(CASE WHEN cited = 0 OR hit = 0 THEN 0e0 ELSE 2e0 * hit / (cited + g) END, 6) AS plain,
    CASE WHEN cited > 0 AND trim(regexp_replace(answer, '\\[[0-9]+\\]', '', 'g')) <> '' THEN 1e0 ELSE 0e0 END AS format FROM m""",
)
def citation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in the answer against gold numbers 0 to g - 1: with half weight where no span has them, plain, and the format."""
    s = answer(spark, sf_dir).withColumn("g", (F.col("n_chars") % 5).cast("int"))
    gold = F.when(F.col("g") > 0, F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array().cast("array<int>"))
    return s.select(
        "doc_id", F.round(A.citation_f1(F.col("answer"), F.col("spans"), gold), 6).alias("weighted"), F.round(A.citation_f1(F.col("answer"), None, gold), 6).alias("plain"),
        A.citation_format(F.col("answer")).alias("format"),
    )


_SETTINGS = """CASE WHEN doc_id % 10 = 9 THEN '{bad' ELSE '{"answer_to_doc_ids": {"0": [1, 2], "1": [' || CASE WHEN doc_id % 2 = 0 THEN '3' ELSE '' END || '], "2": [4], "9": [5], "x": [6]}, "answer_variants": [["' || source || '", "zz"], ["' || lang || '"], ["no such", "' || lang || ' the ' || source || '"]]}' END"""


@query(
    "answer_coverages",
    f"""WITH a AS (SELECT doc_id, {ANSWER} AS s, {_SETTINGS} AS j FROM {DUCK}), n AS (SELECT doc_id, j, array_to_string({_AGG}, ' ') AS answer FROM a),
    v AS (SELECT doc_id, answer, CAST(k AS INT) AS k, unnest(CAST(json_extract(j, '$.answer_variants') AS VARCHAR[][])[CAST(k AS INT) + 1]) AS s
      FROM (SELECT *, unnest(json_keys(j, '$.answer_to_doc_ids')) AS k FROM n WHERE json_valid(j)) WHERE k IN ('0', '1', '2') AND json_array_length(j, '$.answer_to_doc_ids.' || k) > 0),
    f AS (SELECT doc_id, k, answer, array_to_string({_AGG}, ' ') AS variant FROM v),
    h AS (SELECT doc_id, k, bool_or(variant <> '' AND CASE WHEN length(variant) <= 4 AND NOT contains(variant, ' ') THEN list_contains(string_split(answer, ' '), variant) ELSE contains(answer, variant) END) AS found FROM f GROUP BY doc_id, k),
    c AS (SELECT doc_id, count(*) FILTER (WHERE found) AS covered, count(*) AS available FROM h GROUP BY doc_id)
    SELECT n.doc_id, coalesce(covered, 0) AS covered, coalesce(available, 0) AS available, round(CASE WHEN available > 0 THEN least(covered, 5) * 1e0 / least(available, 5) ELSE 0e0 END, 6) AS coverage FROM n LEFT JOIN c USING (doc_id)""",
)
def answer_coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of several right ones, by settings in JSON: those that have documents are available, those of which a variant is found are covered. Malformed settings count nothing."""
    s = answer(spark, sf_dir).select("doc_id", F.col("answer"), F.from_json(F.expr(_SETTINGS), "answer_to_doc_ids map<string, array<int>>, answer_variants array<array<string>>").alias("j"))
    s = s.withColumn("answer", A.aggressive(F.col("answer")))
    keys = F.map_keys(F.map_filter("j.answer_to_doc_ids", lambda k, v: (F.size(v) > 0) & k.rlike("^[0-9]+$")))
    use = s.withColumn("k", F.explode(F.coalesce(keys, F.array().cast("array<string>")))).withColumn("k", F.col("k").cast("int"))
    use = use.where(F.col("k") < F.size("j.answer_variants")).select("doc_id", "answer", "k", F.explode(F.get("j.answer_variants", F.col("k"))).alias("v"))
    found = use.groupBy("doc_id", "k").agg(F.max(A.variant_found(A.aggressive(F.col("v")), F.col("answer"))).alias("found"))
    counts = found.groupBy("doc_id").agg(F.count_if("found").alias("covered"), F.count("*").alias("available"))
    out = s.select("doc_id").join(counts, "doc_id", "left").na.fill(0, ["covered", "available"])
    return out.select("doc_id", "covered", "available", F.round(A.capped_coverage(F.col("covered"), F.col("available")), 6).alias("coverage"))


ORIGINS = ["hotpotqa", "musique", "2wikimultihopqa", "nq", "triviaqa", "math_retrieval", "retrieval_math", "retrieval", "multi_niah", "mcqa_math", "dapo_math", "banking77", "massive", "quality", "majority_vote", "threshold_filter", "top_n_vote", "msmarco_v2", "qampari"]
_ORIGIN_LIST = ", ".join(f"'{o}'" for o in ORIGINS)
#: Answers and gold columns of each kind, in SQL that both engines read.
_ROUTED_ANSWER = f"""CASE WHEN origin IN ('mcqa_math', 'dapo_math') THEN 'so ' || chr(92) || 'boxed{{' || CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END || '}}'
  WHEN origin = 'quality' THEN CASE WHEN doc_id % 3 = 0 THEN 'it is B.' ELSE 'C, not B' END
  WHEN origin IN ('majority_vote', 'threshold_filter') THEN CASE doc_id % 4 WHEN 0 THEN 'Option ' || source || '.' WHEN 1 THEN upper(source) WHEN 2 THEN 'I say option ' || source || '5' ELSE 'it is ' || source END
  WHEN origin = 'top_n_vote' THEN 'Option ' || source || ', option x1 and ' || lang
  WHEN origin = 'msmarco_v2' THEN '[ID: 3] > doc ' || (doc_id % 5) || ' > 1 > 3'
  WHEN origin IN ('banking77', 'massive') THEN 'The ' || source || '!' ELSE source || ' and ' || lang || ' ' || left(text, 40) END"""
_ROUTED_GOLD = """CASE WHEN origin IN ('hotpotqa', 'musique', '2wikimultihopqa', 'nq', 'triviaqa') THEN 'nothing here|||' || CASE WHEN doc_id % 2 = 0 THEN 'a ' || upper(source) ELSE 'other' END
  WHEN origin = 'multi_niah' THEN source || ' ' || lang || ' absent' WHEN origin = 'quality' THEN CASE WHEN doc_id % 2 = 0 THEN 'B' ELSE 'C' END
  WHEN origin IN ('majority_vote', 'threshold_filter') THEN 'Option ' || source WHEN origin = 'top_n_vote' THEN 'Option ' || source || '|||Option x9' ELSE CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE source END END"""
_ROUTED_WRONG = """CASE WHEN origin = 'multi_niah' THEN CASE WHEN doc_id % 3 = 0 THEN source ELSE 'zz' END ELSE 'Option x1' END"""


def _routed_columns() -> list[str]:
    return ["doc_id", "origin", f"{_ROUTED_ANSWER} AS answer", f"{_ROUTED_GOLD} AS gold", "lang AS second", f"{_ROUTED_WRONG} AS wrong"]



_DUCK_NORM = "array_to_string(list_filter(string_split(trim(regexp_replace(translate(lower({x}), " + PUNCT + ", ''), '\\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"
_N = lambda x: _DUCK_NORM.replace("{x}", x)
_WORD = "regexp_matches({s}, '(^|[^\\w])' || regexp_escape({w}) || '([^\\w]|$)')"
_HAS = lambda w, s: _WORD.replace("{w}", w).replace("{s}", s)
_DUCK_ROUTED = f"SELECT {', '.join(_routed_columns())} FROM (SELECT *, [{_ORIGIN_LIST}][CAST(doc_id % {len(ORIGINS)} + 1 AS INT)] AS origin FROM documents)"
_GOLD2 = "string_split(gold, '|||')"


@query(
    "source_scores",
    f"""WITH r AS ({_DUCK_ROUTED}), n AS (SELECT *, trim(rtrim(trim(lower(answer)), '.,;:!?')) AS a, lower(gold) AS g, string_split(lower(gold), ' ')[-1] AS key,
    regexp_extract(answer, '\\\\boxed\\{{(.*)\\}}', 1) AS box, list_distinct(list_filter(list_transform(string_split(replace(replace(regexp_replace(lower(answer), '[\\[\\]:]', '', 'g'), 'id', ''), 'doc', ''), '>'), lambda x: trim(x)), lambda x: x <> '')) AS unordered,
    list_filter(list_transform(string_split(replace(replace(regexp_replace(lower(answer), '[\\[\\]:]', '', 'g'), 'id', ''), 'doc', ''), '>'), lambda x: trim(x)), lambda x: x <> '') AS ids FROM r)
    SELECT doc_id, origin, round(CASE
    WHEN origin IN ('hotpotqa', 'musique', '2wikimultihopqa', 'nq', 'triviaqa') THEN CASE WHEN list_bool_or(list_transform({_GOLD2}, lambda x: contains({_N('answer')}, {_N('x')}) OR contains({_N('x')}, {_N('answer')}))) THEN 1e0 ELSE 0e0 END
    WHEN origin IN ('math_retrieval', 'retrieval_math') THEN CASE WHEN contains(answer, gold) THEN 1e0 WHEN contains(answer, second) THEN 0.25e0 ELSE 0e0 END
    WHEN origin = 'retrieval' THEN CASE WHEN contains(answer, gold) THEN 1e0 ELSE 0e0 END
    WHEN origin = 'multi_niah' THEN greatest(0e0, (len(list_filter(string_split(gold, ' '), lambda x: contains(answer, x))) - CASE WHEN contains(answer, wrong) THEN 1 ELSE 0 END) / 3e0)
    WHEN origin = 'mcqa_math' THEN CASE WHEN contains(box, gold) OR contains(box, second) THEN 1e0 ELSE 0e0 END
    WHEN origin = 'dapo_math' THEN CASE WHEN contains(box, gold) THEN 1e0 ELSE 0e0 END
    WHEN origin IN ('banking77', 'massive') THEN CASE WHEN {_N('answer')} = {_N('gold')} THEN 1e0 ELSE 0e0 END
    WHEN origin = 'quality' THEN CASE WHEN regexp_extract(answer, '[A-D]') = gold THEN 1e0 ELSE 0e0 END
    WHEN origin IN ('majority_vote', 'threshold_filter') THEN CASE WHEN a = g OR a = key OR {_HAS('g', 'a')} OR string_split(a, ' ')[1] = key OR string_split(a, ' ')[-1] = key THEN 1e0 ELSE 0e0 END
    WHEN origin = 'top_n_vote' THEN greatest(0e0, (len(list_filter({_GOLD2}, lambda o: {_HAS('lower(o)', 'lower(answer)')} OR {_HAS("string_split(o, ' ')[-1]", 'answer')})) - CASE WHEN {_HAS('lower(wrong)', 'lower(answer)')} THEN 1 ELSE 0 END) / 2e0)
    WHEN origin = 'msmarco_v2' THEN (SELECT sum(gr / log2(i + 1)) FROM (SELECT i, CASE x WHEN '0' THEN 3 WHEN '1' THEN 0 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END AS gr FROM
      (SELECT x, row_number() OVER (ORDER BY p) AS i FROM (SELECT ids[p] AS x, min(p) AS p FROM (SELECT unnest(range(1, len(ids) + 1)) AS p) GROUP BY ids[p])))) / (3 + 2 / log2(3) + 1 / log2(4)) ELSE 0e0 END, 6) AS score FROM n""",
)
def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to all kinds of sources, each by its rule."""
    r = table(spark, sf_dir, "documents").selectExpr("*", f"element_at(array({_ORIGIN_LIST}), CAST(doc_id % {len(ORIGINS)} + 1 AS INT)) AS origin")
    r = r.selectExpr(*_routed_columns())
    grades = F.create_map(*(x for k, v in (("0", 3), ("1", 0), ("2", 2), ("3", 1)) for x in (F.lit(k), F.lit(v))))
    columns = {"gold": F.col("gold"), "second": F.col("second"), "wrong": F.col("wrong"), "grades": grades}
    return r.select("doc_id", "origin", F.round(A.source_score(F.col("origin"), F.col("answer"), columns), 6).alias("score"))


@query(
    "ranking_scores",
    """WITH r AS (SELECT doc_id, list_transform([doc_id % 7, doc_id % 3, doc_id % 5], lambda x: CAST(x AS VARCHAR)) AS ids, CAST(doc_id % 4 AS INT) AS n FROM documents),
    p AS (SELECT doc_id, n, x, min(i) AS i FROM (SELECT doc_id, n, unnest(ids) AS x, unnest([1, 2, 3]) AS i FROM r) GROUP BY ALL),
    q AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM p),
    g AS (SELECT doc_id, n, count(*) FILTER (WHERE CAST(x AS INT) <= n) AS have, sum(CASE WHEN CAST(x AS INT) <= n THEN (CAST(x AS INT) + 1) / log2(place + 1) ELSE 0 END) AS gain, string_agg(x, ',' ORDER BY place) AS ids FROM q GROUP BY doc_id, n)
    SELECT doc_id, ids, round(sqrt(have / (n + 1e0)), 6) AS format, round(gain / (SELECT sum((n + 1 - i) / log2(i + 2)) FROM (SELECT unnest(range(0, n + 1)) AS i)), 6) AS ndcg FROM g""",
)
def ranking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings written as text: the ids in order, the share of the known ones, and NDCG under grades 1 to n + 1 of ids 0 to n."""
    part = lambda m: (F.col("doc_id") % m).cast("string")
    s = F.concat(F.lit("[ID: "), part(7), F.lit("] > Passage "), part(3), F.lit(" > doc "), part(5), F.lit(" > "))
    ids = F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))
    grades = F.map_from_arrays(F.transform(ids, lambda x: x.cast("string")), F.transform(ids, lambda x: x + 1))
    d = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"), grades.alias("grades"))
    return d.select("doc_id", F.array_join(A.ranking(F.col("s")), ",").alias("ids"), F.round(A.ranking_format(F.col("s"), F.col("grades")), 6).alias("format"), F.round(A.ranking_ndcg(F.col("s"), F.col("grades")), 6).alias("ndcg"))


_COUNT = lambda s, m: f"(len(string_split({s}, '{m}')) - 1)"


@query(
    "span_scores",
    f"""WITH s AS (SELECT *, {DUCK_SPANS} AS spans FROM {DUCK}), e AS (SELECT doc_id, n_chars, len(spans) AS n, abs({_COUNT('solution', '<recall>')} - {_COUNT('solution', '</recall>')}) + len(list_filter(spans, lambda x: length(x) < 7)) AS wrong FROM s)
    SELECT doc_id, round(CASE WHEN n = 0 THEN 1e0 ELSE greatest(0e0, 1 - wrong / sqrt(n)) END, 6) AS quality,
    round(CASE WHEN greatest(n - 1, 0) * 1024e0 / greatest(n_chars, 1) <= 1 THEN 1e0 ELSE pow(2e0, -(greatest(n - 1, 0) * 1024e0 / greatest(n_chars, 1) - 1) / 4e0) END, 6) AS density FROM e""",
)
def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the copied spans, and their density for the length."""
    s = answer(spark, sf_dir)
    return s.select("doc_id", F.round(A.span_quality(F.col("solution"), "<recall>", "</recall>", 7), 6).alias("quality"), F.round(T.density_penalty(F.size("spans"), F.col("n_chars"), 1, 1024, 1.0, 4.0), 6).alias("density"))


@query(
    "final_rewards",
    f"""WITH {_PAIRS}, q AS (SELECT doc_id, avg(plain) AS ret FROM t GROUP BY doc_id), p AS (SELECT *, string_split(solution, '</think>') AS p FROM x),
    f AS (SELECT p.doc_id, CASE WHEN len(p) = 2 AND NOT contains(solution, '<think>') AND len(string_split(p[-1], 'Answer:')) = 2 THEN 1e0 ELSE 0e0 END AS fmt,
    CASE WHEN contains({_N(ANSWER)}, {_N('source')}) OR contains({_N('source')}, {_N(ANSWER)}) THEN 1e0 ELSE 0e0 END AS ans, q.ret, n_chars, len(spans) AS n,
    abs({_COUNT('solution', '<recall>')} - {_COUNT('solution', '</recall>')}) + len(list_filter(spans, lambda s: length(s) < 7)) AS wrong FROM p JOIN q USING (doc_id)),
    w AS (SELECT *, CASE WHEN n = 0 THEN 1e0 ELSE greatest(0e0, 1 - wrong / sqrt(n)) END * CASE WHEN greatest(n - 2, 0) * 1024e0 / greatest(n_chars, 1) <= 6 THEN 1e0 ELSE pow(2e0, -(greatest(n - 2, 0) * 1024e0 / greatest(n_chars, 1) - 6) / 4e0) END AS keep FROM f)
    SELECT doc_id, round(0.2e0 * fmt + 0.4e0 * (ans + ret * keep) / 2 + 0.4e0 * (sqrt((ans + 0.01e0) * (ret * keep + 0.01e0)) - 0.01e0), 6) AS reward,
    round(greatest(0.2e0 * fmt + 0.4e0 * (ans + ret * keep) / 2 + 0.4e0 * (sqrt((ans + 0.01e0) * (ret * keep + 0.01e0)) - 0.01e0) + least(-(n_chars - 1500) / 1000e0, 0e0), 0e0), 6) AS shortened FROM w""",
)
def final_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite of format, answer and copied spans, each from the completion's text, and with the penalty for overlong ones."""
    s = answer(spark, sf_dir).withColumn("golds", F.array("gold_a", "gold_b", "gold_c"))
    keep = A.span_quality(F.col("solution"), "<recall>", "</recall>", 7) * T.density_penalty(F.size("spans"), F.col("n_chars"), 2, 1024, 6.0, 4.0)
    s = s.select("doc_id", "n_chars", A.right_format(F.col("solution")).cast("double").alias("fmt"), T.contains_either_way(F.col("answer"), F.col("source")).alias("ans"), (A.gold_summary(A.gold_scores(F.col("spans"), F.col("golds"), 0.7), F.col("spans"), F.col("golds"), "standard") * keep).alias("ret"))
    reward = 0.2 * F.col("fmt") + 0.4 * (F.col("ans") + F.col("ret")) / 2 + 0.4 * T.geometric_mean([F.col("ans"), F.col("ret")])
    return s.select("doc_id", F.round(reward, 6).alias("reward"), F.round(F.greatest(reward + T.overlong_penalty(F.col("n_chars"), 1500, 1000, 1.0), F.lit(0.0)), 6).alias("shortened"))


_TAGGED = "CASE WHEN doc_id % 5 = 0 THEN text ELSE repeat('<answer>' || lang || '</answer>', CAST(doc_id % 13 AS INT)) || ' <answer> The ' || CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE lang END || '. </answer>' END"


@query(
    "tagged_answers",
    f"""WITH s AS (SELECT doc_id, source, {_TAGGED} AS s FROM documents), t AS (SELECT *, string_split(s, '<answer>') AS p FROM s)
    SELECT doc_id, CASE WHEN len(p) > 1 THEN trim(string_split(p[-1], '</answer>')[1]) END AS answer,
    CASE WHEN len(p) > 1 AND {_N("string_split(p[-1], '</answer>')[1]")} = {_N('source')} THEN CASE WHEN len(p) - 1 > 10 THEN 0.25e0 ELSE 1e0 END ELSE 0e0 END AS score FROM t""",
)
def tagged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tagged answer, and its exact match with a penalty for many tags."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(_TAGGED).alias("s"))
    return d.select("doc_id", A.tagged_answer(F.col("s")).alias("answer"), F.coalesce(A.tagged_exact_match(F.col("s"), F.array("source")), F.lit(0.0)).alias("score"))


# --- maths ---

_X, _Y = "(doc_id % 9 + 1)", "(n_chars % 9 + 1)"
_PRED = f"""CASE doc_id % 8 WHEN 0 THEN chr(92) || 'frac{{' || {_X} || '}}{{' || {_Y} || '}}' WHEN 1 THEN {_X} || '/' || {_Y} WHEN 2 THEN '1,00' || {_X} WHEN 3 THEN {_X} || '%' WHEN 4 THEN '(' || {_X} || ', ' || {_Y} || ')'
  WHEN 5 THEN {_X} || '00' WHEN 6 THEN chr(92) || 'sqrt{{' || {_X} || '}}' ELSE '2x + ' || {_X} END"""
_TRUTH = f"""CASE doc_id % 8 WHEN 0 THEN {_X} || '/' || {_Y} WHEN 1 THEN chr(92) || 'frac{{' || {_Y} || '}}{{' || {_X} || '}}' WHEN 2 THEN '100' || {_X} WHEN 3 THEN CAST({_X} AS STRING) WHEN 4 THEN '(' || {_Y} || ',' || {_X} || ')'
  WHEN 5 THEN CAST({_X} AS STRING) WHEN 6 THEN {_Y} || '^{{' || chr(92) || 'frac12}}' ELSE {_Y} || ' + x + x' END"""


@query(
    "equal_answers",
    f"""SELECT doc_id, CASE WHEN doc_id % 8 IN (0, 2, 3, 5) THEN true ELSE {_X} = {_Y} END AS same, CASE WHEN doc_id % 8 = 0 THEN true WHEN doc_id % 8 = 1 THEN {_X} = {_Y} WHEN doc_id % 8 = 4 THEN {_X} = {_Y} ELSE false END AS same_text FROM documents""",
)
def equal_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions, numbers with commas, percentages, tuples, roots and polynomials: equal in value, and equal as LaTeX."""
    from weftline.functions import maths

    m = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PRED).alias("pred"), F.expr(_TRUTH).alias("truth"))
    return m.select("doc_id", maths.answers_equal(F.col("pred"), F.col("truth")).alias("same"), maths.latex_equal(F.col("pred"), F.col("truth")).alias("same_text"))


_PROOF = f"text || CASE doc_id % 3 WHEN 0 THEN ' Answer: k = $' || {_X} || '$ units' WHEN 1 THEN ' answer : ' || {_X} || ' ' || chr(92) || 'boxed{{' || {_X} || '}}' ELSE ' no more' END"


@query(
    "maths_scores",
    f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND {_X} = {_Y} THEN 1e0 ELSE -1e0 END AS signed, CASE WHEN doc_id % 3 = 1 AND {_X} = {_Y} THEN 1e0 ELSE -1e0 END AS strict,
    CASE WHEN doc_id % 3 = 1 AND {_X} = {_Y} THEN 1e0 ELSE 0e0 END AS boxed FROM documents""",
)
def maths_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions with an answer line or a box: plus or minus one by the final form, by the box as it is, and by its plain form."""
    from weftline.functions import maths

    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PROOF).alias("s"), F.expr(f"CAST({_Y} AS STRING)").alias("truth"))
    s, t = F.col("s"), F.col("truth")
    return d.select("doc_id", maths.signed(s, t).alias("signed"), maths.strictly_signed(s, t).alias("strict"), maths.boxed_equal(s, t).alias("boxed"))


@query(
    "format_and_accuracy",
    f"""SELECT doc_id, round(CASE WHEN doc_id % 4 < 3 AND {_X} = {_Y} THEN 0.9e0 ELSE 0e0 END + CASE WHEN doc_id % 4 IN (0, 1) THEN 0.1e0 ELSE 0e0 END, 6) AS score FROM documents""",
)
def format_and_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.9 for the right value in the box, 0.1 for thoughts before a box."""
    from weftline.functions import maths

    box = f"chr(92) || 'boxed{{' || {_X} || '.0}}'"
    s = f"CASE doc_id % 4 WHEN 0 THEN '<think>' || text || '</think> ' || {box} WHEN 1 THEN '<think></think>' || {box} || '.' WHEN 2 THEN text || {box} ELSE '<think>' || text || '</think>' END"
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(s).alias("s"), F.expr(f"CAST({_Y} AS STRING)").alias("truth"))
    right = maths.answers_equal(A.boxed(F.col("s")), F.col("truth")).cast("double")
    return d.select("doc_id", F.round(0.9 * right + 0.1 * A.boxed_format(F.col("s")), 6).alias("score"))


#: Which scorer each origin has, by its name without the part before a slash; one that begins with "aime" has the signed one.
SCORERS = {
    "gsm8k": "last_number", "MATH": "boxed", "MATH-lighteval": "boxed", "MATH-500": "boxed", "math_dapo": "signed", "math": "signed", "math_dapo_reasoning": "signed",
    "numina_aops_forum": "value", "numina_synthetic_math": "value", "numina_amc_aime": "value", "numina_synthetic_amc": "value", "numina_cn_k12": "value", "numina_olympiads": "value", "geometry3k": "geometry",
    "searchR1_nq": "tagged", "searchR1_triviaqa": "tagged", "searchR1_popqa": "tagged", "searchR1_hotpotqa": "tagged", "searchR1_2wikimultihopqa": "tagged", "searchR1_musique": "tagged", "searchR1_bamboogle": "tagged",
}


def routed_score(origin, s, truth):
    """The score of a solution by the scorer of its origin; an unknown origin is an error."""
    from weftline.functions import maths

    box = A.boxed(s)
    scorers = {
        "last_number": (T.last_number_mark(s) == truth).cast("double"), "boxed": maths.boxed_equal(s, truth), "signed": maths.signed(s, truth), "value": maths.answers_equal(box, truth).cast("double"),
        "geometry": 0.9 * maths.answers_equal(box, truth).cast("double") + 0.1 * A.boxed_format(s), "tagged": A.tagged_exact_match(s, F.array(truth)),
    }
    kinds = F.create_map(*(x for k, v in SCORERS.items() for x in (F.lit(k), F.lit(v))))
    name = F.element_at(F.split(origin, "/"), -1)
    kind = F.when(name.startswith("aime"), F.lit("signed")).otherwise(F.try_element_at(kinds, name))
    chain = F.when(kind.isNull(), F.raise_error(F.concat(F.lit("no scorer for "), origin)).cast("double"))
    for scorer, score in scorers.items():
        chain = chain.when(kind == scorer, F.coalesce(score, F.lit(0.0)))
    return chain


_KINDS = "['a/gsm8k', 'b/MATH', 'aime24', 'numina_cn_k12', 'c/geometry3k', 'searchR1_nq']"


@query(
    "routed_scores",
    f"""SELECT doc_id, {_KINDS}[CAST(doc_id % 6 + 1 AS INT)] AS origin, CASE doc_id % 6 WHEN 2 THEN CASE WHEN {_X} = {_Y} THEN 1e0 ELSE -1e0 END ELSE CASE WHEN {_X} = {_Y} THEN CASE WHEN doc_id % 6 = 4 THEN 0.9e0 ELSE 1e0 END ELSE 0e0 END END AS score FROM documents""",
)
def routed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One solution text with every kind of answer, scored by its origin."""
    solution = f"text || '<answer> the ' || {_X} || '</answer> #### ' || {_X} || ' ' || chr(92) || 'boxed{{' || {_X} || '}} Answer: ' || {_X}"
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"element_at(array({_KINDS[1:-1]}), CAST(doc_id % 6 + 1 AS INT))").alias("origin"), F.expr(solution).alias("s"), F.expr(f"CAST({_Y} AS STRING)").alias("truth"))
    return d.select("doc_id", "origin", F.round(routed_score(F.col("origin"), F.col("s"), F.col("truth")), 6).alias("score"))
