"""Articles as windows of words with their offsets, and what is looked up in them: spans, paragraphs, titles, answers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.plans.registry import query
from weftline.sources.tables import table

LEAST, MOST, SEED = 80, 100, 42


def hashed_length(seed: int, article: str, start: int, least: int = LEAST, most: int = MOST) -> int:
    """The length of the window that begins at ``start``: from ``least`` to ``most``, by eight bytes of BLAKE2b."""
    digest = hashlib.blake2b(f"{seed}::{article}::{start}".encode(), digest_size=8).digest()
    return least + int.from_bytes(digest, "big") % (most - least + 1)


def window_ranges(total: int, seed: int, article: str, length=hashed_length) -> list[tuple[int, int]]:
    """Consecutive windows over ``total`` words; the last may be short."""
    out, at = [], 0
    while at < total:
        end = min(at + length(seed, article, at), total)
        out.append((at, end))
        at = end
    return out


def blake_windows(total: Column, article: Column, seed: int = SEED) -> Column:
    """window_ranges as a column, in Python: no SQL engine has the hash."""

    def of(n: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e} for s, e in window_ranges(int(t), seed, i)] for t, i in zip(n, a, strict=True)])

    return F.pandas_udf(of, "array<struct<start: int, end: int>>")(total, article)


def md5_windows(total: Column, article: Column, seed: int = SEED) -> Column:
    """The same with seven hex digits of an MD5 as the hash, in the row and without Python."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("out"))

    def step(a: Column, _: Column) -> Column:
        number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}::"), article, F.lit("::"), a["at"].cast("string")).cast("binary")), 1, 7), 16, 10).cast("int")
        end = F.least(a["at"] + LEAST + number % (MOST - LEAST + 1), total).cast("int")
        grown = F.struct(end.alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("start"), end.alias("end"))).alias("out"))
        return F.when(a["at"] < total, grown).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.ceil(total / LEAST).cast("int") + 1), begin, step, lambda a: a["out"])


def articles(docs: DataFrame) -> DataFrame:
    """(doc_id, text, pieces, ends): paragraphs without control prefixes joined by line feeds, each word with the white space after it, and the words up to each paragraph's end."""
    lines = F.transform(F.split("text", "\n"), lambda p: F.regexp_replace(p, "^(Section|BULLET|NUMBERED)::::", ""))
    d = docs.select("doc_id", lines.alias("lines")).withColumn("text", F.array_join("lines", "\n"))
    words = F.transform("lines", lambda p: F.regexp_count(p, F.lit(r"\S+")))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    ends = F.aggregate(words, start, lambda a, n: F.struct((a["n"] + n).alias("n"), F.array_append(a["out"], a["n"] + n).alias("out")), lambda a: a["out"])
    return d.select("doc_id", "text", F.regexp_extract_all("text", F.lit(r"\S+\s*"), F.lit(0)).alias("pieces"), ends.alias("ends"))


def paragraph_of(ends: Column, word: Column) -> Column:
    """The first paragraph that ends after a word, the last one at most."""
    return F.least(F.size(F.filter(ends, lambda e: e <= word)), F.size(ends) - 1)


def expanded(a: DataFrame) -> DataFrame:
    """A row for each window of ``articles()``: its place, text, words, characters, paragraphs, and whether it is the last."""
    ranges = md5_windows(F.size("pieces"), F.col("doc_id").cast("string"))
    a = a.where("size(pieces) > 0").withColumn("ranges", ranges).withColumn("lead", F.length("text") - F.length(F.regexp_replace("text", r"^\s+", "")))
    cut = lambda w, i: F.struct(
        i.alias("win"), w["start"].alias("start_word"), w["end"].alias("end_word"), F.array_join(F.slice("pieces", w["start"] + 1, w["end"] - w["start"]), "").alias("chunk"),
        paragraph_of(F.col("ends"), w["start"]).alias("start_paragraph"), paragraph_of(F.col("ends"), F.greatest(w["end"] - 1, F.lit(0))).alias("end_paragraph"), (i == F.size("ranges") - 1).alias("is_tail"),
    )
    rows = a.select("doc_id", "lead", F.explode(F.transform("ranges", cut)).alias("w")).select("doc_id", "lead", "w.*")
    before = F.sum(F.length("chunk")).over(Window.partitionBy("doc_id").orderBy("win").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start_char", (F.col("lead") + F.coalesce(before, F.lit(0))).cast("int")).withColumn("text", F.regexp_replace("chunk", r"\s+$", ""))
    return rows.withColumn("end_char", F.col("start_char") + F.length("text")).drop("lead", "chunk")


_ARTICLES = r"""a AS (SELECT doc_id, regexp_replace(text, '(^|\n)(Section|BULLET|NUMBERED)::::', '\1', 'g') AS text FROM documents),
    p AS (SELECT doc_id, text, regexp_extract_all(text, '\S+\s*') AS pieces, length(text) - length(regexp_replace(text, '^\s+', '')) AS lead FROM a),
    pars AS (SELECT doc_id, par, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY par) AS INT) AS upto FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS par, len(regexp_extract_all(unnest(ls), '\S+')) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM a))),
    w AS (SELECT doc_id, 0 AS i, 0 AS s, least(len(pieces), 80 + CAST('0x' || substr(md5('42::' || doc_id || '::0'), 1, 7) AS INT) % 21) AS e, len(pieces) AS n FROM p WHERE len(pieces) > 0
      UNION ALL SELECT doc_id, i + 1, e, least(n, e + 80 + CAST('0x' || substr(md5('42::' || doc_id || '::' || e), 1, 7) AS INT) % 21), n FROM w WHERE e < n),
    o AS (SELECT w.*, lead + coalesce(list_sum(list_transform(pieces[1:s], lambda x: length(x))), 0) AS sc, regexp_replace(array_to_string(pieces[s + 1:e], ''), '\s+$', '') AS chunk FROM w JOIN p USING (doc_id)),
    f AS (SELECT o.*, (SELECT max(par) FROM pars q WHERE q.doc_id = o.doc_id) AS top, (SELECT count(*) FROM pars q WHERE q.doc_id = o.doc_id AND q.upto <= o.s) AS sp, (SELECT count(*) FROM pars q WHERE q.doc_id = o.doc_id AND q.upto <= greatest(o.e - 1, 0)) AS ep FROM o),
    windows AS (SELECT doc_id, CAST(i AS INT) AS win, CAST(s AS INT) AS start_word, CAST(e AS INT) AS end_word, CAST(sc AS INT) AS start_char, CAST(sc + length(chunk) AS INT) AS end_char, chunk, CAST(least(sp, top) AS INT) AS start_paragraph, CAST(least(ep, top) AS INT) AS end_paragraph, e = n AS is_tail FROM f)"""


@query("article_windows", f"WITH RECURSIVE {_ARTICLES} SELECT * EXCLUDE chunk, md5(chunk) AS digest FROM windows")
def article_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 80 to 100 words, each length hashed from its start, with offsets in words and characters and their paragraphs."""
    w = expanded(articles(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return w.withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("text")


@query(
    "span_windows",
    f"""WITH RECURSIVE {_ARTICLES}, s AS (SELECT doc_id, n_chars // 3 AS lo, n_chars // 3 + 120 AS hi FROM documents)
    SELECT doc_id, arg_min(win, greatest(lo, start_char) - least(hi, end_char)) AS win, CAST(max(least(hi, end_char) - greatest(lo, start_char)) AS BIGINT) AS overlap FROM s JOIN (SELECT * FROM windows ORDER BY doc_id, win) USING (doc_id) WHERE lo < end_char AND start_char < hi GROUP BY doc_id""",
)
def span_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of each article that a span of characters overlaps most; keys and bins are joined, no window meets another article's span."""
    d = table(spark, sf_dir, "documents")
    w = expanded(articles(d.select("doc_id", "text"))).select(F.col("doc_id").alias("r_id"), "win", F.col("start_char").alias("r_lo"), F.col("end_char").alias("r_hi"))
    s = d.selectExpr("doc_id", "n_chars DIV 3 AS l_lo", "n_chars DIV 3 + 120 AS l_hi")
    both = s.join(w, F.col("doc_id") == F.col("r_id")).where("l_lo < r_hi AND r_lo < l_hi")
    over = F.least("l_hi", "r_hi") - F.greatest("l_lo", "r_lo")
    best = both.groupBy("doc_id").agg(F.min(F.struct((-over).alias("o"), "win")).alias("b"))
    return best.select("doc_id", "b.win", (-F.col("b.o")).alias("overlap"))


@query(
    "aligned_spans",
    r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '\S+\s*') AS ps, length(text) - length(regexp_replace(text, '^\s+', '')) AS lead, n_chars // 4 AS lo, n_chars // 4 + 30 AS hi FROM documents),
    t AS (SELECT doc_id, lo, hi, i, lead + coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) AS a, length(rtrim(ps[i + 1], chr(32) || chr(10) || chr(9) || chr(13))) AS n FROM (SELECT *, unnest(range(0, len(ps))) AS i FROM p))
    SELECT doc_id, min(i) AS first_token, max(i) AS last_token FROM t WHERE a < hi AND lo < a + n GROUP BY doc_id""",
)
def aligned_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that a span of characters touches, by the tokens' own offsets."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"\S+\s*"), F.lit(0)).alias("ps"), (F.length("text") - F.length(F.regexp_replace("text", r"^\s+", ""))).alias("lead"), F.expr("n_chars DIV 4").alias("lo"))
    t = d.select("doc_id", "lead", "lo", F.posexplode("ps").alias("i", "piece"))
    before = F.sum(F.length("piece")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("a", F.col("lead") + F.coalesce(before, F.lit(0))).withColumn("b", F.col("a") + F.length(F.regexp_replace("piece", r"\s+$", "")))
    hit = t.where((F.col("a") < F.col("lo") + 30) & (F.col("lo") < F.col("b")))
    return hit.groupBy("doc_id").agg(F.min("i").cast("long").alias("first_token"), F.max("i").cast("long").alias("last_token"))


@query("interval_lookup", "SELECT e.event_id, CAST(least(floor(value / 40), (SELECT count(*) - 1 FROM region)) AS INT) AS region FROM events e")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first interval that ends after a value, the last one for values beyond: the few ends are one array in each row."""
    ends = F.broadcast(table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list((F.col("r_regionkey") + 1) * 40)).alias("ends")))
    return table(spark, sf_dir, "events").crossJoin(ends).select("event_id", paragraph_of(F.col("ends"), F.col("value")).alias("region"))


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


@query(
    "best_title_match",
    r"""WITH t AS (SELECT item_id, 'src' || (item_id % 20) || ' ' || ['en', 'fr', 'de', 'es'][CAST(item_id % 4 + 1 AS INT)] AS title, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM benchmark),
    d AS (SELECT doc_id, trim(regexp_replace(lower(replace(source || '_' || lang, '_', ' ')), '\s+', ' ', 'g')) AS title, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents),
    x AS (SELECT item_id, title, w, count(*) AS n FROM (SELECT item_id, title, unnest(ws) AS w FROM t) GROUP BY ALL), y AS (SELECT doc_id, title, w, count(*) AS n FROM (SELECT doc_id, title, unnest(ws) AS w FROM d) GROUP BY ALL),
    o AS (SELECT item_id, doc_id, sum(least(x.n, y.n)) AS c FROM x JOIN y USING (title, w) GROUP BY ALL),
    f AS (SELECT t.item_id, d.doc_id, coalesce(2e0 * c / (len(t.ws) + len(d.ws)), 0e0) AS f1 FROM t JOIN d USING (title) LEFT JOIN o ON o.item_id = t.item_id AND o.doc_id = d.doc_id)
    SELECT item_id, doc_id, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(f1, 9) DESC, doc_id) AS r FROM f) WHERE r = 1""",
)
def best_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the articles with an item's title, normalised, the one whose words overlap most with it: counts of words are joined, not texts. Where none shares a word, the title's smallest id has an F1 of 0."""
    langs = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("item_id") % 4 + 1).cast("int"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"), F.lit(" "), langs).alias("title"), words_of(F.col("text")).alias("ws"))
    title = T.collapse(F.lower(F.translate(F.concat("source", F.lit("_"), "lang"), "_", " ")))
    d = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), words_of(F.col("text")).alias("ws"))
    counts = lambda rows, key: rows.select(key, "title", F.explode("ws").alias("w")).groupBy(key, "title", "w").agg(F.count("*").alias(f"n_{key}"))
    common = counts(b, "item_id").join(counts(d, "doc_id"), ["title", "w"]).groupBy("item_id", "doc_id").agg(F.sum(F.least("n_item_id", "n_doc_id")).alias("c"))
    sizes = common.join(b.select("item_id", F.size("ws").alias("a")), "item_id").join(d.select("doc_id", F.size("ws").alias("b")), "doc_id")
    f1 = sizes.select("item_id", "doc_id", (2.0 * F.col("c") / (F.col("a") + F.col("b"))).alias("f1"))
    # an article that shares no word counts too, with 0: of a title's, the first one stands for all
    first = b.select("item_id", "title").join(d.groupBy("title").agg(F.min("doc_id").alias("doc_id")), "title").select("item_id", "doc_id", F.lit(0.0).alias("f1"))
    best = f1.unionByName(first).groupBy("item_id").agg(F.min(F.struct((-F.round("f1", 9)).alias("f"), "doc_id", (-F.col("f1")).alias("g"))).alias("m"))
    return best.select("item_id", "m.doc_id", F.round(-F.col("m.g"), 6).alias("f1"))


@query(
    "key_value_lines",
    "SELECT source, doc_id // 512 AS block, string_agg(doc_id || ': ' || n_chars, chr(10) ORDER BY doc_id) AS lines, '{' || string_agg('\"' || doc_id || '\": ' || n_chars, ', ' ORDER BY doc_id) || '}' AS json, 'key,value' || chr(10) || string_agg(doc_id || ',' || n_chars, chr(10) ORDER BY doc_id) AS csv FROM documents GROUP BY source, doc_id // 512",
)
def key_value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value pairs of a source as lines, JSON and CSV, a block of ids at a time."""
    g = table(spark, sf_dir, "documents").groupBy("source", F.expr("doc_id DIV 512").alias("block")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))).alias("s"))
    of = lambda form: F.transform("s", lambda x: form(x["doc_id"].cast("string"), x["n_chars"].cast("string")))
    lines = F.array_join(of(lambda k, v: F.concat(k, F.lit(": "), v)), "\n")
    json = F.concat(F.lit("{"), F.array_join(of(lambda k, v: F.concat(F.lit('"'), k, F.lit('": '), v)), ", "), F.lit("}"))
    csv = F.concat(F.lit("key,value\n"), F.array_join(of(lambda k, v: F.concat(k, F.lit(","), v)), "\n"))
    return g.select("source", "block", lines.alias("lines"), json.alias("json"), csv.alias("csv"))


@query(
    "gold_first_selection",
    """WITH g AS (SELECT l.doc_id, d.source, l.quality, md5('7:' || l.doc_id) AS h FROM labels l JOIN documents d USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quality DESC, h, doc_id) AS r FROM g)
    SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS INT) AS place FROM r WHERE r <= 6""",
)
def gold_first_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six documents of each source, gold ones first and others to fill, in a stable random order."""
    g = table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    g = g.withColumn("h", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")))
    first = g.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("quality"), "h", "doc_id"))).where("r <= 6")
    return first.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("h", "doc_id")).alias("place"))


@query(
    "passages_at_depth",
    """SELECT b.item_id, md5(array_to_string(d.texts[1:depth] || ['>> ' || b.text] || d.texts[depth + 1:], chr(10))) AS digest, depth FROM (SELECT *, CAST(floor((item_id % 10) / 10.0 * 8) AS INT) AS depth FROM benchmark) b JOIN
    (SELECT doc_id // 8 AS g, list('[' || (doc_id % 8) || '] ' || text ORDER BY doc_id) AS texts FROM documents GROUP BY ALL) d ON d.g = b.item_id""",
)
def passages_at_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text put among eight numbered passages at a relative depth, as one prompt."""
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id DIV 8").alias("item_id"), "doc_id", F.concat(F.lit("["), (F.col("doc_id") % 8).cast("string"), F.lit("] "), "text").alias("p"))
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", F.floor((F.col("item_id") % 10) / 10.0 * 8).cast("int").alias("depth"))
    g = d.join(b.select("item_id"), "item_id", "left_semi").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "p"))), lambda x: x["p"]).alias("ps")).join(b, "item_id")
    # an insertion past the end of a short list is at its end, as a slice has it
    parts = F.concat(F.slice("ps", F.lit(1), F.col("depth")), F.array(F.concat(F.lit(">> "), "text")), F.slice("ps", F.col("depth") + 1, F.greatest(F.size("ps") - F.col("depth"), F.lit(0))))
    return g.select("item_id", F.md5(F.array_join(parts, "\n").cast("binary")).alias("digest"), "depth")


_FORMS = {"bracket": ("'Document [' || doc_id || '] (Title: ' || source || ') ' || text"), "lines": "'Title: ' || source || chr(10) || text", "numbered": "'[' || doc_id || '] ' || text", "named": "doc_id || ': ' || source || ' - ' || text", "plain": "text"}
_RANKED = {"id": "'[ID: ' || doc_id || '] Document: ' || text", "passage": "'Passage ' || doc_id || ': ' || text", "bare": "'[' || doc_id || '] ' || text"}


@query(
    "render_formats",
    f"SELECT doc_id, md5(CASE doc_id % 5 {' '.join(f'WHEN {i} THEN {e}' for i, e in enumerate(_FORMS.values()))} END) AS document, md5(CASE doc_id % 3 {' '.join(f'WHEN {i} THEN {e}' for i, e in enumerate(_RANKED.values()))} END) AS passage FROM documents",
)
def render_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in five forms and ranked passages in three, the form chosen for each."""
    c, n = F.col, F.col("doc_id").cast("string")
    forms = [
        F.format_string("Document [%d] (Title: %s) %s", c("doc_id"), c("source"), "text"), F.concat_ws("\n", F.concat(F.lit("Title: "), "source"), "text"), F.concat(F.lit("["), n, F.lit("] "), "text"),
        F.concat(F.concat_ws(": ", n, "source"), F.lit(" - "), "text"), c("text"),
    ]
    ranked = [F.concat(F.lit("[ID: "), n, F.lit("] Document: "), "text"), F.format_string("Passage %d: %s", c("doc_id"), "text"), F.concat(F.lit("["), n, F.lit("] "), "text")]
    pick = lambda xs: F.md5(F.element_at(F.array(*xs), (c("doc_id") % len(xs) + 1).cast("int")).cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", pick(forms).alias("document"), pick(ranked).alias("passage"))

