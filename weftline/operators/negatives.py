"""What a question is given beside its own documents: ranked, dense and random ones that hold no answer, with backfill; and the lookups of such plans.

An item of the benchmark asks; its answers are its fourth and sixth words where
they have four letters or more; documents whose id is divisible by seven are
excluded. The embedding with a document's id is its vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.articles import _ARTICLES, articles, expanded
from weftline.operators.postings import bm25, few, stored
from weftline.operators.retrieval import _BM25, _DOT, dot, vector_top_k
from weftline.plans.registry import query
from weftline.sources.tables import table

DEPTH = 40
_WORDS = "list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"
_ANSWERS = f"items AS (SELECT item_id, list_filter([{_WORDS}[4], {_WORDS}[6]], lambda w: length(w) >= 4) AS answers FROM benchmark)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, text, answers)."""
    b = table(spark, sf_dir, "benchmark")
    ws = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    return b.select("item_id", "text", F.filter(F.array(F.get(ws, F.lit(3)), F.get(ws, F.lit(5))), lambda w: F.length(w) >= 4).alias("answers"))


def without_answers(candidates: DataFrame, asked: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates (item_id, doc_id, ...) whose document holds none of the item's answers, in any case. Texts meet the few candidates, not the items."""
    both = candidates.join(asked.select("item_id", "answers"), "item_id").join(docs.select("doc_id", F.lower("text").alias("body")), "doc_id")
    return both.where(~F.exists("answers", lambda a: F.contains(F.col("body"), a))).drop("answers", "body")


def best(candidates: DataFrame, n: int | Column, *order: Column | str) -> DataFrame:
    """The first ``n`` of each item."""
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("place") <= n)


_HELD = "list_bool_or(list_transform(answers, lambda a: contains(lower(d.text), a)))"


@query(
    "ranked_negatives",
    f"WITH {_BM25}, {_ANSWERS} SELECT item_id, doc_id, CAST(p AS INT) AS place FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS p FROM (SELECT r.item_id, r.doc_id, r.rank FROM r JOIN items USING (item_id) JOIN documents d ON d.doc_id = r.doc_id WHERE r.rank <= {DEPTH} AND r.doc_id % 7 <> 0 AND NOT coalesce({_HELD}, false))) WHERE p <= 5",
)
def ranked_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-ranked documents that are not excluded and hold no answer."""
    asked, docs = items(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text")
    ranked = bm25(asked.select("item_id", "text"), docs, DEPTH).where("doc_id % 7 <> 0")
    return best(without_answers(ranked, asked, docs), 5, "rank").select("item_id", "doc_id", "place")


def dense(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    """(item_id, doc_id, rank): the vectors nearest to that with the item's id. Items are counted and meet the vectors in blocks; each partition of vectors ranks them by itself first."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q"))
    return vector_top_k(q.select(F.col("item_id").alias("vec_id"), F.col("q").alias("embedding")), v, depth).select(F.col("qid").alias("item_id"), F.col("vec_id").alias("doc_id"), F.col("rank").cast("int").alias("rank"))


_DENSE = f"dn AS (SELECT item_id, doc_id, rank FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.vec_id AS item_id, v.vec_id AS doc_id, round({_DOT}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND v.vec_id <> q.vec_id)) WHERE rank <= {DEPTH})"
#: Draws that mixed candidates come from, and how many an item tries that still lacks random ones.
DRAWN, ATTEMPTS = 64, 1000


def _random(draws: int) -> str:
    return f"""pl AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents),
    rn AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY min(j)) AS rank FROM (SELECT item_id, j, CAST('0x' || substr(md5(item_id || ':' || j), 1, 15) AS BIGINT) AS h FROM items, range({draws}) t(j)) x JOIN pl ON place = h % n GROUP BY item_id, doc_id)"""


_CLEAN = lambda name, source: f"{name} AS (SELECT x.item_id, x.doc_id, x.rank FROM {source} x JOIN items USING (item_id) JOIN documents d ON d.doc_id = x.doc_id WHERE x.doc_id % 7 <> 0 AND NOT coalesce({_HELD}, false))"


@query(
    "dense_negatives",
    f"WITH {_ANSWERS}, {_DENSE}, {_CLEAN('c', 'dn')} SELECT item_id, doc_id, CAST(p AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS p FROM c) WHERE p <= 5",
)
def dense_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, docs = items(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text")
    return best(without_answers(dense(spark, sf_dir, DEPTH).where("doc_id % 7 <> 0"), asked, docs), 5, "rank").select("item_id", "doc_id", "place")


def placed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, place): a written table of dense places from 0 in the order of the key, from the sizes of its ranges."""
    ranged = stored(docs.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("low"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(ranged.join(F.broadcast(sizes.select("part", (before - F.col("low")).alias("shift"))), part == F.col("part")).select(key, (F.col("at") + F.col("shift")).alias("place")))


def random_draws(asked: DataFrame, places: DataFrame, low: int, high: int) -> DataFrame:
    """(item_id, doc_id, draw): what each item's draws from ``low`` to below ``high`` take, a uniform place each; of equal ones the first counts. Rows are as many as draws, whatever the number of documents."""
    n = places.count()
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("item_id").cast("string"), F.col("j").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    drawn = asked.select("item_id", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("j")).select("item_id", "j", (h % F.lit(max(n, 1))).alias("place"))
    return places.join(few(stored(drawn)), "place").groupBy("item_id", "doc_id").agg(F.min("j").alias("draw"))


def random_candidates(spark: SparkSession, sf_dir: str, draws: int = DRAWN) -> DataFrame:
    """(item_id, doc_id, rank): the distinct documents of an item's draws, in their order."""
    found = random_draws(table(spark, sf_dir, "benchmark").select("item_id"), placed(table(spark, sf_dir, "documents")), 0, draws)
    return found.select("item_id", "doc_id", F.row_number().over(Window.partitionBy("item_id").orderBy("draw")).alias("rank"))


@query(
    "random_negatives",
    f"WITH {_ANSWERS}, {_random(ATTEMPTS)}, {_CLEAN('c', 'rn')} SELECT item_id, doc_id, CAST(p AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS p FROM c) WHERE p <= 5",
)
def random_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each item that its draws meet first and that neither are excluded nor hold an answer. Items that lack some after DRAWN draws go on, up to ATTEMPTS."""
    asked, docs = stored(items(spark, sf_dir)), table(spark, sf_dir, "documents").select("doc_id", "text")
    places = placed(docs)
    clean = lambda rows, low, high: without_answers(random_draws(rows, places, low, high).where("doc_id % 7 <> 0"), rows, docs).select("item_id", "doc_id", "draw")
    found = stored(clean(asked, 0, DRAWN))
    lacking = stored(asked.join(few(stored(found.groupBy("item_id").count().where("count >= 5"))), "item_id", "left_anti"))
    if lacking.limit(1).count():
        more = clean(lacking, DRAWN, ATTEMPTS).join(found.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
        found = found.unionByName(more)
    return best(found, 5, "draw").select("item_id", "doc_id", "place")


def thirds(n: Column) -> dict[str, Column]:
    """How many of ``n`` each source gives: a third, the remainder to dense, then to ranked."""
    third = F.floor(n / 3)
    return {"dense": third + (n % 3 >= 1).cast("int"), "ranked": third + (n % 3 == 2).cast("int"), "random": third}


@query(
    "mixed_negatives",
    f"""WITH {_BM25}, {_ANSWERS}, {_DENSE}, {_random(DRAWN)}, bm AS (SELECT item_id, doc_id, rank FROM r WHERE rank <= {DEPTH}), {_CLEAN('cd', 'dn')}, {_CLEAN('cb', 'bm')}, {_CLEAN('cr', 'rn')},
    n AS (SELECT item_id, 5 + item_id % 4 AS n FROM benchmark),
    a AS (SELECT item_id, doc_id, 0 AS src, rank FROM (SELECT c.*, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS p FROM cd c) JOIN n USING (item_id) WHERE p <= n // 3 + CASE WHEN n % 3 >= 1 THEN 1 ELSE 0 END),
    b AS (SELECT item_id, doc_id, 1 AS src, rank FROM (SELECT c.*, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS p FROM cb c ANTI JOIN a USING (item_id, doc_id)) JOIN n USING (item_id) WHERE p <= n // 3 + CASE WHEN n % 3 = 2 THEN 1 ELSE 0 END),
    ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
    x AS (SELECT item_id, doc_id, 2 AS src, rank FROM (SELECT c.*, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS p FROM cr c ANTI JOIN ab USING (item_id, doc_id)) JOIN n USING (item_id) WHERE p <= n // 3),
    chosen AS (SELECT * FROM ab UNION ALL SELECT * FROM x),
    rest AS (SELECT item_id, doc_id, min(src * 100000 + rank) AS k FROM (SELECT *, 3 AS src FROM cd UNION ALL SELECT *, 4 FROM cb UNION ALL SELECT *, 5 FROM cr) q ANTI JOIN chosen USING (item_id, doc_id) GROUP BY ALL),
    every AS (SELECT item_id, doc_id, src * 100000 + rank AS k FROM chosen UNION ALL SELECT item_id, doc_id, k FROM rest)
    SELECT item_id, doc_id, CAST(p AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k) AS p FROM every) JOIN n USING (item_id) WHERE p <= n""",
)
def mixed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five to eight for each item: thirds from dense, ranked and random, each without those before; what a source lacks is filled from the others in that order."""
    asked, docs = items(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text")
    ranked = bm25(asked.select("item_id", "text"), docs, DEPTH).select("item_id", "doc_id", F.col("rank").cast("int").alias("rank"))
    lists = [dense(spark, sf_dir, DEPTH), ranked, random_candidates(spark, sf_dir)]
    clean = [without_answers(c.where("doc_id % 7 <> 0"), asked, docs).select("item_id", "doc_id", "rank") for c in lists]
    need = asked.select("item_id", (5 + F.col("item_id") % 4).alias("n"))
    chosen = None
    for k, (c, part) in enumerate(zip(clean, thirds(F.col("n")).values(), strict=True)):
        fresh = c if chosen is None else c.join(chosen.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")
        mine = best(fresh.join(need, "item_id"), part, "rank").select("item_id", "doc_id", (F.lit(k * 100000) + F.col("rank")).alias("k"))
        chosen = mine if chosen is None else chosen.union(mine)
    rest = None
    for k, c in enumerate(clean):
        more = c.select("item_id", "doc_id", (F.lit((3 + k) * 100000) + F.col("rank")).alias("k"))
        rest = more if rest is None else rest.union(more)
    rest = rest.join(chosen.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti").groupBy("item_id", "doc_id").agg(F.min("k").alias("k"))
    return best(chosen.union(rest).join(need, "item_id"), F.col("n"), "k").select("item_id", "doc_id", "place")


_PARAGRAPHS = "SELECT doc_id * 1000 + generate_subscripts(ls, 1) - 1 AS doc_id, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10))[1:1000] AS ls FROM documents)"


@query("paragraph_top_k", f"WITH paragraphs AS ({_PARAGRAPHS}), {_BM25.replace('FROM documents', 'FROM paragraphs')} SELECT item_id, doc_id AS paragraph_id, score, rank FROM r WHERE rank <= 5")
def paragraph_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over paragraphs, from an index that is written once; a paragraph's id is its document's times 1,000 plus its place, of which a document has no more here."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 1000)).alias("p", "text"))
    return bm25(table(spark, sf_dir, "benchmark"), d.select((F.col("doc_id") * 1000 + F.col("p")).alias("paragraph_id"), "text"), 5, did="paragraph_id")


@query(
    "needed_keys",
    """SELECT 'needed' AS kind, CAST(key AS VARCHAR) AS name, 1 AS n FROM (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_totalprice > 50000 AND o_orderkey % 5 <> 0) UNION ALL
    SELECT 'skipped', CASE WHEN o_totalprice <= 50000 THEN 'no answers' ELSE 'no provenance' END, CAST(count(*) AS INT) FROM orders WHERE o_totalprice <= 50000 OR o_orderkey % 5 = 0 GROUP BY 2""",
)
def needed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct keys of usable rows, and how many were skipped for which reason, in one pass over the rows."""
    reason = F.when(F.col("o_totalprice") <= 50000, "no answers").when(F.col("o_orderkey") % 5 == 0, "no provenance")
    o = table(spark, sf_dir, "orders").select(F.coalesce(reason, F.col("o_custkey").cast("string")).alias("name"), F.when(reason.isNull(), "needed").otherwise("skipped").alias("kind"))
    return o.groupBy("kind", "name").agg(F.count("*").alias("c")).select("kind", "name", F.when(F.col("kind") == "needed", 1).otherwise(F.col("c")).cast("int").alias("n"))


@query(
    "lookup_by_title",
    "WITH d AS (SELECT doc_id, trim(regexp_replace(lower(replace('  ' || upper(source) || '__' || lang, '_', ' ')), ' +', ' ', 'g')) AS title FROM documents) SELECT q.item_id, d.doc_id FROM (SELECT item_id, 'src' || (item_id % 25) || ' ' || ['en', 'de'][CAST(item_id % 2 + 1 AS INT)] AS title FROM benchmark) q LEFT JOIN d USING (title)",
)
def lookup_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with an item's title, both normalised; an item without any keeps a row."""
    title = F.concat(F.lit("  "), F.upper("source"), F.lit("__"), "lang")
    title = F.trim(F.regexp_replace(F.lower(F.translate(title, "_", " ")), " +", " "))
    d = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"))
    lang = F.when(F.col("item_id") % 2 == 0, "en").otherwise("de")
    q = table(spark, sf_dir, "benchmark").select("item_id", F.concat_ws(" ", F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string")), lang).alias("title"))
    return q.join(d, "title", "left").select("item_id", "doc_id")


@query(
    "title_keys",
    "SELECT doc_id, CAST(k AS BIGINT) AS key_id FROM documents JOIN (SELECT lower(lang || ' ' || source) AS t, dense_rank() OVER (ORDER BY min(doc_id)) - 1 AS k FROM documents GROUP BY 1) ON t = lower(lang || ' ' || source)",
)
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number for each title in the order in which titles first appear. Titles are few beside documents; they alone are ranked."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.concat_ws(" ", "lang", "source")).alias("t"))
    keys = d.groupBy("t").agg(F.min("doc_id").alias("first")).withColumn("key_id", (F.row_number().over(Window.orderBy("first")) - 1).cast("long"))
    return d.join(keys, "t").select("doc_id", "key_id")


@query(
    "topped_up",
    f"WITH {_BM25}, {_ANSWERS}, c AS (SELECT r.item_id, r.doc_id, r.rank FROM r JOIN items USING (item_id) JOIN documents d ON d.doc_id = r.doc_id WHERE r.rank <= {DEPTH} AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.doc_id) AND NOT EXISTS (SELECT 1 FROM documents j JOIN labels l USING (doc_id) WHERE lower(trim(j.text)) = lower(trim(d.text))) AND NOT coalesce({_HELD}, false)) SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS p FROM c) WHERE p <= 3 - item_id % 3",
)
def topped_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three documents for an item that has too few: ranked ones that aren't judged, don't repeat a judged text and hold no answer."""
    asked, docs = items(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.md5(F.lower(F.trim("text")).cast("binary"))
    judged = table(spark, sf_dir, "labels").select("doc_id").distinct()
    texts = docs.join(judged, "doc_id", "left_semi").select(digest.alias("h")).distinct()
    ranked = bm25(asked.select("item_id", "text"), docs, DEPTH).join(judged, "doc_id", "left_anti")
    ranked = ranked.join(docs.select("doc_id", digest.alias("h")), "doc_id").join(texts, "h", "left_anti")
    return best(without_answers(ranked, asked, docs), 3 - F.col("item_id") % 3, "rank").select("item_id", "doc_id")


@query("unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x * 9))), 5) AS length, CAST(1.0 AS DOUBLE) AS unit FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled to length one, with the length that they had."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e"))
    length = F.sqrt(dot(F.col("e"), F.col("e")))
    unit = F.transform("e", lambda x: x / length)
    return v.select("vec_id", F.round(length, 5).alias("length"), F.round(F.sqrt(dot(unit, unit)), 9).alias("unit"))


_WINDOW_DOCS = "wdocs AS (SELECT doc_id * 10000 + win AS doc_id, chunk AS text FROM windows)"


@query(
    "window_negatives",
    f"WITH RECURSIVE {_ARTICLES}, {_WINDOW_DOCS}, {_BM25.replace('FROM documents', 'FROM wdocs')}, {_ANSWERS} SELECT item_id, window_id, CAST(p AS INT) AS place FROM (SELECT r.item_id, r.doc_id AS window_id, row_number() OVER (PARTITION BY r.item_id ORDER BY r.rank) AS p FROM r JOIN items USING (item_id) JOIN wdocs d ON d.doc_id = r.doc_id WHERE r.rank <= {DEPTH} AND (r.doc_id // 10000) % 7 <> 0 AND NOT coalesce({_HELD}, false)) WHERE p <= 5",
)
def window_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-ranked windows of articles that aren't excluded and hold no answer; a window's id is its document's times 10,000 plus its place."""
    w = expanded(articles(table(spark, sf_dir, "documents").select("doc_id", "text"))).select((F.col("doc_id") * 10000 + F.col("win")).alias("doc_id"), "text")
    ranked = bm25(items(spark, sf_dir).select("item_id", "text"), w, DEPTH).where("(doc_id DIV 10000) % 7 <> 0")
    return best(without_answers(ranked, items(spark, sf_dir), w), 5, "rank").select("item_id", F.col("doc_id").alias("window_id"), "place")
