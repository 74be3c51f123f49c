"""Questions of several hops as joins along a path of facts.

Knowledge is a graph: paragraphs, each with a title and the titles it names.
A hop joins where a path stands with the paragraphs of that title and goes on
to one that they name and the path hasn't visited. Three plans use it: facts
that name their titles, decompositions whose steps are answered one after the
other, and chains of evidence that meet.

Orders, customers, nations, regions and suppliers are the paragraphs here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.sources.tables import table

#: (subject, relation, object) of the star schema: what each row's paragraph says. Titles carry their kind.
_LINKS = """SELECT 'order ' || o_orderkey AS subject, 'placed by' AS relation, 'customer ' || o_custkey AS object FROM {orders}
UNION ALL SELECT 'customer ' || c_custkey, 'lives in', 'nation ' || c_nationkey FROM {customer}
UNION ALL SELECT 'supplier ' || s_suppkey, 'lives in', 'nation ' || s_nationkey FROM {supplier}
UNION ALL SELECT 'nation ' || n_nationkey, 'lies in', 'region ' || n_regionkey FROM {nation}"""
_DUCK = _LINKS.replace("{", "").replace("}", "")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, relation, object)."""
    return spark.sql(_LINKS, **{t: table(spark, sf_dir, t) for t in ("orders", "customer", "supplier", "nation")})


def hop(paths: DataFrame, facts: DataFrame, relation: str | None = None) -> DataFrame:
    """``paths`` (id, at, visited array, said array) one hop further along ``facts``: a path that goes nowhere new ends. Hot titles are split by the session's skew joins."""
    f = facts if relation is None else facts.where(F.col("relation") == relation)
    on = paths.join(f, F.col("at") == F.col("subject")).where(~F.array_contains("visited", F.col("object")))
    said = F.concat_ws(" ", "subject", "relation", "object")
    return on.select("id", F.col("object").alias("at"), F.array_append("visited", F.col("object")).alias("visited"), F.array_append("said", said).alias("said"))


def begun(rows: DataFrame) -> DataFrame:
    """Paths of ``rows`` (id, at), no hop made."""
    return rows.select("id", "at", F.array("at").alias("visited"), F.array().cast("array<string>").alias("said"))


@query(
    "hops_by_titles",
    f"""WITH f AS ({_DUCK}), q AS (SELECT o_orderkey AS id, 'order ' || o_orderkey AS t1, CASE WHEN o_orderkey % 5 = 0 THEN 'customer -1' ELSE 'customer ' || o_custkey END AS t2 FROM orders WHERE o_totalprice > 100000),
    t AS (SELECT id, unnest([t1, t2]) AS title FROM q), g AS (SELECT DISTINCT id, title, relation, object FROM t JOIN f ON subject = title)
    SELECT id, string_agg(title || ' ' || relation || ' ' || object, '. ' ORDER BY title) AS paragraphs, string_agg(title, '|||' ORDER BY title) AS titles FROM g GROUP BY id HAVING count(DISTINCT title) >= 2""",
)
def hops_by_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose facts name two titles: the paragraphs of these, where both are there. A question with a title that no paragraph has is dropped."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    wrong = F.col("o_orderkey") % 5 == 0  # annotations that name the wrong title
    named = F.array(F.concat(F.lit("order "), "o_orderkey"), F.when(wrong, "customer -1").otherwise(F.concat(F.lit("customer "), "o_custkey")))
    t = o.select(F.col("o_orderkey").alias("id"), F.explode(named).alias("title"))
    found = t.join(links(spark, sf_dir), F.col("title") == F.col("subject")).select("id", "title", F.concat_ws(" ", "title", "relation", "object").alias("said")).distinct()
    g = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("title", "said"))).alias("ps")).where(F.size(F.array_distinct(F.col("ps.title"))) >= 2)
    return g.select("id", F.array_join("ps.said", ". ").alias("paragraphs"), F.array_join("ps.title", "|||").alias("titles"))


@query(
    "hops_by_steps",
    """SELECT o_orderkey AS id, 'Who placed order ' || o_orderkey || '? Where does #1 live? Where does #2 lie?' AS question, 'customer ' || c_custkey || ' > nation ' || n_nationkey || ' > region ' || n_regionkey AS steps,
    r_name AS answer FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey % 3 = 0""",
)
def hops_by_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as steps, each about the answer of the one before (#1, #2): three hops, whose last title's name is the answer. A step without an answer drops the question."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    paths, facts = begun(o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), "o_orderkey").alias("at"))), links(spark, sf_dir)
    for relation in ("placed by", "lives in", "lies in"):
        paths = hop(paths, facts, relation)
    names = table(spark, sf_dir, "region").select(F.concat(F.lit("region "), "r_regionkey").alias("at"), F.col("r_name").alias("answer"))
    question = F.concat(F.lit("Who placed "), F.get("visited", F.lit(0)), F.lit("? Where does #1 live? Where does #2 lie?"))
    return paths.join(names, "at").select("id", question.alias("question"), F.array_join(F.slice("visited", 2, 3), " > ").alias("steps"), "answer")


@query(
    "hops_that_meet",
    f"""WITH RECURSIVE f AS ({_DUCK}), q AS (SELECT DISTINCT l_orderkey * 1000000 + l_suppkey AS id, l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 25),
    w AS (SELECT id, 0 AS side, 'order ' || l_orderkey AS at, ['order ' || l_orderkey] AS visited FROM q UNION ALL SELECT id, 1, 'supplier ' || l_suppkey, ['supplier ' || l_suppkey] FROM q),
    p AS (SELECT * FROM w UNION ALL SELECT p.id, p.side, f.object, p.visited || [f.object] FROM p JOIN f ON f.subject = p.at WHERE len(p.visited) < 5 AND NOT list_contains(p.visited, f.object)),
    m AS (SELECT a.id, a.visited AS va, b.visited AS vb, a.at, row_number() OVER (PARTITION BY a.id ORDER BY len(a.visited) + len(b.visited), a.at) AS r FROM p a JOIN p b ON a.id = b.id AND a.side = 0 AND b.side = 1 AND a.at = b.at)
    SELECT id, array_to_string(va, ' > ') AS order_side, array_to_string(vb, ' > ') AS supplier_side, m."at" AS answer FROM m WHERE r = 1""",
)
def hops_that_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an order's customer and a supplier have in common: two chains of evidence, each hop by hop with what it has visited, until they meet at the nearest title; pairs that never meet are dropped."""
    q = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity > 25").select((F.col("l_orderkey") * 1000000 + F.col("l_suppkey")).alias("id"), "l_orderkey", "l_suppkey").distinct()
    facts, sides = links(spark, sf_dir), []
    for kind, key in (("order ", "l_orderkey"), ("supplier ", "l_suppkey")):
        paths = every = begun(q.select("id", F.concat(F.lit(kind), key).alias("at")))
        for _ in range(4):
            paths = hop(paths, facts)
            every = every.unionByName(paths)
        sides.append(every.select("id", "at", "visited"))
    a, b = sides[0].withColumnRenamed("visited", "va"), sides[1].withColumnRenamed("visited", "vb")
    best = a.join(b, ["id", "at"]).groupBy("id").agg(F.min(F.struct((F.size("va") + F.size("vb")).alias("n"), "at", "va", "vb")).alias("m"))
    return best.select("id", F.array_join("m.va", " > ").alias("order_side"), F.array_join("m.vb", " > ").alias("supplier_side"), F.col("m.at").alias("answer"))
