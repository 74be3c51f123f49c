"""Exact quantiles of groups of any size, by counting.

Each wanted rank lies in a range of values, at first the whole group's. A pass
counts a range's values in buckets, which partial aggregates
reduce before any shuffle, and the bucket that holds the rank is the next
range. A range of one value is the answer. No task holds a group's values, and
what a pass shuffles doesn't depend on how many there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.metrics import RES, SPARK_RES
from weftline.operators.postings import few, stored
from weftline.operators.tasks import _picked, pick
from weftline.plans.registry import query
from weftline.sources.tables import table

#: Buckets of a range in a pass.
BUCKETS = 4096
_MOST, _LEAST = 1.7976931348623157e308, 5e-324


def bucket(v: Column, lo: Column, hi: Column) -> Column:
    """The bucket of a value between ``lo`` and ``hi``: never smaller for a larger value, and others for the ends.

    Buckets are of equal width, or of equal ratio in a range whose ends differ
    in sign or by more than a factor of BUCKETS, so that a few passes reach any value.
    """
    size = lambda x: F.greatest(F.least(F.abs(x), F.lit(_MOST)), F.lit(_LEAST))
    order = lambda x: F.signum(x) * (F.log2(size(x)) + 1075)
    half = lambda x: F.least(F.greatest(x, F.lit(-_MOST)), F.lit(_MOST)) / 2  # noqa: E731  halves, as a difference may be infinite
    share = lambda f: (f(v) - f(lo)) / (f(hi) - f(lo))
    wide = (F.signum(lo) != F.signum(hi)) | (F.greatest(size(lo), size(hi)) / BUCKETS > F.least(size(lo), size(hi)))
    within = F.floor(F.when(wide, share(order)).otherwise(share(half)) * BUCKETS)
    return F.when(v == lo, 0).when(v == hi, BUCKETS - 1).otherwise(F.least(F.greatest(within, F.lit(0)), F.lit(BUCKETS - 1))).cast("int")


def exact_quantiles(df: DataFrame, group: list[str], value: str, wanted: list[float] | DataFrame) -> DataFrame:
    """(group..., q, quantile) of ``value`` with linear interpolation between neighbours, as percentile() has.

    ``wanted``: the quantiles of every group, or a table (group..., q) of each
    group's own. Nulls and nan are left out; a group without values has no
    row; a null group is a group. Infinite values are values.
    """
    same = lambda a, b: reduce(lambda x, y: x & y, [a[g].eqNullSafe(b[g]) for g in group], F.lit(True))
    v = df.select(*group, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    sizes = stored(v.groupBy(*group).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    if isinstance(wanted, list):
        asked = sizes.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in wanted))))
    else:
        w = wanted.distinct()
        asked = sizes.join(w, same(sizes, w)).select(*(sizes[g] for g in group), "n", "lo", "hi", w["q"].cast("double").alias("q"))
    asked = asked.withColumn("place", F.col("q") * (F.col("n") - 1))
    sides = F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place"))))
    now = stored(asked.select(*group, "q", "place", "lo", "hi", sides.alias("rank"), F.lit(0).cast("bigint").alias("before")))
    done = now.where("lo = hi")
    while (open_ := now.where("lo < hi")).limit(1).count():
        ranges = few(stored(open_.select(*(F.col(g).alias(f"r_{g}") for g in group), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi")).distinct()))
        match = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"r_{g}")) for g in group], F.col("v").between(F.col("r_lo"), F.col("r_hi")))
        counts = v.join(ranges, match).groupBy(*group, "r_lo", "r_hi", bucket(F.col("v"), F.col("r_lo"), F.col("r_hi")).alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("z"))
        below = Window.partitionBy(*group, "r_lo", "r_hi").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("below", F.coalesce(F.sum("c").over(below), F.lit(0)))
        counts = counts.select(*(F.col(g).alias(f"r_{g}") for g in group), "r_lo", "r_hi", "c", "a", "z", "below")
        at = F.col("rank") - F.col("before")
        match = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"r_{g}")) for g in group], (F.col("lo") == F.col("r_lo")) & (F.col("hi") == F.col("r_hi")) & (F.col("below") <= at) & (at < F.col("below") + F.col("c")))
        now = stored(open_.join(counts, match).select(*group, "q", "place", F.col("a").alias("lo"), F.col("z").alias("hi"), "rank", (F.col("before") + F.col("below")).alias("before")))
        done = done.unionByName(now.where("lo = hi"))
    ends = done.groupBy(*group, "q", "place").agg(F.min("lo").alias("a"), F.max("lo").alias("b"))
    return ends.select(*group, "q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("quantile"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT category, value, k FROM {SPARK_RES}", events=table(spark, sf_dir, "events"))


@query("percentile_threshold", f"SELECT category, round(quantile_cont(value, 0.4), 6) AS threshold FROM {RES} GROUP BY category")
def percentile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_quantiles(scores(spark, sf_dir), ["category"], "value", [0.4]).select("category", F.round("quantile", 6).alias("threshold"))


@query(
    "selective_thresholds",
    f"""WITH r AS {RES}, t AS (SELECT category, quantile_cont(value, [0.3, 0.5, 0.7]) AS qs, count(*) AS n FROM r GROUP BY category),
    c AS (SELECT t.category, q, t.n, (SELECT count(*) FROM r WHERE r.category = t.category AND r.value > q) AS passing FROM (SELECT category, n, unnest(qs) AS q FROM t) t)
    SELECT category, round(q, 6) AS threshold, CAST(passing AS BIGINT) AS passing FROM c WHERE passing * 1e0 / n BETWEEN 0.4 AND 0.8""",
)
def selective_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles as thresholds; those that let in too few or too many are no candidates."""
    r = scores(spark, sf_dir)
    q = stored(exact_quantiles(r, ["category"], "value", [0.3, 0.5, 0.7]))
    c = r.join(few(q), "category").groupBy("category", "quantile").agg(F.count_if(F.col("value") > F.col("quantile")).alias("passing"), F.count("*").alias("n"))
    return c.where((F.col("passing") / F.col("n")).between(0.4, 0.8)).select("category", F.round("quantile", 6).alias("threshold"), "passing")


#: Tries for a pair of conditions, the percentiles that thresholds are drawn from, the share of rows that may pass, and the comparators.
TRIES, PERCENT, SHARE = 10, (30, 70), (0.05, 0.95)
COMPARATORS = (">", "<", ">=", "<=")
_ATTRIBUTES = ("value", "k")
_PASSES = " OR ".join(f"(cm = {i} AND x {o} threshold)" for i, o in enumerate(COMPARATORS))


@query(
    "threshold_conditions",
    f"""WITH r AS {RES}, g AS (SELECT DISTINCT category FROM r),
    w AS (SELECT category, unnest([{", ".join(f"struct_pack(t := {t}, c := {c}, p := CAST({_picked(*PERCENT, f'pc{t}{c}', 'category')} AS INT), cm := CAST({_picked(0, 3, f'cm{t}{c}', 'category')} AS INT))" for t in range(TRIES) for c in range(2))}]) AS s FROM g),
    sorted AS (SELECT category, list_sort(list(value)) AS vs, list_sort(list(CAST(k AS DOUBLE))) AS ks, count(*) AS n FROM r GROUP BY category),
    th AS (SELECT category, s.t AS t, s.c AS c, s.cm AS cm, CASE WHEN s.c = 0 THEN vs ELSE ks END AS xs, s.p / 100e0 * (n - 1) AS place FROM w JOIN sorted USING (category)),
    tv AS (SELECT category, t, c, cm, xs[CAST(floor(place) AS INT) + 1] + (xs[CAST(ceil(place) AS INT) + 1] - xs[CAST(floor(place) AS INT) + 1]) * (place - floor(place)) AS threshold FROM th),
    ok AS (SELECT tv.category, t, event_id, bool_and({_PASSES}) AS good FROM (SELECT category, event_id, unnest([struct_pack(c := 0, x := value), struct_pack(c := 1, x := CAST(k AS DOUBLE))], recursive := true) FROM r) r JOIN tv ON tv.category = r.category AND tv.c = r.c GROUP BY ALL),
    f AS (SELECT category, t, count(*) FILTER (WHERE good) AS passing, count(*) AS n FROM ok GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN passing * 1e0 / n BETWEEN {SHARE[0]} AND {SHARE[1]} THEN t ELSE 100 - t END) AS o FROM f)
    SELECT b.category, CAST(b.t AS INT) AS try, passing, round((SELECT threshold FROM tv WHERE tv.category = b.category AND tv.t = b.t AND c = 0), 6) AS value_threshold, round((SELECT threshold FROM tv WHERE tv.category = b.category AND tv.t = b.t AND c = 1), 6) AS k_threshold FROM b WHERE o = 1""",
)
def threshold_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each category two conditions whose thresholds are random percentiles: the first of ten tries that lets in 5 to 95 percent, else the last. All tries' thresholds are found together, and one pass counts what each lets in."""
    r = scores(spark, sf_dir)
    tries = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(c).alias("c"), (pick(*PERCENT, f"pc{t}{c}", F.col("category")) / 100.0).alias("q"), pick(0, 3, f"cm{t}{c}", F.col("category")).cast("int").alias("cm")) for t in range(TRIES) for c in range(2)))
    asked = stored(r.select("category").distinct().select("category", F.explode(tries).alias("s")).select("category", "s.t", "s.c", "s.q", "s.cm"))
    found = None
    for c, a in enumerate(_ATTRIBUTES):
        mine = asked.where(F.col("c") == c)
        q = exact_quantiles(r, ["category"], a, mine.select("category", "q"))
        found = (x := mine.join(q, ["category", "q"])) if found is None else found.unionByName(x := mine.join(q, ["category", "q"]))
    conditions = stored(found.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "c", "cm", "quantile"))), lambda s: F.struct(s["cm"].alias("cm"), s["quantile"].alias("threshold"))).alias("cs")))

    def holds(x: Column, s: Column) -> Column:
        return F.when(s["cm"] == 0, x > s["threshold"]).when(s["cm"] == 1, x < s["threshold"]).when(s["cm"] == 2, x >= s["threshold"]).otherwise(x <= s["threshold"])

    each = [F.count_if(holds(F.col("value"), F.col("cs")[2 * t]) & holds(F.col("k"), F.col("cs")[2 * t + 1])) for t in range(TRIES)]
    passing = r.join(few(conditions), "category").groupBy("category").agg(F.array(*each).alias("passing"), F.count("*").alias("n"), F.first("cs").alias("cs"))
    fit = F.filter(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda t: (F.get("passing", t) / F.col("n")).between(*SHARE))
    chosen = passing.withColumn("try", F.coalesce(F.get(fit, F.lit(0)), F.lit(TRIES - 1)))
    of = lambda c: F.round(F.get("cs", 2 * F.col("try") + c)["threshold"], 6)
    return chosen.select("category", "try", F.get("passing", F.col("try")).alias("passing"), of(0).alias("value_threshold"), of(1).alias("k_threshold"))
