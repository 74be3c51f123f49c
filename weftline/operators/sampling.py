"""Splits, quotas, permutations and baselines over groups. Chance is an MD5 of the row's key: the same on every run and in any engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.groupstats import RO, rollouts
from weftline.plans.registry import query
from weftline.sources.tables import table


def number(*parts: Column | str) -> Column:
    """A whole number of 32 bits that depends on the parts."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def chance(*parts: Column | str) -> Column:
    """A number over 0, up to 1."""
    return (number(*parts) + 1) / float(2**32)


_NUMBER = lambda text: f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def global_rank(rows: DataFrame, order: Column, ties: str, within: str | None = None) -> DataFrame:
    """``rows`` with ``place``, from 0, by a 32-bit number and then by ``ties``, of each ``within``. Counts of 1,024 ranges of the number give offsets, so no window holds all rows."""
    keys = [within] if within else []
    d = rows.withColumn("_n", order).withColumn("_range", F.shiftright("_n", 22))
    counts = d.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "_range", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_n", ties)) - 1
    return d.withColumn("_own", own).join(before, [*keys, "_range"]).withColumn("place", F.col("_before") + F.col("_own")).drop("_n", "_range", "_own", "_before")


@query(
    "quota_split",
    """WITH p AS (SELECT doc_id, lang = 'en' AS chunk, row_number() OVER (PARTITION BY lang = 'en' ORDER BY doc_id) AS rn FROM documents), n AS (SELECT count(*) FILTER (WHERE chunk) AS c, count(*) FILTER (WHERE NOT chunk) AS o, CAST(count(*) * 0.7 AS BIGINT) AS t FROM p),
    q AS (SELECT least(c, CAST(floor(t * 0.9) AS BIGINT) + greatest(0, t - CAST(floor(t * 0.9) AS BIGINT) - o)) AS qc, least(o, t - CAST(floor(t * 0.9) AS BIGINT) + greatest(0, CAST(floor(t * 0.9) AS BIGINT) - c)) AS qo FROM n)
    SELECT doc_id, chunk FROM p, q WHERE rn <= CASE WHEN chunk THEN qc ELSE qo END""",
)
def quota_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pools with a share each; what one lacks the other gives. The first rows of each are kept: places come from counts of blocks of ids."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "en").alias("chunk"), F.expr("doc_id DIV 4096").alias("block"))
    counts = d.groupBy("chunk", "block").agg(F.count("*").alias("n"))
    before = counts.select("chunk", "block", F.coalesce(F.sum("n").over(Window.partitionBy("chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    t = F.round(F.sum("n") * 0.7).cast("long")
    sizes = counts.agg(F.coalesce(F.sum(F.when(F.col("chunk"), F.col("n"))), F.lit(0)).alias("c"), F.coalesce(F.sum(F.when(~F.col("chunk"), F.col("n"))), F.lit(0)).alias("o"), t.alias("t"))
    want = F.floor(F.col("t") * 0.9)
    quota = sizes.select(F.least("c", want + F.greatest(F.lit(0), F.col("t") - want - F.col("o"))).alias("qc"), F.least("o", F.col("t") - want + F.greatest(F.lit(0), want - F.col("c"))).alias("qo"))
    placed = d.join(before, ["chunk", "block"]).withColumn("rn", F.col("before") + F.row_number().over(Window.partitionBy("chunk", "block").orderBy("doc_id")))
    return placed.crossJoin(F.broadcast(quota)).where(F.col("rn") <= F.when(F.col("chunk"), F.col("qc")).otherwise(F.col("qo"))).select("doc_id", "chunk")


_SPLIT = "SELECT 'd' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'p', page_id FROM pages"


@query(
    "split_and_shuffle",
    f"""WITH s AS (SELECT kind, id, CASE WHEN {_NUMBER("'3:' || kind || ':' || id")} % 100 < 5 THEN 'test' ELSE 'train' END AS split, {_NUMBER("'4:' || kind || ':' || id")} AS h FROM ({_SPLIT}))
    SELECT kind, id, split, CAST(row_number() OVER (PARTITION BY split ORDER BY h, kind || id) - 1 AS BIGINT) AS place FROM s""",
)
def split_and_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources, each split by a hash of its key, joined and shuffled: every row's place in its split."""
    rows = table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id")).union(table(spark, sf_dir, "pages").select(F.lit("p"), "page_id"))
    rows = rows.withColumn("split", F.when(number("3", F.col("kind"), F.col("id")) % 100 < 5, "test").otherwise("train")).withColumn("tie", F.concat("kind", F.col("id").cast("string")))
    return global_rank(rows, number("4", F.col("kind"), F.col("id")), "tie", "split").select("kind", "id", "split", "place")


@query(
    "minibatches",
    f"SELECT epoch, event_id, CAST((row_number() OVER (PARTITION BY epoch ORDER BY {_NUMBER("epoch || ':9:' || event_id")}, event_id) - 1) // 128 AS BIGINT) AS batch FROM events, range(2) t(epoch)",
)
def minibatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of batches of 128 rows, each in an order of its own."""
    e = table(spark, sf_dir, "events").select("event_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("epoch"))
    placed = global_rank(e, number(F.col("epoch"), "9", F.col("event_id")), "event_id", "epoch")
    return placed.select("epoch", "event_id", F.floor(F.col("place") / 128).alias("batch"))


def divided(rows: int, size: int) -> int:
    """Batches of ``size`` in ``rows`` rows, which it must divide."""
    if rows % size:
        raise ValueError(f"{rows} rows don't make batches of {size}")
    return rows // size


@query(
    "permuted_columns",
    f"SELECT lo + rn - 1 AS place, source, lang FROM (SELECT source, lang, min(doc_id) OVER (PARTITION BY doc_id // 64) AS lo, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY {_NUMBER("'8:' || doc_id")}, doc_id) AS rn FROM documents)",
)
def permuted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One permutation of all columns within batches of 64 ids."""
    w = Window.partitionBy(F.expr("doc_id DIV 64"))
    lo, rn = F.min("doc_id").over(w), F.row_number().over(w.orderBy(number("8", F.col("doc_id")), "doc_id"))
    return table(spark, sf_dir, "documents").select((lo + rn - 1).alias("place"), "source", "lang")


@query("derived_seeds", f"SELECT doc_id, {_NUMBER("'42:' || doc_id || ':plan'")} AS seed, {_NUMBER("'42:' || doc_id || ':text'")} % 21 + 80 AS size FROM documents")
def derived_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed for each row from a base seed, its number and a salt, and a whole number from 80 to 100."""
    return table(spark, sf_dir, "documents").select("doc_id", number("42", F.col("doc_id"), "plan").alias("seed"), (number("42", F.col("doc_id"), "text") % 21 + 80).alias("size"))


@query(
    "filled_samples",
    f"""WITH d AS (SELECT doc_id, source, lang, {_NUMBER("'6:' || doc_id")} AS h FROM documents), own AS (SELECT source, doc_id, p FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS p FROM d WHERE lang = 'fr') WHERE p <= 6),
    pool AS (SELECT doc_id, h FROM d ORDER BY h, doc_id LIMIT 60), need AS (SELECT s.source, 6 - count(own.doc_id) AS n FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN own USING (source) GROUP BY s.source),
    more AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS p, n FROM need, pool WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.source = need.source AND own.doc_id = pool.doc_id))
    SELECT source, doc_id, 'own' AS origin FROM own UNION ALL SELECT source, doc_id, 'pool' FROM more WHERE p <= n""",
)
def filled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six French documents of each source by chance; what is missing comes from a pool of 60 documents of all sources."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", number("6", F.col("doc_id")).alias("h"))
    own = d.where("lang = 'fr'").withColumn("p", F.row_number().over(Window.partitionBy("source").orderBy("h", "doc_id"))).where("p <= 6").select("source", "doc_id")
    pool = F.broadcast(d.select("doc_id", "h").orderBy("h", "doc_id").limit(60))
    need = d.select("source").distinct().join(own.groupBy("source").agg(F.count("*").alias("have")), "source", "left").select("source", (6 - F.coalesce("have", F.lit(0))).alias("n"))
    more = need.where("n > 0").crossJoin(pool).join(own, ["source", "doc_id"], "left_anti")
    more = more.withColumn("p", F.row_number().over(Window.partitionBy("source").orderBy("h", "doc_id"))).where("p <= n")
    return own.select("source", "doc_id", F.lit("own").alias("origin")).union(more.select("source", "doc_id", F.lit("pool")))


@query(
    "weighted_round_robin",
    f"""WITH q AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pass, sum(n_chars) OVER (PARTITION BY source) AS w FROM documents)
    SELECT doc_id, pass FROM (SELECT doc_id, pass, row_number() OVER (ORDER BY pass, round(-ln(({_NUMBER("'2:' || pass || ':' || source")} + 1) / 4294967296.0) / w, 15), source) AS r FROM q WHERE pass <= 100) WHERE r <= 100""",
)
def weighted_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each source in a pass, sources in a random order that favours long ones, 100 in all: the first 100 of a source are enough."""
    total = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("w"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("pass", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("pass <= 100").join(total, "source")
    key = F.round(-F.ln(chance("2", F.col("pass"), F.col("source"))) / F.col("w"), 15)
    return d.orderBy("pass", key, "source").limit(100).select("doc_id", F.col("pass").cast("long").alias("pass"))


_RAGGED = "SELECT conv_id, turn, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS n FROM conversations"


@query("ragged_concat", f"SELECT conv_id, turn, n AS size, CAST(coalesce(sum(n) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at FROM ({_RAGGED})")
def ragged_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged rows as one flat array: the offset of each. Sums of conversations in blocks of 512 come first, so no window holds all rows."""
    from weftline.functions.text import tokens

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tokens(F.col("text"))).cast("long").alias("size"), F.expr("conv_id DIV 512").alias("block"))
    totals = c.groupBy("block").agg(F.sum("size").alias("t"))
    before = totals.select("block", F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("size").over(Window.partitionBy("block").orderBy("conv_id", "turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("own", own).join(before, "block").select("conv_id", "turn", "size", (F.col("before") + F.col("own")).alias("start_at"))


# --- trajectories ---

GAMMA, LAMBDA = 0.875, 0.5
_STEPS = f"SELECT user_id, event_type, event_id, value AS r, k * 0.5e0 AS v, CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS m, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM {RO}"
_WHITE = lambda x: f"round(CASE WHEN m = 1 THEN (x - mean) / sqrt(var + 1e-8) ELSE 0 END, 6) AS {x} FROM o, (SELECT avg(x) AS mean, var_samp(x) AS var FROM o WHERE m = 1)"


def masked_returns(steps: Column, gamma: float) -> Column:
    """Returns of an array of (r, m), last to first: a masked step passes nothing on to the one before it."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("run"))

    def step(a: Column, s: Column) -> Column:
        x = s["r"] + gamma * a["run"]
        return F.struct(F.array_append(a["out"], x).alias("out"), (x * s["m"]).alias("run"))

    return F.reverse(F.aggregate(F.reverse(steps), start, step, lambda a: a["out"]))


def masked_gae(steps: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages of an array of (r, v, m), last to first: a masked step keeps the next value and the advantage after it."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("a"), F.lit(0.0).alias("v"))

    def step(acc: Column, s: Column) -> Column:
        new = s["r"] + gamma * acc["v"] - s["v"] + gamma * lam * acc["a"]
        a, v = F.when(s["m"] == 1, new).otherwise(acc["a"]), F.when(s["m"] == 1, s["v"]).otherwise(acc["v"])
        return F.struct(F.array_append(acc["out"], a).alias("out"), a.alias("a"), v.alias("v"))

    return F.reverse(F.aggregate(F.reverse(steps), start, step, lambda a: a["out"]))


def whitened(rows: DataFrame, name: str) -> DataFrame:
    """(event_id, name): ``x`` standardised over the rows with mask 1, 0 for the others; the two moments are one row."""
    moments = rows.where("m = 1").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("var"))
    w = (F.col("x") - F.col("mean")) / F.sqrt(F.col("var") + 1e-8)
    return rows.crossJoin(F.broadcast(moments)).select("event_id", F.round(F.when(F.col("m") == 1, w).otherwise(0.0), 6).alias(name))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of steps for each user and type."""
    m = F.when(F.col("k") % 5 == 0, 0).otherwise(1)
    s = F.struct("event_id", F.col("value").alias("r"), (F.col("k") * 0.5).alias("v"), m.alias("m"))
    return rollouts(spark, sf_dir).groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(s)).alias("s"))


@query(
    "masked_returns",
    f"""WITH RECURSIVE s AS ({_STEPS}), g AS (SELECT user_id, event_type, event_id, rn, m, r AS x FROM s WHERE rn = 1 UNION ALL
    SELECT s.user_id, s.event_type, s.event_id, s.rn, s.m, s.r + 0.875e0 * g.x * g.m FROM s JOIN g ON s.user_id = g.user_id AND s.event_type = g.event_type AND s.rn = g.rn + 1), o AS (SELECT * FROM g) SELECT event_id, {_WHITE('ret')}""",
)
def masked_returns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted returns that masked steps reset, whitened over the unmasked ones."""
    t = trajectories(spark, sf_dir).withColumn("x", masked_returns(F.col("s"), GAMMA))
    return whitened(t.select(F.explode(F.arrays_zip("s", "x")).alias("z")).select("z.s.event_id", "z.s.m", "z.x"), "ret")


@query(
    "masked_advantages",
    f"""WITH RECURSIVE s AS ({_STEPS}), g AS (SELECT user_id, event_type, event_id, rn, m, CASE WHEN m = 1 THEN r - v ELSE 0e0 END AS x, CASE WHEN m = 1 THEN v ELSE 0e0 END AS nv FROM s WHERE rn = 1 UNION ALL
    SELECT s.user_id, s.event_type, s.event_id, s.rn, s.m, CASE WHEN s.m = 1 THEN s.r + 0.875e0 * g.nv - s.v + 0.4375e0 * g.x ELSE g.x END, CASE WHEN s.m = 1 THEN s.v ELSE g.nv END
    FROM s JOIN g ON s.user_id = g.user_id AND s.event_type = g.event_type AND s.rn = g.rn + 1), o AS (SELECT * FROM g) SELECT event_id, {_WHITE('adv')}""",
)
def masked_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised advantages that carry over masked steps, whitened over the others."""
    t = trajectories(spark, sf_dir).withColumn("x", masked_gae(F.col("s"), GAMMA, LAMBDA))
    return whitened(t.select(F.explode(F.arrays_zip("s", "x")).alias("z")).select("z.s.event_id", "z.s.m", "z.x"), "adv")


@query(
    "turn_weighted_baseline",
    f"""WITH s AS (SELECT user_id, event_type, event_id, value, k, row_number() OVER t AS pos, count(*) OVER (PARTITION BY user_id, event_type) AS len, sum(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS ret, sum(k + 1) OVER t AS w FROM {RO} WHERE k % 5 <> 0 WINDOW t AS (PARTITION BY user_id, event_type ORDER BY event_id)),
    l AS (SELECT user_id, event_type, len, row_number() OVER (PARTITION BY user_id ORDER BY len DESC, event_type) AS r, count(*) OVER (PARTITION BY user_id) AS n, lead(len) OVER (PARTITION BY user_id ORDER BY len DESC, event_type) AS nxt FROM (SELECT DISTINCT user_id, event_type, len FROM s)),
    b AS (SELECT s.*, sum(ret * w) OVER p / (sum(w) OVER p + 1e-8) AS base, l.n, l.r, l.nxt FROM s JOIN l USING (user_id, event_type) WINDOW p AS (PARTITION BY s.user_id, pos))
    SELECT event_id, round(ret - CASE WHEN n = 1 OR (r = 1 AND pos > nxt) THEN 0 ELSE base END, 5) AS adv FROM b""",
)
def turn_weighted_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns over a trajectory's unmasked steps less the baseline of their step, weighted by the path so far, among a prompt's trajectories; none where there is one trajectory, nor beyond the second longest."""
    t = Window.partitionBy("user_id", "event_type")
    s = rollouts(spark, sf_dir).where("k % 5 <> 0").select(
        "user_id", "event_type", "event_id", F.row_number().over(t.orderBy("event_id")).alias("pos"), F.count("*").over(t).alias("len"), F.sum("value").over(t.orderBy(F.desc("event_id"))).alias("ret"), F.sum(F.col("k") + 1).over(t.orderBy("event_id")).alias("w"),
    )
    u = Window.partitionBy("user_id").orderBy(F.desc("len"), "event_type")
    lengths = s.select("user_id", "event_type", "len").distinct().select("user_id", "event_type", F.row_number().over(u).alias("r"), F.lead("len").over(u).alias("nxt"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    p = Window.partitionBy("user_id", "pos")
    base = F.sum(F.col("ret") * F.col("w")).over(p) / (F.sum("w").over(p) + 1e-8)
    b = s.join(lengths, ["user_id", "event_type"]).withColumn("base", base)
    none = (F.col("n") == 1) | ((F.col("r") == 1) & F.coalesce(F.col("pos") > F.col("nxt"), F.lit(False)))
    return b.select("event_id", F.round(F.col("ret") - F.when(none, 0.0).otherwise(F.col("base")), 5).alias("adv"))


@query(
    "runs_with_stop",
    f"""WITH s AS (SELECT user_id, event_id, k < 40 AS cut, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM {RO}), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, cut ORDER BY i) AS island FROM s),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id, cut, island ORDER BY i) AS run FROM g), f AS (SELECT user_id, min(i) AS stop FROM c WHERE cut AND run = 3 GROUP BY user_id) SELECT c.user_id, c.event_id FROM c LEFT JOIN f USING (user_id) WHERE stop IS NULL OR i <= stop""",
)
def runs_with_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's results up to the third truncated one in a row, after which the evaluation stops; all where that doesn't occur."""
    u = Window.partitionBy("user_id").orderBy("event_id")
    s = rollouts(spark, sf_dir).select("user_id", "event_id", (F.col("k") < 40).cast("int").alias("cut"))
    third = (F.sum("cut").over(u.rowsBetween(-2, 0)) == 3) & (F.count("*").over(u.rowsBetween(-2, 0)) == 3)
    s = s.withColumn("third", third)
    seen = F.coalesce(F.max(F.col("third").cast("int")).over(u.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.withColumn("seen", seen).where("seen = 0").select("user_id", "event_id")


@query(
    "controller_values",
    f"""WITH RECURSIVE s AS (SELECT user_id, event_id, least(greatest(value / 30e0 - 1, -0.2), 0.2) * 0.01 AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM {RO}),
    c AS (SELECT user_id, event_id, i, 0.2e0 * (1 + e) AS x FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.event_id, s.i, c.x * (1 + s.e) FROM s JOIN c ON s.user_id = c.user_id AND s.i = c.i + 1) SELECT event_id, round(x, 8) AS value FROM c""",
)
def controller_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An adaptive coefficient after each step of a user: a product of positive factors in order, as a sum of logarithms."""
    e = F.least(F.greatest(F.col("value") / 30.0 - 1, F.lit(-0.2)), F.lit(0.2)) * 0.01
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rollouts(spark, sf_dir).select("event_id", F.round(0.2 * F.exp(F.sum(F.log1p(e)).over(w)), 8).alias("value"))


#: Seconds in which a token comes back, and the tokens of a full bucket. A division by the period is rounded once; a rate would be rounded before it is multiplied.
PERIOD, BURST = 21600.0, 3.0


def rate_limited(events: DataFrame, period: float = PERIOD, burst: float = BURST) -> DataFrame:
    """(event_id, allowed, tokens): a token bucket for each user that gains one in ``period`` seconds up to ``burst``; an event takes a token if there is one. A user's events are one task's."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "event_id"])
        tokens, last, rows = burst, None, []
        for i, t in zip(part["event_id"], part["t"], strict=True):
            tokens = min(burst, tokens + (0 if last is None else (t - last) / period))
            allowed = tokens >= 1
            tokens, last = tokens - allowed, t
            rows.append((i, bool(allowed), tokens))
        return pd.DataFrame(rows, columns=["event_id", "allowed", "tokens"])

    e = events.select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return e.groupBy("user_id").applyInPandas(one, "event_id bigint, allowed boolean, tokens double")


@query(
    "rate_limited",
    """WITH RECURSIVE s AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS i FROM events),
    b AS (SELECT user_id, event_id, t, i, true AS allowed, 2e0 AS tokens FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.event_id, s.t, s.i, least(3e0, b.tokens + (s.t - b.t) / 21600e0) >= 1, least(3e0, b.tokens + (s.t - b.t) / 21600e0) - CASE WHEN least(3e0, b.tokens + (s.t - b.t) / 21600e0) >= 1 THEN 1 ELSE 0 END
    FROM s JOIN b ON s.user_id = b.user_id AND s.i = b.i + 1) SELECT event_id, allowed FROM b""",
)
def rate_limited_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limited(table(spark, sf_dir, "events")).select("event_id", "allowed")
