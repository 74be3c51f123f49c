"""Rows to padded batches and nested training rows: chats, preferences, steps. A batch is eight conversations; a word's length stands for its token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import once, tokens
from weftline.plans.registry import query
from weftline.sources.tables import table

IGNORED, PAD, BATCH = -100, 0, 8


def ids(text: Column) -> Column:
    return F.transform(tokens(text), F.length)


def padded(values: Column, size: Column, value: int, left: bool = False) -> Column:
    """An array with ``value`` added up to ``size`` elements, on one side; longer ones stay."""
    fill = F.array_repeat(F.lit(value), F.greatest(size - F.size(values), F.lit(0)).cast("int"))
    return F.concat(fill, values) if left else F.concat(values, fill)


def fixed(values: Column, size: int, value: int, left: bool = False, cut: str = "right") -> Column:
    """An array of exactly ``size`` elements: padded on one side or cut on the ``left``, on the ``right`` or in the ``middle``; ``error`` refuses longer ones."""
    n, half = F.size(values), size // 2
    cuts = {
        "right": F.slice(values, 1, size), "left": F.slice(values, F.greatest(n - size + 1, F.lit(1)), F.lit(size)),
        "middle": F.concat(F.slice(values, 1, half), F.slice(values, F.greatest(n - (size - half) + 1, F.lit(1)), F.lit(size - half))),
        "error": F.when(n > size, F.raise_error(F.lit(f"longer than {size}")).cast("array<int>")).otherwise(values),
    }
    return F.when(n > size, cuts[cut]).otherwise(padded(values, F.lit(size), value, left))


def widest(length: Column, batch: str = "batch", multiple: int = 1) -> Column:
    """The largest length of a batch, raised to a multiple."""
    return F.ceil(F.max(length).over(Window.partitionBy(batch)) / multiple) * multiple


def joined(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ",")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, batch, messages): messages in the order of their turns."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return c.withColumn("batch", F.expr(f"conv_id DIV {BATCH}"))


_IDS = "list_transform(list_filter(string_split_regex({x}, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''), lambda w: length(w))"
_FILL = lambda a, n, v, left=False: f"(list_transform(range(CAST({n} - len({a}) AS BIGINT)), lambda i: {v}) || {a})" if left else f"({a} || list_transform(range(CAST({n} - len({a}) AS BIGINT)), lambda i: {v}))"
_JOIN = lambda a: f"array_to_string(list_transform({a}, lambda i: CAST(i AS VARCHAR)), ',')"


@query(
    "chat_batches",
    f"""WITH m AS (SELECT conv_id, conv_id // 8 AS batch, turn, role || ' ' || text AS s, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
    p AS (SELECT conv_id, batch, {_IDS.format(x="string_agg(s, ' ' ORDER BY turn)")}[1:64] AS ids, {_IDS.format(x="coalesce(string_agg(s, ' ' ORDER BY turn) FILTER (WHERE turn < last), '') || ' assistant'")} AS prompt FROM m GROUP BY conv_id, batch),
    n AS (SELECT *, least(len(prompt), len(ids)) AS k, max(len(ids)) OVER (PARTITION BY batch) AS w FROM p)
    SELECT conv_id, {_JOIN(_FILL('ids', 'w', 0, True))} AS input_ids, {_JOIN(_FILL('list_transform(ids, lambda i: 1)', 'w', 0, True))} AS attention, {_JOIN(_FILL('(list_transform(range(k), lambda i: -100) || ids[k + 1:])', 'w', -100, True))} AS labels FROM n""",
)
def chat_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats as left-padded batches: the tokens of all messages, cut at 64, and labels that leave out the prompt, which is all but the last message and the beginning of an answer."""
    said = lambda m: F.concat(m["role"], F.lit(" "), m["text"])
    c = chats(spark, sf_dir)
    whole = F.slice(ids(F.array_join(F.transform("messages", said), " ")), 1, 64)
    prompt = F.concat(F.array_join(F.transform(F.slice("messages", F.lit(1), F.size("messages") - 1), said), " "), F.lit(" assistant"))
    c = c.select("conv_id", "batch", whole.alias("ids"), F.least(F.size(ids(prompt)), F.size(whole)).alias("k"))
    c = c.withColumn("w", widest(F.size("ids")))
    labels = F.transform("ids", lambda x, i: F.when(i < F.col("k"), F.lit(IGNORED)).otherwise(x))
    return c.select("conv_id", joined(padded(F.col("ids"), F.col("w"), PAD, True)).alias("input_ids"), joined(padded(F.transform("ids", lambda x: F.lit(1)), F.col("w"), 0, True)).alias("attention"), joined(padded(labels, F.col("w"), IGNORED, True)).alias("labels"))


@query(
    "preference_batches",
    f"""WITH p AS (SELECT conv_id, conv_id // 8 AS batch, {_IDS.format(x="any_value(text) FILTER (WHERE turn = 0)")} AS prompt, {_IDS.format(x="coalesce(any_value(text) FILTER (WHERE turn = 1), '')")} AS chosen, {_IDS.format(x="coalesce(any_value(text) FILTER (WHERE turn = 2), '')")} AS rejected FROM conversations GROUP BY conv_id),
    n AS (SELECT *, max(len(prompt)) OVER w AS pw, max(len(chosen)) OVER w AS cw, max(len(rejected)) OVER w AS rw FROM p WINDOW w AS (PARTITION BY batch))
    SELECT conv_id, {_JOIN(_FILL('prompt', 'pw', 0, True))} AS prompt_ids, {_JOIN(_FILL('chosen', 'cw', 0))} AS chosen_ids, {_JOIN(_FILL('rejected', 'rw', 0))} AS rejected_ids, {_JOIN(_FILL('list_transform(chosen, lambda i: 1)', 'cw', 0))} AS chosen_mask FROM n""",
)
def preference_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts padded on the left, the two answers on the right, each to the widest of its batch."""
    turn = lambda k: ids(F.coalesce(F.first(F.when(F.col("turn") == k, F.col("text")), ignorenulls=True), F.lit("")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turn(0).alias("prompt"), turn(1).alias("chosen"), turn(2).alias("rejected")).withColumn("batch", F.expr("conv_id DIV 8"))
    c = c.select("*", *(widest(F.size(x)).alias(f"{x}_w") for x in ("prompt", "chosen", "rejected")))
    side = lambda x, left=False: joined(padded(F.col(x), F.col(f"{x}_w"), PAD, left)).alias(f"{x}_ids")
    return c.select("conv_id", side("prompt", True), side("chosen"), side("rejected"), joined(padded(F.transform("chosen", lambda x: F.lit(1)), F.col("chosen_w"), 0)).alias("chosen_mask"))


@query(
    "stacked_rows",
    f"""WITH r AS (SELECT conv_id, conv_id // 8 AS batch, {_IDS.format(x='text')} AS ids FROM conversations WHERE turn = 0), n AS (SELECT *, CAST(ceil(max(len(ids)) OVER (PARTITION BY batch) / 8.0) * 8 AS BIGINT) AS w FROM r)
    SELECT conv_id, w AS width, {_JOIN(_FILL('ids', 'w', -1))} AS right_padded, {_JOIN(_FILL('ids', 'w', -1, True))} AS left_padded FROM n""",
)
def stacked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a batch at a common length, a multiple of eight, padded on either side."""
    r = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.expr("conv_id DIV 8").alias("batch"), ids(F.col("text")).alias("ids"))
    r = r.withColumn("w", widest(F.size("ids"), multiple=8))
    return r.select("conv_id", F.col("w").alias("width"), joined(padded(F.col("ids"), F.col("w"), -1)).alias("right_padded"), joined(padded(F.col("ids"), F.col("w"), -1, True)).alias("left_padded"))


@query(
    "pad_or_truncate",
    f"""WITH r AS (SELECT conv_id, turn, {_IDS.format(x='text')} AS ids FROM conversations), n AS (SELECT *, len(ids) AS n, greatest(24, len(ids)) AS w FROM r)
    SELECT conv_id, turn, {_JOIN('CASE WHEN n > 24 THEN ids[1:24] ELSE ' + _FILL('ids', 'w', 0) + ' END')} AS head, {_JOIN('CASE WHEN n > 24 THEN ids[n - 23:n] ELSE ' + _FILL('ids', 'w', 0, True) + ' END')} AS tail, {_JOIN('CASE WHEN n > 24 THEN ids[1:12] || ids[n - 11:n] ELSE ' + _FILL('ids', 'w', 0) + ' END')} AS ends FROM n""",
)
def pad_or_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of exactly 24 tokens: cut at the end, at the beginning or in the middle, padded where shorter."""
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", ids(F.col("text")).alias("ids"))
    x = F.col("ids")
    return r.select("conv_id", "turn", joined(fixed(x, 24, 0)).alias("head"), joined(fixed(x, 24, 0, left=True, cut="left")).alias("tail"), joined(fixed(x, 24, 0, cut="middle")).alias("ends"))


@query(
    "masked_positions_dropped",
    "SELECT user_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE k % 3 <> 0) AS kept, count(*) FILTER (WHERE k % 3 <> 0) AS n FROM (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY user_id",
)
def masked_positions_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays without the positions that their mask leaves out; a row without any left has none."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).alias("x"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    g = g.select("user_id", F.transform("xs", lambda x: x["k"]).alias("tokens"), F.transform("xs", lambda x: x["k"] % 3 != 0).alias("mask"))
    kept = F.filter("tokens", lambda x, i: F.get("mask", i))
    return g.select("user_id", F.when(F.size(kept) > 0, joined(kept)).alias("kept"), F.size(kept).cast("long").alias("n"))


@query(
    "training_rows",
    """SELECT conv_id, '{"prompt":[' || string_agg('{"role":"' || role || '","n":' || length(text) || '}', ',' ORDER BY turn) FILTER (WHERE turn < last) || '],"data_source":"chat","reward_model":{"ground_truth":{"answer":"' || any_value(md5(text)) FILTER (WHERE turn = last) || '"}},"extra_info":{"id":' || conv_id || ',"turns":' || count(*) || '}}' AS row
    FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id HAVING count(*) > 1""",
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the nested training schema: prompt messages, source, reference answer and extras, here as JSON."""
    c = chats(spark, sf_dir).where("size(messages) > 1")
    prompt = F.transform(F.slice("messages", F.lit(1), F.size("messages") - 1), lambda m: F.struct(m["role"].alias("role"), F.length(m["text"]).alias("n")))
    truth = F.struct(F.md5(F.element_at("messages", -1)["text"].cast("binary")).alias("answer"))
    row = F.struct(prompt.alias("prompt"), F.lit("chat").alias("data_source"), F.struct(truth.alias("ground_truth")).alias("reward_model"), F.struct(F.col("conv_id").alias("id"), F.size("messages").alias("turns")).alias("extra_info"))
    return c.select("conv_id", F.to_json(row).alias("row"))


@query(
    "typed_messages",
    """SELECT conv_id, turn, '{"prompt":[{"role":"user","content":[{"type":"image"},{"type":"text","text":"' || left(md5(text), 8) || '"}]}],"images":["' || role || '.png"]}' AS row FROM conversations""",
)
def typed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings as nested typed messages, the image in a list of its own."""
    part = lambda kind, text=None: F.struct(F.lit(kind).alias("type"), (F.lit(None).cast("string") if text is None else text).alias("text"))
    short = F.substring(F.md5(F.col("text").cast("binary")), 1, 8)
    message = F.struct(F.lit("user").alias("role"), F.array(part("image"), part("text", short)).alias("content"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.array(message).alias("prompt"), F.array(F.concat("role", F.lit(".png"))).alias("images"))).alias("row"))


#: What begins a turn.
HUMAN, ASSISTANT = "\n\nHuman: ", "\n\nAssistant: "


def common_start(a: Column, b: Column) -> Column:
    """The longest common beginning of two texts."""

    def of(p: Column) -> Column:  # by halves: each step compares beginnings
        n = F.least(F.length(p["a"]), F.length(p["b"]))

        def step(s: Column, _: Column) -> Column:
            mid = F.shiftright(s["low"] + s["high"] + 1, 1)
            same = F.left(p["a"], mid) == F.left(p["b"], mid)
            return F.struct(F.when(same, mid).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(mid - 1).alias("high"))

        steps = F.sequence(F.lit(1), F.length(F.bin(n.cast("long"))))
        return F.left(p["a"], F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), step)["low"])

    return once(F.struct(a.alias("a"), b.alias("b")), of)


def dialogue(chosen: Column, rejected: Column) -> tuple[Column, Column, Column]:
    """(prompt turns, chosen, rejected) of two dialogues that begin alike; the prompt ends where an answer begins."""
    start = common_start(chosen, rejected)
    kept = F.regexp_extract(start, f"(?s)^(.*){ASSISTANT}", 1)
    n = F.length(kept) + len(ASSISTANT)
    turns = F.regexp_extract_all(F.concat(kept, F.lit(HUMAN)), F.lit(f"(?s)({ASSISTANT}|{HUMAN})(.*?)(?={ASSISTANT}|{HUMAN}|$)"), F.lit(0))
    turns = F.filter(turns, lambda t: t != HUMAN)
    messages = F.transform(turns, lambda t: F.struct(F.when(t.startswith(HUMAN), F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.regexp_replace(t, f"^({ASSISTANT}|{HUMAN})", "").alias("content")))
    return messages, F.substring(chosen, n + 1, F.length(chosen)), F.substring(rejected, n + 1, F.length(rejected))


@query(
    "dialogue_turns",
    """WITH t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) || 'Assistant: ' ORDER BY turn) FILTER (WHERE turn < 2) AS a, string_agg(CASE WHEN turn = 0 THEN 'user' ELSE 'assistant' END || '=' || md5(text), ',' ORDER BY turn) FILTER (WHERE turn < 2) AS turns, count(*) FILTER (WHERE turn < 2) AS n FROM conversations GROUP BY conv_id)
    SELECT conv_id, turns || ',user=' || md5('why') AS prompt, 'xyes' AS chosen, 'xno' AS rejected FROM t WHERE n = 2""",
)
def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dialogues of a conversation's first turns and a question, of which only the answers differ: the common turns and the two answers."""
    c = table(spark, sf_dir, "conversations").where("turn < 2").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m")).where("size(m) = 2")
    said = F.concat(F.lit(HUMAN), F.col("m")[0]["text"], F.lit(ASSISTANT), F.col("m")[1]["text"], F.lit(HUMAN + "why" + ASSISTANT + "x"))
    messages, chosen, rejected = dialogue(F.concat(said, F.lit("yes")), F.concat(said, F.lit("no")))
    turns = F.array_join(F.transform(messages, lambda x: F.concat(x["role"], F.lit("="), F.md5(x["content"].cast("binary")))), ",")
    return c.select("conv_id", turns.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"))


MARK = "ⶻ"


def stepwise(text: Column, label: Column) -> tuple[Column, Column, Column]:
    """(prompt, steps, labels) of a solution with a mark after each step, whose label has + or - in the mark's place.

    The first step begins in the prompt at "Step 1:", else at "step 1:", else
    after its question mark; a prompt without any of these is an error.
    """
    parts = F.split(text, MARK)
    size = F.transform(parts, F.length)
    places = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(size, F.lit(1), i), F.lit(0), lambda a, n: a + n) + i)
    labels = F.transform(places, lambda p: F.substring(label, p, F.lit(1)) == "+")
    head = F.get(parts, F.lit(0))
    at = lambda mark: F.instr(head, mark)
    cut = F.when(at("Step 1:") > 0, at("Step 1:")).when(at("step 1:") > 0, at("step 1:")).when(at("?") > 0, at("?") + 1).otherwise(F.raise_error(F.lit("no first step in the prompt")).cast("int"))
    steps = F.concat(F.array(F.substring(head, cut, F.length(head))), F.slice(parts, F.lit(2), F.size(parts) - 2))
    return F.trim(F.left(head, cut - 1)), F.transform(steps, lambda x: F.trim(x)), labels


@query(
    "step_labels",
    """SELECT doc_id, md5(trim(replace(replace(replace(text, '?', ''), 'Step 1:', ''), 'step 1:', '')) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '?' END) AS prompt, md5(CASE WHEN doc_id % 2 = 0 THEN 'Step 1: ' ELSE '' END || source || '|Step 2: ' || lang || '|Step 3: end') AS steps,
    CASE WHEN doc_id % 3 = 0 THEN '1' ELSE '0' END || ',1,' || CASE WHEN n_chars % 2 = 0 THEN '1' ELSE '0' END AS labels FROM documents""",
)
def step_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions cut at their marks, with a label for each step."""
    head = F.regexp_replace("text", r"\?|[Ss]tep 1:", "")
    first = F.when(F.col("doc_id") % 2 == 0, F.concat(head, F.lit(" Step 1: "), "source")).otherwise(F.concat(F.trim(head), F.lit("? "), "source"))
    parts = [first, F.concat(F.lit(" Step 2: "), "lang"), F.lit(" Step 3: end")]
    signs = [F.when(F.col("doc_id") % 3 == 0, F.lit("+")).otherwise(F.lit("-")), F.lit("+"), F.when(F.col("n_chars") % 2 == 0, F.lit("+")).otherwise(F.lit("-"))]
    text = F.concat(*(F.concat(p, F.lit(MARK)) for p in parts))
    label = F.concat(*(F.concat(F.repeat(F.lit("."), F.length(p)), s) for p, s in zip(parts, signs, strict=True)))
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"), label.alias("l"))
    prompt, steps, labels = stepwise(F.col("t"), F.col("l"))
    return d.select("doc_id", F.md5(F.regexp_replace(prompt, r"^ +| +$", "").cast("binary")).alias("prompt"), F.md5(F.array_join(steps, "|").cast("binary")).alias("steps"), F.array_join(F.transform(labels, lambda x: x.cast("int").cast("string")), ",").alias("labels"))


def is_conversational(schema: T.StructType) -> bool:
    """Whether the first of prompt, chosen, rejected, completion and messages that a row has is a list of messages with role and content."""
    for name in ("prompt", "chosen", "rejected", "completion", "messages"):
        if name in schema.fieldNames():
            kind = schema[name].dataType
            inner = kind.elementType if isinstance(kind, T.ArrayType) else None
            return isinstance(inner, T.StructType) and {"role", "content"} <= set(inner.fieldNames())
    return False


@query("conversational_tables", "SELECT * FROM (VALUES ('messages', true), ('texts', false), ('other', false)) t(kind, conversational)")
def conversational_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three forms of the conversations are lists of messages, by their schemas alone."""
    c = chats(spark, sf_dir)
    forms = {"messages": c.select(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("prompt")), "texts": c.select(F.col("messages")[0]["text"].alias("prompt")), "other": c.select("conv_id")}
    return spark.createDataFrame([(k, is_conversational(f.schema)) for k, f in forms.items()], "kind string, conversational boolean")


@query(
    "relabelled",
    "WITH p AS (SELECT label, row_number() OVER (ORDER BY md5('5:' || label)) - 1 AS number FROM (SELECT DISTINCT label FROM embeddings)) SELECT vec_id, CAST(number AS INT) AS number, 'label ' || number AS name FROM embeddings JOIN p USING (label)",
)
def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as numbers by a random permutation, and as names; the few labels are one small table."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    order = F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit("5:"), F.col("label").cast("string")).cast("binary")))) - 1
    p = v.select("label").distinct().select("label", order.alias("number"))
    return v.join(p, "label").select("vec_id", "number", F.concat(F.lit("label "), F.col("number").cast("string")).alias("name"))


@query(
    "same_label_subset",
    "SELECT a.vec_id, b.vec_id AS demo, CAST(b.rn AS INT) AS place FROM embeddings a JOIN (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) b ON a.label = b.label WHERE b.rn <= 6 AND a.vec_id <> b.vec_id AND b.rn - CASE WHEN a.vec_id IN (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r < b.rn AND r <= 6) THEN 1 ELSE 0 END <= 5",
)
def same_label_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row the first five others with its label: the first six of a label are a small table, which every row meets."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    first = v.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("place <= 6").withColumnRenamed("vec_id", "demo")
    both = v.join(first, "label").where("vec_id <> demo")
    own = first.select(F.col("demo").alias("vec_id"), F.col("place").alias("own"))
    both = both.join(own, "vec_id", "left").where(F.col("place") - F.when(F.col("own") < F.col("place"), 1).otherwise(0) <= 5)
    return both.select("vec_id", "demo", "place")


@query(
    "prefix_rows",
    "SELECT conv_id, turn, count(*) OVER w AS turns, md5(string_agg(role || ': ' || text, chr(10)) OVER w) AS digest FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def prefix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each prefix of a conversation, with its messages."""
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    c = chats(spark, sf_dir).select("conv_id", lines.alias("lines"), F.transform("messages", lambda m: m["turn"]).alias("turns"))
    rows = F.transform("lines", lambda x, i: F.struct(F.get("turns", i).alias("turn"), (i + 1).cast("long").alias("turns"), F.md5(F.array_join(F.slice("lines", F.lit(1), i + 1), "\n").cast("binary")).alias("digest")))
    return c.select("conv_id", F.explode(rows).alias("r")).select("conv_id", "r.*")
