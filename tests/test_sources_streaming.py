import json

from pyspark.sql import types as T

from weftline.sources import files
from weftline.streaming import queue


def test_judgements_drop_malformed_lines(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1 Q0 d1 2\nbroken line\n 2 0 d2 0 \n")
    rows = {(r["qid"], r["pid"], r["grade"]) for r in files.judgements(spark, str(tmp_path / "q.txt")).collect()}
    assert rows == {("1", "d1", 2), ("2", "d2", 0)}


def test_results_are_tagged_from_paths(spark, tmp_path):
    place = tmp_path / "m1" / "nq"
    place.mkdir(parents=True)
    (place / "4k.jsonl").write_text("\n".join(json.dumps({"score": i / 2}) for i in range(5)) + "\n{broken\n")
    df = files.results(spark, str(place / "4k.jsonl"), T.StructType([T.StructField("score", T.DoubleType())]), per_file=3)
    rows = df.collect()
    assert len(rows) == 3 and {(r["model"], r["dataset"], r["context"]) for r in rows} == {("m1", "nq", "4k")}


def test_typed_round_trip_and_union(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2,)], "i int")
    both = files.union_configs([a, b])
    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("i", T.LongType())])
    files.write_typed(both, schema, str(tmp_path / "t.parquet"))
    back = files.scan(spark, [str(tmp_path / "t.parquet")])
    assert back.columns == ["s", "i"] and {tuple(r) for r in back.collect()} == {("x", 1), (None, 2)}


def run(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "events")
    events.repartition(3).write.parquet(path)
    run(queue.running_moments(queue.source(spark, path)), "complete", "moments")
    assert {r["event_type"]: r["n"] for r in spark.table("moments").collect()} == {r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()}
    run(queue.windowed(queue.source(spark, path)), "complete", "windows")
    assert sum(r["n"] for r in spark.table("windows").collect()) == events.count()
    run(queue.bounded_queue(queue.source(spark, path), 100, 8), "update", "queues")
    rows = spark.table("queues").collect()
    produced = {}  # every update is a running total; the largest of a type is its last
    for r in rows:
        produced[r["event_type"]] = max(r["produced"], produced.get(r["event_type"], 0))
    assert sum(produced.values()) == events.count()
    assert all(r["produced"] == r["consumed"] + r["dropped"] + r["waiting"] and r["waiting"] < 8 for r in rows)


def test_running_ids_follow_the_files(spark, tmp_path):
    import bz2

    for k in range(2):
        with bz2.open(tmp_path / f"wiki_{k}.bz2", "wt") as f:
            for i in range(300):
                f.write(json.dumps({"title": f"t{k}-{i}", "text": ["a ", f"b{i}."]}) + "\n")
    rows = files.articles(spark, str(tmp_path)).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(600))
    assert [r["title"] for r in rows] == [f"t{k}-{i}" for k in range(2) for i in range(300)] and rows[5]["text"] == "a b5."
    first = files.scan(spark, [str(tmp_path / "wiki_0.bz2")], head=3).collect()
    assert [r["title"] for r in first] == ["t0-0", "t0-1", "t0-2"]
    a, b = (files.scan(spark, [str(tmp_path / "wiki_0.bz2")], sample=20, seed=4).collect() for _ in range(2))
    assert a == b and len({r["title"] for r in a}) == 20


def test_line_offsets(spark, tmp_path):
    data = "first\nsécond\n\nlast"
    (tmp_path / "a.txt").write_text(data)
    raw = data.encode()
    got = sorted((r["line"], r["offset"], r["bytes"]) for r in files.line_offsets(spark, str(tmp_path / "a.txt")).collect())
    assert [raw[o : o + n].decode() for _, o, n in got] == data.split("\n") and [x[0] for x in got] == [0, 1, 2, 3]


def test_messages_nested_and_as_json(spark):
    text = spark.createDataFrame([(1, json.dumps([{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}])), (2, "[]")], "id int, messages string")
    want = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    assert sorted(map(tuple, files.messages(text).collect())) == want
    nested = text.selectExpr("id", "from_json(messages, 'array<struct<role: string, content: string>>') AS messages")
    assert sorted(map(tuple, files.messages(nested).collect())) == want
    pairs = spark.createDataFrame([("q", "a", "b")], "x string, y string, z string")
    assert files.preference_pairs(pairs, "x", "y", "z").collect()[0].asDict() == {"prompt": "q", "chosen": "a", "rejected": "b"}


def test_places_and_copies(spark, tmp_path):
    df = spark.range(3)
    df.write.parquet(str(tmp_path / "d" / "val_4k.parquet"))
    assert files.named_split(spark, str(tmp_path / "d"), "4k").count() == 3
    here = str(tmp_path / "d" / "val_4k.parquet")
    assert files.first_source(spark, [str(tmp_path / "none"), here]) == here
    try:
        files.first_source(spark, [str(tmp_path / "none")])
        raise AssertionError
    except FileNotFoundError:
        pass
    copy = files.cached_copy(spark, here, str(tmp_path / "cache"))
    assert copy == files.cached_copy(spark, here, str(tmp_path / "cache")) and spark.read.parquet(copy).count() == 3


def test_sinks(spark, tmp_path):
    for k in range(2):
        files.append_lines(spark.range(k + 1), str(tmp_path / "lines"))
        files.write_metrics(spark, str(tmp_path / "metrics"), k, {"loss": k / 2})
    assert spark.read.json(str(tmp_path / "lines")).count() == 3
    assert {(r["step"], r["metrics"]["loss"]) for r in spark.read.json(str(tmp_path / "metrics")).collect()} == {(0, 0.0), (1, 0.5)}
    files.save_batch(spark.range(4), str(tmp_path / "batch"), {"step": "7"})
    rows, meta = files.load_batch(spark, str(tmp_path / "batch"))
    assert rows.count() == 4 and meta == {"step": "7"}
    own, more = spark.createDataFrame([("a b",), ("a b c d",)], "prompt string"), spark.createDataFrame([("x",)], "prompt string")
    assert {r["prompt"] for r in files.grown(own, more, "prompt", 3).collect()} == {"a b", "x"}
    years = [spark.createDataFrame([("1", "d1", 2)], files.JUDGEMENTS), spark.createDataFrame([("2", "d9", 0)], files.JUDGEMENTS)]
    asked = spark.createDataFrame([("1",), ("2",), ("3",)], "qid string")
    assert {r["qid"] for r in files.judged(years, asked).collect()} == {"1", "2"}


def test_plugins(spark, tmp_path):
    import pandas as pd
    import pytest
    from pyspark.sql import functions as F

    from weftline.plans import plugins

    with pytest.raises(ValueError):
        plugins.LOSSES.register("clipped")(lambda: None)
    with pytest.raises(KeyError):
        plugins.LOSSES["other"]
    df = spark.createDataFrame([(0.5, 1.0), (-0.5, 1.0), (2.0, -1.0)], "r double, a double")
    got = [x["l"] for x in df.select(plugins.LOSSES["clipped"](F.col("r"), F.col("a")).alias("l")).collect()]
    assert got == [pytest.approx(x) for x in (-1.2, -0.6065306597126334, 3.0)]
    rewards = spark.createDataFrame([(1.0, 1200)], "s double, n int").select(*(f(F.col("s"), F.col("n"), 1000, 400).alias(k) for k, f in plugins.REWARDS.items())).first()
    assert rewards["additive"] == pytest.approx(0.5) and rewards["multiplicative"] == pytest.approx(0.5)
    pairs = spark.createDataFrame([("p", "aa", "b"), ("p", "a", "bb"), (None, "a", "b")], "prompt string, first string, second string")
    assert [r["winner"] for r in plugins.judged(pairs, "longer").collect()] == [0, 1, -1]

    @plugins.dispatched(split="g")
    def centred(part):
        return part.assign(x=part["x"] - part["x"].mean())

    @plugins.dispatched(schema="n int")
    def sizes(part):
        return pd.DataFrame({"n": [len(part)]})

    groups = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, x double")
    assert sorted(r["x"] for r in centred(groups).collect()) == [-1.0, 0.0, 1.0] and sum(r["n"] for r in sizes(groups).collect()) == 3
    sampler = plugins.CurriculumSampler("g", spark, str(tmp_path / "state"))
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(9)], "id int, g string")
    assert sampler.next_rows(rows, 4, "id").count() == 4
    sampler.update(spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.0)], "g string, score double"))
    assert {r["g"] for r in sampler.next_rows(rows, 3, "id").collect()} == {"b"}
    sampler.update(spark.createDataFrame([("a", 0.5), ("b", 1.0)], "g string, score double"))
    assert {r["g"] for r in sampler.next_rows(rows, 3, "id").collect()} == {"a"}


def test_sampler_state_survives(spark, tmp_path):
    from weftline.plans import plugins

    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(9)], "id int, g string")
    sampler = plugins.CurriculumSampler("g", spark, str(tmp_path / "state"))
    for k in range(12):
        sampler.update(spark.createDataFrame([("abc"[k % 3], k / 10), (None, 0.5)], "g string, score double"))
        depth = sampler.state()._jdf.queryExecution().logical().toString().count("\n")
        assert depth <= 2 and sampler.version() == k + 1
    (tmp_path / "state" / "v13").mkdir()  # a version that a failure cut off
    again = plugins.CurriculumSampler("g", spark, str(tmp_path / "state"))
    assert {r["g"]: r["mean"] for r in again.state().collect()} == {"a": 0.9, "b": 1.0, "c": 1.1, None: 0.5}
    assert {r["g"] for r in again.next_rows(rows, 3, "id").collect()} == {"a"}
    again.update(spark.createDataFrame([("a", 0.0)], "g string, score double"))
    assert again.version() == 13 and again.state().count() == 4
    assert len([p for p in (tmp_path / "state").iterdir() if p.is_dir()]) == 2


def test_batches_are_written_once(spark, tmp_path):
    from weftline.streaming import once

    path, schema = str(tmp_path / "sink"), "id bigint, name string"
    rows = lambda a, b: spark.range(a, b).selectExpr("id", "concat('n', id) AS name")
    assert once.committed(spark, path, schema).count() == 0
    assert once.commit_batch(rows(0, 5), path, 0) and not once.commit_batch(rows(0, 5), path, 0)
    assert once.commit_batch(rows(5, 6), path, 1) and once.committed(spark, path, schema).count() == 6
    # a failure between the lines and the commit leaves lines that nobody reads
    rows(6, 9).write.json(f"{path}/data/2-lost")
    assert once.committed(spark, path, schema).count() == 6 and once.uncommitted(spark, path) == ["2-lost"]
    assert once.commit_batch(rows(6, 9), path, 2)
    assert sorted(r["id"] for r in once.committed(spark, path, schema).collect()) == list(range(9))


def test_stream_that_fails_after_its_commit(spark, tmp_path):
    """The batch is committed, the stream fails before it knows, and tries the batch again."""
    from weftline.streaming import once

    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    path, failed = str(tmp_path / "sink"), []

    def write(df, path, batch):
        once.commit_batch(df, path, batch)
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("the driver is lost")

    for attempt in range(2):
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        started = once.lines_once(stream, path, f"{tmp_path}/checkpoint", write)
        try:
            started.awaitTermination()
        except Exception:  # noqa: BLE001  the failure that is asked for
            assert attempt == 0
    assert failed == [1] and sorted(r["id"] for r in once.committed(spark, path, "id bigint").collect()) == list(range(30))
    assert once.uncommitted(spark, path) == []
