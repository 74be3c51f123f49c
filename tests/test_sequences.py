"""Sums in the order of events, and a token's period that divides."""

import json
import random

import pyarrow as pa
import pyarrow.parquet as pq

from weftline.operators import corrections, sampling


def test_tokens_come_back_after_whole_periods(spark):
    seconds, rows = 0, []
    for i, gap in enumerate([0, 0, 0, 15475, 21352, 6373]):
        seconds += gap
        rows.append((i, 1, 1_700_000_000 + seconds))
    e = spark.createDataFrame(rows, "event_id bigint, user_id bigint, t bigint").selectExpr("event_id", "user_id", "timestamp_seconds(t) AS ts")
    assert [r["allowed"] for r in sampling.rate_limited(e).orderBy("event_id").collect()] == [True, True, True, False, True, True]


def test_statistics_sum_in_the_order_of_events(spark, tmp_path):
    r = random.Random(1)

    def total(vs):  # one addition after the other; sum() compensates
        x = 0.0
        for v in vs:
            x += -(v - 30) / 60.0
        return x

    rows, n = [], 0
    while n < 20:  # groups whose sum is -3, or just below it if the last event comes first
        vs = [round(r.uniform(0, 120), 2) for _ in range(3)]
        vs.append(round(300 - sum(vs), 2))
        if total(vs) >= -3.0 > total([vs[3], *vs[:3]]):
            rows += [(n * 10 + i, n, "view", v) for i, v in enumerate(vs)]
            n += 1
    late = [x for x in rows if x[0] % 10 == 3] + [(100_000 + i, 1000 + i, "click", float(i)) for i in range(5000)]
    (tmp_path / "events.parquet").mkdir()
    # the larger file is read first
    for name, part in (("a", [x for x in rows if x[0] % 10 < 3]), ("b", late)):
        columns = dict(zip(("event_id", "user_id", "event_type", "value"), zip(*part, strict=True), strict=True))
        pq.write_table(pa.table({k: list(v) for k, v in columns.items()} | {"props": [json.dumps({"k": 1})] * len(part)}), tmp_path / "events.parquet" / f"{name}.parquet")
    masks = {x["event_id"]: x["seq_sum_k1"] for x in corrections.rejection_masks(spark, str(tmp_path)).collect()}
    assert all(masks[i] for i, *_ in rows)


def test_a_title_without_common_words_has_its_first_article(spark, tmp_path):
    from weftline.operators import articles

    pq.write_table(pa.table({"item_id": [1, 2], "text": ["alpha beta", "gamma " + "delta " * 60]}), tmp_path / "benchmark.parquet")
    docs = [(7, "nothing alike", "src1", "fr"), (5, "nor this", "src1", "fr"), (9, "gamma", "src2", "de"), (8, "none", "src2", "de")]
    pq.write_table(pa.table(dict(zip(("doc_id", "text", "source", "lang"), map(list, zip(*docs, strict=True)), strict=True))), tmp_path / "documents.parquet")
    got = {tuple(r) for r in articles.best_title_match(spark, str(tmp_path)).collect()}
    assert got == {(1, 5, 0.0), (2, 9, round(2 / 62, 6))}
