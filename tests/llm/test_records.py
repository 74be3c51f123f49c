"""Mixing, WARC archives and the pipeline."""

import base64
import collections
import gzip
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.llm import mixing, queries, warc

from .conftest import table_of, words
from .test_dedup import plain_words

SF = "/root/testdata/sf0.001"


def plain_targets(sizes):
    """Sharing by weight, again and again, until no target is above three times its source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while left > 1e-9 and free:
        unit = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += unit * weight[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                free.discard(s)
    return target


def test_mixing(spark, odd, odd_rows, nothing):
    rows = odd_rows + [(1000 + i, " ".join(words(i, 5 + i * 7 % 90)), f"s{i % 7}") for i in range(300)]
    got = mixing.mix_sources(table_of(rows, spark, extra=True)).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(plain_words(t))
    targets = plain_targets(sizes)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(plain_words(t))) for i, t, _ in rows)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in got)
    seen = collections.defaultdict(int)
    for r in got:
        seen[round(r["target"], 3), r["source_size"]] += r["taken"]
    assert set(seen) == {(round(targets[s], 3), n) for s, n in sizes.items()}
    largest = collections.defaultdict(int)
    for _, t, s in rows:
        largest[s] = max(largest[s], len(plain_words(t)))
    for s, n in sizes.items():
        assert abs(seen[round(targets[s], 3), n] - targets[s]) <= largest[s]
    again = mixing.mix_sources(table_of(rows, spark).repartition(5)).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["taken"]) for r in rs)
    assert key(again) == key(got)
    assert mixing.mix_sources(nothing).count() == 0


def test_archives_round_trip(spark, tmp_path):
    pages = [
        (5, "http://a/", "<p>same</p>"), (3, "http://b/ x\n", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "u", None), (2, "u", ""), (4, "u", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\n"),
        (6, "u", "é😀\n" * 50_000), (7, "u", "x" * 300_000), (None, "u", "<p>same</p>"), (3, "http://b/ x\n", "<p>same</p>"),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("sha", F.lit(1)).withColumn("low", F.lit(2))
    path = str(tmp_path / "w")
    warc.write_archives(df.repartition(3), path)
    rows = warc.read_archives(spark, path, chunk=1000).collect()
    assert max(len(r["chunk"]) for r in rows) <= 1000
    parts = collections.defaultdict(list)
    for r in rows:
        parts[r["record_id"], r["page_id"], r["record_type"], r["refers_to"]].append(r)
    got = []
    for (_, page, kind, ref), rs in parts.items():
        rs.sort(key=lambda r: r["chunk_no"])
        last = [r for r in rs if r["last"]]
        got += [(page, kind, ref, r["payload_bytes"], r["payload_digest"]) for r in last]
        if kind == "response" and len(last) == 1:
            body = b"".join(r["chunk"] for r in rs)
            assert hashlib.sha1(body).digest() == base64.b32decode(last[0]["payload_digest"]) and len(body) == last[0]["payload_bytes"]
            for a, r in enumerate(rs):  # digests so far
                assert r["payload_digest"] == warc.base32(hashlib.sha1(b"".join(x["chunk"] for x in rs[: a + 1])).digest())
    low = {"<p>same</p>": 3, "": 1}
    want = []
    for page, _, html in pages:
        html = html or ""
        ref = low.get(html) if page is not None and page != low.get(html) else None
        want.append((page, "revisit" if ref is not None else "response", ref, len(html.encode()), warc.base32(hashlib.sha1(html.encode()).digest())))
    order = lambda x: sorted(x, key=str)
    assert order(got) == order(want)
    foreign = warc.read_foreign(spark, path + "/*.gz").where("last").collect()
    assert order((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in foreign) == order(want)
    content = b"".join(gzip.open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".gz"))
    assert content.count(b"WARC-Type: ") == len(pages)


def test_damaged_archives_are_errors():
    record = "".join(warc.record_pieces(1, "u", "abc", warc.base32(hashlib.sha1(b"abd").digest()), None)).encode()
    with pytest.raises(ValueError):
        warc.Parser().feed(record)
    cut = warc.Parser()
    cut.feed(record[:40])
    with pytest.raises(ValueError):
        cut.end()


def test_long_payloads_stream_in_bounded_memory():
    """A payload without line feeds, far longer than a chunk: no line and no buffer is longer than a chunk, and usual chunked bodies of others are read too."""
    html = "<p>é" * 3_000_000
    digest = warc.base32(hashlib.sha1(html.encode()).digest())
    parser, widest, held, rows, last = warc.Parser(keep=False), 0, 0, 0, None
    for line in warc.lines_of(warc.record_pieces(1, "u", html, digest, None)):
        widest = max(widest, len(line.encode()))
        for last in parser.feed(line.encode() + b"\n"):
            rows += 1
        held = max(held, len(parser.buffer))
    parser.end()
    assert widest <= warc.CHUNK + 2 and held <= 2 * warc.CHUNK and rows > 200
    assert last[6:] == (len(html.encode()), digest, True)
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3;x=y\r\nabc\r\n" + b"%x\r\n" % 70_000 + b"d" * 70_000 + b"\r\n0\r\nTrailer: t\r\n\r\n"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    for step in (1, 7, len(record)):
        parser, got = warc.Parser(), []
        for at in range(0, len(record), step):
            got += parser.feed(record[at : at + step])
        parser.end()
        assert b"".join(r[5] for r in got) == b"abc" + b"d" * 70_000 and [r[8] for r in got] == [False] * (len(got) - 1) + [True]


def test_empty_archives(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        at = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}{'/*.parquet' if os.path.isdir(at) else ''}')")
    want, got = con.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    plain = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_run(spark, name):
    got = queries.queries()[name](spark, SF)
    assert got.count() > 0 and "doc_id" in got.columns


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} < ids and len(out) > 0.5 * len(ids)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.withColumn("row", F.lit(1)), SF).columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, docs.limit(0), SF).count() == 0
