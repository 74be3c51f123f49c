"""WARC archives, written and read as streams of chunks.

Writing: each record is a run of lines in a text file that Spark writes with
gzip, so archives can be in any store that Spark can write, and a file is read
from its start in one piece. A payload longer than PIECE characters is written
in the chunked transfer coding of HTTP, so no line is longer than a piece,
whether or not the payload has line feeds. Reading: a parser is fed line by
line and hands out rows of record identifier and chunk number, each with the
chunk, the bytes so far and the digest so far. It holds one chunk, never a
record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import BROADCAST_IDS, new_path, read_table, written

CHUNK = 1 << 16
#: Characters of a piece of a long payload; at most CHUNK bytes.
PIECE = CHUNK // 4
#: A revisit is written for payloads of so many bytes or more.
LEAST_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROW = "record_id string, page_id bigint, record_type string, refers_to bigint, chunk_no int, chunk binary, payload_bytes bigint, payload_digest string, last boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def pieces_of(html: str) -> Iterator[str]:
    """A long payload in the chunked transfer coding."""
    for at in range(0, len(html), PIECE):
        piece = html[at : at + PIECE]
        yield f"{byte_size(piece):x}\r\n"
        yield piece
        yield "\r\n"
    yield "0\r\n\r\n"


def byte_size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def record_pieces(page_id: int | None, url: str | None, html: str, digest: str, low: int | None) -> Iterator[str]:
    """A record in pieces of bounded size. ``low``: the page that a revisit refers to, or null."""
    revisit, long = low is not None, len(html) > PIECE
    body = lambda: () if revisit else pieces_of(html) if long else (html,)
    size = sum(byte_size(html[at : at + PIECE]) for at in range(0, len(html), PIECE))
    coding = "Transfer-Encoding: chunked" if long and not revisit else f"Content-Length: {size}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{coding}\r\n\r\n"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(low, digest)}", f"X-Refers-To-Page: {low}", f"X-Payload-Length: {size}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + sum(map(byte_size, body()))}", "", ""]
    yield "\r\n".join(head)
    yield http
    yield from body()
    yield "\r\n\r\n"


def lines_of(pieces: Iterator[str]) -> Iterator[str]:
    """The lines of joined pieces, without their line feeds. The last piece ends with one."""
    held = ""
    for piece in pieces:
        *whole, rest = piece.split("\n")
        for line in whole:
            yield held + line
            held = ""
        held += rest


class Parser:
    """Feed it bytes of WARC records in any portions; it returns rows of the payloads' chunks (see ROW). A chunked transfer coding is undone."""

    def __init__(self, chunk: int = CHUNK, keep: bool = True) -> None:
        self.chunk, self.keep, self.state, self.buffer = chunk, keep, "head", bytearray()

    def feed(self, data: bytes) -> list[tuple]:
        rows: list[tuple] = []
        self.buffer += data
        while True:
            if self.state == "head":
                at = self.buffer.find(b"\r\n\r\n")
                if at < 0:
                    return rows
                self.begin(bytes(self.buffer[:at]))
                del self.buffer[: at + 4]
            elif self.state == "http":
                at = self.buffer.find(b"\r\n\r\n", 0, self.left)
                if at < 0 and len(self.buffer) < self.left:
                    return rows
                skip = at + 4 if at >= 0 else 0
                coded = b"\r\ntransfer-encoding: chunked" in bytes(self.buffer[:skip]).lower()
                self.skip(skip)
                self.state = "size" if coded and self.left else "payload"
            elif self.state == "payload":
                n = min(self.left, len(self.buffer), self.chunk)
                if n < min(self.left, self.chunk):
                    return rows
                rows.append(self.emit(self.skip(n), not self.left))
                if not self.left:
                    self.state = "tail"
            elif self.state == "size":
                at = self.buffer.find(b"\r\n", 0, self.left)
                if at < 0:
                    if len(self.buffer) >= min(self.left, 1000):
                        raise ValueError(f"record {self.headers.get('warc-record-id')} has no size of a chunk where it should")
                    return rows
                self.need = int(self.skip(at + 2).split(b";")[0], 16)
                self.state = "data" if self.need else "trailer"
            elif self.state == "data":
                n = min(self.need, len(self.buffer), self.chunk)
                if n < min(self.need, self.chunk):
                    return rows
                if self.held is not None:
                    rows.append(self.emit(self.held, False))
                self.held, self.need = self.skip(n), self.need - n
                if not self.need:
                    self.state = "end"
            elif self.state == "end":
                if len(self.buffer) < 2:
                    return rows
                self.skip(2)
                self.state = "size"
            elif self.state == "trailer":
                if len(self.buffer) < self.left:
                    return rows
                self.skip(self.left)
                rows.append(self.emit(self.held or b"", True))
                self.state = "tail"
            else:
                if len(self.buffer) < 4:
                    return rows
                if self.buffer[:4] != b"\r\n\r\n":
                    raise ValueError(f"record {self.headers.get('warc-record-id')} doesn't end where it should")
                del self.buffer[:4]
                self.state = "head"

    def skip(self, n: int) -> bytes:
        """The next ``n`` bytes of the record, which are done with."""
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.left -= n
        return out

    def begin(self, head: bytes) -> None:
        first, *rest = head.decode("utf-8", "surrogatepass").lstrip("\r\n").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record here: {first[:60]!r}")
        self.headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in rest if ":" in x)}
        self.left = int(self.headers["content-length"])
        self.state = "http" if self.headers.get("content-type", "").startswith("application/http") else "payload"
        self.sha, self.total, self.number, self.held = hashlib.sha1(), 0, 0, None

    def emit(self, chunk: bytes, last: bool) -> tuple:
        h, kind = self.headers, self.headers.get("warc-type", "")
        self.sha.update(chunk)
        self.total += len(chunk)
        stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
        total, digest = self.total, base32(self.sha.copy().digest())
        if kind == "revisit":
            total, digest = int(h.get("x-payload-length", 0)), stated
        elif last and stated and stated != digest:
            raise ValueError(f"record {h.get('warc-record-id')} has digest {digest}, not {stated}")
        number = lambda k: int(h[k]) if k in h else None
        row = (h.get("warc-record-id"), number("x-page-id"), kind, number("x-refers-to-page"), self.number, chunk if self.keep else None, total, digest, last)
        self.number += 1
        return row

    def end(self) -> None:
        if self.state != "head" or self.buffer.strip():
            raise ValueError("the archive ends within a record")


def plan_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, sha, low): the pages whose payload of ``least`` bytes or more a page with a smaller id has too, and the smallest such id."""
    small = written(pages.select("page_id", "sha", "size"), "digests")
    twice = small.where(F.col("size") >= least).groupBy("sha").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).where("low < high")
    twice = written(twice, "twice")  # so that a payload of very many pages can be split over tasks
    return written(small.join(twice, "sha").where("page_id > low").select("page_id", "sha", "low").distinct(), "revisits")


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """A WARC record for each row of ``pages`` (page_id, url, html), as .gz files of whole records under ``path``.

    A null html is an empty payload; a null url or id has no header. Of equal
    payloads the smallest id is the response and the others revisit it; rows
    that repeat that id are responses too, and so is any row with a null id.
    """
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("size"))
    revisits = plan_revisits(p, least)
    few = revisits.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    p = p.join(F.broadcast(revisits) if few else revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", "sha", "low")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines: list[str] = []
            size = 0
            for page, url, text, sha, low in zip(*batch.columns, strict=True):
                for line in lines_of(record_pieces(page.as_py(), url.as_py(), text.as_py(), base32(bytes.fromhex(sha.as_py())), low.as_py())):
                    lines.append(line)
                    size += len(line) + 1
                    if size > 1 << 21:
                        yield pa.record_batch([pa.array(lines, pa.string())], names=["value"])
                        lines, size = [], 0
            yield pa.record_batch([pa.array(lines, pa.string())], names=["value"])

    p.mapInArrow(records, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str, chunk: int = CHUNK, keep: bool = True) -> DataFrame:
    """Rows of chunks (see ROW) of the archives that write_archives made under ``path``.

    Every record has one row at least; the one marked ``last`` has the size and
    the digest of its whole payload. ``keep``: with the chunks' bytes.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(chunk, keep)
        for batch in batches:
            rows: list[tuple] = []
            for line in batch.column(0):
                rows += parser.feed(line.as_buffer().to_pybytes() + b"\n")
                if len(rows) >= 512:
                    yield table_of(rows)
                    rows = []
            yield table_of(rows)
        parser.end()

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(chunks, ROW)


def read_foreign(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of chunks of any WARC files, plain or gzip, one record to a member or many. Each file is read as one binary row, so it must fit a task."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                parser = Parser(chunk)
                for part in inflated(content.as_buffer()):
                    if rows := parser.feed(part):
                        yield table_of(rows)
                parser.end()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(chunks, ROW)


def inflated(data: pa.Buffer, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, of all its gzip members if it has any, about a MB at a time."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[i : i + step]) for i in range(0, len(view), step))
        return
    engine = zlib.decompressobj(31)
    at, rest = 0, b""
    while rest or at < len(view):
        if not rest:
            rest, at = bytes(view[at : at + step]), at + step
        yield engine.decompress(rest, step)
        rest = engine.unconsumed_tail
        if engine.eof:
            rest = engine.unused_data + rest
            engine = zlib.decompressobj(31)


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back."""
    path = new_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    rows = read_archives(spark, path, keep=False).where("last")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS x FROM p),
f AS (SELECT x, min(page_id) AS low FROM d GROUP BY x),
b AS (SELECT d.page_id, d.payload_bytes, f.low, d.x,
  list_transform(range(0, 40, 5), lambda k: CAST('0x' || substr(d.x, CAST(k + 1 AS INTEGER), 5) AS BIGINT)) AS quads FROM d JOIN f USING (x))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(quads, lambda q: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((q >> s) & 31) + 1 AS INTEGER), 1)), 'string_agg', '')), '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to FROM b
"""
