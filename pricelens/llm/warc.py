"""Web archives in WARC form, read back as a chunked record table.

Writing: one record for each page. Records with equal payloads are written once, as the response of the largest page_id; the others are
revisits that refer to it. The archives are gzip files in a folder of any file system that Spark writes to: every
record ends in the two line breaks that the format asks for, which the text writer puts after each row.

Reading: a task streams a file's bytes and cuts every payload into rows (record id, chunk number) of at most CHUNK bytes. Each row
carries the digest of the payload up to there, and the last one has the record's digest. The bytes come as Spark's text
rows: a line up to a line feed is the unit that is held, so a record is not held as a whole unless it is a single line; memory
isn't bounded for a very long one (minified html). Lengths come from the headers, so payloads may hold any bytes, line breaks and header-like lines included.

A response's digest is the one worked out from its chunks, a revisit's the one that its record says.

A null html is an empty payload, a null url leaves out its header; empty payloads are equal payloads too. Of rows that repeat
the largest page_id each is a response; rows without page_id come back without one, as revisits if another row with their payload has one. An empty table gives no records. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches

CHUNK = 1 << 20
#: Rows of one payload are dealt over so many keys when the response's id is looked up.
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the formats.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
_OUT = pa.schema([("record_id", pa.string()), ("chunk", pa.int64()), ("n_bytes", pa.int64()), ("total_bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_()), ("type", pa.string()), ("refers_to", pa.string()), ("said_digest", pa.string()), ("said_bytes", pa.int64()), ("data", pa.binary())])


def sha1_base32(payload: Column) -> Column:
    h = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0")  # noqa: E731  40 bits
    return F.translate(F.concat(*map(part, range(4))), DIGITS, BASE32)


def records(pages: DataFrame) -> DataFrame:
    """(record) of every page: a whole WARC record but for its closing line breaks."""
    p = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1("html"))
    same = p.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = same.select("sha1", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    r = p.withColumn("salt", salt).join(same, ["sha1", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    size = F.octet_length("html")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    uri = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", " "), F.lit("\r\n")), F.lit(""))
    refers = F.concat(F.lit(f"WARC-Profile: {REVISIT}\r\nWARC-Refers-To: <{RECORD_ID}"), "first", F.lit(">\r\n"))
    return r.select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "),
            F.when(revisit, "revisit").otherwise("response"),
            F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <{RECORD_ID}"),
            F.coalesce(F.col("page_id").cast("string"), F.lit("")),
            F.lit(">\r\n"),
            uri,
            F.when(revisit, refers).otherwise(""),
            F.lit("WARC-Payload-Digest: sha1:"),
            sha1_base32(F.col("html")),
            F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
            F.octet_length(block),
            F.lit("\r\n\r\n"),
            block,
        ).alias("record")
    )


def write(pages: DataFrame, path: str) -> None:
    records(pages).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


class _Reader:
    """Takes an archive's bytes piece by piece and gives chunk rows."""

    def __init__(self, data: bool):
        self.data, self.head, self.left, self.http = data, bytearray(), 0, None

    def feed(self, piece: memoryview):
        while len(piece):
            if self.left:  # within a block
                if self.http is not None:  # its HTTP header
                    take = min(self.left, len(piece))
                    before = len(self.http)
                    self.http += piece[:take]
                    end = self.http.find(b"\r\n\r\n", max(0, before - 3))
                    if end >= 0:
                        take = end + 4 - before
                        said = dict(x.split(b": ", 1) for x in bytes(self.http[:end]).split(b"\r\n")[1:] if b": " in x)
                        self.said = int(said.get(b"Content-Length", b"0"))
                        self.http = None
                    self.left -= take
                    piece = piece[take:]
                    if not self.left:
                        yield self.row(b"", True)
                    continue
                part = piece[: min(self.left, CHUNK - len(self.held), len(piece))]
                self.held += part
                self.left -= len(part)
                piece = piece[len(part) :]
                if len(self.held) == CHUNK or not self.left:
                    yield self.row(bytes(self.held), not self.left)
                    self.held.clear()
                continue
            before = len(self.head)
            self.head += piece
            start = len(self.head) - len(self.head.lstrip(b"\r\n"))  # the line breaks after the last record
            end = self.head.find(b"\r\n\r\n", max(start, before - 3))
            if end < 0:
                return
            piece = piece[end + 4 - before :]
            fields = dict(x.split(b": ", 1) for x in bytes(self.head[start:end]).split(b"\r\n")[1:] if b": " in x)
            self.fields = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in fields.items()}
            self.head.clear()
            self.left, self.http, self.held, self.digest = int(self.fields["content-length"]), bytearray(), bytearray(), hashlib.sha1()
            self.chunk = self.total = self.said = 0

    def row(self, part: bytes, last: bool) -> tuple:
        self.digest.update(part)
        self.total += len(part)
        self.chunk += 1
        f, name = self.fields, lambda x: x and x.strip("<>").removeprefix(RECORD_ID)
        return (
            name(f["warc-record-id"]), self.chunk - 1, len(part), self.total, base64.b32encode(self.digest.digest()).decode(), last,
            f["warc-type"], name(f.get("warc-refers-to")), f.get("warc-payload-digest", "").removeprefix("sha1:"), self.said, part if self.data else None,
        )


def read_chunks(spark: SparkSession, path: str, data: bool = True) -> DataFrame:
    """The chunked record table of the archives in path: a row for each record_id and chunk. data: with the bytes."""

    def run(it):
        at, reader, rows, size = None, _Reader(data), [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_OUT)], schema=_OUT)

        for batch in it:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file != at:
                    at, reader = file, _Reader(data)
                raw = line.as_buffer()
                for piece in (memoryview(raw), memoryview(b"\n")):
                    for r in reader.feed(piece):
                        rows.append(r)
                        size += r[2] if data else 100
                        if size >= 4 * CHUNK:
                            yield out()
                            rows, size = [], 0
        yield out()

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return map_batches(
        lines,
        run,
        "record_id string, chunk long, n_bytes long, total_bytes long, digest string, last boolean, type string, refers_to string, said_digest string, said_bytes long, data binary",
    )


def summary(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok) of every record of a chunk table."""
    full = F.col("type") == "response"
    return chunks.where("last").select(
        F.col("record_id").try_cast("long").alias("page_id"),
        F.when(full, F.col("total_bytes")).otherwise(F.col("said_bytes")).alias("payload_bytes"),
        F.when(full, F.col("digest")).otherwise(F.col("said_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").try_cast("long").alias("refers_to"),
        (~full | (F.col("digest") == F.col("said_digest"))).alias("digest_ok"),
    )


#: The same by DuckDB: base32 from 40-bit parts of the hexadecimal digest.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('{BASE32}',
    (((('0x' || substr(h, (10 * (i // 8) + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS digest_ok
FROM p JOIN f USING (h)
"""
