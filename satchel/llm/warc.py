"""WARC archives through a chunked record table: writing, reading, and revisit records for equal payloads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, stored

#: Payload bytes of one chunk at most; a longer payload becomes a record and its continuation records.
CHUNK = 65536
#: Revisit records whose table may be broadcast: 100 MB.
FEW = 500_000
#: Equal payloads of fewer bytes are all stored.
REVISIT_FROM = 100
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK_SCHEMA = "record_id string, record_type string, target_uri string, chunk_no long, last boolean, chunk_bytes long, payload_bytes long, payload_digest string, declared_digest string, refers_to string, chunk string"


def _cut(payload: memoryview, size: int) -> Iterator[memoryview]:
    """Chunks of at most `size` bytes that end on a code point, not copied; an empty payload is one empty chunk."""
    at = 0
    while True:
        end = min(at + size, len(payload))
        while at < end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        yield payload[at:end]
        at = end
        if at >= len(payload):
            return


def _uri(url: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def _payloads(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each text of a column, where they lie."""
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    for i in range(len(column)):
        yield data[at[i] : at[i + 1]]


def _records(rid: str, url: str | None, data: memoryview, digest: str, refers: str | None, date: str, chunk: int) -> Iterator[str]:
    """The archive's text for one record, made chunk by chunk: a response with its continuations, or a revisit. Each piece lacks its last CRLF."""
    uri = [f"WARC-Target-URI: {_uri(url)}"] if url else []
    head = [f"WARC-Record-ID: <{rid}>", f"WARC-Date: {date}", *uri]
    if refers is not None:
        lines = ["WARC/1.1", "WARC-Type: revisit", *head, f"WARC-Refers-To: <{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(HTTP_HEAD)}"]
        yield "\r\n".join(lines) + "\r\n\r\n" + HTTP_HEAD + "\r\n"
        return
    parts, n, total = _cut(data, chunk), 1, len(HTTP_HEAD) + len(data)
    segmented, sent = len(data) > chunk, 0
    for part in parts:
        body = (HTTP_HEAD if n == 1 else "") + str(part, "utf-8")
        size = len(part) + (len(HTTP_HEAD) if n == 1 else 0)
        sent += size
        if n == 1:
            lines = ["WARC/1.1", "WARC-Type: response", *head, f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
        else:
            lines = ["WARC/1.1", "WARC-Type: continuation", f"WARC-Record-ID: <{rid}:{n}>", f"WARC-Date: {date}", *uri, f"WARC-Segment-Origin-ID: <{rid}>"]
        if segmented:
            lines.append(f"WARC-Segment-Number: {n}")
            if sent == total and n > 1:
                lines.append(f"WARC-Segment-Total-Length: {total}")
        lines.append(f"Content-Length: {size}")
        yield "\r\n".join(lines) + "\r\n\r\n" + body + "\r\n"
        n += 1


def revisits(pages: DataFrame) -> DataFrame:
    """pages(id, digest, n_bytes) -> (id, digest, refers): rows that repeat the payload of a row with a smaller id."""
    long = pages.where(F.col("n_bytes") >= REVISIT_FROM)
    heads = long.groupBy("digest").agg(F.min("id").alias("refers"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers is not null").drop("n")
    return long.join(heads, "digest").where("not id <=> refers").select("id", "digest", "refers").distinct()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, date: str = "2024-01-01T00:00:00Z", chunk: int = CHUNK) -> None:
    """Write a record per row to gzipped WARC files under `path`, a folder that all executors reach.

    Spark's own text writer puts the files in place, so a lost executor's task is written anew and nothing is
    left half. A record lies in one file, its segments in order; a payload over `chunk` bytes is segmented, so
    a reader never needs it whole, and the writer makes one chunk after another from the cell that Spark hands it. Only ids and digests are grouped;
    payloads are not shuffled as long as there are at most FEW revisits, whose table is then broadcast (some 200 bytes a row).

    Defined cases: a null payload is empty; null urls have no target line; a null id is written as urn:page:null,
    and never gets referred to; equal rows are written as often as they come; no rows make no records; other columns, whatever their names, are left
    aside; a very long payload is many segments, made one after the other.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    binary = F.col("payload").cast("binary")
    digest = F.sha2(binary, 256)
    again = revisits(p.select("id", digest.alias("digest"), F.octet_length("payload").alias("n_bytes")))
    p, again = p.withColumn("digest", digest), again.withColumnsRenamed({"id": "aid", "digest": "ad"})
    again = stored(again, "revisits")
    again = F.broadcast(again) if again.count() <= FEW else again
    joined = p.join(again, p["id"].eqNullSafe(again["aid"]) & (p["digest"] == again["ad"]), "left")
    out = joined.select("id", "url", F.when(F.col("refers").isNull(), F.col("payload")).otherwise("").alias("payload"), "digest", "refers")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, size = [], 0
            cols = [b.column(i) for i in (0, 1, 3, 4)]
            for i, payload in enumerate(_payloads(b.column(2))):
                rid, url, dig, refers = (c[i].as_py() for c in cols)
                name = lambda x: f"urn:page:{'null' if x is None else x}"
                for text in _records(name(rid), url, payload, dig, None if refers is None else name(refers), date, chunk):
                    texts.append(text)
                    size += len(text)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])
                        texts, size = [], 0
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])

    out.mapInArrow(records, "value string").write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


class _Reader:
    """Walks an archive's lines; carries the digest of the record in hand from chunk to chunk."""

    def __init__(self, with_chunks: bool):
        self.with_chunks, self.state, self.head, self.body, self.want = with_chunks, "start", {}, [], 0
        self.hash, self.sent, self.origin, self.no = hashlib.sha256(), 0, {}, 0

    def line(self, text: str) -> tuple | None:
        if self.state == "start":
            if text.startswith("WARC/"):
                self.state, self.head = "head", {}
            elif text:
                raise ValueError("not a WARC record: " + text[:80])
        elif self.state == "head":
            if text:
                key, _, value = text.partition(": ")
                self.head[key] = value
            else:
                self.state, self.body, self.want = "body", [], int(self.head["Content-Length"])
        else:
            raw = text.encode()
            self.body.append(raw)
            self.want -= len(raw) + 2
            if self.want <= -2:  # the CRLF after the last line belongs to the archive
                self.state = "start"
                return self.chunk(b"\r\n".join(self.body))
        return None

    def chunk(self, block: bytes) -> tuple:
        h = self.head
        kind = h["WARC-Type"]
        if kind != "continuation":
            self.hash, self.sent, self.origin, self.no = hashlib.sha256(), 0, h, 0
            block = block.partition(b"\r\n\r\n")[2]
        self.hash.update(block)
        self.sent += len(block)
        self.no += 1
        last = "WARC-Segment-Number" not in h or "WARC-Segment-Total-Length" in h
        o = self.origin
        plain = lambda x: x and x.strip("<>")
        return (plain(o["WARC-Record-ID"]), o["WARC-Type"], o.get("WARC-Target-URI"), self.no, last, len(block), self.sent, self.hash.hexdigest(), o.get("WARC-Payload-Digest", "").removeprefix("sha256:"), plain(o.get("WARC-Refers-To")), block.decode() if self.with_chunks else None)


def read_chunks(spark: SparkSession, path: str, *, with_chunks: bool = True) -> DataFrame:
    """The chunked record table of the archives under `path`, a row per record identifier and chunk number.

    payload_bytes and payload_digest are running figures: bytes so far, and the SHA-256 of the payload up to and with
    this chunk; in the row marked `last` they hold for the whole payload. No task ever holds more than a chunk.
    """
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in CHUNK_SCHEMA.split(", ")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(with_chunks)
        for b in batches:
            rows = [r for r in map(reader.line, b.column(0).to_pylist()) if r]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names)

    return spark.read.option("lineSep", "\r\n").schema("value string").text(path).mapInArrow(parse, CHUNK_SCHEMA)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: record_id, record_type, target_uri, payload_bytes, payload_digest, refers_to.

    Size and digest of a response come from its bytes, those of a revisit from the record that it refers to.
    """
    r = stored(read_chunks(spark, path, with_chunks=False).where("last").drop("chunk_no", "last", "chunk_bytes", "chunk"), "records")  # the archives are read once
    whole = r.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("whole_bytes"), F.col("payload_digest").alias("declared_digest")).distinct()
    joined = r.join(whole, ["refers_to", "declared_digest"], "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        "record_id",
        "record_type",
        "target_uri",
        F.when(revisit, F.col("whole_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "refers_to",
    )


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return read_records(spark, path).select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), number(F.col("refers_to"))).alias("refers_to"))


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), h AS (SELECT payload_digest, min(page_id) AS head FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN h.head IS NULL OR h.head = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.head <> p.page_id THEN h.head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)
"""
