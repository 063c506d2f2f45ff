"""WARC archives with segmented records: writing, reading back and reassembling.

Writing: each page becomes one record whose block is an HTTP response, its body in chunked transfer framing. Of
pages with equal payloads, the one with the largest id is a ``response``; the others are ``revisit`` records
that refer to it and carry no body. A block longer than ``segment_bytes`` is cut: the first part stays in the record, the
rest goes into ``continuation`` records that name the origin record, count upwards from 2, and give the total
length in the last one. Records are laid out by page, so the parts of one page stand together; an archive
file holds at most ``records_per_file`` of them. Files are written by Spark's text writer (a record ends in the
two line breaks WARC asks for), compressed as ``.gz``.

Reading: archive files are read whole, one per task at a time, as their size is bounded by the two limits above, and
parsed by their declared lengths, never by looking for separators. A record without segments is complete at once. Parts are
grouped by origin identifier, ordered by segment number, and accepted only if the numbers run from 1 without
a gap or repeat and the joined length is the declared total; then the chunked framing is decoded.

Which page is the response is decided by an aggregate over (digest, page id) alone; the payloads travel once,
to meet that decision.

Defined results: a null payload is empty; equal payloads below ``least_bytes`` are all responses; pages
that repeat an id are records of their own, also where the payload repeats with it (identical parts are joined once
and returned as often as the first part was read); a broken or incomplete group of segments raises.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store_paths import stage_path
from . import common
from .textops import pieces

SEGMENT_BYTES = 1 << 15
RECORDS_PER_FILE = 1_000
CHUNK_BYTES = 1 << 12
#: fixed values: the format's words
VERSION = "WARC/1.1"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Base-32 SHA-1, as WARC digests are written."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_chunks(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing. A chunk ends between characters, so that an archive stays valid UTF-8."""
    out, at = [], 0
    while at < len(body):
        end = min(at + size, len(body))
        while end < len(body) and body[end] & 0xC0 == 0x80:
            end += 1
        out += [b"%x\r\n" % (end - at), body[at:end], b"\r\n"]
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def from_chunks(framed: bytes) -> bytes:
    """The body of a chunked message; extensions and trailers are allowed and ignored."""
    out, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        size = int(framed[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(framed[at : at + size])
        at += size + 2


def record_id(page_id, payload_digest: str, part: int = 1) -> str:
    return f"<urn:page:{page_id}:{payload_digest}>" if part == 1 else f"<urn:page:{page_id}:{payload_digest}:{part}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n{block.decode()}"


def records(page_id, url: str, payload: bytes, payload_digest: str, refers_to, segment_bytes: int) -> Iterator[str]:
    """The WARC records of one page, without the two line breaks that end each."""
    target = " ".join((url or "").split()) or None
    same = [("WARC-Target-URI", target), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if refers_to is not None:
        yield _record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id, payload_digest)), *same, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, payload_digest)),
             ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Payload-Length", len(payload))], b"")
        return
    block = HTTP_HEAD.encode() + to_chunks(payload)
    cuts = [0]
    while cuts[-1] < len(block):
        end = min(cuts[-1] + segment_bytes, len(block))
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end += 1
        cuts.append(end)
    last = len(cuts) - 1
    for part in range(1, last + 1):
        first = part == 1
        yield _record(
            [("WARC-Type", "response" if first else "continuation"), ("WARC-Record-ID", record_id(page_id, payload_digest, part)), *same,
             ("WARC-Payload-Digest", f"sha1:{payload_digest}" if first else None),
             ("WARC-Segment-Origin-ID", None if first else record_id(page_id, payload_digest)),
             ("WARC-Segment-Number", part if last > 1 else None),
             ("WARC-Segment-Total-Length", len(block) if part == last > 1 else None)],
            block[cuts[part - 1] : cuts[part]])


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"a record starts with {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, data[start:stop]
        at = stop + 4


def payload_keys(pages: DataFrame, key: str, payload: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "payload", 1 << 23):
            digests = [digest((p.as_py() or "").encode()) for p in batch.column("payload")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.string())], names=["id", "digest"])

    narrow = pages.select(F.col(key).alias("id"), F.col(payload).cast("string").alias("payload"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, digest string")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the pages as WARC files under ``path``."""
    own = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    kind = own.schema["id"].dataType.simpleString()

    def with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "payload", 1 << 23):
            digests = [digest(p.as_py().encode()) for p in batch.column("payload")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["id", "url", "payload", "digest"])

    keyed = own.mapInArrow(with_digest, f"id {kind}, url string, payload string, digest string")
    # one row per payload that several pages have: pages with a payload of their own need no decision
    shared = payload_keys(pages, key, payload).groupBy("digest").agg(F.max("id").alias("original"), F.count("*").alias("n")).filter(F.col("n") > 1).drop("n")
    decided = keyed.join(shared, "digest", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "payload", 1 << 23):
            lines: list[str] = []
            for r in batch.to_pylist():
                body = r["payload"].encode()
                again = r["original"] is not None and r["original"] != r["id"] and len(body) >= least_bytes
                lines += records(r["id"], r["url"], body, r["digest"], r["original"] if again else None, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    text = decided.mapInArrow(write, "value string")
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


_PART = "origin string, number int, type string, digest string, refers_to string, length bigint, total bigint, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: origin identifier, segment number (1 if it has none), and the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                rows = []
                for fields, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    rows.append({
                        "origin": fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), "number": int(fields.get("WARC-Segment-Number", 0)),
                        "type": fields["WARC-Type"], "digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"), "refers_to": fields.get("WARC-Refers-To"),
                        "length": int(fields.get("Payload-Length", 0)), "total": int(fields["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in fields else None, "block": block,
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("origin", pa.string()), ("number", pa.int32()), ("type", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("length", pa.int64()), ("total", pa.int64()), ("block", pa.binary())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, _PART)


def reassemble(parts: DataFrame) -> DataFrame:
    """One row per logical record (origin, type, digest, refers_to, payload): segments joined, checked and unframed."""
    whole = parts.filter("number = 0").select("origin", "type", "digest", "refers_to", "length", "block")
    part = F.struct("number", "type", "digest", "total", "block")
    grouped = parts.filter("number > 0").groupBy("origin").agg(F.sort_array(F.collect_set(part)).alias("parts"), F.count_if(F.col("number") == 1).cast("int").alias("copies"))
    n = F.size("parts")
    joined = F.aggregate(F.col("parts.block"), F.lit(b""), lambda acc, b: F.concat(acc, b))
    complete = (F.element_at("parts", -1)["number"] == n) & (F.array_distinct("parts.number") == F.sequence(F.lit(1), n))
    checked = grouped.withColumn("block", joined).withColumn(
        "block",
        F.when(complete & (F.octet_length("block") == F.element_at("parts", -1)["total"]), F.col("block")).otherwise(
            F.raise_error(F.concat(F.lit("segments of "), "origin", F.lit(" are incomplete")))),
    )
    first = F.element_at("parts", 1)
    checked = checked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    again = checked.select("origin", first["type"].alias("type"), first["digest"].alias("digest"), F.lit(None).cast("string").alias("refers_to"), F.lit(0).cast("bigint").alias("length"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                body = from_chunks(r["block"].split(b"\r\n\r\n", 1)[1]) if r["type"] == "response" else b""
                if r["type"] == "response" and digest(body) != r["digest"]:
                    raise ValueError(f"the payload of {r['origin']} does not have its digest")
                out.append({"origin": r["origin"], "type": r["type"], "digest": r["digest"], "refers_to": r["refers_to"], "length": len(body) if r["type"] == "response" else r["length"], "payload": body})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("origin", pa.string()), ("type", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("length", pa.int64()), ("payload", pa.binary())]))

    return whole.unionByName(again).mapInArrow(run, "origin string, type string, digest string, refers_to string, length bigint, payload binary")


def page_of(identifier: Column) -> Column:
    return F.regexp_extract(identifier, r"^<urn:page:(.*):[A-Z2-7]+>$", 1)


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((CAST('0x' || substr(h, CAST(10 * (x // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (x % 8) AS BIGINT)) & 31) + 1, 1)), '') AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS original FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to FROM m
"""


@common.query("op9_warc", SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    path = stage_path(spark, "warc")
    write_archives(pages, path)
    back = reassemble(read_records(spark, path))
    kind = pages.schema["page_id"].dataType
    return back.select(
        page_of(F.col("origin")).cast(kind).alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), page_of(F.col("refers_to")).cast(kind).alias("refers_to"),
    )
