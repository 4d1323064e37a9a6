"""WARC archives: writing pages as records, and reading archives back with segment reassembly.

Writing: of pages with equal payloads the one with the largest key is a ``response``, the others
are ``revisit`` records without the payload. A response's block is an HTTP message whose body is
in chunked transfer framing; a block beyond ``segment_bytes`` is cut into a first segment and
``continuation`` records. Records are written by Spark's text writer with CRLF CRLF as the line
end, which makes each part file a valid (gzipped) WARC file of at most ``records_per_file`` records.

Reading: files are parsed record by record. Segments are grouped by origin identifier, ordered by
segment number, checked to be gapless and of the stated total length, and joined; then the
chunked framing is decoded. Whole records never leave their task. Segments alone are shuffled,
and a group is one page, which a task must hold to return it at all.

Defined results: null html is an empty payload; of repeated rows that carry the largest key of
their payload all are responses; a null key never is the largest unless all keys of the payload
are null; an incomplete or damaged record fails the read with a message that names it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.plans.store import fresh_path, save

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
RECORDS_PER_FILE = 2048
END = b"\r\n\r\n"
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def digest_column(payload: F.Column) -> F.Column:
    """Hex SHA-1 of a binary column, the form that payloads are grouped by."""
    return F.sha1(payload)


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def chunked(body: bytes, size: int) -> bytes:
    """The body in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(body[i:i + size]), body[i:i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """Decode chunked transfer framing; sizes may carry extensions, trailers are skipped."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(framed[at:at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = b"".join(f"{name}: {value}\r\n".encode() for name, value in [*headers, ("Content-Length", len(block))])
    return _VERSION + b"\r\n" + lines + b"\r\n" + block


def _identifier(row: str) -> str:
    return f"<urn:nodeloom:{row}>"


def records_of(row: str, key: int | None, url: str | None, html: bytes | None, sha1: str, size: int, refers_to: int | None,
               revisit: bool, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page. ``row`` names the row, ``key`` the page."""
    uri = re.sub(r"[\r\n]", "", url or "")
    common = [("WARC-Record-ID", _identifier(row)), ("WARC-Date", _DATE), ("WARC-Target-URI", uri),
              ("WARC-Payload-Digest", f"sha1:{base32(sha1)}"), ("X-Page-Key", "" if key is None else key)]
    if revisit:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        extra = [("WARC-Profile", _PROFILE), ("X-Refers-To-Key", "" if refers_to is None else refers_to)]
        yield _record([("WARC-Type", "revisit"), *common, *extra], head)
        return
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head + chunked(html or b"", chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    cuts = range(0, len(block), segment_bytes)
    for number, at in enumerate(cuts, 1):
        if number == 1:
            headers = [("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)]
        else:
            headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", _identifier(f"{row}-{number}")), ("WARC-Date", _DATE),
                       ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", _identifier(row)), ("WARC-Segment-Number", number)]
        if number == len(cuts):
            headers.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(headers, block[at:at + segment_bytes])


def write(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html",
          segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE,
          compression: str = "gzip") -> None:
    """Write ``pages`` as WARC files under ``path``, any file system Spark can write to."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"), payload.alias("html"))
    rows = rows.withColumn("sha1", digest_column(F.col("html")))
    groups = rows.groupBy("sha1").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = save(groups.filter("n > 1").select("sha1", "first"), "warc_shared")
    known = shared.df.select(F.col("sha1").alias("s_sha1"), "first")
    tagged = rows.join(known, F.col("sha1") == F.col("s_sha1"), "left").select(
        "key", "url", "html", "sha1", "first", (F.col("s_sha1").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))).alias("revisit"))
    tagged = tagged.select("key", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "sha1",
                           F.length("html").cast("bigint").alias("size"), "first", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for row in range(batch.num_rows):
                k, u, h, sha1, n, first, again = (batch.column(c)[row].as_py() for c in range(7))
                for record in records_of(f"{part}-{number}", k, u, h, sha1, n, first, again, segment_bytes, chunk_bytes):
                    out.append(record)
                    size += len(record)
                number += 1
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = tagged.mapInArrow(run, "record binary")
    # The cast keeps the bytes as they are; the text writer copies them and adds the record end.
    (records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode())
     .option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path))
    shared.drop()


PARTS = T.StructType([
    T.StructField("origin", T.StringType()), T.StructField("number", T.LongType()), T.StructField("total", T.LongType()),
    T.StructField("type", T.StringType()), T.StructField("key", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("block", T.BinaryType()),
])
_PARTS_ARROW = pa.schema([
    ("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("type", pa.string()), ("key", pa.int64()),
    ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("size", pa.int64()), ("block", pa.binary())])


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a WARC file, gzipped or not; header names are lower-cased."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if data[at:at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(END, at)
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        begin, size = end + 4, int(headers["content-length"])
        block = data[begin:begin + size]
        if len(block) != size or data[begin + size:begin + size + 4] != END:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block
        at = begin + size + 4


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def http_payload(block: bytes, identifier: str) -> bytes:
    """The body of an HTTP message, chunked framing decoded."""
    head, _, body = block.partition(END)
    if re.search(rb"(?im)^transfer-encoding:\s*chunked", head):
        try:
            return dechunked(body)
        except ValueError as error:
            raise ValueError(f"record {identifier}: {error}") from error
    return body


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: whole responses with their decoded payload, segments with their raw block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows: list[dict] = []
                size = 0
                for headers, block in parse(value.as_buffer().to_pybytes()):
                    kind, number = headers["warc-type"], _number(headers.get("warc-segment-number"))
                    identifier = headers["warc-record-id"]
                    row = {"origin": headers.get("warc-segment-origin-id", identifier), "number": number,
                           "total": _number(headers.get("warc-segment-total-length")), "type": kind,
                           "key": _number(headers.get("x-page-key")), "url": headers.get("warc-target-uri"),
                           "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                           "refers_to": _number(headers.get("x-refers-to-key")), "size": None, "block": block}
                    if kind == "revisit":
                        stated = re.search(rb"(?im)^content-length:\s*(\d+)", block)
                        row |= {"block": None, "size": int(stated[1]) if stated else None}
                    elif number is None:
                        body = http_payload(block, identifier)
                        row |= {"block": body, "size": len(body)}
                    rows.append(row)
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _PARTS_ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _PARTS_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, PARTS)


def _join_segments(rows: Iterator[dict]) -> Iterator[dict]:
    """Reassemble rows that come sorted by origin and segment number."""
    group: list[dict] = []

    def whole() -> dict:
        first, name = group[0], group[0]["origin"]
        if [r["number"] for r in group] != list(range(1, len(group) + 1)) or first["type"] == "continuation":
            raise ValueError(f"record {name}: segments missing or repeated")
        block = b"".join(r["block"] for r in group)
        if group[-1]["total"] != len(block):
            raise ValueError(f"record {name}: {len(block)} bytes, {group[-1]['total']} stated")
        body = http_payload(block, name)
        return first | {"block": body, "size": len(body), "number": None, "total": None}

    for row in rows:
        if group and row["origin"] != group[0]["origin"]:
            yield whole()
            group = []
        group.append(row)
    if group:
        yield whole()


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives: key, url, type, digest, refers_to, size, payload.

    The digest of a response is recomputed from its payload and must equal the stated one.
    """
    parts = save(read_parts(spark, path), "warc_parts").df

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield batch.slice(i, 1).to_pylist()[0]

        for row in _join_segments(rows()):
            yield pa.RecordBatch.from_pylist([row], _PARTS_ARROW)

    cut = parts.filter(F.col("number").isNotNull())
    joined = cut.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(assemble, PARTS)
    pages = parts.filter(F.col("number").isNull()).unionByName(joined)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, stated = batch.column(3).to_pylist(), batch.column(6).to_pylist()
            for kind, digest, block in zip(kinds, stated, batch.column(9), strict=True):
                if kind == "response":
                    made = base64.b32encode(hashlib.sha1(block.as_buffer() or b"").digest()).decode()
                    if digest is not None and made != digest:
                        raise ValueError(f"payload digest {made}, {digest} stated")
            yield batch

    sure = pages.mapInArrow(check, PARTS)
    return sure.select("key", "url", "type", "digest", "refers_to", "size", F.col("block").alias("payload"))


def report(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and list them."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, key=key)
    return read(spark, path).select(
        F.col("key").alias(key), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to"))
