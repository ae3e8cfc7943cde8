"""WARC archives as Spark jobs: pages are written as request, response (or revisit) and metadata records and assembled again.

A capture's records stand beside each other in one archive; the request and the metadata name the response in WARC-Concurrent-To. Reading
parses archives record by record by Content-Length and joins the three kinds on that identifier in one shuffle, a nested row per capture.
Archives are whole gzip files of at most ``records_per_file`` captures, so a task holds a bounded number of pages.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopledger.session import checkpoint_folder

# Payloads below this size are never deduplicated.
LEAST_REVISIT = 100
PAGES_PER_FILE = 4000
DATE = "2024-01-01T00:00:00Z"
_RECORD = (
    "archive string, type string, record_id string, capture string, target_uri string, digest string, bytes long, fields map<string,string>"
)


def _urn(name: str) -> Column:
    """A stable record identifier from what makes the capture: page, address and payload."""
    h = F.md5(F.concat_ws("|", F.lit(name), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                          F.coalesce("url", F.lit("")), "digest").cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column | str, name: str, headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record as text; a header with a null value is left out. Lines end in CRLF."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), lit(kind)), F.concat(F.lit("WARC-Record-ID: "), _urn(name)),
             F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{h}: "), lit(v)) for h, v in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def _one_line(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " ")


def with_revisits(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest, bytes and ``refers_to``: the smallest page_id of an equal payload, null for that page itself."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    digested = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"digest": F.sha2(F.col("payload").cast("binary"), 256), "bytes": F.octet_length("payload").cast("long")})
    first = (
        digested.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "first")
    )
    later = ~F.col("page_id").eqNullSafe(F.col("first"))
    return digested.join(first, F.col("digest") == F.col("d"), "left").select(
        "page_id", "url", "payload", "digest", "bytes", F.when(later & F.col("first").isNotNull(), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = PAGES_PER_FILE) -> None:
    """Writes every page (page_id, url, html) as three records under ``path``."""
    revisit = F.col("refers_to").isNotNull()
    uri = ("WARC-Target-URI", _one_line(F.col("url")))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    host = F.regexp_extract(_one_line(F.col("url")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    request = _record("request", "request", [uri, ("WARC-Concurrent-To", _urn("response")), ("Content-Type", "application/http; msgtype=request")],
                      F.concat(F.lit("GET "), _one_line(F.col("url")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), "response",
        [uri, digest, ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
         ("Content-Type", "application/http; msgtype=response")],
        F.when(revisit, http).otherwise(F.concat(http, "payload")))
    lines = [F.concat(F.lit(f"{name}: "), F.col(name).cast("string")) for name in ("page_id", "bytes", "refers_to")]
    lines.append(F.when(F.col("url").isNotNull(), "has_url: 1"))
    metadata = _record("metadata", "metadata", [uri, ("WARC-Concurrent-To", _urn("response")), ("Content-Type", "application/warc-fields")],
                       F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n")))
    end = "\r\n\r\n"
    with_revisits(pages).select(F.concat_ws(end, request, response, metadata).alias("value")).write.mode("overwrite").option(
        "lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """The archive's bytes in pieces; gzip members one after another, or plain."""
    view = memoryview(data)
    if view[:2] != b"\x1f\x8b":
        yield data
        return
    rest = view
    while rest:
        member, at = zlib.decompressobj(31), 0
        while not member.eof and at < len(rest):
            step = rest[at:at + (1 << 18)]
            at += len(step)
            yield member.decompress(step)
        rest = rest[at - len(member.unused_data):] if member.eof else rest[:0]


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; header names in lower case. A record that is cut off ends the archive."""
    pieces, held, at = _inflated(data), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        lines = held[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        begin = end + 4
        size = int(headers.get("content-length", 0))
        while len(held) < begin + size + 4:
            if not more():
                break
        if len(held) < begin + size:
            return
        yield headers, bytes(held[begin:begin + size])
        del held[:begin + size + 4]
        at = 0


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record. ``capture`` is the response's identifier; digest and bytes of a response are taken from its payload."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[dict] = []
                for headers, block in records(content.as_buffer().to_pybytes()):
                    kind = headers.get("warc-type", "")
                    row = {"archive": archive, "type": kind, "record_id": headers.get("warc-record-id"), "digest": None, "bytes": None,
                           "capture": headers.get("warc-concurrent-to", headers.get("warc-record-id")),
                           "target_uri": headers.get("warc-target-uri"), "fields": []}
                    if kind in ("response", "revisit"):
                        payload = block.partition(b"\r\n\r\n")[2]
                        row["digest"] = headers.get("warc-payload-digest", "").removeprefix("sha256:")
                        if kind == "response":
                            row["digest"], row["bytes"] = hashlib.sha256(payload).hexdigest(), len(payload)
                    elif kind == "metadata":
                        lines = block.decode("utf-8", "replace").split("\r\n")
                        row["fields"] = [(k, v.strip()) for k, c, v in (line.partition(":") for line in lines) if c]
                    rows.append(row)
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(parse, _RECORD)


_ARROW = pa.schema([
    ("archive", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("capture", pa.string()), ("target_uri", pa.string()),
    ("digest", pa.string()), ("bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())),
])


def captures(found: DataFrame) -> DataFrame:
    """One row (capture, request, response, metadata) of nested records per capture.

    Requests and metadata meet their response on the concurrent-to identifier, all three kinds in one shuffle. A capture whose records
    were written n times (repeated pages) comes n times; a missing kind is null.
    """
    part = F.struct("archive", "record_id", "target_uri", "digest", "bytes", "type", "fields")
    kinds = {"request": F.col("type") == "request", "response": F.col("type").isin("response", "revisit"), "metadata": F.col("type") == "metadata"}
    met = found.groupBy("capture").agg(
        *(F.first(F.when(test, part), ignorenulls=True).alias(kind) for kind, test in kinds.items()),
        *(F.count(F.when(test, 1)).alias(f"n_{kind}") for kind, test in kinds.items()),
    )
    times = F.greatest(*(f"n_{kind}" for kind in kinds))
    return met.withColumn("again", F.explode(F.sequence(F.lit(1), times.cast("int")))).select("capture", *kinds)


def pages_through_archives(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) per page, written to archives and read back.

    A null html is an empty payload. Of equal payloads of at least 100 bytes those with the smallest page_id are responses (all of them,
    if the row is repeated), others are revisits; a null page_id is never the smallest. Extra columns do not matter; an
    empty table gives no rows.
    """
    spark = pages.sparkSession
    path = f"{checkpoint_folder(spark)}/hopledger-llm/{uuid.uuid4().hex}-warc"
    write_archives(pages, path)
    whole = captures(read_records(spark, path))
    field = lambda name: F.col("metadata.fields")[name]
    return whole.select(
        field("page_id").cast("long").alias("page_id"),
        F.when(field("has_url").isNotNull(), F.col("response.target_uri")).alias("url"),
        F.coalesce("response.bytes", field("bytes").cast("long")).alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        field("refers_to").cast("long").alias("refers_to"),
    )
