"""WARC archives of captures, and transaction assembly.

Each page becomes three records: the request, the response (or a revisit of an earlier
response with the same payload) and a metadata record with the page's id; request and
metadata name the capture's record in WARC-Concurrent-To. Reading joins the three by that
identifier into one nested row per capture, in one shuffle.

The archives are files of WARC/1.1 records, each a gzip member of its own, a warcinfo record
first. Spark's own text source writes and reads them, so they can be on any store: its line
separator is an empty gzip member, which readers of gzip files pass over. A file can be cut
between members, so a large one is read by several tasks, one record in memory at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import bound_batches, stored

GAP = "\r\n\r\n"
_GAP = GAP.encode()
#: An empty gzip member, as bytes and as the line separator of a Latin-1 text.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "0000000000000000")
SEPARATOR = {"lineSep": EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1"}
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Records that one file holds at most, its warcinfo record included.
FILE_RECORDS = 30_000
DATE = "2020-01-01T00:00:00Z"


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A record without the separator that ends it."""
    parts = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {DATE}\r\n")]
    for name, value in headers:
        parts += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    return F.concat(*parts, F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(GAP), block)


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _info(first: bytes) -> bytes:
    """The warcinfo record that opens a file, named after the record that follows it."""
    h = hashlib.md5(b"warcinfo|" + first).hexdigest()
    block = b"software: docweave\r\nformat: WARC File Format 1.1\r\n"
    name = "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block


def _members(file_records: int) -> Callable:
    """A gzip member for each record; a warcinfo record wherever the writer opens a file."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            out = []
            for value in batch.column(0):
                record = value.as_py()
                if n % file_records == 0:
                    out.append(_member(_info(record) + _GAP))
                    n += 1
                out.append(_member(record + _GAP))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return pack


def write_archive(pages: DataFrame, folder: str, file_records: int = FILE_RECORDS) -> None:
    """Write the captures of ``pages`` (page_id, url, html) to ``folder``.

    The payload is the html in UTF-8, empty for a null. Of rows with equal payloads of at
    least 100 bytes the one with the smallest page_id is the response and the others revisit
    it; repeated rows of that page_id revisit its first one. A null page_id is never the
    smallest unless all are null. Line ends in a url are escaped; a null url is empty. Other
    columns are not read. No rows: no records.
    """
    bound_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    light = rows.where(F.octet_length("payload") >= LEAST_BYTES).groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    origin = F.coalesce(F.min_by("url", "page_id"), F.min("url")).alias("head_url")
    heads = light.groupBy("digest").agg(F.min("page_id").alias("head"), origin, F.sum("n").alias("n")).where("n > 1").drop("n")
    # What a row is depends on (digest, page_id) alone: the hot digest's rows meet its head without their payloads.
    # One key column for the join and the numbering of copies, so that payloads are shuffled once.
    key = F.concat_ws("|", "digest", F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("key")
    fates = light.join(heads, "digest").select(key, F.lit(True).alias("shared"), "head", "head_url")
    rows = rows.select("*", key).join(fates, "key", "left")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("url")))

    def name(page: Column, copy: Column, kind: str) -> Column:
        h = F.md5(F.concat_ws("|", F.lit(kind), "digest", F.coalesce(page.cast("string"), F.lit("null")), copy.cast("string")).cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(h, a, n), F.lit("-"))), F.substring(h, 21, 12), F.lit(">"))

    own, original = name(F.col("page_id"), F.col("copy"), "capture"), name(F.col("head"), F.lit(1), "capture")
    target, concurrent = ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", own)
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(GAP))
    again = F.coalesce(F.col("shared"), F.lit(False)) & ~(F.col("page_id").eqNullSafe(F.col("head")) & (F.col("copy") == 1))
    response = _record("response", own, [target, digest], "application/http;msgtype=response", F.concat(head, "payload"))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    revisit = _record("revisit", own, [target, digest, profile, ("WARC-Refers-To", original), ("WARC-Refers-To-Target-URI", F.col("head_url"))], "application/http;msgtype=response", head)
    request = _record("request", name(F.col("page_id"), F.col("copy"), "request"), [target, concurrent], "application/http;msgtype=request", F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1"), F.lit(GAP)))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", name(F.col("page_id"), F.col("copy"), "metadata"), [target, concurrent], "application/warc-fields", fields)
    records = rows.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata).cast("array<binary>")).alias("value"))
    packed = records.mapInArrow(_members(file_records), "value binary").select(F.col("value").cast("string"))
    packed.write.options(**SEPARATOR).option("maxRecordsPerFile", file_records).text(folder)


def _headers(raw: bytes) -> dict[str, str]:
    """The named fields of a record, names in lower case."""
    lines = raw.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse_member(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the one record of a gzip member."""
    try:
        data = zlib.decompress(member, 31)
    except zlib.error as error:
        raise ValueError(f"damaged archive: {error}") from error
    head, _, rest = data.partition(_GAP)
    headers = _headers(head)
    need = int(headers["content-length"])
    if len(rest) != need + len(_GAP) or not rest.endswith(_GAP):
        raise ValueError("a member of the archive is not one whole record")
    return headers, rest[:need]


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record; ``pieces`` are the bytes between separators, in order."""
    buffer = bytearray()
    need = None
    headers: dict[str, str] = {}
    for piece in pieces:
        buffer += piece
        buffer += b"\r\n\r\n"
        while True:
            if need is None:
                start = 0
                while buffer[start : start + 2] == b"\r\n":
                    start += 2
                end = buffer.find(b"\r\n\r\n", start)
                if end < 0:
                    break
                headers = _headers(bytes(buffer[start:end]))
                need = int(headers["content-length"])
                del buffer[: end + 4]
            if len(buffer) < need + 4:
                break
            yield headers, bytes(buffer[:need])
            del buffer[: need + 4]
            need = None
    if need is not None or bytes(buffer).strip(b"\r\n"):
        raise ValueError("the archive ends within a record")


_RECORD = "kind string, record_id string, capture_id string, target_uri string, refers_to string, page_id long, payload_bytes long, payload_digest string, payload binary"
_FIELDS = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("capture_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind, record_id = headers["warc-type"], headers["warc-record-id"]
    capture = headers.get("warc-concurrent-to", record_id)
    page = size = digest = payload = None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = headers["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response":
            size = len(payload)
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload of {record_id} is damaged")
        else:
            payload = None
            size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    elif kind == "metadata":
        value = next((x.partition(b":")[2].strip() for x in block.split(b"\r\n") if x.startswith(b"page-id:")), b"")
        page = int(value) if value else None
    return kind, record_id, capture, headers.get("warc-target-uri"), headers.get("warc-refers-to"), page, size, digest, payload


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)

    for headers, block in (parse_member(x.as_py()) for b in batches for x in b.column(0)):
        if headers["warc-type"] == "warcinfo":
            continue
        rows.append(_row(headers, block))
        size += len(block) + 300
        if size > 8 << 20:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in ``folder`` but their warcinfo records. A damaged record is an error."""
    bound_batches(spark)
    text = spark.read.options(**SEPARATOR).text(folder).where(F.col("value") != "").select(F.col("value").cast("binary"))
    return text.mapInArrow(_parse, _RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, page_id, request, response, metadata.

    Records meet on the identifier that request and metadata are concurrent to, which is the
    response's or revisit's own. A capture that lacks a record has a null there.
    """

    def part(condition: str, *names: str) -> Column:
        return F.first(F.when(F.expr(condition), F.struct(*names)), ignorenulls=True)

    out = records.groupBy("capture_id").agg(
        part("kind = 'request'", "record_id", "target_uri").alias("request"),
        part("kind in ('response', 'revisit')", "record_id", F.col("kind").alias("record_type"), "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload").alias("response"),
        part("kind = 'metadata'", "record_id", "page_id").alias("metadata"),
    )
    return out.select("capture_id", F.col("metadata.page_id").alias("page_id"), "request", "response", "metadata")


def capture_digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) of every capture.

    A revisit whose size or digest is not that of the response it names is an error; one
    whose response is in another archive has no refers_to.
    """
    light = captures(records.drop("payload").withColumn("payload", F.lit(None).cast("binary")))
    light = stored(light.select("capture_id", "page_id", "response.payload_bytes", "response.payload_digest", "response.record_type", F.col("response.refers_to").alias("refers_id")), "captures")
    origin = light.where("record_type = 'response'").select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.struct("payload_bytes", "payload_digest").alias("original"))
    rows = light.join(origin, "refers_id", "left")
    differs = F.col("original").isNotNull() & (F.col("original") != F.struct("payload_bytes", "payload_digest"))
    failure = F.raise_error(F.concat(F.lit("revisit differs from its response: "), "capture_id"))
    return rows.withColumn("payload_bytes", F.when(differs, failure.cast("long")).otherwise(F.col("payload_bytes"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def read_file(path: str) -> list[tuple[dict[str, str], bytes]]:
    """Records of one local archive, for inspection."""
    with gzip.open(path, "rb") as f:
        return list(parse_records(iter(f.read().removesuffix(b"\r\n\r\n").split(b"\r\n\r\n"))))
