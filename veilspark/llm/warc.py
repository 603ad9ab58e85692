"""WARC archives: a deduplicating writer and a reader that salvages damaged files."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import Scratch, batched, get_file, put_file

VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
STAMP = "1970-01-01T00:00:00Z"
#: A payload shorter than this is always stored.
LEAST = 100


def record_urn(page: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page))}"


def clean(value: str) -> str:
    """A header value in one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(page: int | None, url: str | None, payload: bytes, digest: str, size: int, original: int | None) -> bytes:
    """One response or, with an original, one revisit record. A revisit has no payload; its digest and size are of the full one."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = [
        ("WARC-Type", "response" if original is None else "revisit"),
        ("WARC-Record-ID", f"<{record_urn(page)}>"),
        ("WARC-Date", STAMP),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(size)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", clean(url)))
    if page is not None:
        head.append(("X-Page-ID", str(page)))
    if original is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_urn(original)}>"), ("X-Refers-To-Page-ID", str(original))]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(Exception):
    pass


def parse_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record that starts here; Damaged where a check fails."""
    if not data.startswith(b"WARC/1.", at):
        raise Damaged("no version line")
    # As long as they are, up to the next version line.
    following = data.find(b"\nWARC/1.", at)
    end = data.find(b"\r\n\r\n", at, following if following >= 0 else len(data))
    if end < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line has no colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,15}", headers.get("content-length", "")):
        raise Damaged("no content length")
    start, size = end + 4, int(headers["content-length"])
    block, after = data[start : start + size], start + size
    if len(block) < size:
        raise Damaged("the block is cut short")
    if data[after : after + 4] != b"\r\n\r\n":
        raise Damaged("the record does not end where its length says")
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest:
        raise Damaged("the block digest differs")
    return headers, block, after + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member that starts here and its end."""
    reader = zlib.decompressobj(31)
    try:
        out = reader.decompress(data[at:])
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    if not reader.eof:
        raise Damaged("the gzip member is cut short")
    return out, len(data) - len(reader.unused_data)


def salvage(data: bytes):
    """('record', start, end, headers, block) and ('gap', start, end, reason) over the bytes of one archive.

    After a failed check the reader looks for the next gzip member, or in plain archives the next
    version line, that parses and passes its own checks; everything up to it is one quarantined gap."""
    packed = data.startswith(MEMBER) or (not data.startswith(b"WARC/1.") and MEMBER in data)
    mark = MEMBER if packed else b"WARC/1."
    at, gap, why = 0, None, ""
    view = memoryview(data)
    while at < len(data):
        try:
            if packed:
                # A window first: a member's end is found without inflating past it.
                raw, end = inflate_at(view, at)
                headers, block, inner = parse_record(raw, 0)
                if inner != len(raw):
                    raise Damaged("bytes after the record in its member")
            else:
                headers, block, end = parse_record(data, at)
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            found = data.find(mark, at + 1)
            at = found if found >= 0 else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, why, b""
            gap = None
        yield "record", at, end, headers, block
        at = end
    if gap is not None:
        yield "gap", gap, len(data), why, b""


def inflate_at(view: memoryview, at: int, window: int = 1 << 20) -> tuple[bytes, int]:
    """As inflate, fed by windows so that a large archive isn't copied for each of its members."""
    reader, out = zlib.decompressobj(31), []
    while not reader.eof:
        if at >= len(view):
            raise Damaged("the gzip member is cut short")
        part = view[at : at + window]
        try:
            out.append(reader.decompress(part))
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        at += len(part)
    return b"".join(out), at - len(reader.unused_data)


def body(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


# ---------------------------------------------------------------- Spark


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, bytes and, for revisits, the original's page_id.

    The smallest page_id of each payload is aggregated before it is joined back, so a payload that
    a third of all pages share moves as one row a task; the pages' side of the join can be split."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    copies = base.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = base.join(copies, "digest", "left")
    later = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.withColumn("original", F.when(later, F.col("original")))


def write_warc(pages: DataFrame, folder: str, file_bytes: int = 8 << 20) -> DataFrame:
    """Archives of about file_bytes with a gzip member for each record; file, records and bytes of each.

    Each attempt of a task writes under names of its own, and only finished tasks report theirs:
    what a lost one has left is in no report."""

    def write(batches):
        made, members, size, attempt = 0, [], 0, uuid.uuid4().hex[:12]

        def flush():
            nonlocal made, members, size
            name = f"pages-{TaskContext.get().partitionId():08d}-{made:05d}-{attempt}.warc.gz"
            put_file(folder, name, b"".join(members))
            row = pa.RecordBatch.from_pydict({"file": [name], "records": [len(members)], "bytes": [size]}, schema=schema)
            made, members, size = made + 1, [], 0
            return row

        for batch in batches:
            columns = {n: batch.column(n) for n in ("page_id", "url", "html", "digest", "bytes", "original")}
            for k in range(batch.num_rows):
                page, url, html, digest, n, original = (c[k].as_py() for c in columns.values())
                payload = b"" if original is not None else html.encode()
                members.append(gzip_member(build_record(page, url, payload, digest, n, original)))
                size += len(members[-1])
                if size >= file_bytes:
                    yield flush()
        if members:
            yield flush()

    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    return plan_records(pages).mapInArrow(write, "file string, records long, bytes long")


READ = "file string, status string, gap_start long, gap_end long, reason string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


SCHEMA = pa.schema([("file", pa.string()), ("status", pa.string()), ("gap_start", pa.int64()), ("gap_end", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def number(x: str | None) -> int | None:
    return int(x) if x is not None and re.fullmatch(r"-?\d+", x) else None


def rows_of(name: str, data: bytes):
    """Rows of SCHEMA of one archive."""
    for status, start, end, info, block in salvage(data):
        if status == "gap":
            yield name, status, start, end, info, None, None, None, None, None, None, None
            continue
        kind, payload = info.get("warc-type", ""), body(block)
        if kind == "response":
            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
            if info.get("warc-payload-digest", f"sha256:{digest}") != f"sha256:{digest}":
                yield name, "gap", start, end, "the payload digest differs", None, None, None, None, None, None, None
                continue
        else:
            digest, size = info.get("warc-payload-digest", ":").partition(":")[2], number(info.get("x-payload-length"))
        yield name, status, start, end, None, number(info.get("x-page-id")), info.get("warc-target-uri"), kind, digest, size, number(info.get("x-refers-to-page-id")), payload


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that passes its checks (status record) and every quarantined range of bytes (status gap) of all archives in a folder."""

    def parse(batches):
        found = (row for batch in batches for path, data in zip(batch.column("path").to_pylist(), batch.column("content")) for row in rows_of(path.rsplit("/", 1)[-1], data.as_py()))
        yield from batched(found, SCHEMA, 500)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    return files.mapInArrow(parse, READ)


def read_reported(report: DataFrame, folder: str) -> DataFrame:
    """As read_warc, of the archives in a report of write_warc. An archive that yields other than the
    reported number of records is an error, after its gaps were logged in it."""

    def parse(batches):
        def rows():
            for batch in batches:
                for name, records in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                    found = list(rows_of(name, get_file(folder, name)))
                    gaps = [f"{x[2]} to {x[3]}: {x[4]}" for x in found if x[1] == "gap"]
                    if gaps or len(found) != records:
                        raise ValueError(f"{name}: {len(found) - len(gaps)} of {records} records, gaps {gaps}")
                    yield from found

        yield from batched(rows(), SCHEMA, 500)

    return report.select("file", "records").repartition("file").mapInArrow(parse, READ)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write a record for each page and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; a null page_id is written without an id, never is an original
    while its payload has another id, and comes back as null; rows that repeat the smallest page_id
    are responses all; a url's control characters are escaped and it may have any length; a record that
    isn't read back is an error; an empty table gives no rows; other columns are ignored."""
    scratch = Scratch(pages.sparkSession, "warc")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    report = scratch.save(write_warc(pages, scratch.path("archives")), "report")
    return read_reported(report, scratch.path("archives")).select(*columns)
