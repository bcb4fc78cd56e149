"""WARC archives: writing records with revisits, and a reader that salvages damaged archives.

Archives are written by the engine's text sink: a row is a bundle of records, each a gzip member of its own. The
sink ends each row with its line separator, here the zero byte, which is also the last byte of a
gzip member (the high byte of its length field), so the files hold members end to end. Files become
visible when the job commits, and a task that is run again writes the same bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

VERSION = "WARC/1.1"
#: Payloads of fewer bytes are always stored.
LEAST_SHARED = 100
GZIP = b"\x1f\x8b\x08"
LINE = b"WARC/1."
HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]*\r\n)*?)\r\n")
#: A gzip member of no bytes.
EMPTY = GZIP + bytes(7) + b"\x03\x00" + bytes(8)
#: Gaps between two looks at a cheap sign of damage: bytes inflated at a time.
STEP = 1 << 20
#: Bytes of a bundle of packed records (a larger record is one by itself), and bundles of an archive, when archives are
#: written: an archive has at most so many times the larger of a bundle and its largest record.
BUNDLE_BYTES, ARCHIVE_BUNDLES = 1 << 24, 8
#: Bytes of an archive that is read; the engine hands over a file's content as one value, which can't be longer.
LARGEST_READ = 2**31 - 1 - 4096
#: Rows, and bytes of payloads, after which a batch of records goes out.
ROWS_AT_ONCE = 256
BYTES_AT_ONCE = 1 << 24

RECORD = "path string, offset long, length long, headers map<string,string>, payload binary, gap string"
_RECORD = pa.schema(
    [
        ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
        ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("gap", pa.string()),
    ]
)


def digest(payload: Column) -> Column:
    return F.sha2(payload, 256)


def with_revisits(pages: DataFrame, payload: str, key: str, out: str = "refers_to") -> DataFrame:
    """Add the payload's ``digest`` and ``out``: the smallest key with an equal payload, where that is another row.

    Only payloads of LEAST_SHARED bytes or more are shared. Digests fold before they are shuffled;
    the join has one row per repeated digest on one side, and a digest with very many rows is left
    to the engine's splitting of skewed joins.
    """
    first, count = fresh([*pages.columns, "digest", out], "first", "count")
    marked = pages.withColumn("digest", digest(F.col(payload)))
    big = F.octet_length(payload) >= LEAST_SHARED
    shared = (
        marked.filter(big).groupBy("digest").agg(F.min(key).alias(first), F.count(F.lit(1)).alias(count))
        .filter((F.col(count) > 1) & F.col(first).isNotNull()).select("digest", first)
    )
    other = big & (F.col(key).isNull() | (F.col(key) > F.col(first)))
    return marked.join(shared, "digest", "left").withColumn(out, F.when(other, F.col(first))).drop(first)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as bytes."""
    lines = [VERSION, *[f"{name}: {value}" for name, value in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of the data that ends with a zero byte, without that byte.

    The byte is the high one of the length; for data of 16 MiB or more an empty member follows.
    """
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    packed = packer.compress(data) + packer.flush()
    return packed[:-1] if packed[-1] == 0 else packed + EMPTY[:-1]


def one_line(value: str) -> str:
    """A header value: no line ends, and percent signs escaped with them."""
    return re.sub(r"[%\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write a record for each row: a response, or a revisit of the response with the same payload.

    Null payloads are written as empty ones. Of rows with equal payloads of at least LEAST_SHARED
    bytes the one with the smallest key is the response (rows that share that key are responses
    each; a null key comes last, and among null keys alone all are responses). Rows are written
    where they lie after the join that finds revisits; nothing is sorted or gathered. Archives are
    bounded by bytes (ARCHIVE_BUNDLES), so that they can be read again whatever the size of their records. Columns
    but the three named ones are not written.
    """
    body = F.coalesce(F.encode(F.col(f"`{payload}`").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload")
    )
    marked = with_revisits(rows, "payload", "key").select(
        F.col("key").cast("string").alias("key"), "url", "digest", F.col("refers_to").cast("string").alias("refers_to"),
        F.octet_length("payload").alias("size"), F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
    )

    def write(batches: Iterator[pa.RecordBatch], most=BUNDLE_BYTES) -> Iterator[pa.RecordBatch]:
        bundle, size_of = [], 0

        def full() -> pa.RecordBatch:
            # the zero byte that ends a member stands between them, as between the rows
            return pa.RecordBatch.from_arrays([pa.array([b"\x00".join(bundle)], pa.binary())], ["value"])

        for batch in batches:
            for number, url_, sha, refers, size, data in zip(*[c.to_pylist() for c in batch.columns]):
                named = hashlib.sha256(f"{number}|{url_}|{sha}".encode()).hexdigest()
                headers = [
                    ("WARC-Type", "response" if refers is None else "revisit"),
                    ("WARC-Record-ID", f"<urn:sha256:{named}>"),
                    ("WARC-Date", "2020-01-01T00:00:00Z"),
                    ("WARC-Payload-Digest", f"sha256:{sha}"),
                    ("WARC-Payload-Length", str(size)),
                ]
                headers += [] if url_ is None else [("WARC-Target-URI", one_line(url_))]
                headers += [] if number is None else [("WARC-Page-Key", one_line(number))]
                headers += [] if refers is None else [("WARC-Refers-To-Page-Key", one_line(refers))]
                packed = member(record(headers, data or b""))
                if bundle and size_of + len(packed) > most:
                    yield full()
                    bundle, size_of = [], 0
                bundle.append(packed)
                size_of += len(packed) + 1
        if bundle:
            yield full()

    records = marked.mapInArrow(write, "value binary")
    lines = records.select(F.col("value").cast("string")).write.option("lineSep", "\x00")
    lines.option("maxRecordsPerFile", ARCHIVE_BUNDLES).text(path)


@dataclass
class Salvage:
    """What a pass over an archive's bytes finds: records and the gaps between them."""

    records: list[tuple[int, int, dict[str, str], bytes]] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at a place: headers, block and its end. ValueError says which check fails."""
    head = HEAD.match(data, at)
    if not head:
        raise ValueError("no version line or header end")
    headers = {}
    for line in head.group(1).split(b"\r\n")[:-1]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("a header line without a name")
        headers[name.strip().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("Content-Length", "")
    if not length.isdecimal():
        raise ValueError("no content length")
    start, end = head.end(), head.end() + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("the content does not end where its length says")
    block = data[start:end]
    wanted = headers.get("WARC-Payload-Digest", "")
    if wanted.startswith("sha256:") and headers.get("WARC-Type") != "revisit":
        if hashlib.sha256(block).hexdigest() != wanted.removeprefix("sha256:"):
            raise ValueError("the payload does not match its digest")
    return headers, block, end + 4


def inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The content of the gzip member at a place, its end, and why it is not whole (empty: check sum and length are right).

    Of a damaged or cut-off member the content is what comes out before the error, the end is where that lies.
    """
    packer = zlib.decompressobj(31)
    parts, spot, step, damage = [], at, STEP, ""
    while not packer.eof and spot < len(data):
        try:
            parts.append(packer.decompress(data[spot : spot + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(parts), spot, damage
            # once more to the piece with the error, then byte by byte
            damage, step, packer = f"a damaged member ({str(e).split(':')[0]})", 1, zlib.decompressobj(31)
            parts = [packer.decompress(data[low : low + STEP]) for low in range(at, spot, STEP)]
            continue
        spot += step
    if not packer.eof:
        return b"".join(parts), len(data), damage or "a member that is cut off"
    return b"".join(parts), min(spot, len(data)) - len(packer.unused_data), ""


#: A record or gap: offset and length in the archive, headers and block of a record, reason of a gap.
Entry = tuple[int, int, dict[str, str] | None, bytes | None, str | None]


def checked(headers: dict[str, str]) -> bool:
    """Whether a valid record's block was compared with a digest."""
    return headers.get("WARC-Payload-Digest", "").startswith("sha256:") and headers.get("WARC-Type") != "revisit"


def of_content(content: bytes, place: int, length: int, damage: str) -> Iterator[Entry]:
    """Records and gaps of a member's content: after a failed check, on at the next version line."""
    at, bad, reason = 0, None, ""
    while at < len(content):
        try:
            headers, block, end = parsed(content, at)
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            at = content.find(LINE, at + 1)
            at = at if at >= 0 else len(content)
            continue
        if bad is not None and not damage:
            yield place, length, None, None, f"{reason} (bytes {bad} to {at} of the member's content)"
        bad = None
        # without a digest, what a damaged member yields may be wrong; it is part of the member's own gap
        if checked(headers) or not damage.startswith("a damaged"):
            yield place, length, headers, block, None
        at = end
    if bad is not None and not damage:
        yield place, length, None, None, f"{reason} (bytes {bad} to {at} of the member's content)"


def entries(data: bytes) -> Iterator[Entry]:
    """Records and gaps of an archive as they are found. After a failed check, on at the next valid member or version line.

    Compressed and plain records may follow each other, and a member may hold many records. Bytes that
    belong to no valid record become gaps with the reason the first check failed; nothing before or
    after them is lost. Gaps inside a member have its place, and the range of its content in the reason.
    Whole records that a cut-off member yields count, and of a damaged one those whose digest is right;
    the gap then spans the member.
    """
    at, bad, reason, plain_from = 0, None, "", 0
    while at < len(data):
        packed, found = data.startswith(GZIP, at), []
        try:
            if packed:
                content, end, damage = inflated(data, at)
                if damage:
                    found = list(of_content(content, at, end - at, damage))
                    raise ValueError(damage)
            else:
                headers, block, end = parsed(data, at)
        except ValueError as e:
            if found:
                if bad is not None:
                    yield bad, at - bad, None, None, reason
                    bad = None
                yield from found
                # version lines of stored blocks are those of the records just found
                plain_from = max(plain_from, end)
            if bad is None:
                bad, reason = at, str(e)
            signs = [x for x in (data.find(GZIP, at + 1), data.find(LINE, max(at + 1, plain_from))) if x >= 0]
            at = min(signs, default=len(data))
            continue
        if bad is not None:
            yield bad, at - bad, None, None, reason
            bad = None
        if packed:
            yield from of_content(content, at, end - at, "")
        else:
            yield at, end - at, headers, block, None
        at = end
    if bad is not None:
        yield bad, len(data) - bad, None, None, reason


def salvage(data: bytes) -> Salvage:
    """All ``entries`` of an archive, as records and gaps (start, end, reason)."""
    found = Salvage()
    for at, length, headers, block, gap in entries(data):
        if gap is None:
            found.records.append((at, length, headers, block))
        else:
            found.gaps.append((at, at + length, gap))
    return found


def read_archives(spark: SparkSession, path: str, largest: int = LARGEST_READ) -> DataFrame:
    """The records and gaps of all archives below a path: columns of RECORD.

    A record has its place, headers and payload (the block); a gap has its place and ``gap``, the
    reason (see ``entries``). Rows go out as they are found. An archive is one task's work and must fit it (the usual size is a gigabyte or less); a
    damaged one costs no other, and neither does one of more than ``largest`` bytes: it is not opened, but is a
    gap as a whole. Empty files give no rows.
    """
    found = spark.read.format("binaryFile").load(path)
    files = found.filter(F.col("length").between(1, largest)).select("path", "content")
    beyond = found.filter(F.col("length") > largest).select(
        "path", F.lit(0).cast("long").alias("offset"), "length", F.lit(None).cast("map<string,string>").alias("headers"),
        F.lit(None).cast("binary").alias("payload"), F.lit("an archive too large to be read").alias("gap"),
    )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORD.types)], schema=_RECORD)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for offset, length, headers, block, gap in entries(content.as_buffer().to_pybytes()):
                    rows.append((name.as_py(), offset, length, None if headers is None else list(headers.items()), block, gap))
                    size += len(block or b"")
                    if len(rows) >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(read, RECORD).unionByName(beyond)


def quarantined(found: DataFrame) -> DataFrame:
    """The gaps: path, start, end (exclusive) and reason."""
    return found.filter("gap IS NOT NULL").select(
        "path", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), F.col("gap").alias("reason")
    )


def header(name: str) -> Column:
    return F.col("headers")[name]


def page_records(found: DataFrame) -> DataFrame:
    """Per record: the page's key (null if it is no whole number), the payload's length and digest, the type and what it refers to."""
    return found.filter("gap IS NULL").select(
        header("WARC-Page-Key").try_cast("long").alias("page_id"),
        F.coalesce(header("WARC-Payload-Length").try_cast("long"), F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.regexp_replace(header("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        header("WARC-Type").alias("record_type"),
        header("WARC-Refers-To-Page-Key").try_cast("long").alias("refers_to"),
    )
