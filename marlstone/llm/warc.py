"""WARC archives: a writer of DataFrame functions and a function that makes gzip members, and a reader that salvages what it can.

Archives are bounded files written by Spark's committed text sink into a shared folder, so a task that
is run again cannot leave half a file behind. Each record is a gzip member of its own, so that a
damaged byte costs one record. Equal payloads are written once, as the response with
the largest id; the others are revisit records without payload.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

#: bytes of an archive from which a task begins another one; bounds, but for one record more, what a reading task holds of a file
ARCHIVE_BYTES = 32_000_000
#: bytes of rows from which the reader hands on a batch; an archive may hold a thousand times its own bytes
BATCH_BYTES = 8_000_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = b"\r\n\r\n"
#: fixed value: the profile of a revisit with the same payload
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five digits give four letters."""
    letters = []
    for at in range(0, 40, 5):
        group = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(group, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _lines(*lines: Column | str) -> Column:
    parts = []
    for x in lines:
        parts += [F.lit(x) if isinstance(x, str) else x, F.lit("\r\n")]
    return F.concat(*parts)


def write_warc(
    pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> None:
    """Write a record per row of ``pages`` below ``path``.

    The payload is the column in UTF-8 (null: empty). Of equal payloads of at least ``least_bytes`` bytes
    the one with the largest id is the response; shorter ones are all responses. A null URL becomes
    the record's own name, control characters and blanks in URLs are escaped. A null id sorts lowest.
    """
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")
    ).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    groups = base.groupBy("sha").agg(F.max("page_id").alias("first_id"), F.max(F.octet_length("payload")).alias("n"))
    # decided on (id, digest) alone and joined back by id: no task gathers the payloads of a large group of copies
    decided = (
        base.select("page_id", "sha")
        .distinct()
        .join(groups, "sha")
        .select(
            F.col("page_id").alias("own_id"),
            F.col("sha").alias("own_sha"),
            F.when((F.col("n") >= least_bytes) & (F.col("page_id") != F.col("first_id")), F.col("first_id")).alias("refers_to"),
        )
    )
    rows = base.join(decided, base.page_id.eqNullSafe(F.col("own_id")) & (F.col("sha") == F.col("own_sha")))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.octet_length("payload").cast("string")), "")
    again = F.col("refers_to").isNotNull()
    body = F.when(again, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        _lines(
            "WARC/1.1",
            F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: <"), name(F.col("page_id")), F.lit(">")),
            "WARC-Date: 1970-01-01T00:00:00Z",
            F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), name(F.col("page_id")))),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha"))),
        ),
        F.when(again, _lines(f"WARC-Profile: {PROFILE}", F.concat(F.lit("WARC-Refers-To: <"), name(F.col("refers_to")), F.lit(">")))).otherwise(""),
        _lines("Content-Type: application/http;msgtype=response", F.concat(F.lit("Content-Length: "), (F.octet_length("http") + F.octet_length("body")).cast("string")), ""),
        F.col("http"),
        F.col("body"),
        F.lit("\r\n\r\n"),
    )
    # rows go to Python a hundred at a time: an Arrow batch of payloads would hold ten thousand
    member = F.udf(_filed, "archive int, value binary", useArrow=False).asNondeterministic()
    out = rows.withColumn("http", http).withColumn("body", body).select(member(record).alias("member"))
    # the sink writes the bytes of a string as they are, and its line end is the zero that ends every member
    out = out.select(F.col("member.value").cast("string").alias("value"), F.col("member.archive").alias("archive"))
    out.write.partitionBy("archive").option("lineSep", "\0").option("compression", "none").text(path)


_filled: dict[str, int] = {}


def _filed(record: str) -> tuple[int, bytes]:
    """A record as ``_cut_member`` gives it, and the number of its archive: a task goes on to the next one where ARCHIVE_BYTES are reached."""
    task = str(TaskContext.get().taskAttemptId()) if TaskContext.get() else ""
    if task not in _filled:
        _filled.clear()  # a worker runs one task at a time
        _filled[task] = 0
    data = _cut_member(record)
    number = _filled[task] // ARCHIVE_BYTES
    _filled[task] += len(data) + 1
    return number, data


def _cut_member(record: str) -> bytes:
    """A record as a gzip member without its last byte, which is zero.

    A member ends with the size of its data, lowest byte first; after a record of 16 MB or more, whose size
    has a highest byte, an empty member follows.
    """
    member = gzip_member(record.encode())
    if member[-1]:
        member += gzip_member(b"")
    return member[:-1]


def gzip_member(record: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Bad(ValueError):
    """A record or member that fails a check."""


def _record_at(data, at: int) -> tuple[dict[str, str], int, int]:
    """(headers, start and end of the block) of the record at ``at``; Bad unless every check holds."""
    if data[at : at + 7] != b"WARC/1.":
        raise Bad("no version line")
    head = data.find(_END, at)
    if head < 0:
        raise Bad("headers do not end")
    lines = bytes(data[at:head]).split(b"\r\n")
    headers = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header line without a colon")
        headers[key.strip().lower().decode("latin1")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise Bad("no content length")
    start = head + 4
    end = start + int(headers["content-length"])
    if end > len(data):
        raise Bad("block is cut short")
    if data[end : end + 4] != _END:
        raise Bad("block does not end where it should")
    return headers, start, end


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, found, body = block.partition(_END)
    if not found or not head.startswith(b"HTTP/"):
        return {}, block
    pairs = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin1"): v.strip().decode("latin1") for k, _, v in pairs}, body


def _checked(data, at: int) -> tuple[dict, int]:
    """The record at ``at`` with its payload, and where the next one starts."""
    headers, start, end = _record_at(data, at)
    http, payload = _http(bytes(data[start:end]))
    stated = headers.get("warc-payload-digest", "").rpartition(":")[2]
    kind = headers.get("warc-type", "")
    if kind == "revisit":
        digest, size = stated, http.get("content-length", "")
        size = int(size) if size.isdigit() else None
    else:
        digest, size = base32_sha1(payload), len(payload)
        if stated and stated != digest:
            raise Bad("payload digest differs")
    return {"type": kind, "headers": headers, "payload": payload, "digest": digest, "size": size}, end + 4


def _inflate(data, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` holds up to its first fault, where it ends, and the fault ('' if its checksum is right)."""
    inflate = zlib.decompressobj(31)
    out = []
    at_most = 1 << 16
    for lo in range(at, len(data), at_most):
        chunk = data[lo : lo + at_most]
        before = inflate.copy()
        try:
            out.append(inflate.decompress(chunk))
        except zlib.error as e:
            return b"".join(out) + _before_fault(before, chunk), len(data), f"gzip: {e}"
        if inflate.eof:
            return b"".join(out), lo + len(chunk) - len(inflate.unused_data), ""
    return b"".join(out), len(data), "gzip member is cut short"


def _before_fault(inflate, chunk: bytes) -> bytes:
    """What ``chunk``, which has a fault, holds before it; zlib drops the output of a call that fails, so calls get smaller."""
    out = []
    at, step = 0, len(chunk)
    while step:
        before = inflate.copy()
        try:
            out.append(inflate.decompress(chunk[at : at + step]))
            at += step
        except zlib.error:
            inflate, step = before, step // 16
    try:  # the byte with the fault, a byte of output at a time
        out.append(inflate.decompress(chunk[at : at + 1], 1))
        while out[-1]:
            out.append(inflate.decompress(inflate.unconsumed_tail, 1))
    except zlib.error:
        pass
    return b"".join(out)


def salvage(data: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """All records of an archive that pass their checks, and the byte gaps (start, end, reason) between them.

    An archive is plain or has one or more records to a gzip member. After a failed check the reader looks
    for the next version line or gzip member from which a record can be read whole, goes on there,
    and quarantines the bytes it passed over. Of a damaged member the records before the fault
    are kept, once each also where the member stores them uncompressed. An empty archive has neither
    records nor gaps.
    """
    records: list[dict] = []
    gaps: list[tuple[int, int, str]] = []
    for x in salvaged(data):
        (records if isinstance(x, dict) else gaps).append(x)
    return records, gaps


def salvaged(data: bytes) -> Iterator[dict | tuple[int, int, str]]:
    """The records and gaps of ``salvage`` as they are met; only those of one gzip member are held at a time."""
    at = 0
    gap, reason = None, ""
    partial: set[tuple] = set()  # records of damaged members
    while at < len(data):
        found: list[dict] = []
        fault = ""
        if data[at : at + 2] == b"\x1f\x8b":
            plain, to, fault = _inflate(data, at)
            found, inside = salvage(plain) if plain else ([], [])
            if fault:
                inside = []
        else:
            inside = []
            try:
                one, to = _checked(data, at)
                found = [one]
            except Bad as e:
                fault = str(e)
        for r in found:
            r["offset"] = at
        if fault or partial:
            own = [(tuple(r["headers"].items()), r["digest"]) for r in found]
            found = [r for r, k in zip(found, own) if k not in partial]
            if fault:
                partial.update(own)
        yield from found
        if fault:
            if gap is None:
                gap, reason = at, fault
            nexts = [x for x in (data.find(b"WARC/1.", at + 1), data.find(b"\x1f\x8b\x08", at + 1)) if x >= 0]
            at = min(nexts, default=len(data))
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        yield from ((at, to, f"in the member, bytes {a} to {b}: {why}") for a, b, why in inside)
        at = to
    if gap is not None:
        yield gap, len(data), reason


ROWS = (
    "file string, offset long, length long, record_type string, record_id string, refers_to string, target string, "
    "payload_digest string, payload_bytes long, payload binary, quarantine string"
)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives below ``path``, and one per quarantined gap, whose ``quarantine`` says why.

    ``payloads=False`` leaves the payload null where only digests are needed. The bytes of an archive are
    read whole, but inflated member by member, and rows go on in batches of BATCH_BYTES: a task needs memory for
    the archives as they are stored, whose size the writer bounds, one member and one batch.
    """
    names = [x.split()[0] for x in ROWS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string()]

    def rows(file: str, data: bytes) -> Iterator[tuple]:
        for r in salvaged(data):
            if isinstance(r, tuple):
                start, end, why = r
                yield (file, start, end - start, *[None] * 7, why)
                continue
            h = r["headers"]
            yield (
                file, r["offset"], None, r["type"], h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"),
                r["digest"], r["size"], r["payload"] if payloads else None, None,
            )

    def packed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, size = [], 0
                for row in rows(file, content.as_py()):
                    found.append(row)
                    size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
                    if size >= BATCH_BYTES:
                        yield packed(found)
                        found, size = [], 0
                if found:
                    yield packed(found)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, ROWS)


def page_id(name: Column) -> Column:
    """The id in a record name that ``write_warc`` gave; null for a null id."""
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A row per row of ``pages``; a gap in an archive just written is an error, so no page is lost silently.
    """
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, least_bytes)
    gap = F.concat_ws(" ", F.lit("gap in"), "file", F.lit("at"), F.col("offset").cast("string"), "quarantine")
    found = read_warc(pages.sparkSession, path, payloads=False).where(F.when(F.col("quarantine").isNull(), True).otherwise(F.raise_error(gap).cast("boolean")))
    return found.select(
        page_id(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_id(F.col("refers_to")).alias("refers_to"),
    )
