"""WARC archives: a writer on Spark's committed text sink, and a splittable reader.

Writing. A record is one gzip member, built in Arrow batches and written by the text sink as it is
(the sink copies a string's bytes and ends each row with a separator). The separator is a zero byte:
the last byte of a member is the top byte of its length, zero below 16 MiB, so that byte is left off
and the separator supplies it; a longer member is followed by one byte of zero padding, which gzip
readers skip. So files go through Spark's commit protocol, to any file system it can write.

Reading. Files are cut into byte ranges. A task looks for the gzip magic in its range, and takes a
place for a member only if inflating from there gives a WARC header. It owns the records that start in
its range and reads past the end of the range to finish the last. After a record the search goes on at
its end. (A payload that itself is a gzipped archive, kept uncompressed in a member, could be taken for
records by a range that starts inside it.)

Files are read through pyarrow's file systems, range by range. A store that only Spark's readers open is read by
them, a file in a task, which the writer's bound on files suits.

Payloads of MIN_REVISIT bytes or more that are equal (by SHA-1) are kept once: the record with the
largest key is the response, the others are revisits that refer to it. Equal keys with equal payloads
are responses each. Null payloads are empty; a null key makes a revisit if any key is there for its
payload, else a response. Null addresses are written as ``urn:none``.
"""

from __future__ import annotations

import base64
import hashlib
import io
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm.common import drop_written, scratch_path, written

MIN_REVISIT = 1000
SPLIT_BYTES = 8 << 20
#: Payload bytes for each archive file.
FILE_BYTES = 16 << 20
#: Compression level of the records.
LEVEL = 4
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
_HEAD = 1 << 16
_DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = "path string, offset long, type string, key long, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{digest}')}>"


def _line(value: str) -> str:
    """A header value: no control characters or spaces, which would end or split it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def member(key: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. ``digest``: hex SHA-1 of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(key, digest)}", f"WARC-Target-URI: {_line(uri or 'urn:none')}", f"WARC-Date: {_DATE}"]
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Key: {refers_to}"]
    if key is not None:
        head.append(f"X-Key: {key}")
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def write_archives(df: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html") -> None:
    """Write a record for every row of ``df`` below ``path``.

    Which rows are revisits is found on keys and digests alone; payloads move once, dealt by digest and key over as
    many files as their bytes ask for, so pages that share a payload spread, and a file's task reads FILE_BYTES.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(uri).alias("uri"), F.coalesce(F.col(payload), F.lit("")).alias("payload")).withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("place", F.xxhash64("digest", "key"))
    told = written(rows.select("key", "digest", "place", F.octet_length("payload").cast("long").alias("bytes")), "warc-digests")
    files = min(max(1, math.ceil((told.agg(F.sum("bytes")).first()[0] or 0) / FILE_BYTES)), 1 << 20)
    equal = told.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.max("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    referring = written(told.join(equal, "digest").select("digest", "place", "refers_to").distinct(), "warc-equal")
    dealt = rows.repartition(files, "digest", "place").join(referring.hint("shuffle_hash"), ["digest", "place"], "left")
    revisit = F.coalesce(F.col("refers_to").isNotNull() & ~F.col("key").eqNullSafe(F.col("refers_to")), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for k, u, p, d, r, v in zip(*(c.to_pylist() for c in batch.columns)):
                made = member(k, u, bytes(p), d, r, v)
                out.append(made[:-1] if made[-1] == 0 else made)
                size += len(made)
                if size > _READ * 8:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members = dealt.select("key", "uri", F.col("payload").cast("binary"), "digest", "refers_to", revisit.alias("revisit")).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)
    drop_written(told)
    drop_written(referring)


class _Range:
    """A file from a byte on, read in pieces as they are needed."""

    def __init__(self, file, start: int, size: int):
        self.file, self.size, self.low, self.data = file, size, start, bytearray()
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(_READ) if self.low + len(self.data) < self.size else b""
        self.data += got
        return bool(got)

    def drop(self, upto: int) -> None:
        del self.data[: upto - self.low]
        self.low = upto


def _parsed(head: bytes) -> dict[str, str] | None:
    """Header fields by lower-case name, or None if this is no complete WARC header."""
    if not head.startswith(b"WARC/1."):
        return None
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = (line.partition(b":") for line in bytes(head[:end]).split(b"\r\n")[1:])
    found = {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in fields}
    return found if "warc-type" in found and found.get("content-length", "").isdigit() else None


def _inflate(span: _Range, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header, block and end of the member at ``at``; None if it is none. Only the header's part is inflated before it is judged."""
    unpack, out, used = zlib.decompressobj(31), bytearray(), at - span.low
    fields, looked = None, 0
    while not unpack.eof:
        if used >= len(span.data) and not span.more():
            return None
        feed = bytes(span.data[used : used + _HEAD])
        try:
            out += unpack.decompress(feed)
        except zlib.error:
            return None
        used += len(feed)
        if fields is None:
            if not b"WARC/1.".startswith(out[:7]):
                return None
            ended = out.find(b"\r\n\r\n", looked) >= 0
            looked = max(0, len(out) - 3)
            fields = _parsed(out) if ended else None
            if ended and fields is None:
                return None
    if fields is None:
        return None
    start = out.index(b"\r\n\r\n") + 4
    length = int(fields["content-length"])
    return (fields, bytes(out[start : start + length]), span.low + used - len(unpack.unused_data)) if len(out) >= start + length else None


def records(file, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header and block of every record that starts in the bytes from ``start`` to ``end``."""
    span, at = _Range(file, start, size), start
    while at < end:
        found = span.data.find(_MAGIC, at - span.low)
        if found < 0:
            at = max(at, span.low + len(span.data) - 2)
            span.drop(at)
            if not span.more():
                return
            continue
        at = span.low + found
        if at >= end:
            return
        got = _inflate(span, at)
        if got:
            fields, block, after = got
            yield at, fields, block
            at = after
        else:
            at += 1
        span.drop(at)


def _rows(name: str, file, start: int, end: int, size: int) -> Iterator[pa.RecordBatch]:
    """The responses and revisits of a range, in batches of bounded size."""
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("key", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    rows, held = [], 0
    for offset, fields, block in records(file, start, end, size):
        if fields["warc-type"] not in ("response", "revisit"):
            continue
        payload = block.partition(b"\r\n\r\n")[2]
        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
        if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{name}: the payload at {offset} does not have its digest")
        number = lambda f: int(fields[f]) if f in fields else None
        length = number("x-payload-length")
        rows.append((name, offset, fields["warc-type"], number("x-key"), fields.get("warc-target-uri"), len(payload) if length is None else length, digest, number("x-refers-to-key"), payload))
        held += len(payload)
        if held > 8 * _READ:
            yield made(rows)
            rows, held = [], 0
    if rows:
        yield made(rows)


#: Schemes under which pyarrow knows a store by another name.
_ALSO = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gs": "gs"}


def _opened(name: str) -> tuple[pyarrow.fs.FileSystem, str]:
    scheme, mark, rest = name.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"{_ALSO.get(scheme, scheme)}{mark}{rest}")


def _known(name: str) -> bool:
    try:
        _opened(name)
    except Exception:  # an unknown scheme, or one that this build of pyarrow lacks
        return False
    return True


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row for each response or revisit below ``path``; a response's payload is checked against its digest."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    first = files.select("path").first()
    if first and not _known(first["path"]):
        return spark.read.format("binaryFile").load(path).select("path", "length", "content").mapInArrow(whole_files, _SCHEMA)
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length"), F.lit(split_bytes).cast("long"))).alias("start")).where("start < length")
    total = files.agg(F.sum("length")).first()[0] or 0  # small files share a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                system, inner = _opened(name)
                with system.open_input_file(inner) as file:
                    yield from _rows(name, file, start, min(start + split_bytes, length), length)

    return ranges.select("path", "length", "start").repartition(max(1, min(math.ceil(total / split_bytes), 10_000))).mapInArrow(run, _SCHEMA)


def whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of files that come with their content."""
    for batch in batches:
        for name, length, content in zip(*batch.columns):
            yield from _rows(name.as_py(), io.BytesIO(content.as_py()), 0, length.as_py(), length.as_py())


def archive_round_trip(df: DataFrame) -> DataFrame:
    """Write the pages, read the archives back, and return what the records say of each page."""
    path = scratch_path(df.sparkSession, "warc")
    write_archives(df, path)
    found = read_archives(df.sparkSession, path)
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
