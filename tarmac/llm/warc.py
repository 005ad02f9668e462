"""WARC writer and splittable WARC reader.

Writing: each task writes one archive, a gzip member for each record, into the output folder through pyarrow's file
systems, and returns a manifest row.  The manifest is stored; an archive that a lost or repeated task left behind is
in no manifest and is never read.

Reading: archives are dealt out as byte ranges.  A task looks for the gzip magic in its range, takes a hit for a
member only if it inflates to a WARC version line, and owns the records whose member starts inside the range; it reads
past the range's end to finish the last one.  A magic inside compressed data doesn't inflate to such a line; a whole
member stored uncompressed inside another record would, but the archives written here compress every record.

A record's payload is the page's HTML (null: empty) in UTF-8 behind an HTTP response header.  Of records with equal
payloads, the one with the largest id is a response, the others are revisits without payload that refer to it; their
HTTP header keeps the payload's length and the record keeps its digest.  Rows with the same id and payload are
all responses when the id is the largest.  Null ids lose to others and are kept as null; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, stored, table

#: Start of a gzip member with deflate, and of a record.
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: Bytes of a range, and of one read.
RANGE_BYTES, READ_BYTES = 32 << 20, 1 << 20
#: Bytes inflated at once.
PIECE = 65_536
#: Repeated digests up to this number are broadcast (28 bytes each), more are joined by a shuffle.
BROADCAST_DIGESTS = 1_000_000
MANIFEST = "path string, bytes long, records long"
RECORDS = "record_id string, uri string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary, offset long, path string"


def opened(uri: str):
    """(file system, path) of a folder or file that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record's bytes: WARC header, HTTP header, and for a response the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", uri or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields.insert(4, ("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        fields.insert(4, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html") -> DataFrame:
    """Write the archives; returns the stored manifest."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), text.alias("html"), F.unhex(F.sha1(F.encode(text, "UTF-8"))).alias("sha")
    )
    # only payloads that occur more than once need to know their response; a hot payload is counted before the shuffle
    copied = rows.groupBy("sha").agg(F.count("*").alias("n"), F.max("id").alias("first")).filter("n > 1").select("sha", "first")
    copied = stored(copied, "warc-copied")
    # payloads move only where the repeated digests are too many to be sent to the tasks
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_DIGESTS else copied
    refers = F.when(F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("first") != F.col("id"))), F.col("first"))
    ready = rows.join(copied, "sha", "left").select("id", "uri", "html", refers.alias("refers"))

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = n = 0
        out = path = None
        for b in batches:
            for page_id, uri, html, refers in zip(*(b[c] for c in ("id", "uri", "html", "refers")), strict=True):
                if out is None:
                    system, place = opened(folder)
                    system.create_dir(place, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, out = f"{folder}/{name}", system.open_output_stream(f"{place}/{name}", compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                own, other = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                data = member(record("response" if other is None else "revisit", own, uri, payload, base32_sha1(payload), other))
                out.write(data)
                at, n = at + len(data), n + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [at], "records": [n]})

    return stored(ready.mapInPandas(archive, MANIFEST), "warc-manifest")


def pieces(file, buffer: bytes, seen: int, place: int) -> Iterator[bytes]:
    """``buffer`` from ``seen`` on, then the file from ``place`` on, where the buffer ends."""
    for i in range(seen, len(buffer), PIECE):
        yield buffer[i : i + PIECE]
    file.seek(place)
    while more := file.read(READ_BYTES):
        for i in range(0, len(more), PIECE):
            yield more[i : i + PIECE]


def inflated(data: Iterator[bytes]) -> tuple[bytes, int] | None:
    """The member at the start of ``data`` and the bytes it takes there; None if it is no WARC record.

    A long member is read once, piece by piece; what is no record ends with its first bytes.
    """
    z, parts, taken, first = zlib.decompressobj(31), [], 0, b""
    for piece in data:
        try:
            parts.append(z.decompress(piece))
        except zlib.error:
            return None
        taken += len(piece)
        if len(first) < len(VERSION):
            first = (first + parts[-1])[: len(VERSION)]
            if not VERSION.startswith(first):
                return None
        if z.eof:
            return (b"".join(parts), taken - len(z.unused_data)) if first == VERSION else None
    return None


def members(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of every member that begins in [start, end) and inflates to a WARC record.

    The buffer never holds more than two reads, however long a member is.
    """
    at, buffer, base = start, b"", start
    while at < end:
        # the buffer holds the file's bytes from base on
        if at + len(MAGIC) > base + len(buffer) and base + len(buffer) < size:
            buffer, base = buffer[at - base :], at
            file.seek(base + len(buffer))
            buffer += file.read(READ_BYTES)
        hit = buffer.find(MAGIC, at - base)
        if hit < 0:
            if base + len(buffer) >= size:
                return
            at = max(at, base + len(buffer) - len(MAGIC) + 1)
            continue
        at = base + hit
        if at >= end:
            return
        found = inflated(pieces(file, buffer, hit, base + len(buffer)))
        if found:
            yield at, found[0]
        at += found[1] if found else 1


def parsed(data: bytes) -> dict:
    """A record's fields and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?mi)^Content-Length: (\d+)", http)
    return {
        "record_id": fields.get("WARC-Record-ID"), "uri": fields.get("WARC-Target-URI", ""), "record_type": fields["WARC-Type"],
        "refers_to": fields.get("WARC-Refers-To"), "payload_digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
        "payload_bytes": int(length[1]) if length else len(payload), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the archives in ``manifest`` (path, bytes), each read by the task whose range it starts in.

    A response whose payload doesn't have its digest or length fails the read.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = manifest.select("path", "bytes", starts.alias("start"))
    tasks = max(1, min(10_000, ranges.count()))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size, start in zip(b["path"], b["bytes"], b["start"], strict=True):
                system, place = opened(path)
                rows, held = [], 0
                with system.open_input_file(place) as file:
                    for at, data in members(file, size, start, min(size, start + range_bytes)):
                        row = parsed(data) | {"offset": at, "path": path}
                        if row["payload"] is not None and (base32_sha1(row["payload"]) != row["payload_digest"] or len(row["payload"]) != row["payload_bytes"]):
                            raise ValueError(f"damaged record at {at} of {path}")
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(data)
                        if held > 16 << 20:
                            yield pd.DataFrame(rows)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows)

    return ranges.repartition(tasks).mapInPandas(scan, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page as a WARC record and reads the archives back."""
    manifest = write(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    number = lambda c: F.regexp_extract(c, r"(-?\d+)", 1).try_cast("long")
    return read(manifest, payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "uri"
    )
