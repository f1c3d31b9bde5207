"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

Writer: pages meet the smallest page_id of their payload's SHA-256 by a join (SHA-1, which the
records state, can be made to collide); each task then
writes its records, each a gzip member of its own, into archives of about ARCHIVE_BYTES in the
shared folder.  An archive gets its final name only when complete, and a task that runs again
writes the same names, so lost executors leave nothing half done.

Reader: archives are cut into members of one or more records; a member must inflate with its
checksum, and a record begin with a version line, hold as many bytes as its header says and agree
with its block digest.  After a
failed check the reader searches for the next member or version line (an archive may hold both) that
passes, recovers the records from there on, and reports the bytes in between as a quarantined gap.
Inside a member it goes on at the next version line of the inflated bytes; such a gap has the
member's bytes, and its reason names the inflated ones.  Of a member that does not inflate to its
end, or has another checksum, the records before the damage that agree with a block digest stay.

Defined cases: null html is an empty payload, and empty payloads are equal like others; among
rows with equal payloads those with the smallest page_id (null last) are responses, so exact
repeats of that row are responses too; a null url is written as urn:page:<id>; an empty table
writes no archive and gives an empty result; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read, shared_dir

ARCHIVE_BYTES = 8 << 20
MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_HEADER_END = re.compile(rb"\r?\n\r?\n")
_RECORD_END = re.compile(rb"\r?\n\r?\n")
#: Where a record may begin: a member, or a version line.
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, digest: str | None = None) -> bytes:
    """One uncompressed record.  refers_to: the response's page_id makes it a revisit."""
    digest = digest or base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes, pos: int = 0) -> tuple[dict, int]:
    """The record at pos and the place behind it; ValueError says which check failed."""
    m = _VERSION.match(data, pos)
    if not m:
        raise ValueError("no version line")
    stop_line = _HEADER_END.search(data, m.end() - 1)
    if not stop_line:
        raise ValueError("header does not end")
    end, head = stop_line.start(), {}
    for line in data[m.end() : max(end, m.end())].splitlines():
        k, colon, v = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        head[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise ValueError("no length")
    begin = stop_line.end()
    stop = begin + int(head["content-length"])
    tail = _RECORD_END.match(data, stop)
    if not tail:
        raise ValueError("record cut short")
    block = data[begin:stop]
    want = head.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != base32_sha1(block):
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    if head.get("warc-type") == "response" and head.get("warc-payload-digest", "").startswith("sha1:") and head["warc-payload-digest"][5:] != base32_sha1(payload):
        raise ValueError("payload digest differs")
    return {"head": head, "payload": payload}, tail.end()


def _inflate(view: memoryview, pos: int) -> tuple[bytes, int, str]:
    """The gzip member at pos, the place behind it, and what is wrong with it ('' if nothing); of a damaged one, what can be read."""
    z, out, at = zlib.decompressobj(31), [], pos
    while not z.eof:
        chunk = view[at : at + 65536]
        if not chunk:
            return b"".join(out), at, "member cut short"
        try:
            out.append(z.decompress(chunk))
        except zlib.error as e:
            # again up to this chunk, and then byte by byte, for what stands before the damage
            z = zlib.decompressobj(31)
            for x in range(pos, at, 65536):
                z.decompress(view[x : x + 65536])
            try:
                for x in range(len(chunk)):
                    out.append(z.decompress(chunk[x : x + 1]))
            except zlib.error:
                pass
            return b"".join(out), at, f"member damaged: {e}"
        at += len(chunk)
    return b"".join(out), at - len(z.unused_data), ""


def _inner(inner: bytes, damaged: str) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """The valid records of a member's inflated bytes, and the gaps in these.

    In a damaged member only a digest vouches for a record, and one at whose end the bytes break off is not known to be whole.
    """
    torn = bool(damaged) and "incorrect" not in damaged  # else the stream came to its end, with another checksum or length
    records, gaps, at, gap, reason = [], [], 0, None, ""
    while at < len(inner):
        try:
            one, after = parse_record(inner, at)
            if damaged and not one["head"].get("warc-block-digest", "").startswith("sha1:"):
                raise ValueError("no digest in a damaged member")
            if torn and after >= len(inner):
                raise ValueError("record at the end of what can be read")
        except ValueError as e:
            if gap is None:
                gap, reason = at, str(e)
            m = _VERSION.search(inner, at + 1)
            at = m.start() if m else len(inner)
            continue
        if gap is not None:
            gaps.append((gap, at, reason))
            gap = None
        records.append(one)
        at = after
    if gap is not None:
        gaps.append((gap, len(inner), reason))
    return records, gaps


def salvage(data: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """The valid records of an archive, in order, and the quarantined gaps (begin, end, reason)."""
    records, gaps, view = [], [], memoryview(data)
    pos, gap, reason = 0, None, ""
    while pos < len(data):
        bad, inside = "", []
        try:
            if not _START.match(data, pos):
                raise ValueError("no member or record here")
            if data[pos : pos + 3] == _MAGIC:
                inner, after, bad = _inflate(view, pos)
                got, inside = _inner(inner, bad)
                if not got and (bad or inside):
                    raise ValueError(bad or inside[0][2])
            else:
                one, after = parse_record(data, pos)
                got = [one]
        except ValueError as e:
            if gap is None:
                gap, reason = pos, str(e)
            m = _START.search(data, pos + 1)
            pos = m.start() if m else len(data)
            continue
        if gap is not None:
            gaps.append((gap, pos, reason))
            gap = None
        records += got
        gaps += [(pos, after, f"{why} (inflated bytes {x} to {y} of the member)") for x, y, why in inside if not bad]
        if bad:  # it ends where the next member that passes begins
            gap, reason = pos, "; ".join([f"{bad} (after {len(inner)} inflated bytes)", *(f"{why} (inflated bytes {x} to {y})" for x, y, why in inside)])
            m = _START.search(data, pos + 1)
            after = m.start() if m else len(data)
        pos = after
    if gap is not None:
        gaps.append((gap, len(data), reason))
    return records, gaps


def _store(folder: str):
    """What opens files below a folder: plain files for file:, else what pyarrow has for the scheme."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)
    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages; the manifest: archive, n_records, n_bytes."""
    pages = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha2(F.col("html"), 256)))
    first = pages.groupBy("sha").agg(F.min("page_id").alias("first_id"))
    rows = pages.join(first, "sha").sortWithinPartitions("page_id", "sha")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out, made, k = [], [], 0
        size = count = 0

        def close():
            nonlocal out, size, count, k
            if not count:
                return None
            name = f"part-{part:05d}-{k:05d}.warc.gz"
            temp = f"{base}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temp, compression=None) as f:
                for x in out:
                    f.write(x)
            store.move(temp, f"{base}/{name}")
            row = (name, count, size)
            out, size, count, k = [], 0, 0, k + 1
            return row

        for batch in batches:
            ids, urls, htmls, firsts = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id"))
            for page_id, url, html, first_id in zip(ids, urls, htmls, firsts, strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                again = first_id is not None and page_id != first_id and len(payload) >= min_bytes
                x = member(record(page_id, url, payload, first_id if again else None))
                out.append(x)
                size, count = size + len(x), count + 1
                if size >= archive_bytes:
                    made.append(close())
        made.append(close())
        made = [m for m in made if m]
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["archive", "n_records", "n_bytes"])

    return materialise(rows.select("page_id", "url", "html", "first_id").mapInArrow(run, "archive string, n_records long, n_bytes long"), "warc-manifest")


RECORD_SCHEMA = (
    "archive string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, "
    "gap_begin long, gap_end long, gap_reason string"
)


def _read(batches, payloads: bool):
    names = [x.strip().split()[0] for x in RECORD_SCHEMA.split(",")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            name = os.path.basename(path.as_py())
            records, gaps = salvage(content.as_py())
            rows = []
            for r in records:
                h = r["head"]
                num = lambda k, h=h: int(h[k]) if h.get(k, "").lstrip("-").isdigit() else None
                size = num("x-payload-length") if h.get("warc-type") == "revisit" else len(r["payload"])
                rows.append((name, num("x-page-id"), h.get("warc-target-uri"), size, h.get("warc-payload-digest", "").removeprefix("sha1:"), h.get("warc-type"), num("x-refers-to-page-id"), r["payload"] if payloads else None, None, None, None))
            rows += [(name, None, None, None, None, None, None, None, a, b, why) for a, b, why in gaps]
            for a in range(0, len(rows), 500):
                part = rows[a : a + 500]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], types[i]) for i in range(len(names))], names=names)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each valid record, and one for each gap (record_type null, gap_* set)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    return files.mapInArrow(lambda batches: _read(batches, payloads), RECORD_SCHEMA)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/veilspark/warc-{uuid.uuid4().hex}"
    written = write_archives(read(spark, sf_dir, "pages"), folder)
    if written.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = read_archives(spark, folder, payloads=False).filter("record_type is not null")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
