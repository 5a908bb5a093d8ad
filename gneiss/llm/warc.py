"""WARC archives: a writer with revisit records, and a reader that splits files by byte range.

Every record is a gzip member of its own. A reading task scans its range for the gzip magic, takes a candidate for a
member only if it decodes to a WARC header, and owns the records that start inside its range, however far they reach.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.session import delete_at_end, materialise, scratch_path

MAGIC = b"\x1f\x8b\x08"
MIN_SHARED, SPLIT_BYTES, FILE_BYTES, READ_BYTES = 100, 8 << 20, 256 << 20, 1 << 18
DATE = "1970-01-01T00:00:00Z"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def open_fs(path: str):
    """The file system of a shared path, and the path in it; any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if path.startswith("file:") else path)


def record(page_id: int | None, url: str | None, kind: str, digest: str, refers_to: int | None, payload: bytes) -> bytes:
    """One record as a gzip member; a revisit has no payload."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + http + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple:
    """A record's row: page_id, url, record_type, payload_digest as the header has it, payload_bytes, refers_to, payload."""
    head, _, block = member.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    number = lambda v: int(m[1]) if v and (m := re.search(r"urn:page:(-?\d+)>", v)) else None
    block = block[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    url = fields.get("warc-target-uri")
    url = None if url is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
    return number(fields.get("warc-record-id")), url, fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:"), len(payload), number(fields.get("warc-refers-to")), payload


def members(f, size: int, start: int, end: int, step: int = READ_BYTES) -> Iterator[bytes]:
    """The decoded members that start in [start, end) of an open file."""

    def read(at: int) -> bytes:
        f.seek(at)
        return f.read(min(step, size - at))

    def decode(at: int) -> tuple[bytes, int] | None:
        unpack, out, first = zlib.decompressobj(31), [], b""
        try:
            while at < size and not unpack.eof:
                data = read(at)
                out.append(unpack.decompress(data))
                at += len(data) - len(unpack.unused_data)
                if len(first) < 5:
                    first = b"".join(out)[:5]
                    if not b"WARC/".startswith(first[:5]):
                        return None
        except zlib.error:
            return None
        return (b"".join(out), at) if unpack.eof and first == b"WARC/" else None

    at, buffer, base = start, b"", start
    while at < end:
        if not base <= at < base + len(buffer) - 2:
            base, buffer = at, read(at)
        found = buffer.find(MAGIC, at - base)
        if found < 0:
            if base + len(buffer) >= size:
                return
            at = base + len(buffer) - 2
            continue
        at = base + found
        if at >= end:
            return
        if got := decode(at):
            yield got[0]
            at = got[1]
        else:
            at += 1


def write(pages: DataFrame, folder: str, min_shared: int = MIN_SHARED, file_bytes: int = FILE_BYTES) -> int:
    """Write ``pages`` (page_id, url, html) as archives in a shared folder; how many records were written.

    Null html counts as empty. Of pages with equal payloads of at least ``min_shared`` bytes that with the smallest id is
    stored and the others revisit it; rows that share that id are all stored, as are rows without an id if none has one.
    A task that is run again replaces its own files.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", body.alias("body"), F.sha2(body, 256).alias("digest"))
    keys = pages.select("page_id", "digest", F.octet_length("body").alias("n")).filter(F.col("n") >= min_shared)
    shared = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    again = keys.select("page_id", "digest").distinct().join(shared, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_d"), "first")
    out = pages.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_d")), "left").select("page_id", "url", "body", "digest", "first")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        task = TaskContext.get()
        part, sink, done, at, n = 0, None, 0, 0, 0
        name = lambda: f"{top}/part-{task.partitionId():06d}-{part:04d}.warc.gz"
        own = f".{task.taskAttemptId()}.open"
        for b in batches:
            for i, url, payload, digest, first in zip(*(c.to_pylist() for c in b.columns)):
                if sink is None:
                    sink, at = fs.open_output_stream(name() + own, compression=None), 0
                rec = record(i, url, "response" if first is None else "revisit", digest, first, payload if first is None else b"")
                sink.write(rec)
                at, n = at + len(rec), n + 1
                if at >= file_bytes:
                    sink.close()
                    fs.move(name() + own, name())
                    sink, part = None, part + 1
        if sink is not None:
            sink.close()
            fs.move(name() + own, name())
            part += 1
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64())], names=["files", "records"])

    spark = pages.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return out.mapInArrow(put, "files long, records long").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"]


def read(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """The records of all archives in a folder, with payload_bytes and payload_digest of what was stored (a revisit's digest is its header's)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "length")
    ranges = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    # a given number of parts: a range's row is tiny, but its bytes are not, so rows must not be coalesced by size
    parts = min(max(1, ranges.count()), 100_000)
    ranges = ranges.repartition(parts, "path", "start")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns)):
                fs, name = open_fs(path)
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for m in members(f, size, start, min(size, start + split_bytes)):
                        i, url, kind, digest, n, refers, body = parse(m)
                        if kind == "response":
                            digest = hashlib.sha256(body).hexdigest()
                        rows.append((i, url, kind, digest, n, refers, body if payload else None))
                        held += len(body)
                        if held > 8 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                yield _frame(rows)

    return ranges.mapInArrow(take, RECORD)


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of RECORD; ids never pass through floating point, which holds no longs beyond 2**53."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[n for n, _ in fields])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back and resolve revisits; one row per row of ``pages``."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write(pages, folder)
    delete_at_end(spark, folder)
    rows = materialise(read(spark, folder, payload=False).drop("payload"), "records")
    stored = rows.filter("record_type = 'response'").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_n")).dropDuplicates(["_id", "_d"])
    back = rows.join(stored, (rows["refers_to"] == stored["_id"]) & (rows["payload_digest"] == stored["_d"]), "left")
    return back.select("page_id", F.when(F.col("record_type") == "revisit", F.col("_n")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
