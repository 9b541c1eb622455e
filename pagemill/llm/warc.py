"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of a few whole records, and at its end a
skippable frame with the seek table (sizes of every frame before and after compression, in the public
seekable format). A record is named by its bundle, its frame and the place inside the frame, so
reading one record costs the seek table and one frame.

Payloads met before become revisit records that name the page of the first. Which page that is comes
from a shuffled aggregate of digests; the payloads themselves are shuffled once, by page. Tasks write
their bundles to the shared folder under a name of their own and rename them when they are complete,
so a task that is lost or runs twice leaves one whole file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import scratch_path, written

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1, struct.Struct("<IBI")
ENTRY = struct.Struct("<II")
#: Bytes before compression: a task and its bundle have at most about the first, and aren't made for less than the second.
TASK_BYTES, LEAST_BYTES = 128 << 20, 4 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str | None, payload: bytes, digest: str, date: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit record (without the payload) of page ``refers_to``."""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        head.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        head.append(("WARC-Payload-Length", str(len(payload))))
    block = HTTP_HEAD + payload if refers_to is None else HTTP_HEAD
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: memoryview, at: int, size: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record of ``size`` bytes at a place."""
    whole = bytes(data[at : at + size])
    end = whole.index(b"\r\n\r\n")
    first, *lines = whole[:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no record here")
    head = dict(line.split(": ", 1) for line in lines)
    block = whole[end + 4 : end + 4 + int(head["Content-Length"])]
    return head, block[block.index(b"\r\n\r\n") + 4 :]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(ENTRY.pack(*s) for s in sizes) + FOOTER.pack(len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(file) -> list[tuple[int, int, int]]:
    """(offset, size, size unpacked) of every frame, from the seek table at the end of an open file."""
    total = file.size()
    file.seek(total - FOOTER.size)
    count, _, magic = FOOTER.unpack(file.read(FOOTER.size))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(total - FOOTER.size - count * ENTRY.size)
    table, at, out = file.read(count * ENTRY.size), 0, []
    for packed, plain in ENTRY.iter_unpack(table):
        out.append((at, packed, plain))
        at += packed
    return out


def tasks_for(spark: SparkSession, size: int) -> int:
    """How many tasks share ``size`` bytes: ``TASK_BYTES`` each, or less while that leaves cores idle."""
    return max(1, -(-size // TASK_BYTES), min(spark.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))


def payload_digests(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """id, digest (hex SHA-1) and size (bytes) of every payload, as a written table."""
    payload = F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8")
    return written(pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")), "payload-digests")


def with_first_copy(digests: DataFrame, least_bytes: int) -> DataFrame:
    """id, digest and first: the smallest id with an equal payload of ``least_bytes`` or more."""
    first = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = digests.filter((F.col("size") >= least_bytes) & F.col("id").isNotNull()).join(first, "digest")
    return shared.groupBy("id", "digest").agg(F.min("first").alias("first"))


def write_bundles(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z", frame_bytes: int = 1 << 20, level: int = 3, bundles: int | None = None,
) -> DataFrame:
    """Writes a record per row of ``pages`` into bundles below ``folder`` (any store that pyarrow opens) and
    returns the index as a written table: page (string), bundle, frame, at (place in the unpacked frame), size.

    Of equal payloads of at least ``least_bytes`` the row with the smallest id is a response, the others
    revisit it. Defined results: a null payload is empty and a null URL left blank; a row with a null id
    is always a response; of rows alike in id and payload the first is the response; an empty table
    writes nothing; the number of bundles follows the payloads' bytes unless ``bundles`` names it; other columns are ignored, whatever their names."""
    spark = pages.sparkSession
    digests = payload_digests(pages, id_col, payload_col)
    shared = with_first_copy(digests, least_bytes)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    count = bundles or tasks_for(spark, digests.agg(F.sum("size")).first()[0] or 0)
    # the one shuffle of the payloads, before the join, which keeps its partitions: after it, adaptive execution could fold them into one
    rows = rows.repartition(count, "id", "digest")
    joined = rows.join(shared.select(F.col("id").alias("i"), F.col("digest").alias("d"), "first"), (F.col("id") == F.col("i")) & (F.col("digest") == F.col("d")), "left")
    spread = joined.sortWithinPartitions("digest", "id", "url")
    spread = spread.select(F.col("id").cast("string").alias("page"), F.col("first").cast("string").alias("first"), "url", "payload", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"bundle-{TaskContext.get().partitionId():05d}.warc.zst"
        draft = f"{root}/.{name}.{uuid.uuid4().hex}"
        packer, out, sizes, frame, held, index = zstandard.ZstdCompressor(level=level), None, [], [], 0, []

        def close_frame() -> None:
            nonlocal frame, held
            packed = packer.compress(b"".join(frame))
            out.write(packed)
            sizes.append((len(packed), held))
            frame, held = [], 0

        def entries() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], names=["page", "bundle", "frame", "at", "size"])

        before = None
        for batch in batches:
            for page, first, url, payload, digest in zip(*(c.to_pylist() for c in batch.columns)):
                payload, again = payload.encode(), before == (page, digest)
                before = (page, digest)
                revisit = first if first is not None and (first != page or again) else None
                made = record(str(page), url, payload, base32_sha1(payload), date, revisit)
                if out is None:
                    out = store.open_output_stream(draft)
                index.append((page, f"{root}/{name}", len(sizes), held, len(made)))
                frame.append(made)
                held += len(made)
                if held >= frame_bytes:
                    close_frame()
            if index:
                yield entries()
                index.clear()
        if out is not None:
            if frame:
                close_frame()
            out.write(seek_table(sizes))
            out.close()
            store.move(draft, f"{root}/{name}")

    return written(spread.mapInArrow(run, "page string, bundle string, frame long, at long, size long"), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Every indexed record, read from its bundle by the seek table: page, type, refers_to (page),
    payload_bytes, payload_digest, payload (null for a revisit).

    The digest of a response is taken anew from its payload and must equal its header's (ValueError otherwise).
    Defined results: rows come in any order; an empty index gives none; a null id was written as "None".
    Tasks are as many as the records' bytes need, whatever the size of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        unpacker, bundle, file, table, number, data = zstandard.ZstdDecompressor(), None, None, [], -1, memoryview(b"")
        for batch in batches:
            rows, held = [], 0
            for b, f, at, length, page in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bundle:
                    file = store.open_input_file(b)
                    bundle, table, number = b, frames_of(file), -1
                if f != number:
                    start, size, plain = table[f]
                    file.seek(start)
                    data, number = memoryview(unpacker.decompress(file.read(size), max_output_size=plain)), f
                head, payload = parse(data, at, length)
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = head["WARC-Type"] == "revisit"
                if not revisit and base32_sha1(payload) != digest:
                    raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
                refers = head["WARC-Refers-To"][len("<urn:page:") : -1] if revisit else None
                size = int(head["WARC-Payload-Length"]) if revisit else len(payload)
                rows.append((page, head["WARC-Type"], refers, size, digest, None if revisit else payload))
                held += len(payload)
                if held >= 1 << 24:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page", "type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    # each frame is read by one task, frames of a bundle by many; a stated number, since the index itself is tiny
    tasks = tasks_for(index.sparkSession, index.agg(F.sum("size")).first()[0] or 0)
    ordered = index.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "at").select("bundle", "frame", "at", "size", "page")
    return ordered.mapInArrow(run, "page string, type string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def new_folder(df: DataFrame) -> str:
    """A new folder for bundles below the shared checkpoint folder, as a URI."""
    path = scratch_path(df.sparkSession, "warc")
    return path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}"
