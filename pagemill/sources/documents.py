"""Whole documents written from ordered text parts (S9, S10, S13): a data source with a commit of its own.

A document (a combined export) can be larger than any task. Rows of (document, text) sorted by document and
place are cut into ranges; each task appends its texts to one piece file and lists in an index file beside it
which bytes belong to which document. Nobody sees the pieces until the driver has heard of every task and
renames one manifest into place, which lists the pieces in order: a failed job leaves the manifest of the
job before, or none, and a task that runs twice counts once. The manifest has one line per task.

Reading gives the bytes of every document in chunks, with their place in the document's share of the piece.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "ordered_documents"
MANIFEST = "_manifest.json"
CHUNK = 1 << 20
BATCH_BYTES = 4 << 20  # chunks read at a time
INDEX_SCHEMA = "document string, part int, bytes long"
BODY_SCHEMA = "document string, part int, start long, body binary"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of ``path`` (a URI, or a plain path of a shared file system) and the path inside it."""
    return fs.FileSystem.from_uri(path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}")


@dataclass
class Piece(WriterCommitMessage):
    part: int
    name: str | None  # None: no rows


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path
        self.job = f"pieces-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Piece:
        """One piece file and its index; none for a task without rows."""
        store, root = file_system(self.path)
        part = TaskContext.get().partitionId()
        name = f"{self.job}/{part:06d}-{uuid.uuid4().hex}"
        body, index, document, held = None, None, None, 0
        for batch in iterator:
            for doc, text in zip(batch.column("document"), batch.column("text")):
                if body is None:
                    store.create_dir(f"{root}/{self.job}", recursive=True)
                    body, index = store.open_output_stream(f"{root}/{name}.text"), store.open_output_stream(f"{root}/{name}.index")
                doc = doc.as_py()
                if held and doc != document:
                    index.write(json.dumps([document, held]).encode() + b"\n")
                    held = 0
                document, data = doc, (text.as_py() or "").encode()
                body.write(data)
                held += len(data)
        if body is None:
            return Piece(part, None)
        index.write(json.dumps([document, held]).encode() + b"\n")
        body.close()
        index.close()
        return Piece(part, name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        draft = f"{root}/.{self.job}.json"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps([m.name for m in sorted((m for m in messages if m and m.name), key=lambda m: m.part)]).encode())
        store.move(draft, f"{root}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = file_system(self.path)
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class DocumentReader(DataSourceReader):
    def __init__(self, path: str, only_index: bool):
        self.path, self.only_index = path, only_index

    def partitions(self) -> list[InputPartition]:
        store, root = file_system(self.path)
        with store.open_input_file(f"{root}/{MANIFEST}") as f:
            return [InputPartition((k, name)) for k, name in enumerate(json.loads(f.read()))]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        """Batches of about ``BATCH_BYTES``: rows would be gathered by thousands, whatever their size."""
        if partition is None:  # a manifest without pieces
            return
        part, name = partition.value
        store, root = file_system(self.path)
        with store.open_input_stream(f"{root}/{name}.index") as f, store.open_input_stream(f"{root}/{name}.text") as text:
            entries = (json.loads(line) for line in io.TextIOWrapper(io.BufferedReader(f), "utf-8", newline="\n"))
            if self.only_index:
                yield from _batches(((doc, part, size) for doc, size in entries), _INDEX, lambda row: 64 + len(row[0]))
                return
            pieces = ((doc, part, at, text.read(min(CHUNK, size - at))) for doc, size in entries for at in range(0, size, CHUNK))
            yield from _batches(pieces, _BODY, lambda row: 64 + len(row[0]) + len(row[3]))


_INDEX = pa.schema([("document", pa.string()), ("part", pa.int32()), ("bytes", pa.int64())])
_BODY = pa.schema([("document", pa.string()), ("part", pa.int32()), ("start", pa.int64()), ("body", pa.binary())])


def _batches(rows: Iterable[tuple], schema: pa.Schema, taken: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += taken(row)
        if size >= BATCH_BYTES:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


class OrderedDocuments(DataSource):
    """``format("ordered_documents")`` with a folder as ``path``; option ``index`` reads sizes only."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _index(self) -> bool:
        return str(self.options.get("index", "false")).lower() == "true"

    def schema(self) -> str:
        return INDEX_SCHEMA if self._index() else BODY_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return DocumentReader(self.options["path"], self._index())

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        if not overwrite:
            raise ValueError("a folder of documents is replaced as a whole: use mode('overwrite')")
        if schema.names != ["document", "text"]:
            raise ValueError("the columns are document, text")
        return DocumentWriter(self.options["path"])


def write_documents(parts: DataFrame, path: str, *order: str) -> None:
    """Writes ``parts`` (document, text, ...) below ``path``: the bytes of a document are its texts in ``order``.

    ``order`` must tell the rows of a document apart. A null text counts as empty; a document may be of any
    size, since rows are cut into ranges of (document, order) and one may take many tasks. The folder's
    earlier documents are replaced at the commit; their pieces stay on disk for jobs still reading them."""
    parts.sparkSession.dataSource.register(OrderedDocuments)
    cut = parts.repartitionByRange("document", *order).sortWithinPartitions("document", *order)
    cut.select("document", "text").write.format(NAME).mode("overwrite").save(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(document, at, body): chunks of at most 1 MiB and their first byte's place in the document.

    Sizes come from the index files: one row for each document and task that it reaches into."""
    spark.dataSource.register(OrderedDocuments)
    sizes = spark.read.format(NAME).option("index", "true").load(path)
    before = Window.partitionBy("document").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("bytes")
    chunks = spark.read.format(NAME).load(path)
    return chunks.join(sizes, ["document", "part"]).select("document", (F.col("before") + F.col("start")).alias("at"), "body")


def document_blocks(spark: SparkSession, path: str, size: int = 1 << 16) -> DataFrame:
    """(document, block, bytes, sha256): checksums of the blocks of ``size`` bytes of every document, to compare
    two stores without moving them. A block's fragments, at most ``size`` bytes together, meet in one group."""
    chunks = read_chunks(spark, path).withColumn("end", F.col("at") + F.octet_length("body"))
    numbers = F.sequence(F.floor(F.col("at") / size), F.floor((F.col("end") - 1) / size))
    cut = chunks.select("document", "at", "end", "body", F.explode(numbers).alias("block"))
    lo, hi = F.greatest(F.col("at"), F.col("block") * size), F.least(F.col("end"), (F.col("block") + 1) * size)
    piece = F.substring("body", (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int"))
    cut = cut.select("document", "block", F.struct(lo.alias("lo"), piece.alias("piece")).alias("x"))
    whole = cut.groupBy("document", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    body = F.aggregate("xs", F.lit(b""), lambda acc, x: F.concat(acc, x["piece"]))
    return whole.withColumn("body", body).select("document", "block", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha256"))
