"""Documents written from ordered parts: byte-equal, whole or not at all."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions.text import normalize_markdown
from pagemill.session import scratch_path
from pagemill.sources import documents, files

PARTS = [(d, k, f"{d} part {k} \u00e9\u4e2d\U0001f600\n" * (k % 7)) for d in ("a.md", "b.md", "c.md") for k in range(60 if d == "b.md" else 3)]


def read_back(spark, path):
    found = {}
    for r in sorted(documents.read_chunks(spark, path).collect(), key=lambda r: (r.document, r.at)):
        assert r.at == len(found.get(r.document, b""))
        found[r.document] = found.get(r.document, b"") + bytes(r.body)
    return {k: v.decode() for k, v in found.items()}


def whole(parts):
    return {d: "".join(t for x, _, t in parts if x == d) for d in {p[0] for p in parts}}


def test_documents_come_back_byte_equal(spark, monkeypatch):
    monkeypatch.setattr(documents, "CHUNK", 50)
    path = scratch_path(spark, "documents")
    df = spark.createDataFrame(PARTS, "document string, k int, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        documents.write_documents(df, path, "k")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spark.read.format(documents.NAME).option("index", "true").load(path).filter("document = 'b.md'").count() > 1
    assert read_back(spark, path) == whole(PARTS)
    blocks = documents.document_blocks(spark, path, 64).orderBy("document", "block").collect()
    assert {d: sum(b.bytes for b in blocks if b.document == d) for d in whole(PARTS)} == {d: len(t.encode()) for d, t in whole(PARTS).items()}
    assert all(b.bytes == 64 for b, after in zip(blocks, blocks[1:]) if b.document == after.document)


def test_a_failed_job_leaves_the_earlier_documents(spark):
    path = scratch_path(spark, "documents")
    df = spark.createDataFrame(PARTS, "document string, k int, text string")
    documents.write_documents(df, path, "k")
    bad = df.withColumn("text", F.when((F.col("document") == "c.md") & (F.col("k") == 2), F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="lost"):
        documents.write_documents(bad, path, "k")
    assert read_back(spark, path) == whole(PARTS)
    store, root = documents.file_system(path)
    assert len([f for f in store.get_file_info(documents.fs.FileSelector(root)) if f.base_name.startswith("pieces-")]) == 1
    documents.write_documents(df.limit(0), path, "k")
    assert read_back(spark, path) == {}


def test_columns_and_mode_are_checked(spark):
    path = scratch_path(spark, "documents")
    spark.dataSource.register(documents.OrderedDocuments)
    with pytest.raises(Exception, match="document, text"):
        spark.range(1).write.format(documents.NAME).mode("overwrite").save(path)
    with pytest.raises(Exception, match="overwrite"):
        spark.createDataFrame([("a", "b")], "document string, text string").write.format(documents.NAME).mode("append").save(path)


def test_import_parts_concatenate_to_the_normalised_whole(spark):
    bodies = ["text\n\n\n\nmore  \n", "", None, "  \n", "a\r\nb\x0b", "```\n\n\n\n```", "end \n \n \n x"]
    rows = [(k, t, "s", u, b) for k, (b, u, t) in enumerate((b, u, t) for b in bodies for u in (None, "http://x/") for t in ("Title", " ", "", "a\n\n\nb"))]
    docs = spark.createDataFrame(rows, "doc_no long, title string, source string, url string, body_markdown string")
    parts = [r.text for r in files.import_combined(docs).orderBy("doc_no").collect()]
    raw = [r.text for r in files.import_combined_parts(docs).orderBy("doc_no").collect()]
    one = spark.createDataFrame([("\n".join(raw),)], "text string").select(normalize_markdown("text")).first()[0]
    assert "".join(parts) == one


def test_chunks_are_read_in_small_batches(spark, monkeypatch, tmp_path):
    """A piece is larger than any batch: its chunks leave a few at a time, not by thousands."""
    from pyspark.sql.datasource import InputPartition

    (tmp_path / "one.text").write_bytes(b"0123456789" * 1000)
    (tmp_path / "one.index").write_text('["aé.md", 0]\n["b.md", 9000]\n["c.md", 1000]\n', "utf-8")
    monkeypatch.setattr(documents, "CHUNK", 400)
    monkeypatch.setattr(documents, "BATCH_BYTES", 2000)
    batches = list(documents.DocumentReader(str(tmp_path), False).read(InputPartition((3, "one"))))
    assert len(batches) > 5 and max(b.num_rows for b in batches) <= 5
    rows = [r for b in batches for r in b.to_pylist()]
    assert b"".join(r["body"] for r in rows) == b"0123456789" * 1000 and {r["part"] for r in rows} == {3}
    assert [r["start"] for r in rows if r["document"] == "c.md"] == [0, 400, 800]
    index = [r for b in documents.DocumentReader(str(tmp_path), True).read(InputPartition((3, "one"))) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in index] == [("aé.md", 3, 0), ("b.md", 3, 9000), ("c.md", 3, 1000)]
