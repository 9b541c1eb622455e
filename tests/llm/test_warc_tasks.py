"""Bundles are made and read by as many tasks as their bytes need."""

from pyspark.sql import functions as F

from pagemill.llm import warc


def test_read_back_uses_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_BYTES", 10_000)
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha1(F.col("id").cast("string")), 20).alias("html"))
    folder = warc.new_folder(pages)
    index = warc.write_bundles(pages, folder, frame_bytes=4000)
    assert 1 < index.select("bundle").distinct().count() <= spark.sparkContext.defaultParallelism
    back = warc.read_records(index, folder).withColumn("task", F.spark_partition_id())
    assert back.select("task").distinct().count() > 1
    # a frame is read by one task only
    where = index.select("page", "bundle", "frame").join(back.select("page", "task"), "page")
    assert where.groupBy("bundle", "frame").agg(F.count_distinct("task").alias("n")).filter("n > 1").count() == 0
    assert {(r.page, bytes(r.payload).decode()) for r in back.collect()} == {(str(r.page_id), r.html) for r in pages.collect()}


def test_number_of_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [warc.tasks_for(spark, n) for n in (0, 1, warc.LEAST_BYTES + 1)] == [1, 1, min(2, cores)]
    assert warc.tasks_for(spark, 1000 * warc.TASK_BYTES) == max(1000, cores)
