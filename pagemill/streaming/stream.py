"""Structured Streaming forms of the run-long state (ST1, ST2).

ST1: arriving captures -> U1 -> ``dropDuplicates(norm_url)`` (the visited set as state-store
state; without an event-time watermark the state grows with the number of distinct URLs, so a
production stream should pass ``watermark``). ST2: running outcome counts per host, an
aggregation in update mode written per micro-batch with ``foreachBatch``.

Both run with ``Trigger.AvailableNow``; sink and state live below a folder that the caller names, so a
query restarted with the same folder resumes from its offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import with_normalized_url, with_url_parts
from pagemill.operators.fetchlog import outcome


def url_dedupe_stream(source: DataFrame, url_col: str = "url", watermark: tuple[str, str] | None = None) -> DataFrame:
    """ST1 on a streaming DataFrame: first arrival of each normalised URL ('' collects the
    URLs that are not http(s); readers drop it)."""
    df = with_normalized_url(source, url_col, "norm_url")
    if watermark:
        df = df.withWatermark(*watermark)
        return df.dropDuplicatesWithinWatermark(["norm_url"])
    return df.dropDuplicates(["norm_url"])


def outcome_counts_stream(captures: DataFrame) -> DataFrame:
    """ST2 on a streaming DataFrame of capture attempts: counts per (host, reason)."""
    df = with_url_parts(captures, "url", "c_").withColumn("reason", outcome())
    return df.groupBy(F.col("c_host").alias("host"), "reason").agg(F.count(F.lit(1)).alias("n"))


def run_available_now(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a streaming query to completion (AvailableNow) into a Parquet table below ``folder`` and
    return the table. ``folder`` holds the sink and the state: started again with the same folder, the
    query goes on from its offsets and writes each row once."""
    spark = stream.sparkSession
    out, ckpt = f"{folder}/out", f"{folder}/state"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    else:  # update mode: each micro-batch carries the changed groups; a repeated batch replaces its own part

        def upsert(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

        q = stream.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def latest_per_group(updates: DataFrame, keys: list[str]) -> DataFrame:
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in updates.columns if c not in keys + ["epoch"]]), "epoch").alias("v")).select(*keys, "v.*")
