"""Session, table access and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pagemill") -> SparkSession:
    """Session for tests and the bench (local mode, UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune_session(spark)
    ensure_checkpoint_dir(spark)
    return spark


# Optimizer rules that walk every join key's lineage; with the long projection chains of the
# URL and HTML operators they cost minutes of planning and prune nothing (no partitioned tables).
PLANNING_CONF = {
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "false",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "false",
}


def tune_session(spark: SparkSession) -> SparkSession:
    for k, v in PLANNING_CONF.items():
        spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; set a scratch one only when none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is; without it a
    cluster job is refused, because executors and driver share no machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="pagemill-ckpt-", dir=os.environ.get("PAGEMILL_SCRATCH", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once into the shared checkpoint folder and read again (survives executor loss). A
    Parquet table rather than ``checkpoint()``: that one runs the job twice and keeps whole rows."""
    return written(df, "cut")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, columns prunable, lineage cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def size_at_most(df: DataFrame, rows: int) -> bool:
    """Size check before a broadcast: True when ``df`` holds at most ``rows`` rows.

    Runs a bounded job (``limit(rows + 1)``), never collects the rows themselves.
    """
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a table of fewer files than there are cores over the cluster (a file with one row
    group is one task). A table of many files, or a frame that reads none, is returned unchanged; only
    the file list is looked at, nothing is run."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
