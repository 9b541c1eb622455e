"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

1. One scan writes the digest table (id, digest): 32 bytes a row instead of the text.
2. Misra-Gries counters (``freqItems``) name at most ``1 / support`` candidate digests. Every digest
   with more than ``support`` of the rows is among them; the false ones are removed by exact counts.
3. The verified winners, at most ``1 / support`` rows, are broadcast and settle their copies map-side,
   so a group of copies that holds a third of the rows never meets a shuffle.
4. The other digests take the ordinary shuffled aggregate and join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalized(text: str | Column) -> Column:
    """The compared form: A-Z lower-cased, nothing else changed; a null text is empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(c, F.lit("")), UPPER, UPPER.lower())


def digest(text: str | Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(F.encode(normalized(text), "UTF-8"), 256))


def heavy_digests(digests: DataFrame, support: float) -> DataFrame:
    """Digests with more than ``support`` of the rows: digest, keep (id and row), group_size.

    At most ``1 / support`` rows. Misra-Gries misses none; the exact count removes the rest."""
    named = digests.select(F.hex("digest").alias("h")).freqItems(["h"], support)
    named = named.select(F.explode("h_freqItems").alias("h")).select(F.unhex("h").alias("digest"))
    exact = _groups(digests.join(F.broadcast(named), "digest", "left_semi"))
    least = digests.agg((F.count(F.lit(1)) * F.lit(support)).alias("least"))
    return exact.filter(F.col("group_size") > least.scalar())


def _groups(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(
        F.max_by(F.struct("id", "row"), F.struct(F.col("id").isNotNull(), "id", "row")).alias("keep"),
        F.count(F.lit(1)).alias("group_size"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 1 / 512) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256 (lower-case hex).

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id
    stays. Defined results: a null text equals the empty text; a null id stays only where the group
    has no other id; of repeated rows (same id and text) exactly one is kept; an empty table gives an
    empty result; columns other than ``id_col`` and ``text_col`` are ignored, whatever their names."""
    rows = docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest"))
    table = written(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    heavy = written(heavy_digests(table, support), "heavy-digests")
    light = table.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    settled = table.join(F.broadcast(heavy), "digest").unionByName(light.join(_groups(light), "digest"))
    return settled.select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 1 / 512) -> DataFrame:
    """The rows of ``docs`` that stay, for tables whose ``id_col`` is unique: one semi-join on the id."""
    kept = exact_groups(docs, id_col, text_col, support).filter("kept").select(F.col(id_col).alias("__kept_id"))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept_id"]), "left_semi")
