"""Document pipeline: toxic documents go, recurring lines go, one of each group of near copies stays, the rest is packed.

Each stage reads what the one before wrote (Parquet in the shared folder). All but the last return the
columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.line_templates import without_recurring
from pagemill.llm.packing import pack_documents
from pagemill.llm.pigeonhole import without_near_copies
from pagemill.llm.registry import CATEGORIES, toxicity_labels
from pagemill.llm.toxicity import toxicity
from pagemill.session import table, written

#: Workers outlive a stage with what they keep, beside the other stages' memory: fewer pieces than packing alone keeps.
MEMO_PIECES = 150_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain gives a toxic probability below one half."""
    scored = toxicity(docs, toxicity_labels(spark, sf_dir), CATEGORIES)
    return scored.filter("p_toxic < 0.5").select(*docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of templates that recur in three documents or more (long lines: two), but for the first; n_chars follows."""
    cleaned = without_recurring(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of linked fingerprints."""
    return without_near_copies(docs, length=3, radius=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), memo_pieces=MEMO_PIECES)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_recurring_lines), ("near-duplicates", drop_near_copies), ("packing", pack_sequences)]

#: The classifier, the propagation over links and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
