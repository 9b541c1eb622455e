"""Importance resampling towards a target text, with the cutoff found by weighted medians of medians.

Each text is a bag of hashed runs of words. Two arrays of bucket counts, of the corpus and of the target,
give an array of gains; a text's weight is the floored mean of its features' gains, and a fixed random number
of its id (Gumbel noise) makes the highest scores a draw without replacement in proportion to the weights.

The highest ``draw`` scores are found without a sort of the whole: of what is left, every partition names the
median of its keys, weighted by how many it has. At least a quarter of all keys lies on either side of the
weighted median of these, so after counting above it a quarter at least is discarded for good. Only winners
are sorted, by ranges."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.session import written

#: A to Z become a to z; digits, small letters and bytes from 0x80 on stay; all others become blanks.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of ``text`` in UTF-8, A to Z lower-cased: stretches of digits, letters a to z and characters from U+0080 on."""
    return text.encode().translate(_TO_WORDS).split() if text else []


def buckets_of(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to ``longest`` consecutive words, joined by blanks, repeats included."""
    crcs = runs = list(map(zlib.crc32, words))
    blank = [b" " + w for w in words[1:]]
    found = [np.array(crcs, np.int64)]
    for n in range(1, longest):
        # a run's checksum goes on from that of the run without its last word
        runs = list(map(zlib.crc32, blank[n - 1 :], runs))
        found.append(np.array(runs, np.int64))
    return np.concatenate(found) % buckets


def bucket_counts(texts: DataFrame, text_col: str, longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket. Every task adds up one array first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(buckets_of(words_of(text.as_py()), longest, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return texts.select(F.col(text_col)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """For each bucket floor(1000 * ln of the target's smoothed share over the corpus's). ``buckets`` numbers come to the driver."""
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").fillna(0)
    rows = F.broadcast(both.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))).join(both, "bucket", "left").fillna(0)
    every = Window.partitionBy()  # over ``buckets`` rows
    d = lambda c: c.cast("double")
    total = lambda c: d(F.sum(c).over(every) + buckets)
    share = (d(F.col("t") + 1) * total("s")) / (d(F.col("s") + 1) * total("t"))
    found = rows.select("bucket", F.floor(1000 * F.log(share)).alias("gain")).collect()
    return [r["gain"] for r in sorted(found)]


def _key(score: str = "score", id_col: str = "id", place: str = "place") -> list[Column]:
    """A total order: the highest score first, ties to the smaller id (null last), then by the row's place."""
    return [F.col(score).desc(), F.col(id_col).asc_nulls_last(), F.col(place).asc()]


def _before(key: tuple) -> Column:
    """Rows that come before ``key`` (score, has no id, id, place) in that order."""
    score, none, ident, place = key
    same = F.col("id").isNull() if none else F.col("id") == F.lit(ident)
    less = F.col("id").isNotNull() if none else F.coalesce(F.col("id") < F.lit(ident), F.lit(False))
    return (F.col("score") > score) | ((F.col("score") == score) & (less | (F.coalesce(same, F.lit(False)) & (F.col("place") < place))))


def _medians(keys: DataFrame) -> list[tuple[tuple, int]]:
    """The middle key of every partition that has rows, and how many it has; one row a partition comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            columns = [t.column(c).to_numpy() for c in ("score", "none", "id", "place")]
            order = np.lexsort((columns[3], columns[2], columns[1], -columns[0]))
            mid = int(order[(len(order) - 1) // 2])
            yield pa.RecordBatch.from_arrays([t.column(c).slice(mid, 1).combine_chunks() for c in t.column_names] + [pa.array([len(order)])], names=[*t.column_names, "n"])

    kinds = dict(keys.dtypes)
    rows = keys.select("score", F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "place")
    found = rows.mapInArrow(run, f"score long, none boolean, id {kinds['id']}, place long, n long").collect()
    return [((r.score, r.none, r.id, r.place), r.n) for r in found]


def cutoff_key(keys: DataFrame, draw: int, rewrite: float = 0.25) -> tuple | None:
    """The ``draw``-th key of ``keys`` (id, score, place) in the order of ``_key``; None where there are not so many.

    Every round discards a guaranteed quarter of what is left. What is left is written anew once it has
    shrunk to ``rewrite`` of the table last written, so all rounds together read a small multiple of the input."""
    left, written_rows = keys, None
    order = lambda key: (-key[0], *key[1:])
    while True:
        found = sorted(_medians(left), key=lambda x: order(x[0]))
        n = sum(m for _, m in found)
        written_rows = written_rows or n
        if draw < 1 or n < draw:
            return None
        seen = 0
        for middle, m in found:
            seen += m
            if 2 * seen >= n:
                break
        above = left.filter(_before(middle)).count()
        if above == draw - 1:
            return middle
        if above >= draw:
            left, n = left.filter(_before(middle)), above
        else:
            left, draw, n = left.filter(~_before(middle)).filter(~_is(middle)), draw - above - 1, n - above - 1
        if n <= rewrite * written_rows:
            left, written_rows = written(left, "cutoff"), n


def _is(key: tuple) -> Column:
    score, none, ident, place = key
    same = F.col("id").isNull() if none else F.col("id") == F.lit(ident)
    return F.coalesce((F.col("score") == score) & same & (F.col("place") == place), F.lit(False))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with rank 1, 2, 3... in a total order: a sort by ranges, and a sum over the sizes of its partitions."""
    names = rows.columns
    by_range = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = written(by_range.select(F.struct(*names).alias("row"), F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("number")), "ranked")
    sizes = cut.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"))
    # one row for each partition of the sort
    before = F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("range", "first", before.alias("before")))
    return cut.join(offsets, "range").select("row.*", (F.col("before") + F.col("number") - F.col("first") + 1).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    longest: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7,
) -> DataFrame:
    """Every document's ``id_col``, n_features, weight, score, and rank from 1 among the floor(``percent`` * N / 100)
    drawn of the N documents with at least ``least_words`` words (null: not drawn).

    The texts are read twice and never shuffled; numbers alone are written. ``id_col`` is a whole number.
    Defined results: a null or wordless text has no features and weight 0; a null id has a null score and is not
    drawn; rows that repeat an id and text tie, and the one first written is drawn first; an empty corpus
    gives an empty result, an empty target a weight near 0 for all; other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    table = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets), buckets)
    shared = spark.sparkContext.broadcast(np.array(table, np.int64))  # ``buckets`` numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                at = buckets_of(words, longest, buckets)
                n_words.append(len(words))
                n_features.append(len(at))
                weight.append(int(shared.value[at].sum()) // len(at) if len(at) else 0)
            numbers = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers], names=["id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)[id_col]
    weighed = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed.withColumn("score", F.col("weight") + noise).withColumn("place", F.monotonically_increasing_id()), "scores")

    able = scored.filter((F.col("n_words") >= least_words) & F.col("score").isNotNull()).select("id", "score", "place")
    draw = able.count() * percent // 100
    cut = cutoff_key(able, draw)
    out = ["id", "n_features", "weight", "score"]
    if cut is None:
        result = scored.select(*out, F.lit(None).cast("long").alias("rank"))
    else:
        wins = (F.col("n_words") >= least_words) & F.col("score").isNotNull() & (_before(cut) | _is(cut))
        winners = ranked(scored.filter(wins).select(*out, "place"), _key()).select(*out, "rank")
        result = winners.unionByName(scored.filter(~F.coalesce(wins, F.lit(False))).select(*out, F.lit(None).cast("long").alias("rank")))
    return result.withColumnRenamed("id", id_col)
