"""SimHash document fingerprints and Hamming search by permuted block tables, in DataFrame operations only.

Votes are counted in lanes: bit j and bit j + 32 of a hash share one 64-bit sum, 32 bits apart, so the
64 signed counters of a text are 32 sums of a code-generated aggregate over exploded terms. Terms of a
text meet in the task that read it (partial aggregation); what moves is 32 sums a text.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import written

LANE = 0x0000000100000001


def words(text: Column, breaks: str) -> Column:
    """The pieces of ``text`` between characters of the class ``breaks``, without empty ones."""
    return F.array_remove(F.split(text, breaks), "")


def shingle_hash(ws: Column, at: Column, length: int) -> Column:
    """XXH64 (seed 42) of ``length`` words from ``at``, joined by spaces; a shorter end gives fewer words."""
    return F.xxhash64(F.concat_ws(" ", *[F.get(ws, at + k) for k in range(length)]))


def fingerprints(texts: DataFrame, keys: Sequence[str], ws: Column, length: int, name: str = "fingerprint") -> DataFrame:
    """``keys`` and the 64-bit SimHash (long) of the word array ``ws`` of each row, over shingles of
    ``length`` words, repeats included: each occurrence is a vote, so a shingle weighs its frequency.
    A bit is 1 if set in over half of the shingle hashes. Fewer words than ``length``: the whole
    sequence is one shingle; no word: fingerprint 0. ``keys`` must identify the row."""
    keys = list(keys)
    split = texts.select(*keys, ws.alias("__ws"))
    last = F.greatest(F.size("__ws") - F.lit(length), F.lit(0))
    starts = F.when(F.size("__ws") > 0, F.sequence(F.lit(0), last))
    shingles = split.select(*keys, "__ws", F.explode_outer(starts).alias("__at"))
    hashed = shingles.select(*keys, F.when(F.col("__at").isNotNull(), shingle_hash(F.col("__ws"), F.col("__at"), length)).alias("__h"))
    lanes = [F.sum(F.shiftrightunsigned("__h", j).bitwiseAND(F.lit(LANE))).alias(f"__s{j}") for j in range(32)]
    sums = hashed.groupBy(*keys).agg(F.count("__h").alias("__n"), *lanes)
    low = F.lit(0xFFFFFFFF)
    bits = [F.when(F.col(f"__s{j}").bitwiseAND(low) * 2 > F.col("__n"), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(32)]
    bits += [
        F.when(F.shiftrightunsigned(f"__s{j}", 32) * 2 > F.col("__n"), F.lit((1 << (j + 32)) - (1 << 64) * (j == 31))).otherwise(F.lit(0))
        for j in range(32)
    ]
    made = bits[0].cast("long")
    for b in bits[1:]:
        made = made.bitwiseOR(b.cast("long"))
    return sums.select(*keys, made.alias(name))


def as_hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def distance(a: str | Column, b: str | Column) -> Column:
    return F.bit_count((F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b))


# ---------------------------------------------------------------- search


def block_masks(blocks: int) -> list[int]:
    """64 bits cut into ``blocks`` runs of nearly equal length, as masks."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(ends, ends[1:])]


def block_tables(fps: DataFrame, fp: str, radius: int, blocks: int) -> DataFrame:
    """``fps`` once for each table: table (int) and key, the bits of ``blocks - radius`` of the blocks.

    Fingerprints within ``radius`` bits agree on at least ``blocks - radius`` whole blocks, so they share
    the key of at least one of the C(blocks, radius) tables; a key is the leading part of a permuted table."""
    masks = block_masks(blocks)
    tables = []
    for t, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        mask -= (1 << 64) * (mask >> 63)
        tables.append(F.struct(F.lit(t).alias("table"), F.col(fp).bitwiseAND(F.lit(mask)).alias("key")))
    return fps.select("*", F.inline(F.array(*tables)))


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs (q, fp, distance) of distinct fingerprints ``queries.q`` and ``fps.fp`` at most ``radius``
    bits apart, equal ones included; every such pair once. Both sides are made distinct first, so copies
    cost nothing; the pair is reported by the first table whose blocks agree. Nulls match nothing."""
    masks = [m - (1 << 64) * (m >> 63) for m in block_masks(blocks)]
    left = block_tables(queries.select("q").filter("q is not null").distinct(), "q", radius, blocks)
    right = block_tables(fps.select("fp").filter("fp is not null").distinct(), "fp", radius, blocks)
    met = left.join(right, ["table", "key"]).withColumn("distance", distance("q", "fp")).filter(F.col("distance") <= radius)
    agree = [F.col("q").bitwiseXOR(F.col("fp")).bitwiseAND(F.lit(m)) == 0 for m in masks]
    first = F.lit(None).cast("int")
    for t, chosen in reversed(list(enumerate(combinations(range(blocks), blocks - radius)))):
        both = agree[chosen[0]]
        for b in chosen[1:]:
            both = both & agree[b]
        first = F.when(both, F.lit(t)).otherwise(first)
    return met.filter(F.col("table") == first).select("q", "fp", "distance")


# ---------------------------------------------------------------- each document beside its successor


def _cuts_above(cuts: list[float], x: Column) -> Column:
    """How many of the ascending ``cuts`` are at least ``x`` (null for null), in two steps of about sqrt(n) tests."""
    if not cuts:
        return F.when(x.isNotNull(), F.lit(0))
    step = max(1, round(len(cuts) ** 0.5))
    parts = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    part = F.size(F.filter(array([p[-1] for p in parts]), lambda c: c < x))
    inside = F.size(F.filter(F.get(F.array(*[array(p) for p in parts]), part), lambda c: c >= x))
    after = F.get(array([len(cuts) - min(len(cuts), (k + 1) * step) for k in range(len(parts))]), part)
    return F.when(x.isNotNull(), F.when(part >= len(parts), F.lit(0)).otherwise(inside + after))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2, buckets: int | None = None, radius: int = 3) -> DataFrame:
    """Each text's fingerprint beside that of an edited text and of the next document's text.

    The edited text ends, instead of its last floor(n_chars / 2) code points, with the first as many of
    the next document by descending id (the first document after the last). Returns ``id_col``, n_chars,
    edited_sha256, fingerprint, edited_fingerprint (16 hex digits), near_edited, near_next (1 - distance
    / 64) and near_docs: for ids divisible by 100, how many documents, itself included, lie within
    ``radius`` bits (found by permuted block tables), else null. Defined results: a null text is empty and
    has fingerprint 0; a null id is last in the order; repeated ids are ordered by their texts; a single
    document is its own successor; an empty table gives an empty result."""
    spark = docs.sparkSession
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    beside = with_next(texts, "id", ["text"], buckets)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    twice = beside.select(
        "range", "at", "id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"),
        "next_range", "next_at",
    )
    keys = ["range", "at", "id", "n_chars", "sha", "next_range", "next_at"]
    twice = twice.withColumn("sha", F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256)))
    twice = twice.select(*keys, F.posexplode(F.array("text", "edited")).alias("kind", "body"))
    made = fingerprints(twice, [*keys, "kind"], words(F.lower("body"), r"\s+"), length)
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("fingerprint")))
    rows = written(made.groupBy(*keys).agg(of(0).alias("own"), of(1).alias("edited")), "fingerprints")

    following = rows.select(F.col("range").alias("next_range"), F.col("at").alias("next_at"), F.col("own").alias("next"))
    is_query = F.coalesce(F.col("id") % 100 == 0, F.lit(False))
    weights = rows.groupBy(F.col("own").alias("fp")).agg(F.count(F.lit(1)).alias("copies"))
    near = within_radius(rows.filter(is_query).select(F.col("own").alias("q")), weights, radius)
    near = near.join(weights, "fp").groupBy(F.col("q").alias("own")).agg(F.sum("copies").alias("near_docs"))
    asked = rows.withColumn("asked", F.when(is_query, F.col("own")))
    near = near.withColumnRenamed("own", "asked")
    out = asked.join(following, ["next_range", "next_at"]).join(near, "asked", "left")
    like = lambda a, b: 1 - distance(a, b) / F.lit(64.0)
    return out.select(
        F.col("id").alias(id_col), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        as_hex("own").alias("fingerprint"), as_hex("edited").alias("edited_fingerprint"),
        like("own", "edited").alias("near_edited"), like("own", "next").alias("near_next"), "near_docs",
    )


def with_next(docs: DataFrame, id_col: str, carry: Sequence[str], buckets: int) -> DataFrame:
    """``docs`` with ``next_<c>`` for each ``c`` of ``carry``, of the next row by descending id; after the
    last comes the first again. (range, at) numbers a row, (next_range, next_at) its successor. No one-task window: rows are cut into ``buckets`` id ranges by
    approximate quantiles; only the last row of a range looks up the first row of the next range.

    Ties of the id are ordered by the hash of the carried columns; a null id comes last."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("double"), [k / buckets for k in range(1, buckets)], 10000)).first()[0]
    cuts = sorted(set(cuts or []))
    order = [F.col(id_col).desc_nulls_last(), F.xxhash64(*carry).desc()]
    # ranges are numbered downwards: 0 holds the largest ids, nulls are in the last
    ranged = docs.withColumn("range", F.coalesce(_cuts_above(cuts, F.col(id_col).cast("double")), F.lit(len(cuts) + 1)))
    w = Window.partitionBy("range").orderBy(*order)
    rows = ranged.withColumn("at", F.row_number().over(w))
    for c in carry:
        rows = rows.withColumn(f"in_{c}", F.lead(F.struct(F.col(c).alias("v"))).over(w))
    # first row of each range that has rows, and the range before it (the last one before the first)
    heads = ranged.groupBy("range").agg(F.max_by(F.struct(*carry), F.struct(F.col(id_col).isNotNull(), F.col(id_col), F.xxhash64(*carry))).alias("head"))
    heads = written(heads, "range-heads")
    present = sorted(r["range"] for r in heads.select("range").collect())  # at most buckets + 1 numbers
    after = list(zip(present, present[1:] + present[:1])) or [(0, 0)]
    chain = spark.createDataFrame(after, "range int, range_next int")
    heads = heads.withColumnRenamed("range", "range_next").join(F.broadcast(chain), "range_next")
    joined = rows.join(heads.select("range", "head", "range_next"), "range", "left")
    last = F.col(f"in_{carry[0]}").isNull()
    return joined.select(
        *docs.columns, "range", "at",
        F.when(last, F.col("range_next")).otherwise(F.col("range")).alias("next_range"), F.when(last, F.lit(1)).otherwise(F.col("at") + 1).alias("next_at"),
        *[F.coalesce(F.col(f"in_{c}.v"), F.when(F.col(f"in_{c}").isNull(), F.col(f"head.{c}"))).alias(f"next_{c}") for c in carry]
    )
