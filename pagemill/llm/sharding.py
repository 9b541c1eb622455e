"""Consistent-hash sharding with virtual nodes and bounded loads, in DataFrame operations only.

Each shard owns ``vnodes`` points of a 32-bit ring and each key one place on it. A key belongs to the
shard of the next point clockwise; when that shard is full, the key goes on clockwise to the next
shard with room. Capacities differ by one at most and add up to the number of keys, so counts are at
most one apart, and every key that its own shard can hold stays where plain consistent hashing puts it.

Whether a key overflows depends only on its arc (the ring between two points), its rank there and the
number of keys in each arc. Spark counts the keys of the arcs (``shards * vnodes`` numbers, bounded by
parameters); the walk around the ring is planned on those numbers as rank intervals; each key finds
its interval with a broadcast join. Ranks come from windows over ring cells, not over shards.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.session import written

RING_BITS = 32


def ring_place(key: Column, salt: int = 0) -> Column:
    """Place on the ring, 0 to 2**32 - 1."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 64 - RING_BITS)


def ring_points(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node in clockwise order; a place taken twice goes to the lower shard."""
    made = spark.range(shards * vnodes).select(
        ring_place(F.concat_ws("/", F.lit("shard"), (F.col("id") / vnodes).cast("long"), F.col("id") % vnodes)).alias("place"),
        (F.col("id") / vnodes).cast("int").alias("shard"),
    )
    rows = made.groupBy("place").agg(F.min("shard").alias("shard")).orderBy("place").collect()
    return [(r.place, r.shard) for r in rows]


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def plan_arcs(points: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the keys of each arc go.

    Round 0 offers each arc's keys to its own shard, round k to the owner of the k-th point further on;
    in a round arcs are served in ring order. Lower ranks settle first."""
    room, used, plan = list(room), [0] * len(room), []
    waiting = [(a, 0, n) for a, n in sorted(counts.items()) if n]
    step = 0
    while waiting:
        left = []
        for arc, lo, n in waiting:
            shard = points[(arc + step) % len(points)][1]
            take = min(n, room[shard])
            if take:
                plan.append((arc, lo, lo + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if n > take:
                left.append((arc, lo + take, n - take))
        waiting, step = left, step + 1
    return plan


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, vnodes: int = 64, cell_bits: int = 14) -> DataFrame:
    """One row per input row: ``id_col``, size, text_crc32, home_shard, shard, slot.

    size is the text's UTF-8 bytes plus 16; ``home_shard`` is the owner without load bounds. Defined results: a null text counts as empty;
    rows with a null or repeated id are keys like any other: they share a place and are ranked by size
    and checksum there, alike rows in any order; shards beyond the number of rows stay empty; an empty table
    gives an empty result; other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
    )
    keys = keys.withColumn("place", ring_place(F.struct("id")))
    points = ring_points(spark, shards, vnodes)
    places = [p for p, _ in points]
    # one row per ring cell and arc that meet: a bounded table that turns a place into its arc by an equi-join
    bits = RING_BITS - cell_bits
    cells, arc = [], 0
    for cell in range(1 << cell_bits):
        lo, hi = cell << bits, (cell + 1) << bits
        while True:
            arc = bisect_left(places, lo)
            end = min(hi, places[arc] + 1) if arc < len(places) else hi
            cells.append((cell, lo, end, arc % len(places)))
            lo = end
            if lo >= hi:
                break
    arcs = spark.createDataFrame(cells, "cell int, lo long, end long, arc int")
    cell_of = F.shiftright("place", bits).cast("int")
    placed = keys.withColumn("cell", cell_of).join(F.broadcast(arcs), "cell").filter("place >= lo and place < end")
    order = ["place", "id", "size", "crc"]
    ranked = placed.withColumn("in_cell", F.row_number().over(Window.partitionBy("cell", "arc").orderBy(*order)) - 1)
    ranked = written(ranked.select("id", "size", "crc", "cell", "lo", "arc", "in_cell"), "ring-ranks")
    # at most cells + points numbers, whatever the number of rows
    met = ranked.groupBy("arc", "lo").agg(F.count(F.lit(1)).alias("n")).collect()
    wrap = places[-1] + 1  # the arc past the last point starts there and goes on at 0
    counts: dict[int, int] = {}
    starts = []
    for r in sorted(met, key=lambda r: (r.arc, (r.lo < wrap) if r.arc == 0 else 0, r.lo)):
        starts.append((r.arc, r.lo, counts.get(r.arc, 0)))
        counts[r.arc] = counts.get(r.arc, 0) + r.n
    plan = plan_arcs(points, counts, capacities(sum(counts.values()), shards))
    owner = [s for _, s in points]
    offsets = spark.createDataFrame([(a, lo, n, owner[a]) for a, lo, n in starts], "arc int, lo long, before long, home_shard int")
    where = spark.createDataFrame(plan, "arc int, first long, last long, shard int, base long")
    rank = F.col("before") + F.col("in_cell")
    found = ranked.join(F.broadcast(offsets), ["arc", "lo"]).withColumn("rank", rank).join(F.broadcast(where), "arc")
    return found.filter("rank >= first and rank < last").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "home_shard",
        "shard",
        (F.col("base") + F.col("rank") - F.col("first")).alias("slot"),
    )
