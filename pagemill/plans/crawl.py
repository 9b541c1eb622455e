"""Breadth-first crawl over a link table.

The service pops one URL at a time from a FIFO queue; that order is plain BFS: level by level, and
inside a level by (parent's crawl position, link position). So the crawl is a driver loop over levels,
each one a few Spark jobs, until the frontier is empty or a limit is met:

  J3  a queued node that an earlier page was redirected to is skipped when its turn comes
  J8  frontier joins the edges on src (AQE splits a source with a huge out-degree)
  J2  left join with every node seen so far (the written tables of the levels, never rewritten)
  X2  first occurrence of each target: ``min(struct(parent_ord, pos))`` (partial aggregation)
  W5  dense rank in that order without a one-partition window: range sort, per-partition counts,
      offsets from the small counts table (one row per partition), added back
  G4  budget: admit while pages, queue and redirect targets together stay below ``max_pages``
  G6  the final URL of a redirected page counts as seen from that page on

Every link of every expanded page gets one decision (G3): depth, budget, seen, rules or admitted.
Each level is written to the shared checkpoint folder, so lineage stays short. Without redirects the
crawl is that of one site by ``site_crawls``, whose work in a level follows the level's own size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.plans.site_crawls import crawl_sites
from pagemill.session import cut_lineage, written

_LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | row number in partition
_CHUNK = 1 << 16  # rows of one window partition in a running sum over a dense order


def dense_rank_by(df: DataFrame, order_col: str, out: str, base: int = 0) -> DataFrame:
    """``out`` = base + 0-based position of each row in ``order_col`` order, computed without a
    single-partition window: sort (range partitions), tag rows with their partition-local index,
    checkpoint, count rows per partition, prefix-sum those counts (one row per partition)."""
    tagged = cut_lineage(df.orderBy(order_col).withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumns({"_pid": F.shiftright("_mid", _LOCAL_BITS), "_loc": F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)})
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # small: one row per partition
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    ranked = tagged.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
    return ranked.withColumn(out, (F.lit(base) + F.col("_off") + F.col("_loc")).cast("bigint")).drop("_mid", "_pid", "_loc", "_off")


def running_sum(df: DataFrame, order_col: str, value: str, out: str) -> DataFrame:
    """``out`` = sum of ``value`` over the rows up to this one, for a gapless ``order_col``: windows over
    chunks of the order, plus the sums of the chunks before (one row per chunk)."""
    chunked = df.withColumn("_chunk", F.floor(F.col(order_col) / _CHUNK))
    sums = chunked.groupBy("_chunk").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per 65,536 rows
    sums = sums.select("_chunk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_chunk").orderBy(order_col)
    return chunked.withColumn("_in", F.sum(value).over(inside)).join(sums, "_chunk").withColumn(out, F.col("_in") + F.col("_before")).drop("_chunk", "_in", "_before")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bfs(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int | None = None,
    max_pages: int | None = None,
    can_enqueue: str | None = None,
    expandable: DataFrame | None = None,
    aliases: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Crawl ``edges(src, pos, dst[, can_enqueue])`` from ``seeds(node)`` (seed order = node order).

    Returns (frontier, decisions):
      frontier(node, depth, ord, parent, pos, visited): admitted nodes in crawl order (``ord`` dense from
      0); ``visited`` is false for a node skipped in the queue because an earlier page led to it;
      decisions(src, pos, dst, depth, decision) for every link of an expanded node.
    ``expandable(node)`` limits which nodes are fetched successfully and so expand; ``aliases(node,
    alias)`` gives the final URL of redirected pages. Without limits the whole reachable graph is crawled."""
    if aliases is None:  # one site of the many that ``crawl_sites`` walks at once
        of_one = seeds.select(F.lit(0).alias("site"), "node", F.col("node").alias("place"))
        frontier, decisions = crawl_sites(edges, of_one, max_depth, max_pages, can_enqueue, expandable)
        return frontier.withColumn("visited", F.lit(True)).drop("site"), decisions.drop("site")
    kind = dict(seeds.dtypes)["node"]
    no_alias = seeds.sparkSession.createDataFrame([], f"alias {kind}, alias_ord long")
    edges = written(edges, "crawl-edges")
    level = dense_rank_by(seeds.select("node").distinct(), "node", "ord")
    level = level.select("node", F.lit(0).alias("depth"), "ord", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("int").alias("pos"))
    level, used, placed = written(level, "crawl-level"), 0, 0
    seen, led, done, decided = [], [no_alias], [], []
    depth = 0
    while True:
        queued = level.count()
        if not queued:
            break
        seen.append(level.select(F.col("node").alias("dst")))
        used, placed = used + queued, placed + queued
        level = _skip_redirected(level, led, aliases)
        done.append(level)
        new, grown = _new_aliases(level, seen, led, aliases)
        led.append(new)
        src = grown.filter("visited")
        if expandable is not None:
            src = src.join(expandable.select("node"), "node", "left_semi")
        out = src.select(F.col("node").alias("src"), F.col("ord").alias("parent_ord"), "grown").join(edges, "src")  # J8
        depth += 1
        if max_depth is not None and depth > max_depth:
            decided.append(out.select("src", "pos", "dst", F.lit(depth).alias("depth"), F.lit("depth").alias("decision")))
            break
        rules_ok = F.coalesce(F.col(can_enqueue), F.lit(False)) if can_enqueue else F.lit(True)
        out = out.withColumn("_rules", rules_ok).withColumn("_k", F.struct("parent_ord", "pos"))
        flagged = out.join(_union(seen).withColumn("_seen", F.lit(True)), "dst", "left")  # J2
        flagged = flagged.join(_union(led).withColumnRenamed("alias", "dst"), "dst", "left")  # G6
        flagged = flagged.withColumn("_seen", F.col("_seen").isNotNull() | F.coalesce(F.col("alias_ord") <= F.col("parent_ord"), F.lit(False)))
        flagged = written(flagged.select("src", "pos", "dst", "parent_ord", "grown", "_rules", "_k", "_seen"), "crawl-links")
        cand = flagged.where(~F.col("_seen") & F.col("_rules"))
        first = cand.groupBy("dst").agg(F.min_by(F.struct("_k", "grown"), "_k").alias("f")).select("dst", "f._k", "f.grown")  # X2
        ranked = dense_rank_by(first, "_k", "rank")  # W5
        if max_pages is not None:
            ranked = ranked.where(F.col("rank") + F.col("grown") + used < max_pages)  # G4
        nxt = ranked.select(
            F.col("dst").alias("node"), F.lit(depth).alias("depth"), (F.col("rank") + placed).alias("ord"),
            F.col("_k.parent_ord").alias("parent"), F.col("_k.pos").alias("pos"),
        )
        nxt = written(nxt, "crawl-level")
        won = nxt.select(F.col("parent").alias("parent_ord"), "pos", F.lit(True).alias("_won"))
        dec = flagged.join(won, ["parent_ord", "pos"], "left")
        over = F.lit(False)
        if max_pages is not None:
            # the budget is checked first: past the link that filled it, every link of the level is refused
            filled = nxt.agg(F.max(F.struct("parent", "pos")).alias("m"), F.count(F.lit(1)).alias("n")).first()
            full = (F.col("grown") + used + filled.n) >= max_pages
            after = F.lit(True) if filled.m is None else (F.col("parent_ord") > filled.m.parent) | ((F.col("parent_ord") == filled.m.parent) & (F.col("pos") > filled.m.pos))
            over = full & after & F.col("_won").isNull()
        dec = dec.select(
            "src", "pos", "dst", F.lit(depth).alias("depth"),
            F.when(F.col("_won"), "admitted").when(over, "budget").when(F.col("_seen"), "seen").when(~F.col("_rules"), "rules").otherwise("seen").alias("decision"),
        )
        decided.append(dec)
        used += led[-1].count()
        level = nxt
    return _union(done), _union(decided)


def _skip_redirected(level: DataFrame, led: list[DataFrame], aliases: DataFrame) -> DataFrame:
    """``visited`` is false where an earlier page was redirected to the node, in an earlier level or
    before it in this one. A skipped page redirects nowhere, so pages of one level that lead to each
    other are settled in rounds, one more than the longest such chain."""
    onward = written(level.join(aliases, "node").filter(F.col("alias") != F.col("node")).select("node", "alias", "ord"), "crawl-redirects")
    skipped = None
    while True:
        here = onward if skipped is None else onward.join(skipped, "node", "left_anti")
        here = here.groupBy("alias").agg(F.min("ord").alias("alias_ord"))
        earlier = _union([*led, here]).groupBy(F.col("alias").alias("node")).agg(F.min("alias_ord").alias("alias_ord"))
        now = written(level.join(earlier, "node").filter(F.col("alias_ord") < F.col("ord")).select("node"), "crawl-skipped")
        same = skipped is not None and not now.exceptAll(skipped).limit(1).count() and not skipped.exceptAll(now).limit(1).count()
        if same or (skipped is None and not now.limit(1).count()):
            break
        skipped = now
    marked = level.join(now.withColumn("_skip", F.lit(True)), "node", "left")
    return written(marked.withColumn("visited", F.col("_skip").isNull()).drop("_skip"), "crawl-visited")


def _new_aliases(level: DataFrame, seen: list[DataFrame], led: list[DataFrame], aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Final URLs first met on this level (alias, alias_ord), and the level with ``grown``, how many of
    them were met up to each page."""
    met = level.filter("visited").join(aliases, "node").groupBy("alias").agg(F.min("ord").alias("alias_ord"))
    met = met.join(_union(seen).withColumnRenamed("dst", "alias"), "alias", "left_anti").join(_union(led).select("alias"), "alias", "left_anti")
    met = written(met, "crawl-aliases")
    one = met.groupBy(F.col("alias_ord").alias("ord")).agg(F.count(F.lit(1)).alias("_n"))
    counted = level.join(one, "ord", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return met, running_sum(counted, "ord", "_n", "grown").drop("_n")


def first_pages(frontier: DataFrame, successful: DataFrame, max_pages: int | None = None) -> DataFrame:
    """O3: the visited nodes that were fetched successfully, in crawl order, the first ``max_pages`` of them."""
    ok = dense_rank_by(frontier.filter("visited").join(successful.select("node"), "node", "left_semi"), "ord", "page_no")
    return ok if max_pages is None else ok.where(F.col("page_no") < max_pages)


def skipped_counts(decisions: DataFrame) -> DataFrame:
    """A10: links by decision."""
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
