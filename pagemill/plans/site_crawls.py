"""Breadth-first crawls of many sites in one job (X1, G2, G3, G4, J2, J8, W5), and sitemap expansion.

Each site has a queue of its own: its start, then the URLs of its sitemaps, then links level by level in the
order (parent, link position). All sites advance together, one level a round:

  J8  the level joins the links of its pages
  J2  the distinct targets are asked of ``Seen``: a Bloom filter first, its positives exactly
  X2  the first link to each new target
  W5  its place in its site: a dense rank by segments, no window over a whole site
  G4  admitted while the site's places stay below its ``max_pages``

A level is written once; the places a site has used are its level's last place. The decisions of eight levels
are written together. So a round costs a few jobs over what it brings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.operators.robots import with_robots_disallowed
from pagemill.plans.seen import Seen, unions
from pagemill.session import scratch_path, written

_LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | row number in partition


def segmented_rank(df: DataFrame, segment: list[str], order: str, out: str, rows: int | None = None) -> DataFrame:
    """``out`` = 0-based place of each row within its ``segment`` in ``order``.

    One range sort by (segment, order), so a large segment is spread over partitions. A segment's rows in a
    partition are consecutive; what precedes them is the sum of its counts in the partitions before, a
    window over one row per partition that the segment reaches into. A caller that knows ``rows`` to be at most
    65,536 gets the same by a plain window in one stage."""
    if rows is not None and rows <= 1 << 16:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*segment).orderBy(order)) - 1).cast("long"))
    sorted_ = df.repartitionByRange(*segment, order).sortWithinPartitions(*segment, order)
    tagged = written(sorted_.withColumn("_at", F.monotonically_increasing_id()), "segments").withColumn("_part", F.shiftright("_at", _LOCAL_BITS))
    heads = tagged.groupBy("_part", *segment).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*segment).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = heads.select("_part", *segment, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return tagged.join(shift, ["_part", *segment]).withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def one_queue(starts: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """(site, node, place) of the start and the sitemap URLs of every site: the start first, then the
    URLs (site, file_ord, pos, node) by file and position, each at its first place."""
    first = starts.select("site", "node", F.struct(F.lit(-1).cast("long").alias("file_ord"), F.lit(0).alias("pos")).alias("place"))
    listed = sitemap_urls.select("site", "node", F.struct(F.col("file_ord").cast("long").alias("file_ord"), F.col("pos").cast("int").alias("pos")).alias("place"))
    return first.unionByName(listed).groupBy("site", "node").agg(F.min("place").alias("place"))


def crawl_sites(
    edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_pages: int | None = None, can_enqueue: str | None = None,
    expandable: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Crawl ``edges([site, ]src, pos, dst[, can_enqueue])`` from ``seeds(site, node, place)``, every site by itself.

    Returns (frontier, decisions): frontier(site, node, depth, ord, parent, pos), ``ord`` dense from 0 in each
    site; decisions(site, src, pos, dst, depth, decision) for every link of an expanded page, decision one of
    depth, budget, seen, rules, admitted. Edges without ``site`` hold for every site that reaches their source.
    ``max_pages`` holds for each site (seeds are always admitted); ``expandable(node)`` names the pages that
    were fetched. A repeated seed counts once, at its first place."""
    spark, kinds, edge_kinds = edges.sparkSession, dict(seeds.dtypes), dict(edges.dtypes)
    on = ["site", "src"] if "site" in edge_kinds else ["src"]
    edges = written(edges.select(*on, "pos", "dst", *([can_enqueue] if can_enqueue else [])), "site-edges")
    place = f"site {kinds['site']}, node {kinds['node']}, depth int, ord long, parent long, pos {edge_kinds['pos']}"
    link = f"site {kinds['site']}, src {kinds['node']}, pos {edge_kinds['pos']}, dst {edge_kinds['dst']}, depth int, decision string"
    frontier, decided = scratch_path(spark, "site-frontier"), scratch_path(spark, "site-decisions")
    rules = F.coalesce(F.col(can_enqueue), F.lit(False)) if can_enqueue else F.lit(True)
    waiting = [spark.createDataFrame([], link)]

    def put(level: DataFrame, depth: int) -> DataFrame:
        path = f"{frontier}/level={depth}"
        level.write.parquet(path)
        return spark.read.schema(place).parquet(path)

    def decide(made: DataFrame, flush: bool) -> None:
        waiting.append(made)
        if flush or len(waiting) >= 8:
            unions(waiting).write.mode("append").parquet(decided)
            waiting.clear()

    first = segmented_rank(seeds.groupBy("site", "node").agg(F.min("place").alias("place")), ["site"], "place", "ord")
    level = put(first.select("site", "node", F.lit(0).alias("depth"), "ord", F.lit(None).cast("long").alias("parent"), F.lit(None).cast(edge_kinds["pos"]).alias("pos")), 0)
    seen, depth = Seen(spark, ["site", "node"]), 0
    while True:
        src = level if expandable is None else level.join(expandable.select("node"), "node", "left_semi")
        links = src.select("site", F.col("node").alias("src"), F.col("ord").alias("parent")).join(edges, on)  # J8
        depth += 1
        if max_depth is not None and depth > max_depth:
            decide(links.select("site", "src", "pos", "dst", F.lit(depth).alias("depth"), F.lit("depth").alias("decision")), True)
            break
        seen.add(level)
        links = written(links.select("site", "src", "pos", "dst", "parent", rules.alias("_rules")), "site-links")
        targets = links.groupBy("site", F.col("dst").alias("node")).agg(F.min(F.when(F.col("_rules"), F.struct("parent", "pos"))).alias("key"))  # X2
        targets = written(seen.marked(targets, "_seen"), "site-targets")  # J2
        n = targets.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_seen").isNull()).alias("open")).first()
        if n.open:
            targets = written(seen.known(targets, "_seen"), "site-targets")
        # the level before holds a row of every site that is still going on: its last place tells how many are used
        used = level.groupBy("site").agg((F.max("ord") + 1).alias("used"))
        new = targets.filter(~F.col("_seen") & F.col("key").isNotNull()).select("site", "node", "key")
        new = segmented_rank(new, ["site"], "key", "rank", n.rows).join(used, "site").withColumn("ord", F.col("rank") + F.col("used"))  # W5
        if max_pages is not None:
            new = new.filter(F.col("ord") < max_pages)  # G4
        level = put(new.select("site", "node", F.lit(depth).alias("depth"), "ord", "key.parent", "key.pos"), depth)

        known = targets.select("site", F.col("node").alias("dst"), "_seen")
        won = level.select("site", "parent", "pos", F.lit(True).alias("_won"))
        made = links.join(known, ["site", "dst"]).join(won, ["site", "parent", "pos"], "left")
        over = F.lit(False)
        if max_pages is not None:
            # the budget is checked first: past the link that filled it, every link of the site's level is refused
            grown = level.groupBy("site").agg((F.max("ord") + 1).alias("now"), F.max(F.struct("parent", "pos")).alias("last"))
            full = used.join(grown, "site", "left").filter(F.coalesce("now", "used") >= max_pages)
            made = made.join(full.select("site", "last", F.lit(True).alias("_full")), "site", "left")
            over = F.col("_full") & F.coalesce(F.struct("parent", "pos") > F.col("last"), F.lit(True))
        decision = F.when(F.col("_won"), "admitted").when(over, "budget").when(F.col("_seen"), "seen").when(~F.col("_rules"), "rules").otherwise("seen")
        done = level.isEmpty()
        decide(made.select("site", "src", "pos", "dst", F.lit(depth).alias("depth"), decision.alias("decision")), done)
        if done:
            break
    found = spark.read.schema(place).parquet(frontier).select("site", "node", "depth", "ord", "parent", "pos")
    return found, spark.read.schema(link).parquet(decided)


def expand_sitemaps(starts: DataFrame, entries: DataFrame, present: DataFrame, max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Follow index files to their children, theirs too, each file of a site once and in queue order.

    ``starts(site, node)`` names each site's first sitemap file; ``entries(file, kind, pos, loc)`` holds the
    resolved and normalised locations in the files, kind ``sitemap`` or ``url``; ``present(file)`` the files
    that could be read. ``max_files`` limits the files of a site; a missing file uses up its place, as a
    failed fetch does. Returns (files(site, node, depth, file_ord, found), urls(site, file_ord, pos, node))."""
    entries = written(entries.select("file", "kind", "pos", "loc"), "sitemap-entries")
    children = entries.filter("kind = 'sitemap'").select(F.col("file").alias("src"), "pos", F.col("loc").alias("dst"))
    files, _ = crawl_sites(children, starts.select("site", "node", F.lit(0).alias("place")), max_pages=max_files)
    there = present.select(F.col("file").alias("node"), F.lit(True).alias("found")).distinct()
    files = files.join(there, "node", "left").select("site", "node", "depth", F.col("ord").alias("file_ord"), F.coalesce("found", F.lit(False)).alias("found"))
    urls = files.join(entries.filter("kind = 'url'"), files.node == entries.file).select("site", "file_ord", "pos", F.col("loc").alias("node"))
    return files, urls


def with_can_enqueue(df: DataFrame, rules: DataFrame, site: str, url: str, out: str) -> DataFrame:
    """``out`` = the URL belongs to the site (a host name) and no extension or robots rule forbids it.
    The decided rows are written: the conditions are long expressions over the parts of the URL."""
    named = df.withColumns({"__root": U.root_domain(site), "__start": F.lower(site)})
    named = U.with_internal(named, url, "__start", "__root", "__internal")
    named = U.with_ignored_extension(named, url, "__ignored")
    named = with_robots_disallowed(named, rules, url, "__disallowed")
    return written(named.withColumn(out, F.col("__internal") & ~F.col("__ignored") & ~F.col("__disallowed")).select(*df.columns, out), "can-enqueue")
