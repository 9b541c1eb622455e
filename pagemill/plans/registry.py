
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.operators import lines
from pagemill.sources import documents as DS
from pagemill.session import cut_lineage, scratch_path, spread, table, tune_session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune_session(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn

    return deco


# ---------------------------------------------------------------- step 0: lines


@register("a1_line_freq")
def a1_line_freq(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_frequencies(spread(table(spark, d, "documents").select("text")))


@register("a2_boilerplate")
def a2_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return lines.boilerplate_filter(table(spark, d, "documents"), "doc_id", "text")


# ---------------------------------------------------------------- step 1: URLs

from pyspark.sql import functions as F  # noqa: E402

from pagemill.functions import text as T  # noqa: E402
from pagemill.functions import urls as U  # noqa: E402

# Fixed parameters of the example jobs (a user passes their own Config).
EXAMPLE_PREFIXES = ("/en/", "/de/")


def _pages(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "pages").select(*(cols or ("page_id", "url", "html")))


@register("u1_norm_url")
def u1_norm_url(spark: SparkSession, d: str) -> DataFrame:
    return U.with_normalized_url(_pages(spark, d, "page_id", "url"), "url", "norm_url")


@register("x2_first_url")
def x2_first_url(spark: SparkSession, d: str) -> DataFrame:
    """Distinct normalised URLs, keeping the first page (by page_id) of each."""
    df = U.with_normalized_url(_pages(spark, d, "page_id", "url"), "url", "norm_url")
    return df.groupBy("norm_url").agg(
        F.min("page_id").alias("first_page_id"),
        F.min_by("url", "page_id").alias("first_url"),
        F.count(F.lit(1)).alias("n_copies"),
    )


@register("u4_root_domain")
def u4_root_domain(spark: SparkSession, d: str) -> DataFrame:
    df = U.with_url_parts(_pages(spark, d, "page_id", "url"), "url", "p_")
    return df.select("page_id", F.col("p_host").alias("host"), U.root_domain("p_host").alias("root_domain"))


@register("u5_host_path")
def u5_host_path(spark: SparkSession, d: str) -> DataFrame:
    df = U.with_normalized_url(_pages(spark, d, "page_id", "url"), "url", "norm_url")
    df = df.withColumn("root", U.root_domain(F.lit("")))
    return U.with_host_path(df, "norm_url", F.col("root")).select("page_id", "norm_url", "host", "path")


@register("u6_public_url")
def u6_public_url(spark: SparkSession, d: str) -> DataFrame:
    df = U.with_public_url(_pages(spark, d, "page_id", "url"), "url", "safe_url", "reject_reason")
    return df.select("page_id", "safe_url", "reject_reason")


@register("u7_slug")
def u7_slug(spark: SparkSession, d: str) -> DataFrame:
    df = _pages(spark, d, "page_id", "url")
    return df.select("page_id", T.slugify("url", "page").alias("slug"), T.slugify(F.lit("!!"), "document").alias("empty_slug"))


@register("p2_blocked_url")
def p2_blocked_url(spark: SparkSession, d: str) -> DataFrame:
    df = U.with_url_parts(_pages(spark, d, "page_id", "url"), "url", "p_")
    df = U.with_blocked_host(df, "p_host", "blocked_host")
    df = U.with_blocked_url(df, "url", "blocked_url")
    return df.select("page_id", "blocked_host", "blocked_url")


def seeds_by_root(df: DataFrame) -> DataFrame:
    """One crawl seed per root domain: the URL of its smallest page_id."""
    return df.groupBy("root").agg(F.min_by("norm_url", "page_id").alias("seed_url")).select(
        "root", "seed_url"
    )


def _with_seed(spark: SparkSession, d: str) -> DataFrame:
    df = U.with_normalized_url(_pages(spark, d, "page_id", "url"), "url", "norm_url")
    df = U.with_url_parts(df, "norm_url", "n_").withColumn("root", U.root_domain("n_host"))
    seeds = seeds_by_root(df)
    seeds = U.with_url_parts(seeds, "seed_url", "s_").select("root", "seed_url", F.col("s_host").alias("start_host"))
    return df.select("page_id", "norm_url", "root").join(seeds, "root")


@register("p3_internal")
def p3_internal(spark: SparkSession, d: str) -> DataFrame:
    df = _with_seed(spark, d)
    df = U.with_internal(df, "norm_url", "start_host", "root", "internal")
    df = U.with_internal(df, "norm_url", "start_host", "root", "internal_sub", include_subdomains=True)
    return df.select("page_id", "seed_url", "internal", "internal_sub")


@register("p4_p5_filters")
def p4_p5_filters(spark: SparkSession, d: str) -> DataFrame:
    df = U.with_normalized_url(_pages(spark, d, "page_id", "url"), "url", "norm_url")
    df = U.with_path_prefix_match(df, "norm_url", "prefix_ok", EXAMPLE_PREFIXES)
    df = U.with_ignored_extension(df, "url", "ignored_ext")
    return df.select("page_id", "prefix_ok", "ignored_ext")


# ---------------------------------------------------------------- step 3: robots

from pagemill.operators import fetchlog as FL  # noqa: E402
from pagemill.operators import robots as RB  # noqa: E402
from pagemill.sources import fixtures as FX  # noqa: E402


@register("w1_robots_rules")
def w1_robots_rules(spark: SparkSession, d: str) -> DataFrame:
    return RB.robots_rules(FX.robots(spark, d))


@register("j1_robots_disallowed")
def j1_robots_disallowed(spark: SparkSession, d: str) -> DataFrame:
    df = U.with_normalized_url(_pages(spark, d, "page_id", "url"), "url", "norm_url")
    rules = RB.robots_rules(FX.robots(spark, d))
    return RB.with_robots_disallowed(df, rules, "norm_url", "disallowed").select("page_id", "norm_url", "disallowed")


def url_decisions(spark: SparkSession, d: str, prefixes=()) -> DataFrame:
    """P7 / P9 for every page URL against the seed of its root domain."""
    df = _with_seed(spark, d)
    df = U.with_ignored_extension(df, "norm_url", "ignored_ext")
    df = U.with_internal(df, "norm_url", "start_host", "root", "internal")
    df = U.with_path_prefix_match(df, "norm_url", "prefix_ok", prefixes)
    df = RB.with_robots_disallowed(df, RB.robots_rules(FX.robots(spark, d)), "norm_url", "robots_disallowed")
    return U.with_blocked_url(df, "norm_url", "blocked_url")


@register("p7_url_decision")
def p7_url_decision(spark: SparkSession, d: str) -> DataFrame:
    df = url_decisions(spark, d)
    reason = (
        F.when(F.col("ignored_ext"), "ignored-extension")
        .when(~F.col("internal"), "external")
        .when(~F.col("prefix_ok"), "path-prefix")
        .when(F.col("robots_disallowed"), "robots-disallowed")
        .otherwise("ok")
    )
    return df.select("page_id", "norm_url", (reason == "ok").alias("allowed"), reason.alias("reason"))


@register("p9_can_visit")
def p9_can_visit(spark: SparkSession, d: str) -> DataFrame:
    df = url_decisions(spark, d)
    error = F.when(F.col("blocked_url"), "blocked-host").when(F.col("robots_disallowed"), "robots-disallowed").otherwise("")
    allowed = ~F.col("ignored_ext") & F.col("internal") & F.col("prefix_ok") & ~F.col("robots_disallowed")
    return df.select(
        "page_id",
        (~F.col("blocked_url") & allowed).alias("can_visit"),
        error.alias("error_reason"),
        (error == "robots-disallowed").alias("has_diagnostic"),
    )


# ---------------------------------------------------------------- step 4: fetch log


@register("f1_outcome")
def f1_outcome(spark: SparkSession, d: str) -> DataFrame:
    c = FL.classify(FX.captures(spark, d))
    return c.select("page_id", "attempt", FL.is_html("content_type").alias("is_html"), "reason", "retryable")


@register("f3_backoff")
def f3_backoff(spark: SparkSession, d: str) -> DataFrame:
    return FL.backoff_plan(FX.captures(spark, d))


@register("w3_last_attempt")
def w3_last_attempt(spark: SparkSession, d: str) -> DataFrame:
    last = FL.last_attempts(FX.captures(spark, d))
    chk = FL.retries_consistent(FX.captures(spark, d))
    return last.select("page_id", "attempt", "status", "reason", "attempts").join(chk.select("page_id", "consistent"), "page_id")


@register("f5_diagnostics")
def f5_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return FL.diagnostics(FX.captures(spark, d))


@register("f6_errors")
def f6_errors(spark: SparkSession, d: str) -> DataFrame:
    return FL.errors(FL.outcomes(FX.captures(spark, d)))


@register("a9_by_reason")
def a9_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return FL.by_reason(FL.outcomes(FX.captures(spark, d)))


@register("f4_variant")
def f4_variant(spark: SparkSession, d: str) -> DataFrame:
    v = FL.best_variant(FX.rendered_captures(spark, d), "auto", 600)
    return v.select("page_id", "attempt", "renderer", "reason", "chars")


@register("f4_browser_variant")
def f4_browser_variant(spark: SparkSession, d: str) -> DataFrame:
    v = FL.best_variant(FX.rendered_captures(spark, d), "browser", 600)
    return v.select("page_id", "attempt", "renderer", "reason", "chars")


@register("w2_latest_diag")
def w2_latest_diag(spark: SparkSession, d: str) -> DataFrame:
    diag = FL.diagnostics(FX.captures(spark, d)).withColumn("seq", F.col("page_id"))
    return FL.latest_diagnostic(diag).select("any_url", "page_id", "reason")


# ---------------------------------------------------------------- steps 2 + 5: HTML

from pagemill.operators import extract as X  # noqa: E402
from pagemill.operators import links as LK  # noqa: E402
from pagemill.plans import pages as PG  # noqa: E402


def _nodes(spark: SparkSession, d: str, profile: str = "crawl", reused: bool = True) -> DataFrame:
    """The node table; written only where a query reads it more than once."""
    return PG.node_table(_pages(spark, d, "page_id", "html"), profile, checkpoint=reused)


@register("h3_title")
def h3_title(spark: SparkSession, d: str) -> DataFrame:
    return X.titles(_nodes(spark, d))


@register("h1_h2_noise")
def h1_h2_noise(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d, reused=False).where(F.col("kind") == "t")
    return n.groupBy("page_id").agg(
        F.count_if(~F.col("removed")).alias("kept_text_nodes"), F.count_if(F.col("removed")).alias("removed_text_nodes")
    )


@register("h4_main_text")
def h4_main_text(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    area = X.content_area(nodes, "crawl", readability=False)
    return X.main_text(nodes, area)


@register("a11_largest_div")
def a11_largest_div(spark: SparkSession, d: str) -> DataFrame:
    return X.largest_div(_nodes(spark, d, reused=False))


@register("h6_readability")
def h6_readability(spark: SparkSession, d: str) -> DataFrame:
    return X.readability_candidates(_nodes(spark, d, reused=False), 600)


@register("g1_links")
def g1_links(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d, "page_id", "url", "html")
    return LK.links(PG.node_table(pages), pages)


@register("h8_markdown")
def h8_markdown(spark: SparkSession, d: str) -> DataFrame:
    return PG.page_records(_pages(spark, d))


# ---------------------------------------------------------------- step 8: exports

from pagemill.functions.text import nonempty  # noqa: E402
from pagemill.operators import export as EX  # noqa: E402


def simple_records(spark: SparkSession, d: str) -> DataFrame:
    """Page records whose body is the main text (H4) and title H3: every column SQL-expressible,
    so the exports below are checked against DuckDB. ``ord`` = page_id."""
    pages = _pages(spark, d, "page_id", "url", "html")
    nodes = PG.node_table(pages)
    area = X.content_area(nodes, "crawl", readability=False)
    body = X.main_text(nodes, area)
    df = U.with_normalized_url(pages.select("page_id", "url"), "url", "norm_url")
    df = df.join(X.titles(nodes), "page_id", "left").join(body, "page_id", "left")
    df = U.with_host_path(df.drop("url").withColumnRenamed("norm_url", "url"), "url", None)
    recs = df.select(
        F.col("page_id").cast("bigint").alias("ord"),
        "url",
        "host",
        "path",
        F.coalesce(nonempty("title"), F.col("url")).alias("title"),
        F.concat(F.coalesce(F.col("main_text"), F.lit("")), F.lit("\n")).alias("markdown"),
    )
    # a written table, as page records are for every export: later plans start from a scan
    return cut_lineage(recs)


def url_records(spark: SparkSession, d: str) -> DataFrame:
    """Page records without title and body, for questions about URLs alone: the HTML is never read."""
    df = U.with_normalized_url(_pages(spark, d, "page_id", "url"), "url", "norm_url")
    df = U.with_host_path(df.drop("url").withColumnRenamed("norm_url", "url"), "url", None)
    return df.select(F.col("page_id").cast("bigint").alias("ord"), "url", "host", "path")


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return FL.errors(FL.outcomes(FX.captures(spark, d))).withColumn("seq", F.col("page_id"))


@register("a7_combined")
def a7_combined(spark: SparkSession, d: str) -> DataFrame:
    recs = simple_records(spark, d)
    header = EX.summary_header(recs, _errors(spark, d), 0)
    return EX.combined_parts(recs, header)


def _named(records: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` under the S9 file name of their export: the first host's, at a given time (the time is no data)."""
    started = F.lit("2024-01-02 03:04:05").cast("timestamp")
    name = records.agg(EX.combined_file_name(F.min("host"), started)).scalar()
    return parts.withColumn("document", F.coalesce(name, F.lit("output.md")))


@register("s9_written")
def s9_written(spark: SparkSession, d: str) -> DataFrame:
    """The combined export written as a document and read back: checksums of its blocks."""
    recs = simple_records(spark, d)
    parts = EX.combined_parts(recs, EX.summary_header(recs, _errors(spark, d), 0))
    path = scratch_path(spark, "export")
    DS.write_documents(_named(recs, parts), path, "section", "host", "ord")
    return DS.document_blocks(spark, path)


@register("s10_grouped")
def s10_grouped(spark: SparkSession, d: str) -> DataFrame:
    return EX.grouped_parts(simple_records(spark, d))


@register("s12_index")
def s12_index(spark: SparkSession, d: str) -> DataFrame:
    return EX.index_lines(EX.with_file_names(simple_records(spark, d)))


@register("s11_files")
def s11_files(spark: SparkSession, d: str) -> DataFrame:
    return EX.bundle_files(simple_records(spark, d))


@register("s15_preview")
def s15_preview(spark: SparkSession, d: str) -> DataFrame:
    return EX.preview(simple_records(spark, d))


@register("p12_search")
def p12_search(spark: SparkSession, d: str) -> DataFrame:
    return EX.search(EX.preview(simple_records(spark, d)), "The", "all")


@register("x3_hosts")
def x3_hosts(spark: SparkSession, d: str) -> DataFrame:
    return EX.hosts_sorted(url_records(spark, d))


@register("a6_pages_per_host")
def a6_pages_per_host(spark: SparkSession, d: str) -> DataFrame:
    return EX.pages_per_host(url_records(spark, d))


def _selection(spark: SparkSession, d: str) -> DataFrame:
    """The pages a user selects: those the search 'the' finds."""
    recs = simple_records(spark, d)
    hits = EX.search(EX.preview(recs), "the", "all").select(F.col("id").alias("ord"), F.lit(True).alias("hit"))
    return recs.join(hits, "ord", "left").withColumn("selected", F.coalesce("hit", F.lit(False))).drop("hit")


@register("a8_selection")
def a8_selection(spark: SparkSession, d: str) -> DataFrame:
    return EX.selection_counts(_selection(spark, d))


@register("s16_selected")
def s16_selected(spark: SparkSession, d: str) -> DataFrame:
    sel = _selection(spark, d)
    chosen = EX.selected_pages(sel.drop("selected"), sel.where("selected").select("url"))
    return EX.bundle_files(chosen)


@register("a4_run_summary")
def a4_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return EX.run_summary(simple_records(spark, d), _errors(spark, d), 0)


# ---------------------------------------------------------------- step 6: crawl (G2-G6, J2, J3, J8, W5, O3, A10) + sitemaps

from pagemill.plans import crawl as CR  # noqa: E402
from pagemill.plans import site_crawls as SC  # noqa: E402
from pagemill.sources import sitemap as SM  # noqa: E402

def _crawl(spark: SparkSession, d: str, **limits):
    """The link graph from the first page on; without limits until nothing new is reached."""
    seeds = _pages(spark, d, "page_id").agg(F.min("page_id").alias("node"))
    return CR.bfs(FX.link_graph(spark, d), seeds, **limits)


def _frontier(frontier: DataFrame) -> DataFrame:
    return frontier.select(F.col("node").alias("page_id"), F.col("depth").cast("int").alias("depth"), "ord", "parent", "pos")


@register("g2_bfs")
def g2_bfs(spark: SparkSession, d: str) -> DataFrame:
    frontier, _ = _crawl(spark, d)
    return frontier.select(F.col("node").alias("page_id"), F.col("depth").cast("int").alias("depth"))


@register("g2_crawl_order")
def g2_crawl_order(spark: SparkSession, d: str) -> DataFrame:
    return _frontier(_crawl(spark, d)[0])


@register("g3_decisions")
def g3_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _crawl(spark, d)[1]


@register("a10_skipped")
def a10_skipped(spark: SparkSession, d: str) -> DataFrame:
    return CR.skipped_counts(_crawl(spark, d)[1])


# the limits are the feature here: a crawl that may admit 100 pages down to depth 4
BUDGET = dict(max_depth=4, max_pages=100)


@register("g4_budget_order")
def g4_budget_order(spark: SparkSession, d: str) -> DataFrame:
    return _frontier(_crawl(spark, d, **BUDGET)[0])


@register("g4_budget_decisions")
def g4_budget_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _crawl(spark, d, **BUDGET)[1]


def site_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, successful, aliases) of the captured pages by normalised URL: the link graph with the
    enqueue rules (P8: extension, robots, blocked host) decided once per target, the pages whose best
    variant (F4) is usable, and the final URLs of redirected ones (G6)."""
    pages = _pages(spark, d, "page_id", "url")
    named = cut_lineage(U.with_normalized_url(pages, "url", "norm_url").select("page_id", F.col("norm_url").alias("node")))
    ruled = U.with_ignored_extension(named, "node", "ignored_ext")
    ruled = RB.with_robots_disallowed(ruled, RB.robots_rules(FX.robots(spark, d)), "node", "disallowed")
    ruled = cut_lineage(U.with_blocked_url(ruled, "node", "blocked"))
    ok = ruled.select(F.col("page_id").alias("dst_id"), F.col("node").alias("dst"), (~F.col("ignored_ext") & ~F.col("disallowed") & ~F.col("blocked")).alias("can_enqueue"))
    graph = FX.link_graph(spark, d).join(named.select(F.col("page_id").alias("src"), F.col("node").alias("src_url")), "src")
    edges = graph.join(ok, graph.dst == ok.dst_id).select(F.col("src_url").alias("src"), "pos", ok.dst, "can_enqueue")
    # two pages with one normalised URL are one node: its first page's links count
    edges = edges.groupBy("src", "pos").agg(F.min(F.struct("dst", "can_enqueue")).alias("e")).select("src", "pos", "e.*")
    best = FL.best_variant(FX.rendered_captures(spark, d), "auto", 600).select("page_id", "final_url")
    best = cut_lineage(U.with_normalized_url(best.join(named, "page_id"), "final_url", "alias").select("node", "alias"))
    successful = best.select("node").distinct()
    aliases = best.filter("alias <> node and alias <> ''").groupBy("node").agg(F.min("alias").alias("alias"))
    return edges, successful, aliases


@register("g6_site_crawl")
def g6_site_crawl(spark: SparkSession, d: str) -> DataFrame:
    """The crawl job over captures: rules, variants, redirects and queue order together."""
    edges, successful, aliases = site_graph(spark, d)
    seeds = edges.agg(F.min("src").alias("node"))
    frontier, _ = CR.bfs(edges, seeds, can_enqueue="can_enqueue", expandable=successful, aliases=aliases)
    pages = CR.first_pages(frontier, successful).select("node", "page_no")
    return frontier.join(pages, "node", "left").select("node", F.col("depth").cast("int").alias("depth"), "ord", "visited", "page_no")


@register("s2_sitemap_urls")
def s2_sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    e = SM.sitemap_entries(FX.sitemaps(spark, d))
    return U.with_normalized_url(e, "loc", "norm_url").select("host", "kind", "pos", "loc", "norm_url")


@register("g5_sitemap_enqueue")
def g5_sitemap_enqueue(spark: SparkSession, d: str) -> DataFrame:
    """Sitemap URLs that pass P8 (internal to their site, robots) enter the queue at depth 0, all of
    them, at their first place in the sitemap."""
    e = SM.sitemap_entries(FX.sitemaps(spark, d)).where(F.col("kind") == "url")
    e = cut_lineage(U.with_normalized_url(e, "loc", "norm_url").select("host", "pos", "norm_url"))
    e = e.where(F.col("norm_url") != "")
    e = e.withColumn("root", U.root_domain("host")).withColumn("start_host", F.lower("host"))
    e = U.with_internal(e, "norm_url", "start_host", "root", "internal")
    e = U.with_ignored_extension(e, "norm_url", "ignored_ext")
    e = RB.with_robots_disallowed(e, RB.robots_rules(FX.robots(spark, d)), "norm_url", "disallowed")
    # the decided queue candidates are written once; filtering the derived URL columns in the
    # same plan would make the optimizer inline the URL expressions into every pushed filter
    e = cut_lineage(e.select("host", "pos", "norm_url", "internal", "ignored_ext", "disallowed"))
    ok = e.where(F.col("internal") & ~F.col("ignored_ext") & ~F.col("disallowed"))
    first = ok.groupBy("host", "norm_url").agg(F.min("pos").alias("pos"))
    return first.select("host", "norm_url", "pos", F.lit(0).alias("depth"))


def _sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(pages by host, starts): page_id, node (normalised URL) and site of every page, and each site's first page."""
    pages = _pages(spark, d, "page_id", "url").withColumn("site", F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    named = cut_lineage(U.with_normalized_url(pages, "url", "node").select("page_id", "site", "node")).filter("node <> ''")
    return named, named.groupBy("site").agg(F.min_by("node", "page_id").alias("node"))


def _expanded(spark: SparkSession, d: str, max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    files = FX.sitemap_files(spark, d)
    starts = files.select("site", F.concat(F.lit("https://"), F.col("site"), F.lit("/sitemap.xml")).alias("node")).distinct()
    return SC.expand_sitemaps(starts, SM.resolved_entries(files), files.select("file"), max_files)


@register("g5_sitemap_files")
def g5_sitemap_files(spark: SparkSession, d: str) -> DataFrame:
    """The sitemap files of every site in queue order, from its index down through the indexes below; a
    file that leads back is met once, a missing one is listed as not found."""
    files, _ = _expanded(spark, d)
    return files.select("site", F.col("node").alias("file"), "depth", "file_ord", "found")


@register("g5_sitemap_file_limit")
def g5_sitemap_file_limit(spark: SparkSession, d: str) -> DataFrame:
    """The URLs that a site's first five sitemap files list (the limit is the feature)."""
    _, urls = _expanded(spark, d, max_files=5)
    return urls.select("site", "file_ord", "pos", F.col("node").alias("url"))


def _site_queue(spark: SparkSession, d: str, starts: DataFrame) -> DataFrame:
    _, urls = _expanded(spark, d)
    urls = SC.with_can_enqueue(urls, RB.robots_rules(FX.robots(spark, d)), "site", "node", "ok")
    return SC.one_queue(starts, urls.filter("ok"))


@register("x1_site_queue")
def x1_site_queue(spark: SparkSession, d: str) -> DataFrame:
    """The queue that every site begins with: its start, then the URLs of its sitemaps that pass P8."""
    queue = _site_queue(spark, d, _sites(spark, d)[1])
    return SC.segmented_rank(queue, ["site"], "place", "ord").select("site", "node", "ord")


def _many_sites(spark: SparkSession, d: str, **limits) -> tuple[DataFrame, DataFrame]:
    """One crawl of all hosts: start, sitemap URLs and links in one queue each."""
    pages, starts = _sites(spark, d)
    links = FX.site_links(spark, d).join(pages.select(F.col("page_id").alias("src_id"), "site", F.col("node").alias("src")), "src_id")
    links = links.join(pages.select(F.col("page_id").alias("dst_id"), F.col("node").alias("dst")), "dst_id").select("site", "src", "pos", "dst")
    edges = SC.with_can_enqueue(links, RB.robots_rules(FX.robots(spark, d)), "site", "dst", "ok")
    # two pages with one normalised URL are one node: its lesser link at each place counts
    edges = edges.groupBy("site", "src", "pos").agg(F.min(F.struct("dst", "ok")).alias("e")).select("site", "src", "pos", "e.*")
    return SC.crawl_sites(edges, _site_queue(spark, d, starts), can_enqueue="ok", **limits)


@register("g2_many_sites")
def g2_many_sites(spark: SparkSession, d: str) -> DataFrame:
    """The crawl order of every site, all of them in one job."""
    return _many_sites(spark, d)[0].select("site", "node", "depth", "ord")


# the limits are the feature here: every site may hold eight pages, down to depth 2
@register("g4_site_budgets")
def g4_site_budgets(spark: SparkSession, d: str) -> DataFrame:
    """The decision for every link where each site has a budget of its own."""
    return _many_sites(spark, d, max_depth=2, max_pages=8)[1]


def _page_hosts(spark: SparkSession, d: str) -> DataFrame:
    df = U.with_normalized_url(_pages(spark, d, "page_id", "url"), "url", "norm_url")
    df = U.with_url_parts(df, "norm_url", "n_")
    return cut_lineage(df.select("page_id", F.col("n_host").alias("host"), F.when(F.col("n_path") == "", "/").otherwise(F.col("n_path")).alias("path")))


@register("j7_allowed_hosts")
def j7_allowed_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose host is one of a table of allowed hosts (one for every customer among them) or below one."""
    pages = _page_hosts(spark, d)
    own = pages.filter("page_id % 3 = 0 AND host <> ''").select(U.root_domain("host").alias("host"))
    exact = pages.filter("page_id % 7 = 1 AND host <> ''").select("host")
    shops = table(spark, d, "customer").select(F.concat(F.lit("shop"), F.col("c_custkey"), F.lit(".example")).alias("host"))
    allowed = own.unionByName(exact).unionByName(shops).unionByName(spark.createDataFrame([(".b",), (" ",)], "host string"))
    return LK.with_allowed_host(pages.select("page_id", "host"), "host", allowed, "allowed")


@register("p6_rule_index")
def p6_rule_index(spark: SparkSession, d: str) -> DataFrame:
    """The longest rule of its host that a page's path begins with, where one host has a rule for every order."""
    pages = _page_hosts(spark, d)
    rules = pages.filter("page_id % 4 = 1").select("host", F.substring(F.col("path"), F.lit(1), (2 + F.col("page_id") % 13).cast("int")).alias("rule"))
    many = table(spark, d, "orders").select(F.concat(F.lit("/none/"), F.col("o_orderkey")).alias("rule"), F.lit(0).cast("long").alias("page_id")).join(pages, "page_id")
    found = RB.with_longest_rule(pages, rules.unionByName(many.select("host", "rule")), "host", "path", "longest_rule")
    return found.select("page_id", "longest_rule")


# ---------------------------------------------------------------- step 7: import

from pagemill.sources import files as FI  # noqa: E402


def _doc_files(spark: SparkSession, d: str) -> DataFrame:
    """documents as text files: (path, content bytes, order)."""
    docs = table(spark, d, "documents")
    ext = F.when(F.col("doc_id") % 2 == 0, F.lit(".txt")).otherwise(F.lit(".md"))
    return docs.select(
        F.concat(F.lit("/import/"), F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
        F.col("doc_id").alias("o"),
    )


@register("s4_text_import")
def s4_text_import(spark: SparkSession, d: str) -> DataFrame:
    docs = FI.import_documents(_doc_files(spark, d), "o", kinds=("text",))
    return docs.select("doc_no", "source", "title", "body_markdown", F.col("meta")["type"].alias("type"))


@register("s5_html_import")
def s5_html_import(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(
        F.concat(F.lit("/import/page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
        F.col("page_id").alias("o"),
    )
    return FI.import_documents(pages, "o", kinds=("html",)).select("doc_no", "source", "title", "body_markdown", F.col("meta")["type"].alias("type"))


def _mbox_files(spark: SparkSession, d: str) -> DataFrame:
    m = FX.mail(spark, d)
    return m.select(F.concat(F.lit("/import/"), F.col("filename")).alias("path"), F.encode("content", "UTF-8").alias("content"), F.col("conv_id").alias("o"))


@register("s7_mbox_import")
def s7_mbox_import(spark: SparkSession, d: str) -> DataFrame:
    docs = FI.import_documents(_mbox_files(spark, d), "o", kinds=("mail",))
    return docs.select("doc_no", "source", "title", "body_markdown", F.col("meta")["index"].alias("msg_index"))


@register("s6_eml_import")
def s6_eml_import(spark: SparkSession, d: str) -> DataFrame:
    """Each mailbox message written as its own .eml file, then imported as e-mail."""
    msgs = FI.mbox_messages(
        FX.mail(spark, d).select(F.col("conv_id").alias("file_no"), F.concat(F.lit("/m/"), F.col("filename")).alias("path"), F.col("content").alias("text"))
    )
    eml = CR.dense_rank_by(msgs, "msg_id", "o").select(
        F.concat(F.lit("/import/msg-"), F.col("file_no").cast("string"), F.lit("-"), F.col("idx").cast("string"), F.lit(".eml")).alias("path"),
        F.encode("raw", "UTF-8").alias("content"),
        "o",
    )
    return FI.import_documents(eml, "o", kinds=("mail",)).select("doc_no", "source", "title", "body_markdown")


@register("s13_import_combined")
def s13_import_combined(spark: SparkSession, d: str) -> DataFrame:
    return FI.import_combined_parts(FI.import_documents(_doc_files(spark, d), "o", kinds=("text",)))


@register("s13_written")
def s13_written(spark: SparkSession, d: str) -> DataFrame:
    """The combined export (S13 with T1) of the imported files, written and read back."""
    parts = FI.import_combined(FI.import_documents(_doc_files(spark, d), "o", kinds=("text",)))
    path = scratch_path(spark, "import-export")
    DS.write_documents(parts.withColumn("document", F.lit("imported.md")), path, "doc_no")
    return DS.document_blocks(spark, path)


@register("s14_import_bundle")
def s14_import_bundle(spark: SparkSession, d: str) -> DataFrame:
    return FI.import_bundle(FI.import_documents(_doc_files(spark, d), "o", kinds=("text",))).drop("title")


@register("s14_index")
def s14_index(spark: SparkSession, d: str) -> DataFrame:
    return FI.import_index_lines(FI.import_bundle(FI.import_documents(_doc_files(spark, d), "o", kinds=("text",))))


@register("t1_normalize")
def t1_normalize(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.normalize_markdown("text").alias("t1"), T.normalize_markdown("text", False).alias("t3"),
                       T.text_chars("text").alias("t4"))


# ---------------------------------------------------------------- step 9: streams (ST1, ST2)

from pagemill.streaming import stream as ST  # noqa: E402


@register("st1_url_dedupe_stream")
def st1_url_dedupe_stream(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "pages-in")
    # the captured URLs as files arriving in a folder (four files -> four micro-batches)
    _pages(spark, d, "page_id", "url").repartition(4, "page_id").write.parquet(path)
    src = spark.readStream.schema("page_id long, url string").option("maxFilesPerTrigger", 1).parquet(path)
    out = ST.run_available_now(ST.url_dedupe_stream(src), scratch_path(spark, "st1"))
    return out.select("norm_url").where(F.col("norm_url") != "")


@register("st2_outcome_counts_stream")
def st2_outcome_counts_stream(spark: SparkSession, d: str) -> DataFrame:
    cap = FX.captures(spark, d)
    path = scratch_path(spark, "captures-in")
    cap.write.parquet(path)  # the capture log as files arriving in a folder
    src = spark.readStream.schema(cap.schema).parquet(path)
    upd = ST.run_available_now(ST.outcome_counts_stream(src), scratch_path(spark, "st2"), mode="update")
    return ST.latest_per_group(upd, ["host", "reason"])


# ---------------------------------------------------------------- S8 URL lists, J5, U9

def validate_url_list(urls: DataFrame, url_col: str = "url", pos_col: str = "pos", max_urls: int | None = None) -> DataFrame:
    """Strip, skip blank, U6 public check (rejected rows keep their reason), ordered dedupe on
    the exact accepted URL (no U1): (url, pos, reject_reason). ``max_urls`` (the service's 200)
    is checked with a bounded count when given."""
    if max_urls is not None and urls.limit(max_urls + 1).count() > max_urls:
        raise ValueError(f"Provide {max_urls} URLs or fewer.")
    df = urls.select(T.py_strip(F.col(url_col)).alias("_u"), F.col(pos_col).alias("pos")).where(F.col("_u") != "")
    # checked URLs are written once; filters on derived URL columns go after the cut
    df = cut_lineage(U.with_public_url(df, "_u", "url", "reject_reason").select("_u", "pos", "url", "reject_reason"))
    ok = df.where(F.col("reject_reason") == "").groupBy("url").agg(F.min("pos").alias("pos"))
    bad = df.where(F.col("reject_reason") != "").select(F.col("_u").alias("url"), "pos", "reject_reason")
    return ok.withColumn("reject_reason", F.lit("")).unionByName(bad)


@register("s8_url_list")
def s8_url_list(spark: SparkSession, d: str) -> DataFrame:
    """The page URLs as a bulk list in page order."""
    return validate_url_list(_pages(spark, d, "page_id", "url"), "url", "page_id")


@register("j5_diag_extracted")
def j5_diag_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Each successful fetch's diagnostic carries the extracted length of its page."""
    diag = FL.diagnostics(FX.captures(spark, d))
    recs = simple_records(spark, d).select(F.col("ord").alias("page_id"), T.text_chars("markdown").alias("clean_text_chars"))
    diag = cut_lineage(diag)
    ok = diag.where(F.col("reason") == "ok")
    return FL.with_extracted_chars(ok, recs).select("page_id", "final_url", "extracted_chars").unionByName(
        diag.where(F.col("reason") != "ok").select("page_id", "final_url", "extracted_chars"))


@register("u9_canonical")
def u9_canonical(spark: SparkSession, d: str) -> DataFrame:
    pages = FX.canonical_pages(spark, d)
    return LK.canonical_links(PG.node_table(pages.select("page_id", "html"), checkpoint=False), pages)


# ---------------------------------------------------------------- F6 over a visit, F7


@register("f6_visit_errors")
def f6_visit_errors(spark: SparkSession, d: str) -> DataFrame:
    df = cut_lineage(url_decisions(spark, d))
    reason = F.when(F.col("blocked_url"), "blocked-host").when(F.col("robots_disallowed"), "robots-disallowed").otherwise("")
    decided = df.select("page_id", F.col("norm_url").alias("url"), reason.alias("error_reason"))
    return FL.visit_errors(decided, FL.errors(FL.outcomes(FX.captures(spark, d))))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """The fetch log as five runs that started one after another."""
    return FL.diagnostics(FX.captures(spark, d)).withColumn("run", (F.col("page_id") + 1) % 5)


@register("f7_run_snapshots")
def f7_run_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return FL.run_snapshots(_runs(spark, d), "run")


@register("f7_last_run_errors")
def f7_last_run_errors(spark: SparkSession, d: str) -> DataFrame:
    """The latest run's summary beside each of its errors."""
    runs = _runs(spark, d)
    last = FL.last_run(FL.run_snapshots(runs, "run"), "run")
    return FL.errors(runs).join(runs.select("page_id", "run"), "page_id").join(F.broadcast(last), "run").drop("max_elapsed_ms")
