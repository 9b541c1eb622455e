"""Exports and run metrics.

Large outputs are never built as one string: ``combined_parts`` and ``grouped_parts`` emit one
text part per page with its sort keys (section, host rank / host, ord), so concatenating the
parts in key order gives exactly the service's document. A writer range-partitions on the keys
and writes each partition in order; ``to_text`` joins the parts for small results only.
First-page-of-host markers come from a ``min(ord)`` aggregate per host (partial aggregation,
no per-host window), and the first host from a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import first_nonempty, nonempty, py_rstrip, py_strip, slugify
from pagemill.functions.urls import export_file_name

THIN_PAGE_CHARS = 200
MIN_OUTPUT_CHARS = 500
ERRORS_IN_SUMMARY = 20
GATE_SAMPLES = 10


def _first_of_host(records: DataFrame, host: Column, ord_col: str) -> DataFrame:
    firsts = records.groupBy(host.alias("_h")).agg(F.min(ord_col).alias("_first"))
    return records.withColumn("_h", host).join(firsts, "_h").withColumn("_is_first", F.col(ord_col) == F.col("_first"))


def summary_header(records: DataFrame, errors: DataFrame, skipped_links: Column | int = 0, timed_out: bool = False,
                   crawl_timeout: float = 90.0) -> DataFrame:
    """A7 header as one row (text): totals plus the first 20 errors by ``seq``."""
    spark = records.sparkSession
    n_pages = records.agg(F.count(F.lit(1)).alias("n"))
    n_err = errors.agg(F.count(F.lit(1)).alias("e"))
    line = F.concat(
        F.lit("  - "), F.col("url"), F.lit(" ("), F.col("reason"),
        F.when(F.coalesce(F.col("status"), F.lit("")) != "", F.concat(F.lit(" "), F.col("status"))).otherwise(F.lit("")), F.lit(")"),
    )
    first = errors.orderBy("seq").limit(ERRORS_IN_SUMMARY).select("seq", line.alias("l"))
    first = first.agg(F.array_sort(F.collect_list(F.struct("seq", "l"))).alias("ls"))
    skipped = skipped_links if isinstance(skipped_links, Column) else F.lit(skipped_links)
    one = spark.range(1).select(
        n_pages.scalar().alias("n"), n_err.scalar().alias("e"), first.select(F.col("ls")).scalar().alias("ls")
    )
    lines = F.concat(
        F.array(
            F.lit("<!-- Crawl summary:"),
            F.concat(F.lit("Total pages: "), F.col("n").cast("string")),
            F.concat(F.lit("Skipped links: "), skipped.cast("string")),
            F.concat(F.lit("Errors: "), F.col("e").cast("string")),
        ),
        F.coalesce(F.transform("ls", lambda x: x["l"]), F.array().cast("array<string>")),
        F.array(F.lit(f"Crawl timed out after {crawl_timeout:.0f} seconds.")) if timed_out else F.array().cast("array<string>"),
        F.array(F.lit("-->")),
    )
    return one.select(F.array_join(lines, "\n").alias("text"))


def combined_parts(records: DataFrame, header: DataFrame, root_domain: str = "", ord_col: str = "ord") -> DataFrame:
    """A7 / S9 as ordered parts: (section, host, ord, text). Section 0 is the header; pages follow,
    hosts sorted, pages in crawl order. Host falls back to the root domain, then 'unknown host';
    title to path, then url; bodies are right-stripped."""
    host = F.coalesce(nonempty("host"), nonempty(F.lit(root_domain)), F.lit("unknown host"))
    df = _first_of_host(records, host, ord_col)
    top = df.agg(F.min("_h")).scalar()
    section = F.concat(
        F.lit("## "), first_nonempty("title", "path", "url"), F.lit("\n\n"), py_rstrip(F.coalesce(F.col("markdown"), F.lit(""))), F.lit("\n")
    )
    sep = F.when(F.col("_h") == top, F.lit("\n\n")).otherwise(F.lit("\n\n---\n\n"))
    text = F.when(F.col("_is_first"), F.concat(sep, F.lit("# "), F.col("_h"), F.lit("\n\n"), section)).otherwise(
        F.concat(F.lit("\n\n"), section)
    )
    body = df.select(F.lit(1).alias("section"), F.col("_h").alias("host"), F.col(ord_col).cast("bigint").alias("ord"), text.alias("text"))
    # a document with no pages still ends with one newline
    head = header.select(F.lit(0).alias("section"), F.lit("").alias("host"), F.lit(0).cast("bigint").alias("ord"), "text")
    tail = records.agg(F.count(F.lit(1)).alias("c")).where("c = 0").select(
        F.lit(2).alias("section"), F.lit("").alias("host"), F.lit(0).cast("bigint").alias("ord"), F.lit("\n").alias("text")
    )
    return head.unionByName(body).unionByName(tail)


def grouped_parts(records: DataFrame, ord_col: str = "ord") -> DataFrame:
    """S10 bulk grouped export as ordered parts: (host_rank, ord, text); hosts in first-seen order,
    headings title -> path -> url -> 'Page', bodies as they are; the whole ends with one newline."""
    host = F.coalesce(F.col("host"), F.lit(""))
    df = _first_of_host(records, host, ord_col)
    top = df.agg(F.min(ord_col)).scalar()
    heading = F.coalesce(first_nonempty("title", "path", "url"), F.lit("Page"))
    section = F.concat(F.lit("## "), heading, F.lit("\n\n"), F.coalesce(F.col("markdown"), F.lit("")), F.lit("\n"))
    text = (
        F.when(F.col(ord_col) == top, F.concat(F.lit("# "), F.col("_h"), F.lit("\n\n"), section))
        .when(F.col("_is_first"), F.concat(F.lit("\n\n---\n\n# "), F.col("_h"), F.lit("\n\n"), section))
        .otherwise(F.concat(F.lit("\n\n"), section))
    )
    return df.select(F.col("_first").cast("bigint").alias("host_rank"), F.col(ord_col).cast("bigint").alias("ord"), text.alias("text"))


def to_text(parts: DataFrame, *order: str) -> DataFrame:
    """Join ordered parts into one string (for small results; a large export is written as ordered parts)."""
    g = parts.agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col("text")))).alias("ps"))
    return g.select(F.array_join(F.transform("ps", lambda x: x["text"]), "").alias("text"))


def with_file_names(records: DataFrame) -> DataFrame:
    """U8 per page."""
    return records.withColumn("filename", export_file_name("host", "title", "path", "url"))


def index_lines(records_with_files: DataFrame) -> DataFrame:
    """S12 as ordered lines: (host, ord, line); '# Index' first, hosts sorted, entries without a
    file name skipped; title -> path -> url -> filename."""
    r = records_with_files.withColumn("_h", F.coalesce(F.col("host"), F.lit("")))
    title = first_nonempty("title", "path", "url", "filename")
    entries = r.where(F.coalesce(F.col("filename"), F.lit("")) != "").select(
        F.lit(1).alias("k"), "_h", F.col("ord").cast("bigint").alias("ord"),
        F.concat(F.lit("- ["), title, F.lit("]("), F.col("filename"), F.lit(")")).alias("line"),
    )
    hosts = r.select("_h").distinct()
    heads = hosts.select(F.lit(1).alias("k"), "_h", F.lit(-1).cast("bigint").alias("ord"), F.concat(F.lit("## "), F.col("_h")).alias("line"))
    blanks = hosts.select(F.lit(1).alias("k"), "_h", F.lit(1 << 62).cast("bigint").alias("ord"), F.lit("").alias("line"))
    top = r.sparkSession.createDataFrame([(0, "", -2, "# Index"), (0, "", -1, "")], "k int, _h string, ord bigint, line string")
    return top.unionByName(heads).unionByName(entries).unionByName(blanks).withColumnRenamed("_h", "host")



def bundle_files(records: DataFrame) -> DataFrame:
    """(filename, content) per page; duplicates of a file name are kept as they are."""
    return with_file_names(records).select("filename", F.coalesce(F.col("markdown"), F.lit("")).alias("content"))


def preview(records: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Id (from 0, crawl order), url, host, path, title, suggested_filename.

    ``ord`` of a crawl is dense from 0, so the id is ``ord`` itself and no global window is needed."""
    return with_file_names(records).select(
        F.col(ord_col).cast("bigint").alias("id"), "url", "host", "path", "title", F.col("filename").alias("suggested_filename")
    )


def search(preview_rows: DataFrame, query: str = "", host: str = "all") -> DataFrame:
    """Lowered query is a substring of 'title path url'; host 'all' or equal; empty host shows as
    'Unknown host'."""
    shown = F.coalesce(nonempty("host"), F.lit("Unknown host"))
    df = preview_rows.withColumn("host_label", shown)
    q = query.strip().lower()
    if q:
        hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("path", F.lit("")), F.coalesce("url", F.lit(""))))
        df = df.where(hay.contains(q))
    if host != "all":
        df = df.where(shown == host)
    return df


def hosts_sorted(records: DataFrame) -> DataFrame:
    """Distinct hosts, ascending."""
    return records.select(F.coalesce(nonempty("host"), F.lit("Unknown host")).alias("host")).distinct()


def pages_per_host(records: DataFrame) -> DataFrame:
    """Pages per host with the host's first crawl position."""
    return records.groupBy(F.coalesce(nonempty("host"), F.lit("Unknown host")).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), F.min("ord").cast("bigint").alias("first_ord")
    )


def selection_counts(selected: DataFrame) -> DataFrame:
    """Per host and overall: total, selected, all / some selected."""
    h = F.coalesce(nonempty("host"), F.lit("Unknown host"))
    per = selected.groupBy(h.alias("host")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("selected").alias("selected"),
        F.bool_and("selected").alias("all_selected"),
        F.bool_or("selected").alias("some_selected"),
    )
    overall = selected.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("selected").alias("selected"),
        F.bool_and("selected").alias("all_selected"),
        F.bool_or("selected").alias("some_selected"),
    ).select(F.lit(None).cast("string").alias("host"), "*")
    return per.unionByName(overall)


def run_summary(records: DataFrame, errors: DataFrame, skipped_links: Column | int = 0, timed_out: bool = False) -> DataFrame:
    """A3 + A4 + P13 + P14: one row with pages, total / thin counts, errors, skipped, and the gates."""
    skipped = skipped_links if isinstance(skipped_links, Column) else F.lit(skipped_links)
    agg = records.agg(
        F.count(F.lit(1)).alias("pages_count"),
        F.coalesce(F.sum(F.length("markdown")), F.lit(0)).cast("bigint").alias("total_chars"),
        F.count_if(F.length(py_strip("markdown")) < THIN_PAGE_CHARS).alias("thin_pages_count"),
    )
    e = errors.agg(F.count(F.lit(1)).alias("errors_count"))
    one = agg.select("*", e.scalar().alias("errors_count"))
    return one.select(
        "*",
        skipped.cast("bigint").alias("skipped_links"),
        F.lit(timed_out).alias("timed_out"),
        ((F.col("pages_count") > 0) & (F.col("total_chars") >= MIN_OUTPUT_CHARS)).alias("accepted"),
        (F.col("pages_count") > 0).alias("preview_ok"),
    )


def gate_samples(diagnostics: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first 10 diagnostics and errors shown with a rejection."""
    return diagnostics.orderBy("seq").limit(GATE_SAMPLES), errors.orderBy("seq").limit(GATE_SAMPLES)


def selected_pages(records: DataFrame, selected_urls: DataFrame) -> DataFrame:
    """Pages whose URL was selected (left semi join)."""
    return records.join(selected_urls.select(F.col("url")).distinct(), "url", "left_semi")


def combined_file_name(host, started_at) -> Column:
    """``slug(host)__YYYYmmdd_HHMMSS.md`` of a combined export."""
    return F.concat(slugify(host, "output"), F.lit("__"), F.date_format(started_at, "yyyyMMdd_HHmmss"), F.lit(".md"))
