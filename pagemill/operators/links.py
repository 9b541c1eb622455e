"""Link extraction (H7, U3, G1): every ``<a href>`` of the raw page (noise included), resolved
against the page's final URL and normalised. Positions come from a ``row_number`` per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import py_strip
from pagemill.functions.urls import with_joined_parts, with_normalized_url, with_url_parts, with_urljoin
from pagemill.session import cut_lineage


def anchors(nodes: DataFrame) -> DataFrame:
    """(page_id, pos, href) in document order; ``pos`` from 0."""
    a = nodes.where((F.col("kind") == "e") & (F.col("tag") == "a") & F.col("href").isNotNull())
    w = Window.partitionBy("page_id").orderBy("n")
    return a.select("page_id", (F.row_number().over(w) - 1).cast("int").alias("pos"), "href")


def links(nodes: DataFrame, pages: DataFrame, base_col: str = "url") -> DataFrame:
    """G1: (page_id, pos, href, dst_url); dst_url = normalize(urljoin(base, href)), '' when not http(s)."""
    # a base is split once for its page; each URL step is written, because their joint code exceeds what can be compiled
    bases = cut_lineage(with_url_parts(pages.select("page_id", F.col(base_col).alias("_base")), "_base", "_b_"))
    a = cut_lineage(with_url_parts(anchors(nodes).join(bases, "page_id"), "href", "_h_"))
    a = with_joined_parts(a, "_base", "href", "_abs", "_b_", "_h_").select("page_id", "pos", "href", "_abs")
    return with_normalized_url(cut_lineage(a), "_abs", "dst_url").select("page_id", "pos", "href", "dst_url")


def canonical_links(nodes: DataFrame, pages: DataFrame, base_col: str = "url") -> DataFrame:
    """(page_id, canonical_url) from the first ``<link rel~=canonical href>``, resolved and
    normalised; pages without one (or whose result is empty) have no row."""
    c = nodes.where((F.col("kind") == "e") & (F.col("tag") == "link") & F.lower(F.coalesce("attr_rel", F.lit(""))).contains("canonical")
                    & (F.coalesce(F.col("href"), F.lit("")) != ""))
    first = c.groupBy("page_id").agg(F.min_by("href", "n").alias("href"))
    j = first.join(pages.select(F.col("page_id"), F.col(base_col).alias("_base")), "page_id")
    j = cut_lineage(with_urljoin(j, "_base", "href", "_abs").select("page_id", "_abs"))
    j = with_normalized_url(j, "_abs", "canonical_url")
    # written once: a filter on the derived URL would be inlined into every URL stage
    j = cut_lineage(j.select("page_id", "canonical_url"))
    return j.where(F.col("canonical_url") != "")


def with_allowed_host(df: DataFrame, host: str, allowed: DataFrame, out: str) -> DataFrame:
    """``out`` = ``host`` equals one of ``allowed(host)`` or ends with a dot and one, case aside.

    Each distinct host is cut into its dot-suffixes, which meet the allowed names in an equi-join; the
    number of allowed hosts costs no more than their shuffle. Blank names are no names; a null host isn't allowed."""
    names = allowed.select(F.lower(py_strip(F.col("host"))).alias("_suffix")).filter("_suffix <> ''").distinct()
    hosts = df.select(F.col(host).alias("_host")).filter("_host IS NOT NULL").distinct()
    labels = F.split(F.lower("_host"), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = hosts.select("_host", F.explode(suffixes).alias("_suffix")).join(names, "_suffix", "left_semi").select("_host").distinct()
    met = met.withColumn("_allowed", F.lit(True))
    return df.join(met, df[host] == met["_host"], "left").withColumn(out, F.col("_allowed").isNotNull()).drop("_host", "_allowed")
