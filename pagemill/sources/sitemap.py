"""Sitemap source (S2, G5): ``urlset`` -> url/loc, ``sitemapindex`` -> sitemap/loc.

Namespace prefixes are removed from tag names, then ``from_xml`` (PERMISSIVE: a malformed file
gives NULL, i.e. no URLs, instead of failing the job) reads the child lists; ``posexplode`` keeps
document order and each loc is stripped. One row per sitemap file: a protocol-sized document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import py_strip
from pagemill.functions.urls import with_normalized_url, with_urljoin
from pagemill.session import cut_lineage

_SCHEMA = "url array<struct<loc: string>>, sitemap array<struct<loc: string>>"


def sitemap_entries(df: DataFrame, key: str = "host", content: str = "content") -> DataFrame:
    """(key, kind 'url'|'sitemap', pos, loc) for every loc of every sitemap file."""
    plain = F.regexp_replace(F.col(content), r"<(/?)[A-Za-z_][\w.\-]*:", "<$1")
    root = F.regexp_extract(plain, r"<\s*([A-Za-z_][\w.\-]*)[^>]*>", 1)
    # the first tag may be an XML declaration or a comment; take the first element name
    root = F.regexp_extract(F.regexp_replace(plain, r"(?s)<\?.*?\?>|<!--.*?-->", ""), r"<\s*([A-Za-z_][\w.\-]*)", 1)
    parsed = F.from_xml(plain, _SCHEMA, {"mode": "PERMISSIVE"})
    df = df.select(F.col(key), root.alias("_root"), parsed.alias("_x"))
    urls = df.where(F.col("_root") == "urlset").select(key, F.lit("url").alias("kind"), F.posexplode("_x.url").alias("pos", "e"))
    maps = df.where(F.col("_root") == "sitemapindex").select(key, F.lit("sitemap").alias("kind"), F.posexplode("_x.sitemap").alias("pos", "e"))
    out = urls.unionByName(maps).select(key, "kind", F.col("pos").cast("int").alias("pos"), py_strip(F.col("e.loc")).alias("loc"))
    return out.where(F.col("loc").isNotNull() & (F.col("loc") != ""))


def resolved_entries(files: DataFrame, key: str = "file", content: str = "content") -> DataFrame:
    """(file, kind, pos, loc): the entries of the sitemap files named by their URLs, each location resolved
    against its file and normalised; what no normal form has is left out."""
    entries = sitemap_entries(files, key, content).withColumnRenamed(key, "file")
    joined = cut_lineage(with_urljoin(entries, "file", "loc", "url").select("file", "kind", "pos", "url"))
    found = cut_lineage(with_normalized_url(joined, "url", "norm").select("file", "kind", "pos", F.col("norm").alias("loc")))
    return found.filter("loc <> ''")
