"""Views derived from the driver's tables (FIXTURES.md section 2), as DataFrame jobs.

``captures`` (fetch log), ``link_graph`` (src -> dst page ids), ``robots`` and ``sitemaps``
(one file per host) and ``mail`` (one mailbox per conversation). They grow with ``pages`` and
``conversations``; the fixed 3 attempts / 5 link positions are small literal arrays exploded
per row, not joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import table

NL = "\n"


def _host(url) -> F.Column:
    return F.regexp_extract(url, r"^https?://([^/?#]+)", 1)


def captures(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url", "html")
    m = F.col("page_id") % 10
    a = F.col("attempt")
    df = p.select("page_id", "url", F.length("html").cast("bigint").alias("chars"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("attempt"))
    df = df.where((a == 0) | ((m == 0) & (a == 1)) | m.isin(3, 4))
    timeout = (m == 4) & (a < 2)
    return df.select(
        "page_id",
        "url",
        F.col("attempt").cast("int").alias("attempt"),
        F.when((m == 0) & (a == 0), 503)
        .when(m == 1, 404)
        .when(m == 2, 403)
        .when(m == 3, 429)
        .when(timeout, F.lit(None))
        .otherwise(200)
        .cast("int")
        .alias("status"),
        F.when(m == 5, "application/pdf").when(timeout, "").otherwise("text/html; charset=utf-8").alias("content_type"),
        F.when(timeout, "timeout").otherwise("").alias("failure"),
        F.when(F.col("page_id") % 25 == 7, F.concat(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.lit("/")))
        .otherwise(F.col("url"))
        .alias("final_url"),
        "chars",
        (50 + (F.col("page_id") * 37 + a * 11) % 400).cast("bigint").alias("elapsed_ms"),
    )


def rendered_captures(spark: SparkSession, d: str) -> DataFrame:
    """``captures`` with a renderer: every third page is also rendered by a browser, in one attempt that
    fails on every fifteenth page; of every seventh page the http text is short."""
    c = captures(spark, d)
    http = c.withColumn("renderer", F.lit("http")).withColumn("chars", F.when(F.col("page_id") % 7 == 0, F.lit(100)).otherwise(F.col("chars")).cast("bigint"))
    browser = c.where((F.col("attempt") == 0) & (F.col("page_id") % 3 == 0)).withColumns({
        "renderer": F.lit("browser"),
        "status": F.when(F.col("page_id") % 15 == 0, 500).otherwise(200).cast("int"),
        "content_type": F.lit("text/html"),
        "failure": F.lit(""),
    })
    return http.unionByName(browser)


def canonical_pages(spark: SparkSession, d: str) -> DataFrame:
    """``pages`` with a canonical link in the head of every second one; forty pages share one target."""
    p = table(spark, d, "pages").select("page_id", "url", "html")
    target = F.concat(F.lit('<link rel="Canonical" href="/c//'), (F.col("page_id") % 40).cast("string"), F.lit('/?utm_source=x&amp;b=1#top"></head>'))
    return p.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("</head>"), target)).otherwise(F.col("html")))


def link_graph(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id")
    n = p.count()  # one number, computed by Spark
    pos = F.col("pos")
    df = p.select(F.col("page_id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos"))
    return df.select("src", pos.cast("int").alias("pos"), ((F.col("src") * 7 + pos * pos * 3 + 1) % F.lit(n)).alias("dst"))


_ROBOTS = {
    0: "User-agent: *\nDisallow: /de/\nDisallow: /fr/\nAllow: /fr/",
    1: "User-agent: somebot\nDisallow: /\n# note\nUser-agent: *\nDisallow: /es/",
    2: "User-agent: *\nDisallow:",
}


def robots(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", _host(F.col("url")).alias("host"))
    k = F.col("k")
    g = p.groupBy("host").agg((F.min("page_id") % 4).alias("k"))
    content = F.when(k == 0, _ROBOTS[0]).when(k == 1, _ROBOTS[1]).when(k == 2, _ROBOTS[2]).otherwise("")
    return g.select("host", content.alias("content"))


def sitemaps(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url", _host(F.col("url")).alias("host"))
    entry = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    g = p.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))).alias("es"))
    body = F.array_join(F.transform("es", lambda x: x["e"]), "")
    return g.select(
        "host",
        F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), body, F.lit("</urlset>")).alias("content"),
    )


def mail(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    msg = F.concat(
        F.lit("From x@example.com\nFrom: "),
        F.col("role"),
        F.lit("@example.com\nTo: kb@example.com\nSubject: Turn "),
        F.col("turn").cast("string"),
        F.lit("\n\n"),
        F.replace("text", F.lit("\nFrom "), F.lit("\n>From ")),
        F.lit("\n"),
    )
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", msg.alias("m")))).alias("ms"))
    return g.select(
        "conv_id",
        F.concat(F.lit("mail-"), F.col("conv_id").cast("string"), F.lit(".mbox")).alias("filename"),
        F.array_join(F.transform("ms", lambda x: x["m"]), "\n").alias("content"),
    )


def sitemap_files(spark: SparkSession, d: str) -> DataFrame:
    """(site, file, content): an index for every host, a second index below it that leads back to the first,
    a missing file, and three lists of pages."""
    p = table(spark, d, "pages").select("page_id", "url", _host(F.col("url")).alias("site"))
    entry = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("page_id") % 9 == k, F.struct("page_id", entry.alias("e")))))
    g = p.groupBy("site").agg(*[listed(k).alias(f"l{k}") for k in range(3)])
    body = lambda k: F.concat(F.lit("<urlset>"), F.array_join(F.transform(f"l{k}", lambda x: x["e"]), ""), F.lit("</urlset>"))
    index = '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>maps/a.xml</loc></sitemap><sitemap><loc> /maps/b.xml#x </loc></sitemap><sitemap><loc>missing.xml</loc></sitemap></sitemapindex>'
    second = '<s:sitemapindex xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:sitemap><s:loc>urls-0.xml</s:loc></s:sitemap><s:sitemap><s:loc>../sitemap.xml</s:loc></s:sitemap><s:sitemap><s:loc>./urls-1.xml</s:loc></s:sitemap></s:sitemapindex>'
    files = {"sitemap.xml": F.lit(index), "maps/a.xml": F.lit(second), "maps/b.xml": body(2), "maps/urls-0.xml": body(0), "maps/urls-1.xml": body(1)}
    rows = F.array(*[F.struct(F.lit(name).alias("name"), content.alias("content")) for name, content in files.items()])
    one = g.select("site", F.explode(rows).alias("f"))
    return one.select("site", F.concat(F.lit("https://"), F.col("site"), F.lit("/"), F.col("f.name")).alias("file"), "f.content")


def site_links(spark: SparkSession, d: str) -> DataFrame:
    """(src_id, pos, dst_id): every page links to two pages of its host and to one anywhere."""
    from pyspark.sql import Window

    p = table(spark, d, "pages").select("page_id", _host(F.col("url")).alias("host"))
    w = Window.partitionBy("host")
    p = p.withColumns({"r": F.row_number().over(w.orderBy("page_id")) - 1, "n": F.count(F.lit(1)).over(w)})
    near = p.select("host", F.col("page_id").alias("src_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"), "r", "n")
    near = near.withColumn("r", (2 * F.col("r") + F.col("pos") + 1) % F.col("n")).join(p.select("host", "r", F.col("page_id").alias("dst_id")), ["host", "r"])
    total = p.count()
    far = p.select(F.col("page_id").alias("src_id"), F.lit(2).alias("pos"), ((F.col("page_id") * 7 + 1) % F.lit(total)).alias("dst_id"))
    return near.select("src_id", "pos", "dst_id").unionByName(far)
