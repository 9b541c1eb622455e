"""Pages of our own: noise, main area, code, links, titles and the combined export."""

from pyspark.sql import functions as F

from pagemill.config import Config
from pagemill.operators import export as EX
from pagemill.operators import extract as X
from pagemill.operators.lines import boilerplate_filter
from pagemill.operators.links import canonical_links, links
from pagemill.plans import pages as PG


def pages_of(spark, *htmls, url="https://shop.test/p"):
    return spark.createDataFrame([(k, f"{url}{k}", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")


def test_noise_goes_by_tag_id_and_class(spark):
    html = """<body><header>Top bar</header><nav>Menu</nav><p id="newsletter-signup">Join us</p>
      <article><h2>Soup</h2><p>Boil the water.</p><ul class="social-share"><li>Post it</li></ul></article>
      <form>Your name</form><aside>See also</aside><footer>Imprint</footer></body>"""
    nodes = PG.node_table(pages_of(spark, html))
    kept = {r.text.strip() for r in X.text_rows(nodes).collect()} - {""}
    assert {"Soup", "Boil the water."} <= kept
    assert not kept & {"Top bar", "Menu", "Post it", "See also", "Imprint"}


def test_the_largest_div_without_a_main_area(spark):
    html = "<body><div id='a'>short</div><div id='b'>" + "a long tale of many words " * 20 + "</div><div id='c'>also short</div></body>"
    nodes = PG.node_table(pages_of(spark, html))
    area = X.content_area(nodes, "crawl", selectors=(), readability=False)
    text = X.main_text(nodes, area).first().main_text
    assert "a long tale" in text and "short" not in text


def test_code_keeps_its_lines_in_a_fence(spark):
    md = PG.page_records(pages_of(spark, "<main><p>Run</p><pre><code>for x in y:\n    go(x)\n</code></pre></main>")).first().markdown
    assert "```" in md and "for x in y:\n    go(x)" in md


def test_links_are_resolved_against_the_page(spark):
    html = '<main><a href="b?utm_campaign=1&x=2">b</a> <a href="../up/">up</a> <a href="//other.test">o</a> <a href="tel:1">t</a></main>'
    df = pages_of(spark, html, url="https://shop.test/dir/p")
    got = [r.dst_url for r in links(PG.node_table(df), df).orderBy("pos").collect()]
    assert got == ["https://shop.test/dir/b?x=2", "https://shop.test/up", "https://other.test/", ""]


def test_canonical_links(spark):
    df = pages_of(spark, '<head><link rel="canonical" href="/item//7/?ref=mail&b=1&a=2#top"></head>', "<p>none</p>")
    assert [(r.page_id, r.canonical_url) for r in canonical_links(PG.node_table(df), df).collect()] == [(0, "https://shop.test/item/7?a=2&b=1")]


def test_a_page_without_a_title_is_named_by_its_url(spark):
    r = PG.page_records(pages_of(spark, "<p>text only</p>")).first()
    assert r.title == "https://shop.test/p0" and r.markdown.endswith("\n")


def test_min_text_chars_is_taken_as_given(spark):
    html = "<body><div><p>" + "brief words, " * 9 + "</p></div></body>"
    low = PG.page_records(pages_of(spark, html), Config(min_text_chars=50)).first()
    assert Config(min_text_chars=50, max_pages=100_000).max_pages == 100_000
    assert low.clean_text_chars > 50
    limits = Config(min_text_chars=50, max_pages=100_000, max_depth=99).service_limits()
    assert (limits.min_text_chars, limits.max_pages, limits.max_depth) == (200, 500, 6)


SHOP = """<html><head><title>Tea shop</title></head><body><nav>All teas</nav><main><h1>Green tea</h1>
<p>Pour at eighty degrees.</p><p>Wait two minutes.</p></main><footer>Imprint</footer></body></html>"""
BLOG = """<html><head><title>Tea notes</title></head><body><article><h2>Storing</h2><p>Keep it dry and dark.</p></article></body></html>"""

# fixed value: the layout of the combined export
COMBINED = """<!-- Crawl summary:
Total pages: 2
Skipped links: 3
Errors: 1
Error samples:
  - https://shop.test/gone (http-error 404)
-->

# shop.test

## Tea shop

# Green tea

Pour at eighty degrees.

Wait two minutes.


## Tea notes

## Storing

Keep it dry and dark.
"""


def test_combined_export(spark):
    recs = PG.page_records(pages_of(spark, SHOP, BLOG)).withColumnRenamed("page_id", "ord")
    cleaned = boilerplate_filter(recs.select("ord", "markdown"), "ord", "markdown")
    recs = recs.drop("markdown").join(cleaned, "ord")
    errors = spark.createDataFrame([(0, "https://shop.test/gone", "http-error", "404")], "seq long, url string, reason string, status string")
    parts = EX.combined_parts(recs, EX.summary_header(recs, errors, 3))
    text = EX.to_text(parts, "section", "host", "ord").first().text
    head, body = text.split("-->")
    want_head, want_body = COMBINED.split("-->")
    assert body == want_body
    assert "Total pages: 2" in head and "Skipped links: 3" in head and "Errors: 1" in head and "https://shop.test/gone (http-error" in head


def test_only_visible_columns_are_needed(spark):
    recs = PG.page_records(pages_of(spark, SHOP))
    assert recs.select(F.col("host")).first()[0] == "shop.test"


def markdown_of(spark, html, **options):
    nodes = PG.node_table(pages_of(spark, html))
    area = X.content_area(nodes, "crawl", readability=False)
    return X.markdown(nodes, area, **options).first().markdown


def test_lists_and_tables(spark):
    html = """<main><ol><li>one</li><li>two<ul><li>inner</li></ul></li></ol><p>after</p>
      <table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr></table></main>"""
    assert markdown_of(spark, html) == "  1. one\n  2. two\n    * inner\n\nafter\n\nk | v\n---|---\na | 1\n"


def test_links_and_images_on_request(spark):
    html = '<main><p>see <a href="/x">the <b>list</b></a> <img src="i.png" alt="pic"></p></main>'
    assert markdown_of(spark, html) == "see the **list**\n"
    assert markdown_of(spark, html, strip_links=False, strip_images=False) == "see [the](/x) [**list**](/x) ![pic](i.png)\n"


def test_combined_export_is_named_by_host_and_time(spark):
    name = spark.sql("SELECT 'Docs.Example.com' AS host, timestamp'2024-01-02 03:04:05' AS at").select(EX.combined_file_name("host", "at")).first()[0]
    assert name == "docs-example-com__20240102_030405.md"


def test_a_batch_of_nodes_is_bounded_whatever_the_pages(monkeypatch):
    """Pages come by thousands and may be deep; nodes leave in batches of a few MB, with the same rows."""
    import pyarrow as pa

    from pagemill.sources import html_nodes as H

    htmls = ["<main id='m' class='k'>" + "<p>word <b>bold</b></p>" * 50 + "</main>", None, "<b>" * 200 + "x", "", "<ul><li>a<br>b</ul>"] * 4
    pages = pa.record_batch({"page_id": pa.array([None, *range(1, 20)], pa.int64()), "html": pa.array(htmls)})
    whole = pa.Table.from_batches(list(H._tokenize_batches(iter([pages]))))
    monkeypatch.setattr(H, "BATCH_BYTES", 10_000)
    cut = list(H._tokenize_batches(iter([pages.slice(0, 7), pages.slice(7)])))
    assert len(cut) > 50 and max(b.get_total_buffer_size() for b in cut) < 40_000
    assert pa.Table.from_batches(cut).combine_chunks().equals(whole.combine_chunks())
    last = [r for r in whole.to_pylist() if r["page_id"] == 2][-1]
    assert (last["kind"], last["text"], last["anc_n"], last["anc_tag"]) == ("t", "x", list(range(200)), ["b"] * 200)
    bold = next(r for r in whole.to_pylist() if r["page_id"] is None and r["text"] == "bold")
    assert (bold["anc_tag"], bold["anc_id"], bold["anc_cls"]) == (["main", "p", "b"], ["m", None, None], ["k", None, None])


def test_the_writer_of_nodes_holds_one_batch(monkeypatch):
    """The first batch leaves before the last pages are read."""
    import pyarrow as pa

    from pagemill.sources import html_nodes as H

    monkeypatch.setattr(H, "BATCH_BYTES", 10_000)
    read = []

    def pages():
        for k in range(100):
            read.append(k)
            yield pa.record_batch({"page_id": pa.array([k], pa.int64()), "html": pa.array(["<p>some text</p>" * 20])})

    next(H._tokenize_batches(pages()))
    assert len(read) < 10
