"""Records with heads of any length."""

from pagemill.llm import warc


def test_pages_with_very_long_urls(spark):
    rows = [(1, "https://example.org/" + "x" * 200_000, "a page"), (2, "https://example.org/" + " " * 70_000, "another")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.new_folder(pages)
    got = warc.read_records(warc.write_bundles(pages, folder, bundles=1), folder).collect()
    assert {r.page: bytes(r.payload) for r in got} == {"1": b"a page", "2": b"another"}
