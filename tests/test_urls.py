import duckdb
from pyspark.sql import functions as F

from conftest import SF001
from pagemill.functions import urls

# (input, normalised URL)
URLS = [
    ("http://example.com/page#section", "http://example.com/page"),
    ("http://example.com/page/#section", "http://example.com/page"),
    ("HTTP://Example.COM//a//b///?b=2&a=1&utm_source=x&REF=y#frag", "http://Example.COM/a/b?a=1&b=2"),
    ("example.com/path/", "https://example.com/path"),
    ("ftp://example.com/file", ""),
    ("mailto:someone@example.com", ""),
    ("http://example.com?a", "http://example.com/?a="),
    ("http://example.com/?a=&b", "http://example.com/?a=&b="),
    ("http://example.com/p;params/x;y?q=1", "http://example.com/p;params/x;y?q=1"),
    ("http://example.com/x//y/;p", "http://example.com/x/y;p"),
    ("https://user:pw@Host.Example:8080/a/", "https://user:pw@Host.Example:8080/a"),
    ("http://example.com/?q=a+b&q=a%20b&z=%7E*", "http://example.com/?q=a+b&q=a+b&z=~%2A"),
    ("http://example.com/?k=%zz&k2=%41%42", "http://example.com/?k=%25zz&k2=AB"),
    ("http://example.com/?%E2%82%AC=1&a=%FF", "http://example.com/?a=%EF%BF%BD&%E2%82%AC=1"),
    ("https://example.com/?gclid=1&fbclid=2&mc_cid=3&mc_eid=4&source=5&utm_medium=6&keep=7", "https://example.com/?keep=7"),
    ("  \thttp://example.com/a\nb", "http://example.com/ab"),
    ("http://[::1]:80/a", "http://[::1]:80/a"),
    ("//example.com/a", "https:///example.com/a"),
    ("example.com:8080/path", ""),
    ("http://example.com/?a=1&&b=2&", "http://example.com/?a=1&b=2"),
    ("https://example.com/a/b/../c/./d", "https://example.com/a/b/../c/./d"),
    ("http://ex.com/?b=%2F&a=~x*y", "http://ex.com/?a=~x%2Ay&b=%2F"),
    ("", ""),
    ("https://example.com", "https://example.com/"),
    ("http:foo", "http:foo"),
    ("http://example.com/?é=ü", "http://example.com/?%C3%A9=%C3%BC"),
]
BLOCKED = [
    "localhost", "LOCALHOST", "127.0.0.1", "127.1.2.3", "10.1.2.3", "172.16.0.1", "192.168.1.1", "192.0.0.11", "169.254.1.1", "0.0.0.0",
    "255.255.255.255", "::1", "::", "fe80::1", "fc00::1", "fd12:3456::1", "2001:db8::1", "2002::1", "::ffff:10.0.0.1", "fe80::1%eth0",
    "64:ff9b:1::1", "100::1",
]
OPEN = [
    "172.32.0.1", "192.0.0.9", "192.0.0.10", "100.64.0.1", "224.0.0.1", "8.8.8.8", "010.0.0.1", "1.2.3", "example.com", "2001:4860::8888",
    "::ffff:8.8.8.8", "2001:1::1", "2001:3::1", "2606:4700::1111", ":::", "1::2::3", "2001:20::1", "2001:200::1",
]


def test_normalised_urls(spark):
    df = spark.createDataFrame(URLS, "url string, want string")
    for r in urls.with_normalized_url(df, "url", "n").collect():
        assert r.n == r.want, r.url


def test_normalising_twice_changes_nothing(spark):
    df = spark.read.parquet(f"{SF001}/pages.parquet").select("url")
    once = urls.with_normalized_url(df, "url", "n").select("n")
    rows = urls.with_normalized_url(once, "n", "again").collect()
    assert len(rows) == 250 and all(r.n == r.again for r in rows)
    assert len({r.n for r in rows}) == 249


def test_reference_fragment_case(spark):
    df = spark.createDataFrame([("http://example.com/page#section",), ("http://example.com/page/#section",)], "url string")
    assert {r["n"] for r in urls.with_normalized_url(df, "url", "n").collect()} == {"http://example.com/page"}


def test_blocked_hosts(spark):
    df = spark.createDataFrame([(h,) for h in BLOCKED + OPEN], "h string")
    got = {r.h for r in urls.with_blocked_host(df, "h", "b").collect() if r.b}
    assert got == set(BLOCKED)


def test_blocked_url_and_public(spark):
    df = spark.createDataFrame([("http://127.0.0.1/secret",), ("https://example.com/a",), ("ftp://x.com",),
                                ("localhost:8000/x",), ("example.com/a",)], "u string")
    out = urls.with_public_url(urls.with_blocked_url(df, "u", "b"), "u", "safe", "why")
    rows = {r["u"]: r for r in out.collect()}
    assert rows["http://127.0.0.1/secret"]["b"] is True
    assert rows["https://example.com/a"]["b"] is False
    assert rows["ftp://x.com"]["why"] == "Only http(s) URLs are allowed."
    assert rows["example.com/a"]["safe"] == "https://example.com/a"
    assert rows["http://127.0.0.1/secret"]["why"] == "Target host is not allowed."


def test_urljoin_matches_python(spark):
    from urllib.parse import urljoin

    bases = ["http://a.com/b/c/d;p?q", "https://x.org", "https://x.org/dir/", "http://h.com/a/b"]
    hrefs = ["g", "./g", "g/", "/g", "//g.com/x", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g",
             "../..", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h",
             "g/../h", "g;x=1/./y", "g;x=1/../y", "http:g", "ftp://o.org/x", "mailto:a@b", "a//b/../c", "/a//b/"]
    rows = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(rows, "b string, h string")
    got = urls.with_urljoin(df, "b", "h", "j").collect()
    for r in got:
        assert r["j"] == urljoin(r["b"], r["h"]), (r["b"], r["h"], r["j"], urljoin(r["b"], r["h"]))
