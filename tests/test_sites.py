"""Many sites at once, sitemap indexes, the set of keys met, host suffixes and path prefixes, against plain Python."""

import random
from collections import deque

from pagemill.operators.links import with_allowed_host
from pagemill.operators.robots import robots_rules, with_longest_rule, with_robots_disallowed
from pagemill.plans.seen import Seen
from pagemill.plans.site_crawls import crawl_sites, expand_sitemaps, segmented_rank
from pagemill.session import written


def plain_crawl(edges, seeds, max_pages):
    """One queue per site, one URL at a time."""
    out, decisions = {}, {}
    for site in {s for s, _ in seeds}:
        order = [n for s, n in seeds if s == site]
        queue, met = deque((n, 0) for n in order), set(order)
        while queue:
            node, depth = queue.popleft()
            out[site, node] = (depth, len([1 for s, _ in out if s == site]))
            for src, pos, dst, ok in sorted(e[1:] for e in edges if e[:2] == (site, node)):
                if max_pages is not None and len(met) >= max_pages:
                    decisions[site, src, pos] = "budget"
                elif dst in met or not ok:
                    decisions[site, src, pos] = "seen" if dst in met else "rules"
                else:
                    decisions[site, src, pos] = "admitted"
                    met.add(dst)
                    queue.append((dst, depth + 1))
    return out, decisions


def test_many_sites_equal_one_queue_each(spark):
    r = random.Random(4)
    edges = [(s, f"n{k}", p, f"n{r.randrange(12)}", r.random() < 0.8) for s in "abc" for k in range(12) for p in range(r.randrange(4))]
    seeds = [("a", "n0"), ("a", "n3"), ("b", "n1"), ("c", "n11"), ("d", "alone")]
    table = spark.createDataFrame(edges, "site string, src string, pos int, dst string, ok boolean")
    starts = spark.createDataFrame([(s, n, k) for k, (s, n) in enumerate(seeds)] + [("a", "n0", 99)], "site string, node string, place int")
    for max_pages in (None, 5):
        frontier, decisions = crawl_sites(table, starts, max_pages=max_pages, can_enqueue="ok")
        order, decided = plain_crawl(edges, seeds, max_pages)
        assert {(x.site, x.node): (x.depth, x.ord) for x in frontier.collect()} == order
        assert {(x.site, x.src, x.pos): x.decision for x in decisions.collect()} == decided


def test_a_long_chain_and_an_empty_queue(spark):
    n = 40
    chain = spark.range(n).selectExpr("id AS src", "0 AS pos", "id + 1 AS dst")
    start = spark.createDataFrame([(7, 0, 0)], "site int, node long, place int")
    frontier, decisions = crawl_sites(chain, start)
    assert [(x.node, x.depth, x.ord) for x in frontier.orderBy("ord").collect()] == [(k, k, k) for k in range(n + 1)]
    assert decisions.count() == n
    frontier, decisions = crawl_sites(chain, start.limit(0))
    assert frontier.count() == 0 and decisions.count() == 0


def test_ranks_in_segments_by_range_sort(spark):
    rows = [(None if k % 7 == 0 else k % 3, (k * 37) % 500) for k in range(500)]
    got = segmented_rank(spark.createDataFrame(rows, "s int, k int").repartition(5), ["s"], "k", "rank").filter("s IS NOT NULL").collect()
    for s in range(3):
        ks = sorted(k for x, k in rows if x == s)
        assert {x.k: x["rank"] for x in got if x.s == s} == {k: i for i, k in enumerate(ks)}


def test_seen_keys(spark):
    seen = Seen(spark, ["a", "b"], words=64)
    for k in range(18):  # more rounds than one tier holds
        seen.add(written(spark.createDataFrame([(k, f"x{j}") for j in range(5)] + ([(None, None)] if k == 3 else []), "a int, b string"), "round"))
    asked = spark.createDataFrame([(0, "x0"), (17, "x4"), (17, "x5"), (None, None), (None, "x0"), (99, "x0")], "a int, b string")
    found = seen.known(seen.marked(asked, "met"), "met").collect()
    assert {(x.a, x.b): x.met for x in found} == {(0, "x0"): True, (17, "x4"): True, (17, "x5"): False, (None, None): True, (None, "x0"): False, (99, "x0"): False}
    assert len(seen.tiers) == 2 and len(seen.tiers[0]) == 2


def test_sitemap_indexes_with_cycles_and_limits(spark):
    entries = [
        ("i", "sitemap", 0, "j"), ("i", "sitemap", 1, "gone"), ("i", "sitemap", 2, "u"), ("j", "sitemap", 0, "i"), ("j", "sitemap", 1, "v"),
        ("u", "url", 0, "p"), ("v", "url", 0, "q"), ("v", "url", 1, "p"), ("i", "url", 5, "r"),
    ]
    table = spark.createDataFrame(entries, "file string, kind string, pos int, loc string")
    present = spark.createDataFrame([(f,) for f in "ijuv"] + [("empty",)], "file string")
    starts = spark.createDataFrame([("s", "i"), ("t", "j"), ("x", "empty"), ("y", "none")], "site string, node string")
    files, urls = expand_sitemaps(starts, table, present)
    got = {(x.site, x.node): (x.file_ord, x.found) for x in files.collect()}
    assert got == {
        ("s", "i"): (0, True), ("s", "j"): (1, True), ("s", "gone"): (2, False), ("s", "u"): (3, True), ("s", "v"): (4, True),
        ("t", "j"): (0, True), ("t", "i"): (1, True), ("t", "v"): (2, True), ("t", "gone"): (3, False), ("t", "u"): (4, True),
        ("x", "empty"): (0, True), ("y", "none"): (0, False),
    }
    assert sorted(x.node for x in urls.filter("site = 's'").collect()) == ["p", "p", "q", "r"]
    files, urls = expand_sitemaps(starts.filter("site = 's'"), table, present, max_files=3)
    assert {x.node for x in files.collect()} == {"i", "j", "gone"} and [x.node for x in urls.collect()] == ["r"]


def test_allowed_hosts(spark):
    hosts = ["a.b.c", "B.C", "c", "xb.c", "a..b.c", "", None, "b.c", "1.2.3.4", "é.b.c"]
    names = [" B.c ", "3.4", "", "  ", "é", "zz"]
    got = with_allowed_host(spark.createDataFrame(list(enumerate(hosts)), "id int, h string"), "h", spark.createDataFrame([(n,) for n in names], "host string"), "ok")
    clean = [n.strip().lower() for n in names if n.strip()]
    assert {r.id: r.ok for r in got.collect()} == {k: h is not None and any(h.lower() == n or h.lower().endswith("." + n) for n in clean) for k, h in enumerate(hosts)}


def test_prefix_index_equals_a_scan(spark):
    r = random.Random(8)
    path = lambda n: "/" + "".join(r.choice("ab/é😀") for _ in range(n))
    rules = [(h, path(r.randrange(4))) for h in "xy" for _ in range(25)] + [("z", "/")]
    paths = [(k, r.choice(["x", "y", "z", "w", None]), path(r.randrange(8))) for k in range(120)]
    table = spark.createDataFrame(rules, "host string, rule string")
    got = with_longest_rule(spark.createDataFrame(paths, "id int, h string, p string"), table, "h", "p", "best")
    want = {k: max((x for g, x in rules if g == h and p.startswith(x)), key=len, default=None) for k, h, p in paths}
    assert {x.id: x.best for x in got.collect()} == want


def test_robots_by_array_and_by_index_are_equal(spark):
    robots = spark.createDataFrame([("a.org", "User-agent: *\nDisallow: /x\nDisallow: /y/z"), ("b.org", "User-agent: *\nDisallow:")], "host string, content string")
    urls = spark.createDataFrame([(f"https://{h}{p}",) for h in ("a.org", "b.org", "c.org") for p in ("", "/", "/x", "/xy?q", "/y", "/y/z/1")], "url string")
    rules = robots_rules(robots)
    one = {r.url: r.no for r in with_robots_disallowed(urls, rules, "url", "no").collect()}
    assert one == {r.url: r.no for r in with_robots_disallowed(urls, rules, "url", "no", host_rules=0).collect()} and sum(one.values()) == 9
