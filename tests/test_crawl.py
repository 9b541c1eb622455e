"""Crawls of hand-made graphs with their expected order, decisions and redirects."""

from pagemill.plans.crawl import bfs, dense_rank_by, first_pages, running_sum, skipped_counts

#        a -> b c    b -> d a    c -> d e    d -> f    e -> (none)    f -> a
EDGES = [
    ("a", 0, "b"), ("a", 1, "c"), ("b", 0, "d"), ("b", 1, "a"), ("c", 0, "d"), ("c", 1, "e"), ("d", 0, "f"), ("f", 0, "a"),
]


def crawl(spark, edges=EDGES, seeds=("a",), **options):
    df = spark.createDataFrame(edges, "src string, pos int, dst string" + (", ok boolean" if len(edges[0]) == 4 else ""))
    return bfs(df, spark.createDataFrame([(s,) for s in seeds], "node string"), **options)


def order(frontier):
    rows = sorted(frontier.collect(), key=lambda r: r.ord)
    assert [r.ord for r in rows] == list(range(len(rows)))
    return [(r.node, r.depth) for r in rows]


def decisions(df):
    return {(r.src, r.pos): r.decision for r in df.collect()}


def test_whole_graph_without_limits(spark):
    frontier, decided = crawl(spark)
    assert order(frontier) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 2), ("f", 3)]
    assert decisions(decided) == {
        ("a", 0): "admitted", ("a", 1): "admitted", ("b", 0): "admitted", ("b", 1): "seen", ("c", 0): "seen", ("c", 1): "admitted",
        ("d", 0): "admitted", ("f", 0): "seen",
    }
    assert {r.decision: r.n for r in skipped_counts(decided).collect()} == {"admitted": 5, "seen": 3}


def test_more_than_500_pages(spark):
    tree = [("r", k, f"c{k}") for k in range(30)] + [(f"c{k}", j, f"g{k}-{j}") for k in range(30) for j in range(30)]
    frontier, decided = crawl(spark, tree, ("r",))
    assert order(frontier)[-1] == ("g29-29", 2) and frontier.count() == 931
    assert set(decisions(decided).values()) == {"admitted"}


def test_depth_limit_leaves_a_decision_for_every_link(spark):
    frontier, decided = crawl(spark, max_depth=1)
    assert order(frontier) == [("a", 0), ("b", 1), ("c", 1)]
    assert decisions(decided) == {("a", 0): "admitted", ("a", 1): "admitted", ("b", 0): "depth", ("b", 1): "depth", ("c", 0): "depth", ("c", 1): "depth"}


def test_budget_comes_before_seen(spark):
    frontier, decided = crawl(spark, max_pages=4)
    assert order(frontier) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    # d fills the budget, so every later link of the level is refused, also the seen one
    assert decisions(decided) == {
        ("a", 0): "admitted", ("a", 1): "admitted", ("b", 0): "admitted", ("b", 1): "budget", ("c", 0): "budget", ("c", 1): "budget", ("d", 0): "budget",
    }


def test_rules_and_failed_pages(spark):
    edges = [(*e, e[2] != "c") for e in EDGES]
    ok = spark.createDataFrame([("a",), ("d",)], "node string")
    frontier, decided = crawl(spark, edges, can_enqueue="ok", expandable=ok)
    assert order(frontier) == [("a", 0), ("b", 1)]
    assert decisions(decided) == {("a", 0): "admitted", ("a", 1): "rules"}
    assert [(r.node, r.page_no) for r in first_pages(frontier, ok).collect()] == [("a", 0)]


def test_redirect_targets_are_seen_and_skipped(spark):
    # b leads to d: d is not queued again from b on; c leads to e
    aliases = spark.createDataFrame([("b", "d"), ("c", "e")], "node string, alias string")
    frontier, decided = crawl(spark, aliases=aliases)
    assert order(frontier) == [("a", 0), ("b", 1), ("c", 1)]
    assert decisions(decided)[("b", 0)] == "seen" and decisions(decided)[("c", 1)] == "seen"


def test_queued_page_is_skipped_when_an_earlier_one_led_to_it(spark):
    # b and c are both queued; b leads to c, so c is skipped and its links are never read
    aliases = spark.createDataFrame([("b", "c"), ("c", "e")], "node string, alias string")
    frontier, decided = crawl(spark, aliases=aliases)
    assert {r.node for r in frontier.filter("not visited").collect()} == {"c"}
    assert ("c", 0) not in decisions(decided) and "e" not in {n for n, _ in order(frontier)}


def test_redirect_targets_use_the_budget(spark):
    aliases = spark.createDataFrame([("a", "z")], "node string, alias string")
    frontier, decided = crawl(spark, aliases=aliases, max_pages=3)
    assert order(frontier) == [("a", 0), ("b", 1)]
    assert decisions(decided)[("a", 1)] == "budget"


def test_dense_rank_and_running_sum(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 AS k")
    assert all(r.r == r.k + 10 for r in dense_rank_by(df, "k", "r", 10).collect())
    summed = running_sum(spark.range(0, 200_000).selectExpr("id AS k", "id % 3 AS v"), "k", "v", "s")
    assert {r.s for r in summed.filter("k in (2, 65536, 199999)").collect()} == {3, 65536, 199999}
