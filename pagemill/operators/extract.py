"""Main content and Markdown from the node table.

All steps are DataFrame work over ``html_nodes``:

* H1 / H2 noise: a row is removed when it or an ancestor is a noise tag or (crawl profile) has
  an id / class matching the noise words; a row-local ``exists`` over the ancestor arrays.
* H3 title: the first kept ``<title>`` with exactly one text child, stripped.
* H4 / O5 main area: the selector list is matched on element rows; ``min_by(n, (rank, n))``
  per page picks the first match of the highest-priority selector.
* H5 / A11 largest div: text rows exploded over their ``div`` ancestors, summed per div,
  ``max_by`` with ties to the first div; used when longer than 200 characters.
* H6 readability: a corpus-side score per container (text length, commas, link density);
  the best container is used when its text reaches ``min_text_chars``.
* H8 Markdown: rows under the chosen container are grouped into blocks (nearest block-level
  ancestor; a new segment whenever the block changes in document order), each block is
  formatted by its tag and the blocks are joined in order, then T2.

Every group is one page (bounded by the page itself); nothing is collected to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.config import MAIN_SELECTORS
from pagemill.functions.text import postprocess_markdown, py_strip

# Tags removed with their subtree, and the id / class words that remove an element.
NOISE_TAGS = ("script", "style", "nav", "footer", "header", "aside")
EXTRA_NOISE_TAGS = ("form", "noscript", "svg", "iframe")
NOISE_WORDS = r"(?i)(cookie|consent|banner|modal|popup|subscribe|newsletter|social|share|breadcrumb|sidebar|menu|nav)"

BLOCK_TAGS = (
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "th", "tr",
    "table", "ul", "ol", "dl", "dt", "dd", "section", "article", "main", "body", "html", "header",
    "footer", "nav", "aside", "form", "figure", "figcaption", "address",
)
READABILITY_CANDIDATES = ("article", "main", "section", "div", "td")
LARGEST_DIV_MIN = 200


def _exists(arr: str, pred) -> Column:
    return F.coalesce(F.exists(F.col(arr), lambda x: F.coalesce(pred(x), F.lit(False))), F.lit(False))


def with_removed(nodes: DataFrame, profile: str = "crawl", extra_noise: bool = True) -> DataFrame:
    """H1 (+ H2 for the crawl profile): ``removed`` per row."""
    tags = NOISE_TAGS + (EXTRA_NOISE_TAGS if extra_noise or profile == "import" else ())
    removed = _exists("anc_tag", lambda t: t.isin(*tags)) | (
        (F.col("kind") == "e") & F.coalesce(F.col("tag").isin(*tags), F.lit(False))
    )
    if profile == "crawl":
        removed = (
            removed
            | _exists("anc_id", lambda v: v.rlike(NOISE_WORDS))
            | _exists("anc_cls", lambda v: v.rlike(NOISE_WORDS))
            | ((F.col("kind") == "e") & (F.coalesce(F.col("attr_id").rlike(NOISE_WORDS), F.lit(False))
                                         | F.coalesce(F.col("attr_cls").rlike(NOISE_WORDS), F.lit(False))))
        )
    return nodes.withColumn("removed", removed)


def titles(nodes: DataFrame) -> DataFrame:
    """H3: (page_id, title) from the first kept <title> with a single text child ('' if none)."""
    t = nodes.where((F.col("kind") == "e") & (F.col("tag") == "title") & ~F.col("removed"))
    first = t.groupBy("page_id").agg(F.min_by(F.struct("n", "n_children"), "n").alias("t"))
    texts = nodes.where((F.col("kind") == "t") & ~F.col("removed")).select("page_id", F.col("parent").alias("tn"), "text")
    j = first.select("page_id", F.col("t.n").alias("tn"), F.col("t.n_children").alias("k")).join(texts, ["page_id", "tn"], "left")
    title = F.when(F.col("k") == 1, py_strip(F.coalesce(F.col("text"), F.lit("")))).otherwise(F.lit(""))
    return j.groupBy("page_id").agg(F.max(title).alias("title"))


def _selector_match(sel: str) -> Column:
    sel = sel.strip()
    m = re.fullmatch(r"\[\s*([\w-]+)\s*=\s*['\"]?([^'\"\]]*)['\"]?\s*\]", sel)
    if m:
        if m.group(1) != "role":
            raise ValueError(f"unsupported attribute selector {sel!r}")
        return F.col("attr_role") == m.group(2)
    if sel.startswith("#"):
        return F.col("attr_id") == sel[1:]
    if sel.startswith("."):
        return F.coalesce(F.array_contains(F.split(F.trim(F.col("attr_cls")), r"\s+"), sel[1:]), F.lit(False))
    return F.col("tag") == sel.lower()


def main_by_selectors(nodes: DataFrame, selectors: Sequence[str] = MAIN_SELECTORS) -> DataFrame:
    """(page_id, sel_n) of the first element matching the highest-priority selector."""
    if not selectors:
        return nodes.sparkSession.createDataFrame([], "page_id long, sel_n int")
    rank = None
    for i, s in enumerate(selectors):
        rank = F.when(_selector_match(s), F.lit(i)) if rank is None else rank.when(_selector_match(s), F.lit(i))
    e = nodes.where((F.col("kind") == "e") & ~F.col("removed")).withColumn("rank", rank).where(F.col("rank").isNotNull())
    return e.groupBy("page_id").agg(F.min_by("n", F.struct("rank", "n")).alias("sel_n"))


def text_rows(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("kind") == "t") & ~F.col("removed"))


def largest_div(nodes: DataFrame) -> DataFrame:
    """(page_id, div_n, div_chars) of the div with the longest stripped text; ties go to the
    first div in document order."""
    t = text_rows(nodes).select("page_id", F.length(py_strip("text")).alias("len"), F.arrays_zip("anc_n", "anc_tag").alias("a"))
    t = t.select("page_id", "len", F.explode("a").alias("x")).where(F.col("x.anc_tag") == "div")
    per_div = t.groupBy("page_id", F.col("x.anc_n").alias("div_n")).agg(F.sum("len").alias("div_chars"))
    best = per_div.groupBy("page_id").agg(F.max_by(F.struct("div_n", "div_chars"), F.struct("div_chars", -F.col("div_n"))).alias("b"))
    return best.select("page_id", F.col("b.div_n").alias("div_n"), F.col("b.div_chars").cast("bigint").alias("div_chars"))


def readability_candidates(nodes: DataFrame, min_text_chars: int) -> DataFrame:
    """H6 re-aimed: (page_id, rd_n, rd_chars, used_readability) for the best-scoring container.

    Score = (text length / 100 + commas) * (1 - link text share), the usual content-scoring
    signals; the container is used when its text joined by spaces reaches ``min_text_chars``."""
    t = text_rows(nodes).select(
        "page_id",
        py_strip("text").alias("s"),
        F.exists("anc_tag", lambda x: x == "a").alias("in_link"),
        F.arrays_zip("anc_n", "anc_tag").alias("a"),
    )
    t = t.select("page_id", "s", "in_link", F.explode("a").alias("x")).where(F.col("x.anc_tag").isin(*READABILITY_CANDIDATES))
    per = t.groupBy("page_id", F.col("x.anc_n").alias("rd_n")).agg(
        F.sum(F.length("s")).alias("chars"),
        F.sum(F.when(F.col("s") != "", F.lit(1)).otherwise(F.lit(0))).alias("pieces"),
        F.sum(F.size(F.split("s", ",", -1)) - 1).alias("commas"),
        F.sum(F.when(F.col("in_link"), F.length("s")).otherwise(F.lit(0))).alias("link_chars"),
    )
    # text joined by single spaces: characters plus one space between non-empty pieces
    per = per.withColumn("rd_chars", (F.col("chars") + F.greatest(F.col("pieces") - 1, F.lit(0))).cast("bigint"))
    score = (F.col("chars") / 100.0 + F.col("commas")) * (1 - F.col("link_chars") / F.greatest(F.col("chars"), F.lit(1)))
    best = per.withColumn("score", score).groupBy("page_id").agg(
        F.max_by(F.struct("rd_n", "rd_chars"), F.struct("score", -F.col("rd_n"))).alias("b")
    )
    return best.select(
        "page_id",
        F.col("b.rd_n").alias("rd_n"),
        F.col("b.rd_chars").alias("rd_chars"),
        (F.col("b.rd_chars") >= min_text_chars).alias("used_readability"),
    )


def content_area(
    nodes: DataFrame,
    profile: str = "crawl",
    selectors: Sequence[str] = MAIN_SELECTORS,
    readability: bool = True,
    min_text_chars: int = 600,
) -> DataFrame:
    """H4-H6: (page_id, container_n, used_readability); container_n = -1 means the whole document."""
    pages = nodes.select("page_id").distinct()
    sel = main_by_selectors(nodes, selectors)
    body = nodes.where((F.col("kind") == "e") & (F.col("tag") == "body") & ~F.col("removed")).groupBy("page_id").agg(
        F.min("n").alias("body_n")
    )
    df = pages.join(sel, "page_id", "left").join(body, "page_id", "left")
    fallback = [F.col("sel_n")]
    if profile == "crawl":
        div = largest_div(nodes).where(F.col("div_chars") > LARGEST_DIV_MIN).select("page_id", "div_n")
        df = df.join(div, "page_id", "left")
        fallback.append(F.col("div_n"))
    chosen = F.coalesce(*fallback, F.col("body_n"), F.lit(-1))
    if readability and profile == "crawl":
        rd = readability_candidates(nodes, min_text_chars)
        df = df.join(rd, "page_id", "left")
        used = F.coalesce(F.col("used_readability"), F.lit(False))
        return df.select("page_id", F.when(used, F.col("rd_n")).otherwise(chosen).alias("container_n"), used.alias("used_readability"))
    return df.select("page_id", chosen.alias("container_n"), F.lit(False).alias("used_readability"))


def content_rows(nodes: DataFrame, area: DataFrame) -> DataFrame:
    """Kept rows inside each page's container (the container's descendants)."""
    j = nodes.where(~F.col("removed")).join(area.select("page_id", "container_n"), "page_id")
    inside = (F.col("container_n") == -1) | F.array_contains("anc_n", F.col("container_n"))
    return j.where(inside)


def main_text(nodes: DataFrame, area: DataFrame) -> DataFrame:
    """(page_id, main_text): ``get_text(' ', strip=True)`` of the container."""
    t = content_rows(nodes, area).where(F.col("kind") == "t").select("page_id", "n", py_strip("text").alias("s"))
    t = t.where(F.col("s") != "")
    g = t.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("xs"))
    return g.select("page_id", F.array_join(F.transform("xs", lambda x: x["s"]), " ").alias("main_text"))


def markdown(nodes: DataFrame, area: DataFrame, strip_links: bool = True, strip_images: bool = True, mark_code: bool = True) -> DataFrame:
    """H8: (page_id, markdown) with T2 applied. Items of a list follow each other line by line, indented by
    depth, with bullets or their numbers; a table is a line per row with a rule after the first. Links
    and images are their text and nothing, or with ``strip_links`` / ``strip_images`` off their Markdown."""
    rows = content_rows(nodes, area)
    rows = rows.where((F.col("kind") == "t") | F.col("tag").isin("br", "hr", "img"))
    anc = F.arrays_zip("anc_n", "anc_tag")
    below = F.filter(anc, lambda x: x["anc_n"] >= F.col("container_n"))
    blocks = F.filter(below, lambda x: x["anc_tag"].isin(*BLOCK_TAGS))
    nearest = lambda tag: F.get(F.transform(F.reverse(F.filter(below, lambda x: x["anc_tag"] == tag)), lambda x: x["anc_n"]), 0)
    rows = rows.withColumn("_blk", F.element_at(blocks, -1))
    rows = rows.withColumns(
        {
            "block_n": F.coalesce(F.col("_blk.anc_n"), F.lit(-1)),
            "block_tag": F.coalesce(F.col("_blk.anc_tag"), F.lit("")),
            "in_pre": F.exists("anc_tag", lambda t: t == "pre"),
            "tr_n": nearest("tr"),
            "table_n": nearest("table"),
        }
    )
    inline = F.filter(below, lambda x: x["anc_n"] > F.col("block_n"))
    bold = F.exists(inline, lambda x: x["anc_tag"].isin("b", "strong"))
    italic = F.exists(inline, lambda x: x["anc_tag"].isin("em", "i"))
    code = F.exists(inline, lambda x: x["anc_tag"] == "code") & ~F.col("in_pre")
    collapsed = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[ \t\n\r\f]+", " ")
    body = F.when(F.col("in_pre"), F.col("text")).otherwise(collapsed)
    core = F.regexp_extract(body, r"(?s)^\s*(.*?)\s*\z", 1)
    lead = F.regexp_extract(body, r"(?s)^(\s*)", 1)
    trail = F.regexp_extract(body, r"(?s)(\s*)\z", 1)
    # marks go around the text without its outer blanks: code innermost, then italic, bold and the link
    marked = core
    for mark, cond in (("`", code), ("_", italic), ("**", bold)):
        marked = F.when(cond, F.concat(F.lit(mark), marked, F.lit(mark))).otherwise(marked)
    if not strip_links:
        target = F.coalesce("link", F.lit(""))
        marked = F.when(target != "", F.concat(F.lit("["), marked, F.lit("]("), target, F.lit(")"))).otherwise(marked)
    piece = F.when(F.col("in_pre") | (core == ""), body).otherwise(F.concat(lead, marked, trail))
    image = F.lit("") if strip_images else F.concat(F.lit("!["), F.coalesce("alt", F.lit("")), F.lit("]("), F.coalesce("src", F.lit("")), F.lit(")"))
    piece = (
        F.when(F.col("tag") == "br", F.lit("\n"))
        .when(F.col("tag") == "hr", F.lit("\n\n* * *\n\n"))
        .when(F.col("tag") == "img", image)
        .otherwise(piece)
    )
    rows = rows.select("page_id", "n", "block_n", "block_tag", "in_pre", "tr_n", "table_n", "li_no", "list_depth", piece.alias("piece"))
    w = Window.partitionBy("page_id").orderBy("n")
    change = F.when(F.lag("block_n").over(w).isNull() | (F.lag("block_n").over(w) != F.col("block_n")), 1).otherwise(0)
    rows = rows.withColumn("seg", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = lambda c: F.min_by(c, "n").alias(c)
    segs = rows.groupBy("page_id", "seg").agg(
        first("block_tag"),
        first("tr_n"),
        first("table_n"),
        first("li_no"),
        first("list_depth"),
        F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("ps"),
    )
    txt = F.array_join(F.transform("ps", lambda x: x["piece"]), "")
    segs = segs.withColumn("t", F.when(F.col("block_tag") == "pre", txt).otherwise(
        F.regexp_replace(F.regexp_replace(txt, r" *\n *", "\n"), r"^[ \t]+|[ \t]+\z", "")))
    bt = F.col("block_tag")
    level = F.regexp_extract(bt, r"^h([1-6])\z", 1)
    t = F.col("t")
    item = F.when(F.col("li_no") > 0, F.concat(F.col("li_no").cast("string"), F.lit(". "))).otherwise(F.lit("* "))
    fmt = (
        F.when(t.rlike(r"^\s*\z"), F.lit(""))
        .when(level != "", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), F.regexp_replace(t, "\n", " ")))
        .when(bt == "li", F.concat(F.repeat(F.lit("  "), F.greatest(F.coalesce("list_depth", F.lit(1)), F.lit(1))), item, t))
        .when(bt == "blockquote", F.concat(F.lit("> "), F.regexp_replace(t, "\n", "\n> ")))
        .when(bt == "pre", F.concat(F.lit("[code]" if mark_code else ""), t, F.lit("[/code]" if mark_code else "")))
        .when(bt.isin("td", "th"), F.regexp_replace(t, "\n", " "))
        .otherwise(t)
    )
    segs = segs.select("page_id", "seg", (bt == "li").alias("is_item"), F.when(bt.isin("td", "th"), F.col("table_n")).alias("table_n"), "tr_n", fmt.alias("md"))
    # one block per page for each table: its rows are lines of cells, with a rule after the first
    cells = segs.where(F.col("table_n").isNotNull()).groupBy("page_id", "table_n", "tr_n").agg(F.array_sort(F.collect_list(F.struct("seg", "md"))).alias("cs"))
    line = F.array_join(F.transform("cs", lambda x: x["md"]), " | ")
    lines = cells.select("page_id", "table_n", F.get("cs", F.lit(0))["seg"].alias("seg"), line.alias("line"), F.size("cs").alias("width"))
    tables = lines.groupBy("page_id", "table_n").agg(F.array_sort(F.collect_list(F.struct("seg", "line", "width"))).alias("ls"))
    top = F.get("ls", F.lit(0))
    rule = F.array_join(F.array_repeat(F.lit("---"), top["width"]), "|")
    shown = F.concat(F.array(top["line"], rule), F.transform(F.slice("ls", 2, F.size("ls")), lambda x: x["line"]))
    tables = tables.select("page_id", top["seg"].alias("seg"), F.lit(False).alias("is_item"), F.array_join(shown, "\n").alias("md"))
    blocks_ = segs.where(F.col("table_n").isNull() & (F.col("md") != "")).select("page_id", "seg", "is_item", "md").unionByName(tables)
    g = blocks_.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seg", "is_item", "md"))).alias("bs"))
    sep = lambda x, k: F.when(k == 0, F.lit("")).when(x["is_item"] & F.get("bs", k - 1)["is_item"], F.lit("\n")).otherwise(F.lit("\n\n"))
    md = F.array_join(F.transform("bs", lambda x, k: F.concat(sep(x, k), x["md"])), "")
    return g.select("page_id", postprocess_markdown(md).alias("markdown"))
