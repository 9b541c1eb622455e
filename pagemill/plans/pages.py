"""Page records (H1-H9): pages -> node table (once) -> title, content area, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.config import Config
from pagemill.functions.text import nonempty, postprocess_markdown, text_chars
from pagemill.functions.urls import with_host_path
from pagemill.operators import extract as X
from pagemill.session import cut_lineage
from pagemill.sources.html_nodes import html_nodes


def node_table(pages: DataFrame, profile: str = "crawl", checkpoint: bool = True) -> DataFrame:
    """Tokenise once (the only Python step) and write the node table to the checkpoint folder,
    so the title, area, Markdown and link jobs read it instead of re-parsing."""
    nodes = X.with_removed(html_nodes(pages), profile)
    return cut_lineage(nodes) if checkpoint else nodes


def page_records(pages: DataFrame, cfg: Config = Config(), profile: str = "crawl", nodes: DataFrame | None = None,
                 url_col: str = "url", renderer: str = "http", checkpoint: bool = True) -> DataFrame:
    """(page_id, url, host, path, title, markdown, clean_text_chars, used_readability, renderer).

    Title falls back to the URL; pages without content keep Markdown ``"\\n"``."""
    if nodes is None:
        nodes = node_table(pages, profile)
    area = X.content_area(nodes, profile, cfg.main_selectors, readability=cfg.readability_fallback, min_text_chars=cfg.min_text_chars)
    md = X.markdown(nodes, area, cfg.strip_links, cfg.strip_images, mark_code=(profile == "crawl"))
    title = X.titles(nodes)
    base = pages.select("page_id", F.col(url_col).alias("url"))
    df = base.join(title, "page_id", "left").join(md, "page_id", "left").join(area.select("page_id", "used_readability"), "page_id", "left")
    df = with_host_path(df, "url", None)
    markdown = F.coalesce(F.col("markdown"), postprocess_markdown(F.lit("")))
    recs = df.select(
        "page_id",
        "url",
        "host",
        "path",
        F.coalesce(nonempty("title"), F.col("url")).alias("title"),
        markdown.alias("markdown"),
        text_chars(markdown).alias("clean_text_chars"),
        F.coalesce(F.col("used_readability"), F.lit(False)).alias("used_readability"),
        F.lit(renderer).alias("renderer"),
    )
    return cut_lineage(recs) if checkpoint else recs
