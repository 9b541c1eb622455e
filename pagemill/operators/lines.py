"""Corpus-wide repeated-line removal.

Plan (two passes over the text, as the service does):

1. ``line_frequencies`` (A1): ``groupBy(line).count()``. Partial aggregation runs map-side,
   so a line that makes up a third of the corpus is collapsed to one row per task before
   the shuffle.
2. The droppable lines (count > 3 and not a protected heading) are written to the shared
   checkpoint folder, measured with one aggregate and broadcast only if they fit
   ``broadcast_bytes``; otherwise the join stays a shuffle join and AQE splits skewed
   partitions.
3. J4: the positions of the droppable lines of each page (``dropped_positions``).
4. A2: pages joined with their positions and rebuilt row by row, then T2. Pages that lose every
   line are kept with text ``"\\n"``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import postprocess_markdown, py_rstrip, py_strip, splitlines
from pagemill.session import spread, written

# Short lines that are never removed, compared lower-cased.
PROTECTED_HEADINGS = ("overview", "introduction", "summary", "contents", "table of contents")

REPEAT_LIMIT = 3  # a line seen more than this many times is boilerplate


@dataclass(frozen=True)
class BoilerplateOptions:
    protect_fences: bool = False
    broadcast_bytes: int = 64 * 1024 * 1024
    checkpoint: bool = True


def line_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A1: (line, n) over all occurrences of each stripped non-blank line."""
    lines = df.select(F.explode(splitlines(text_col)).alias("raw")).select(py_strip("raw").alias("line"))
    return lines.where(F.col("line") != "").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def protected_line(stripped: Column, protect_fences: bool = False) -> Column:
    """P11's exception: short headings and '# ' / '## ' lines survive any count."""
    cond = (F.length(stripped) <= 60) & (
        F.lower(stripped).isin(*PROTECTED_HEADINGS) | stripped.startswith("# ") | stripped.startswith("## ")
    )
    if protect_fences:
        cond = cond | (stripped == "```")
    return cond


def droppable_lines(freq: DataFrame, opts: BoilerplateOptions = BoilerplateOptions()) -> DataFrame:
    return freq.where((F.col("n") > REPEAT_LIMIT) & ~protected_line(F.col("line"), opts.protect_fences)).select(
        "line"
    )


def _fits_broadcast(df: DataFrame, max_bytes: int) -> bool:
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("line") + 16).alias("bytes")).first()
    return (row["bytes"] or 0) <= max_bytes


def dropped_positions(df: DataFrame, key: list[str], text_col: str, opts: BoilerplateOptions = BoilerplateOptions()) -> DataFrame:
    """(key, _drops) for the texts that have a droppable line: the positions of such lines. Blank
    lines never join; what is shuffled is a key and an array per text."""
    drop = droppable_lines(line_frequencies(df, text_col), opts)
    if opts.checkpoint:
        drop = written(drop, "droppable-lines")
        if _fits_broadcast(drop, opts.broadcast_bytes):
            drop = F.broadcast(drop)
    occ = df.select(*key, F.posexplode(splitlines(text_col)).alias("_pos", "raw")).select(*key, "_pos", py_strip("raw").alias("line"))
    hit = occ.where(F.col("line") != "").join(drop, "line")
    return hit.groupBy(*key).agg(F.collect_set("_pos").alias("_drops"))


def boilerplate_filter(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    opts: BoilerplateOptions = BoilerplateOptions(),
) -> DataFrame:
    """A2: (id, text) with lines repeated more than 3 times across ``df`` removed, then T2.

    Only the positions of dropped lines come together by id; the texts are rebuilt row by row."""
    src = spread(df.select(id_col, text_col))
    drops = dropped_positions(src, [id_col], text_col, opts)
    if opts.checkpoint:
        drops = written(drops, "dropped-positions")
    joined = src.join(drops, id_col, "left")
    positions = F.coalesce("_drops", F.array().cast("array<int>"))
    lines = F.filter(splitlines(text_col), lambda line, k: ~F.array_contains(positions, k))
    text = F.array_join(F.transform(lines, lambda line: py_rstrip(line)), "\n")
    return joined.select(id_col, postprocess_markdown(F.coalesce(text, F.lit(""))).alias(text_col))
