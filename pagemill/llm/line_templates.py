"""Line deduplication with a log-template tree, in DataFrame operations only.

The tree has a fixed depth: the number of tokens of a line, then its first tokens. A leaf holds the lines
that agree on these. Runs of digits, URLs and mail addresses are masked inside their tokens, and a masked
token is a variable field. A token with a letter and no mask is a word. A line with masked tokens needs at
least two words, and as many as half of its tokens, to be known by the rest; otherwise it says too little
without its fields and is compared by its whole text, with lines equal to it only.

Words can be fields too, but only in lines of at least ``least_words`` words, where the others are evidence
enough: within a leaf a word that recurs at its position, in at least ``min_docs`` documents and more than
half as many as the line's other words do, stays; any other is a field. What remains, if it is at least
``constant_share`` of the words, is the line's template; any other line is a template of its own. Unlike the
usual parser, which grows its templates line by line, the outcome depends on the set of lines alone, not on
their order or placing.

A template in at least ``min_docs`` documents, or in ``long_docs`` for lines of ``long_line`` tokens or more
(which don't agree by chance), recurs: its lines are dropped but for the first (by document and line
number), so that no content leaves the corpus altogether.

Lines and templates are named by two independent 64-bit hashes each. What is shuffled: these for every line,
the text of each document once to look up the candidate lines and once to take the dropped lines out.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import written

VARIABLE = "<*>"
#: The variable part of a token: a mail address, a URL (as far as it is ASCII) or a run of digits.
#: A run is tried from its start only, so that a very long token takes linear time.
VARIABLE_PART = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9._%+-]*|(?<![A-Za-z0-9+.-])[A-Za-z0-9+.-]++://[!-~]*|[0-9]+"
BLANKS = " \t\x0b\f\r"
ID, TEXT_HASH = "__id", "__text_hash"
KEY = [ID, TEXT_HASH]


def other_blanks(line: Column) -> Column:
    """Whether the line has a blank other than the space."""
    return reduce(or_, (F.contains(line, F.lit(b)) for b in BLANKS[1:]))


def split_tokens(line: Column) -> Column:
    """Tokens between blanks; only lines with other blanks than the space pay for their replacement, which looks each character up."""
    spaced = F.when(other_blanks(line), F.translate(line, BLANKS[1:], " " * len(BLANKS[1:]))).otherwise(line)
    return F.array_remove(F.split(spaced, " "), "")


def one_spaced(line: Column) -> Column:
    """The tokens joined by one space: for most lines the line itself, so that they are not taken apart."""
    odd = other_blanks(line) | F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(odd, F.array_join(split_tokens(line), " ")).otherwise(line)


def parts(text: Column, mark: str) -> Column:
    """How many parts the one-byte ``mark`` cuts the text into, without cutting it."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit(""))) + 1


def has_address(line: Column) -> Column:
    return F.contains(line, F.lit("@")) | F.contains(line, F.lit("://"))


def has_digit(line: Column) -> Column:
    return line.rlike("[0-9]")


def masked(line: Column, address: Column, digit: Column) -> Column:
    """The line with the variable parts of its tokens replaced; only lines with an address pay for the long pattern."""
    return F.when(address, F.regexp_replace(line, VARIABLE_PART, VARIABLE)).when(digit, F.regexp_replace(line, "[0-9]+", VARIABLE)).otherwise(line)


def tokens(line: Column) -> Column:
    """Tokens between blanks, their variable parts replaced."""
    return split_tokens(masked(line, has_address(line), has_digit(line)))


def word(tok: Column) -> Column:
    """A token that says something by itself: it has a letter and no masked part."""
    return ~F.contains(tok, F.lit(VARIABLE)) & tok.rlike(r"\p{L}")


def named(*parts: Column | str) -> Column:
    """128 bits of hash over the parts."""
    return F.struct(F.xxhash64(F.lit(0), *parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (a struct of all columns but the text), ``text``, and the two columns that name a row: its id and a hash of its text."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias(ID), F.xxhash64(text_col).alias(TEXT_HASH))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a[ID].eqNullSafe(b[ID]) & (a[TEXT_HASH] == b[TEXT_HASH])


def lines_of(docs: DataFrame, depth: int, long_line: int) -> DataFrame:
    """(key, line_no, long, leaf, line): the hashes of every line with a token; equal lines share ``line``. A line
    that its words don't make known has a leaf of its own, named by its unmasked tokens."""
    # from the left only: trimming from the right walks through the whole line
    split = docs.select(*KEY, F.posexplode(F.split("text", "\n")).alias("line_no", "body")).filter(F.ltrim("body", F.lit(BLANKS)) != "")
    body, address, digit, line = F.col("body"), F.col("address"), F.col("digit"), F.col("line")
    marked = split.select(*KEY, "line_no", "body", has_address(body).alias("address"), has_digit(body).alias("digit"))
    cut = marked.select(*KEY, "line_no", "body", (address | digit).alias("varies"), masked(body, address, digit).alias("line"))
    cut = cut.select(*KEY, "line_no", "body", "varies", one_spaced(line).alias("line"))
    # the words are counted inside the branch: beside an "and", they would be for every line
    toks = F.split(line, " ")
    words = F.size(F.filter(toks, word))
    by_text = F.when(F.col("varies"), ~((words >= 2) & (2 * words >= F.size(toks))))
    cut = cut.select(*KEY, "line_no", "line", F.when(by_text, one_spaced(body)).alias("plain"))
    n = parts(line, " ")
    known = F.col("plain").isNull()
    cut = cut.select(*KEY, "line_no", "plain", "line", n.alias("n"))
    return cut.select(
        *KEY, "line_no", (F.col("n") >= long_line).alias("long"),
        F.when(known, F.xxhash64("n", F.substring_index(line, " ", depth))).otherwise(F.xxhash64(F.lit(-1), "plain")).alias("leaf"),
        named(known, F.coalesce("plain", "line")).alias("line"),
    )


def enough_docs(min_docs: int, long_docs: int) -> Column:
    """In how many documents a line must stand."""
    return F.when(F.col("long"), F.lit(long_docs)).otherwise(F.lit(min_docs))


def words_of(toks: Column) -> Column:
    """The words among the tokens, as (at, tok): place and hash. Each token is looked at once."""
    marked = F.transform(toks, lambda t, k: F.when(word(t), F.struct(k.alias("at"), F.xxhash64(t).alias("tok"))))
    return F.filter(marked, lambda x: x.isNotNull())


def steady_templates(looked: DataFrame, constant_share: float) -> DataFrame:
    """(line, template) of the lines (leaf, line, docs, least, words) whose template is constant enough.

    A line's cluster is about as large as the count of its k-th most seen word, where k words are enough
    to be constant. Its words in more than half as many documents are the template, by place and hash."""
    placed = looked.select("leaf", "line", "docs", "least", F.size("words").alias("n"), F.explode("words").alias("w")).select("leaf", "line", "docs", "least", "n", "w.*")
    steady = placed.groupBy("leaf", "at", "tok", "least").agg(F.sum("docs").alias("seen")).filter(F.col("seen") >= F.col("least")).drop("least")
    kept = placed.join(steady, ["leaf", "at", "tok"]).groupBy("leaf", "line", "n")
    kept = kept.agg(F.array_sort(F.collect_list(F.struct("seen", "at", "tok"))).alias("kept"))
    enough = F.ceil(F.col("n") * F.lit(constant_share)).cast("int")
    kept = kept.filter(F.size("kept") >= enough).withColumn("cluster", F.element_at("kept", -enough)["seen"])
    template = F.filter("kept", lambda t: t["seen"] * 2 > F.col("cluster"))
    template = F.array_sort(F.transform(template, lambda t: F.struct(t["at"].alias("at"), t["tok"].alias("tok"))))
    return kept.select("line", named("leaf", template).alias("template"))


def recurring_lines(docs: DataFrame, min_docs: int, long_docs: int, long_line: int, depth: int, least_words: int, constant_share: float) -> DataFrame:
    """(key, line_no, template, docs, first): every line of a recurring template of the keyed ``docs``;
    ``first`` marks the line that stays."""
    lines = written(lines_of(docs, depth, long_line), "lines")
    # a document counts once for a line, and partial sums come before any shuffle
    in_docs = lines.groupBy("leaf", "line", "long", *KEY).agg(F.min("line_no").alias("line_no"))
    by_line = in_docs.groupBy("leaf", "line", "long").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct(*KEY, "line_no")).alias("at"))
    by_line = written(by_line, "distinct-lines")
    # a leaf matters only if its lines stand in enough documents together
    least = enough_docs(min_docs, long_docs)
    leaves = by_line.groupBy("leaf").agg(F.sum("docs").alias("in_leaf"), F.count(F.lit(1)).alias("kinds"))
    cand = by_line.join(leaves, "leaf").withColumn("least", least).filter(F.col("in_leaf") >= F.col("least"))
    cand = written(cand.select("leaf", "line", "docs", "at", "kinds", "least"), "candidate-lines")
    # a line alone in its leaf is its own template; the others need their tokens, from one document that has the line
    mixed = cand.filter("kinds > 1").select("at.*", "leaf", "line", "docs", "least")
    wanted = mixed.groupBy(*KEY).agg(F.collect_list(F.struct("line_no", "leaf", "line", "docs", "least")).alias("wanted"))
    bodies = docs.select(*KEY, F.split("text", "\n").alias("bodies"))
    looked = bodies.join(wanted, same_row(bodies, wanted)).select("bodies", F.explode("wanted").alias("w"))
    looked = looked.select("w.leaf", "w.line", "w.docs", "w.least", words_of(tokens(F.get("bodies", F.col("w.line_no")))).alias("words"))
    looked = written(looked.filter(F.size("words") >= least_words).dropDuplicates(["line"]), "line-words")
    steady = written(steady_templates(looked, constant_share), "line-templates")
    own = cand.select("line", named("line").alias("own"))
    names = written(own.join(steady, "line", "left").select("line", F.coalesce("template", "own").alias("template")), "named-lines")
    met = written(lines.join(names, "line").select(*KEY, "line_no", "long", "template"), "template-lines")
    stats = met.groupBy("template", "long", *KEY).agg(F.min("line_no").alias("line_no"))
    stats = stats.groupBy("template", "long").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct(*KEY, "line_no")).alias("at"))
    # written, so that the join below has two plain sides and a frequent template can be split
    stats = written(stats.filter(F.col("docs") >= least).drop("long"), "template-stats")
    return met.join(stats, "template").select(*KEY, "line_no", "template", "docs", (F.struct(*KEY, "line_no") == F.col("at")).alias("first"))


def _cleaned(
    docs: DataFrame, id_col: str, text_col: str, min_docs: int = 3, long_docs: int = 2, long_line: int = 20, depth: int = 3,
    least_words: int = 8, constant_share: float = 0.8,
) -> DataFrame:
    """row, text, n_lines, n_dropped; no column of ``docs`` has a name of its own here."""
    rows = keyed(docs, id_col, text_col)
    found = recurring_lines(rows.select(*KEY, "text"), min_docs, long_docs, long_line, depth, least_words, constant_share).filter(~F.col("first"))
    drops = written(found.groupBy(*KEY).agg(F.collect_set("line_no").alias("drops")), "dropped-lines")
    joined = rows.join(drops, same_row(rows, drops), "left")
    left = F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains("drops", k))
    n_lines = parts(F.col("text"), "\n")
    return joined.select(
        "row", F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), F.lit(0)).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
    )


def _columns(docs: DataFrame, text_col: str) -> list[Column]:
    return [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the recurring lines taken out of the text, and n_lines, n_dropped (long).

    Options and their defaults: min_docs 3, long_docs 2, long_line 20, depth 3, least_words 8,
    constant_share 0.8 (see the module). Kept lines stand in their order, joined by line feeds. Lines without
    a token are never dropped. Defined results: a null text stays null and has no lines; a null id is a
    document of its own for each text and counts as the first; rows alike in id and text count as one
    document and are treated alike; an empty table gives an empty result; other columns are passed on,
    whatever their names, but a table that has n_lines or n_dropped is refused (ValueError)."""
    if clash := {"n_lines", "n_dropped"} & set(docs.columns):
        raise ValueError(f"the result has columns of its own named {sorted(clash)}")
    return _cleaned(docs, id_col, text_col, **options).select(*_columns(docs, text_col), "n_lines", "n_dropped")


def without_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without their recurring lines, same columns; a document of which nothing but blank lines is left goes.

    Options and defined results as in ``drop_recurring``; any column names are taken."""
    cleaned = _cleaned(docs, id_col, text_col, **options)
    left = cleaned.filter((F.col("n_dropped") == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    return left.select(*_columns(docs, text_col))
