"""Text and Markdown expressions (T1-T8, U7) with Python string semantics.

Spark's ``trim`` removes only U+0020 and ``split`` keeps a final empty element, while the
service strips all Unicode whitespace and splits like ``str.splitlines``. Every job goes
through the helpers here so the two never drift apart. The patterns use ``\\x{..}`` escapes,
which both Java regular expressions and RE2 (the DuckDB oracle) accept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes of Python's str.isspace() and str.splitlines().
WS = r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_BREAK = r"\r\n|[\n\x{0B}\x{0C}\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
# whitespace that is not a line break (what rstrip() removes inside one line)
INLINE_WS = r"[\t\x{1F} \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``."""
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+\z", "")


def py_rstrip(c) -> Column:
    """``str.rstrip()``."""
    return F.regexp_replace(col(c), rf"{WS}+\z", "")


def py_lstrip(c) -> Column:
    return F.regexp_replace(col(c), rf"^{WS}+", "")


def splitlines(c) -> Column:
    """``str.splitlines()``: no final empty element, ``[]`` for the empty string."""
    c = col(c)
    body = F.regexp_replace(c, rf"(?:{LINE_BREAK})\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK, -1))


def join_lines(c) -> Column:
    """``"\\n".join(s.splitlines())`` as one regular expression."""
    c = col(c)
    return F.regexp_replace(F.regexp_replace(c, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK, "\n")


def _rstrip_each_line(c: Column) -> Column:
    # lines are LF-separated here; drop inline whitespace before each LF and at the end
    return F.regexp_replace(c, rf"{INLINE_WS}+(?=\n|\z)", "")


def postprocess_markdown(c) -> Column:
    """Code markers to fences, rstrip lines, drop outer blank lines, collapse blank runs,
    exactly one final newline (``"\\n"`` when nothing is left)."""
    s = F.replace(F.replace(col(c), F.lit("[code]"), F.lit("```\n")), F.lit("[/code]"), F.lit("\n```"))
    s = F.regexp_replace(s, LINE_BREAK, "\n")
    s = _rstrip_each_line(s)
    s = F.regexp_replace(s, r"^\n+|\n+\z", "")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    return F.concat(s, F.lit("\n"))


def normalize_markdown(c, final_newline: bool = True) -> Column:
    """T1 (``final_newline=True``, import path) and T3 (``False``): collapse 3+ LF to 2,
    then rstrip each line, strip the whole; empty input gives ``''``."""
    c = col(c)
    s = F.regexp_replace(c, r"\n{3,}", "\n\n")
    s = join_lines(s)
    s = _rstrip_each_line(s)
    s = py_strip(s)
    if final_newline:
        s = F.concat(s, F.lit("\n"))
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(s)


def text_chars(c) -> Column:
    """T4: length of the stripped Markdown, as a 32-bit integer."""
    return F.length(py_strip(c)).cast("int")


def nonempty(c) -> Column:
    """``value or None``: NULL for NULL and for the empty string (for ``coalesce`` fall-backs, T5)."""
    c = col(c)
    return F.when(c != "", c)


def first_nonempty(*cols) -> Column:
    """T5: ``a or b or c``."""
    return F.coalesce(*[nonempty(x) for x in cols])


def decode_utf8(c) -> Column:
    """Bytes to text, bad sequences replaced by U+FFFD."""
    return F.make_valid_utf8(col(c).cast("string"))


def file_name(c) -> Column:
    return F.regexp_extract(col(c), r"([^/]*)\z", 1)


def extension(c) -> Column:
    """``Path(name).suffix.lower()`` (``.bashrc`` has none)."""
    return F.lower(F.regexp_extract(file_name(c), r"^.+(\.[^.]+)\z", 1))


def slugify(c, empty: str = "page") -> Column:
    """Lower, runs of non ``[a-z0-9]`` to ``-``, trim ``-``; empty gives ``empty``."""
    s = F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", "-")
    s = F.regexp_replace(s, r"^-+|-+\z", "")
    return F.coalesce(nonempty(s), F.lit(empty))
