"""Document import.

Input is a file table ``files(path, content binary)`` as ``spark.read.format("binaryFile")``
gives it. Dispatch is a CASE on the lower-cased extension (S17: a registry maps extensions to
``DataFrame -> DataFrame`` readers):

* .txt / .md and unknown extensions: T7 decode with replacement, T1 normalise (S4);
* .html / .htm: the node table with the import profile (noise tags only, selectors, body) (S5);
* .eml: one message (S6); .mbox: messages split at lines starting ``From `` with a running
  count per file, index from 1 (S7);
* MIME parts of every message come from one ``mapInPandas`` over the standard library's email
  parser (modern policy); the body is the first text/plain or text/html part in walk order that
  is not an attachment (P15, O6), picked with ``min_by``; headers are plain columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import decode_utf8, extension, file_name, first_nonempty, normalize_markdown
from pagemill.operators import extract as X
from pagemill.session import cut_lineage, spread
from pagemill.sources.html_nodes import html_nodes

DOC_SCHEMA = "doc_no long, source string, url string, title string, body_markdown string, meta map<string,string>"
PART_SCHEMA = (
    "msg_id long, part_no int, subject string, from_ string, to_ string, date string, "
    "content_type string, disposition string, text string"
)


def doc_key(file_no: str):
    """First key of a file's documents. A file is one string of less than 2**31 bytes, so it has fewer messages than that."""
    return F.shiftleft(F.col(file_no).cast("long"), 31)


# ------------------------------------------------------------------ MIME parts (the Python step)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from email import policy
    from email.parser import Parser

    for pdf in batches:
        out = []
        for mid, raw in zip(pdf["msg_id"].tolist(), pdf["raw"].tolist()):
            msg = Parser(policy=policy.default).parsestr(raw or "")

            def h(name):
                v = msg.get(name)
                return None if v is None else str(v)

            head = [h("Subject"), h("From"), h("To"), h("Date")]
            parts = list(msg.walk()) if msg.is_multipart() else [msg]
            for i, part in enumerate(parts):
                ctype = part.get_content_type()
                text = None
                if ctype in ("text/plain", "text/html"):
                    try:
                        text = part.get_content()
                    except Exception:  # noqa: BLE001 - undecodable part: no text
                        payload = part.get_payload(decode=True) or b""
                        text = payload.decode("utf-8", errors="replace")
                out.append([mid, i, *head, ctype, part.get_content_disposition(), text])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PART_SCHEMA.split(", ")])


def message_parts(messages: DataFrame) -> DataFrame:
    """(msg_id, part_no, headers..., content_type, disposition, text) per MIME part, written once
    to the checkpoint folder so the header, body and HTML branches do not re-run the parser."""
    raw = spread(messages.select(F.col("msg_id").cast("long"), F.col("raw")))
    return cut_lineage(raw.mapInPandas(_parts, PART_SCHEMA))


def _html_to_markdown(parts: DataFrame) -> DataFrame:
    """text/html parts -> Markdown with links kept (import profile, whole document)."""
    html = parts.where(F.col("content_type") == "text/html").select(F.col("msg_id").alias("page_id"), F.col("text").alias("html"))
    nodes = cut_lineage(X.with_removed(html_nodes(html), "import"))  # tokenised once
    area = nodes.select("page_id").distinct().withColumn("container_n", F.lit(-1))
    md = X.markdown(nodes, area, strip_links=False, strip_images=True, mark_code=False)
    return md.select(F.col("page_id").alias("msg_id"), F.col("markdown").alias("html_md"))


def email_documents(messages: DataFrame) -> DataFrame:
    """S6 / S7 assembly: messages(msg_id, source, fallback_title, meta) -> documents."""
    parts = message_parts(messages)
    body_part = parts.where(F.col("content_type").isin("text/plain", "text/html") & ~F.coalesce(F.col("disposition") == "attachment", F.lit(False)))
    first = body_part.groupBy("msg_id").agg(F.min_by(F.struct("content_type", "text"), "part_no").alias("b"))  # O6
    heads = parts.where(F.col("part_no") == 0).select("msg_id", "subject", "from_", "to_", "date")
    html_md = _html_to_markdown(first.select("msg_id", F.col("b.content_type").alias("content_type"), F.col("b.text").alias("text")))
    m = messages.join(heads, "msg_id", "left").join(first, "msg_id", "left").join(html_md, "msg_id", "left")
    body = F.when(F.col("b.content_type") == "text/html", normalize_markdown(F.coalesce("html_md", F.lit("")))).otherwise(
        normalize_markdown(F.coalesce(F.col("b.text"), F.lit("")))
    )
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("**From:** "), F.coalesce("from_", F.lit("Unknown"))),
        F.concat(F.lit("**To:** "), F.coalesce("to_", F.lit("Unknown"))),
        F.when(F.coalesce(F.col("date"), F.lit("")) != "", F.concat(F.lit("**Date:** "), F.col("date"))),
        F.lit(""),
        body,
    )
    return m.select(
        "doc_no",
        "source",
        F.lit(None).cast("string").alias("url"),
        F.coalesce(first_nonempty("subject"), F.col("fallback_title")).alias("title"),
        normalize_markdown(lines).alias("body_markdown"),
        "meta",
    )


def mbox_messages(files: DataFrame) -> DataFrame:
    """Split each .mbox file into messages: (msg_id, source, fallback_title, meta, raw)."""
    lines = files.select("file_no", "path", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("ln", "line"))
    w = Window.partitionBy("file_no").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("idx", F.sum(F.when(F.col("line").startswith("From "), 1).otherwise(0)).over(w))
    # the separator opens its message, so a message that has nothing else is still one
    body = F.when(~F.col("line").startswith("From "), F.struct("ln", "line"))
    msgs = lines.where(F.col("idx") > 0).groupBy("file_no", "path", "idx").agg(F.array_sort(F.collect_list(body)).alias("ls"))
    name = file_name("path")
    return msgs.select(
        (doc_key("file_no") + F.col("idx")).alias("msg_id"),
        F.concat(name, F.lit("#"), F.col("idx").cast("string")).alias("source"),
        F.concat(F.lit("Message "), F.col("idx").cast("string")).alias("fallback_title"),
        F.create_map(F.lit("type"), F.lit("email"), F.lit("mbox_source"), name, F.lit("index"), F.col("idx").cast("string")).alias("meta"),
        F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("raw"),
        F.col("file_no"),
        F.col("idx"),
    )


# ------------------------------------------------------------------ readers per extension


def _text_docs(files: DataFrame) -> DataFrame:
    name = file_name("path")
    known = F.col("ext").isin(".txt", ".md")
    meta = F.when(known, F.create_map(F.lit("type"), F.lit("text"))).otherwise(
        F.create_map(F.lit("type"), F.lit("text"), F.lit("note"), F.lit("Unknown extension treated as text"))
    )
    return files.select(
        doc_key("file_no").alias("doc_no"),
        F.coalesce(F.when(name != "", name), F.when(known, F.lit("text")).otherwise(F.lit("file"))).alias("source"),
        F.lit(None).cast("string").alias("url"),
        F.coalesce(F.when(name != "", name), F.when(known, F.lit("Text document")).otherwise(F.lit("Uploaded file"))).alias("title"),
        normalize_markdown("text").alias("body_markdown"),
        meta.alias("meta"),
    )


def _html_docs(files: DataFrame) -> DataFrame:
    """Noise tags removed, selectors then body then the whole document, title or file name."""
    name = F.coalesce(F.when(file_name("path") != "", file_name("path")), F.lit("HTML page"))
    src = files.select(F.col("file_no").alias("page_id"), F.col("text").alias("html"))
    nodes = cut_lineage(X.with_removed(html_nodes(src), "import"))  # tokenised once
    area = X.content_area(nodes, "import", readability=False)
    md = X.markdown(nodes, area, strip_links=True, strip_images=True, mark_code=False)
    title = X.titles(nodes)
    df = files.join(md.withColumnRenamed("page_id", "file_no"), "file_no", "left").join(title.withColumnRenamed("page_id", "file_no"), "file_no", "left")
    return df.select(
        doc_key("file_no").alias("doc_no"),
        name.alias("source"),
        F.lit(None).cast("string").alias("url"),
        F.coalesce(first_nonempty("title"), name).alias("title"),
        normalize_markdown(F.coalesce("markdown", F.lit(""))).alias("body_markdown"),
        F.create_map(F.lit("type"), F.lit("html")).alias("meta"),
    )


def _eml_messages(files: DataFrame) -> DataFrame:
    name = F.coalesce(F.when(file_name("path") != "", file_name("path")), F.lit("email"))
    return files.select(
        doc_key("file_no").alias("msg_id"),
        name.alias("source"),
        name.alias("fallback_title"),
        F.create_map(F.lit("type"), F.lit("email")).alias("meta"),
        F.col("text").alias("raw"),
    )


def _mail_docs(files: DataFrame) -> DataFrame:
    """S6 + S7 together: one pass of the MIME reader over single messages and mailboxes."""
    boxes = mbox_messages(files.where(F.col("ext") == ".mbox")).drop("file_no", "idx")
    single = _eml_messages(files.where(F.col("ext") != ".mbox"))
    return email_documents(single.unionByName(boxes).withColumn("doc_no", F.col("msg_id")))


Reader = Callable[[DataFrame], DataFrame]
#: kind -> (extensions, reader); a kind is one branch of the plan. Other extensions are text.
READERS: dict[str, tuple[tuple[str, ...], Reader]] = {"html": ((".html", ".htm"), _html_docs), "mail": ((".eml", ".mbox"), _mail_docs)}


def register_reader(kind: str, extensions: tuple[str, ...], fn: Reader) -> None:
    """S17 extension point: a reader is ``files(file_no, path, ext, text) -> documents``."""
    READERS[kind] = (tuple(e.lower() for e in extensions), fn)


def import_documents(files: DataFrame, file_order: str | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """files(path, content[, order]) -> documents(doc_no, source, url, title, body_markdown, meta).

    ``doc_no`` orders documents as the service lists them (file order, then message index). ``kinds``
    names the kinds of files there are ("text" and those of ``READERS``); the plan then has no branch for
    the others, and files of other kinds are left out."""
    if file_order:
        f = files.select("path", "content", F.col(file_order).cast("long").alias("file_no"))
    else:  # files in path order; a distributed dense rank, no one-partition window
        from pagemill.plans.crawl import dense_rank_by

        f = dense_rank_by(files.select("path", "content"), "path", "file_no", 1)
    f = spread(f).select("file_no", "path", extension("path").alias("ext"), decode_utf8("content").alias("text"))
    known = [e for exts, _ in READERS.values() for e in exts]
    branches = []
    if kinds is None or "text" in kinds:
        branches.append(_text_docs(f.where(~F.col("ext").isin(*known))))
    for kind, (exts, read) in READERS.items():
        if kinds is None or kind in kinds:
            branches.append(read(f.where(F.col("ext").isin(*exts))))
    docs = branches[0]
    for more in branches[1:]:
        docs = docs.unionByName(more)
    return docs


# ------------------------------------------------------------------ exports


def import_combined_parts(docs: DataFrame) -> DataFrame:
    """S13 before the final T1 (``import_combined`` has it): per document ``# title-or-source``, optional ``_Source_: url``, blank,
    stripped body, blank; (doc_no, text) parts joined by newlines in doc order."""
    from pagemill.functions.text import py_strip

    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), first_nonempty("title", "source")),
        F.when(F.coalesce(F.col("url"), F.lit("")) != "", F.concat(F.lit("_Source_: "), F.col("url"))),
        F.lit(""),
        py_strip(F.coalesce("body_markdown", F.lit(""))),
        F.lit(""),
    )
    return docs.select("doc_no", text.alias("text"))


def import_combined(docs: DataFrame) -> DataFrame:
    """S13 with its T1: (doc_no, text) parts whose plain concatenation in ``doc_no`` order is the document.

    T1 works part by part: a part starts with ``#`` and ends in blank lines, of which the whole keeps one, so
    nothing is collapsed or stripped across a border but these. No document gives no part (an empty text)."""
    parts = import_combined_parts(docs)
    first = parts.agg(F.min("doc_no")).scalar()
    return parts.select("doc_no", F.concat(F.when(F.col("doc_no") == first, F.lit("")).otherwise(F.lit("\n")), normalize_markdown("text")).alias("text"))


def import_bundle(docs: DataFrame) -> DataFrame:
    """S14 files: (doc_no, i, filename, content) per document; slug of title or source or doc-i,
    T1 on each body. ``i`` (from 1) comes from a distributed dense rank."""
    from pagemill.functions.text import slugify
    from pagemill.plans.crawl import dense_rank_by

    d = dense_rank_by(docs, "doc_no", "i", 1)
    fname = F.concat(slugify(F.coalesce(first_nonempty("title", "source"), F.concat(F.lit("doc-"), F.col("i").cast("string"))), "document"), F.lit(".md"))
    d = d.withColumn("filename", fname)
    return d.select("doc_no", "i", "filename", normalize_markdown("body_markdown").alias("content"), "title")


def import_index_lines(bundle: DataFrame) -> DataFrame:
    """S14 index.md as ordered lines (i, line): '# Imported documents', blank, '- [title](file)'.
    The file is T1 of the lines joined by newlines."""
    head = bundle.sparkSession.createDataFrame([(-1, "# Imported documents"), (0, "")], "i long, line string")
    entries = bundle.select(
        F.col("i").cast("long").alias("i"),
        F.concat(F.lit("- ["), F.coalesce(first_nonempty("title"), F.col("filename")), F.lit("]("), F.col("filename"), F.lit(")")).alias("line"),
    )
    return head.unionByName(entries)
