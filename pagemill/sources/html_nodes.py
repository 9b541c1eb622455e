"""HTML -> node table: the one Python step of the HTML jobs (one ``mapInArrow`` pass).

Each page is tokenised once with the standard library's ``html.parser`` and emitted as rows,
one per element and one per text run, in document order. Every row carries its ancestors'
numbers, tags, ids and classes, so every later decision (noise removal, title, main area,
largest div, links, Markdown blocks) is a row-local expression or a ``groupBy(page_id)``.

Tree rules (stdlib events are not a tree): void elements never open, a start tag opens, an
end tag closes up to the most recent open element with that name and is ignored when none is
open, everything still open closes at the end; adjacent text runs merge, comments and
declarations are dropped, entities are decoded.

A worker holds one page's nodes and one output batch of about ``BATCH_BYTES``: a node's ancestors are
written out only as it goes into the batch, so neither the number of pages nor their depth adds memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements that never have content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

NODE_SCHEMA = (
    "page_id long, n int, kind string, tag string, parent int, depth int, "
    "anc_n array<int>, anc_tag array<string>, anc_id array<string>, anc_cls array<string>, "
    "attr_id string, attr_cls string, attr_role string, href string, n_children int, text string, attr_rel string, "
    "li_no int, list_depth int, link string, src string, alt string"
)
#: An output batch ends after about so many bytes; a row counts ROW_BYTES beside its strings and ancestors.
BATCH_BYTES, ROW_BYTES = 4 << 20, 200


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[int] = []  # row indexes of open elements
        self.buf: list[str] = []
        self.items: dict[int, int] = {}  # open list element -> items so far

    # -- helpers
    def _place(self, tag: str | None = None):
        """Number of the list item a node stands in (0 in a bullet list, null outside), how many lists
        enclose it, and the target of the link around it."""
        rows = self.rows
        lists = [i for i in self.stack if rows[i][3] in ("ul", "ol")]
        inside = tag == "li" or any(rows[i][3] == "li" for i in self.stack)
        li_no = None
        if lists and inside:
            li_no = self.items.get(lists[-1], 0) if rows[lists[-1]][3] == "ol" else 0
        link = next((rows[i][13] for i in reversed(self.stack) if rows[i][3] == "a"), None)
        return [li_no, len(lists), link]

    def _child(self) -> int:
        if self.stack:
            self.rows[self.stack[-1]][14] += 1
            return self.rows[self.stack[-1]][1]
        return -1

    def _flush(self) -> None:
        if not self.buf:
            return
        text = "".join(self.buf)
        self.buf = []
        parent = self._child()
        self.rows.append([None, len(self.rows), "t", None, parent, len(self.stack), None, None, None, None, None, None, None, None, 0, text, None, *self._place(), None, None])

    # -- events
    def handle_starttag(self, tag, attrs):
        self._flush()
        a = {}
        for k, v in attrs:
            a.setdefault(k, "" if v is None else v)
        parent = self._child()
        idx = len(self.rows)
        if tag == "li":
            top = next((i for i in reversed(self.stack) if self.rows[i][3] in ("ul", "ol")), None)
            if top is not None:
                self.items[top] = self.items.get(top, 0) + 1
        self.rows.append(
            [None, idx, "e", tag, parent, len(self.stack), None, None, None, None, a.get("id"), a.get("class"), a.get("role"), a.get("href"), 0, None,
             a.get("rel"), *self._place(tag), a.get("src"), a.get("alt")]
        )
        if tag not in VOID:
            self.stack.append(idx)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.rows[self.stack[-1]][3] == tag:
            self.stack.pop()

    def handle_endtag(self, tag):
        self._flush()
        for pos in range(len(self.stack) - 1, -1, -1):
            if self.rows[self.stack[pos]][3] == tag:
                del self.stack[pos:]
                break

    def handle_data(self, data):
        self.buf.append(data)

    def close(self):
        super().close()
        self._flush()


def parse_html(html: str | None) -> list[list]:
    """The rows of a page, without its id and their ancestors (``with_ancestors`` adds those)."""
    t = _Tree()
    try:
        t.feed(html or "")
        t.close()
    except Exception:  # noqa: BLE001 - malformed markup: keep what was read
        t._flush()
    return t.rows


def with_ancestors(rows: list[list], page_id: int | None) -> Iterator[tuple[list, int]]:
    """Each row with its page's id and its ancestors, one at a time, and the bytes it takes.

    Rows are in document order, so the ancestors of a row of depth k are the first k elements of the path so far."""
    path: list[list] = []
    total = [0]  # bytes of the path's first k elements
    for r in rows:
        depth = r[5]
        del path[depth:], total[depth + 1 :]
        anc = [[x[c] for x in path] for c in (1, 3, 10, 11)]
        yield [page_id, *r[1:6], *anc, *r[10:]], ROW_BYTES + total[-1] + sum(len(r[c]) for c in (10, 11, 12, 13, 15, 16, 19, 20, 21) if r[c])
        if r[2] == "e":
            path.append(r)
            total.append(total[-1] + 32 + len(r[3]) + len(r[10] or "") + len(r[11] or ""))


_COLS = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}
_TYPES = [_ARROW[x.split()[1]] for x in NODE_SCHEMA.split(", ")]


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_COLS)


def _tokenize_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list] = []
    size = 0
    for batch in batches:
        for pid, html in zip(batch.column("page_id"), batch.column("html")):
            for row, taken in with_ancestors(parse_html(html.as_py()), pid.as_py()):
                held.append(row)
                size += taken
                if size >= BATCH_BYTES:
                    yield _batch(held)
                    held, size = [], 0
    if held:
        yield _batch(held)


def html_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, n, kind 'e'|'t', tag, parent, depth, ancestors..., attributes, n_children, text)."""
    from pagemill.session import spread

    src = spread(pages.select(pages[id_col].cast("long").alias("page_id"), pages[html_col].alias("html")))
    return src.mapInArrow(_tokenize_batches, NODE_SCHEMA)
