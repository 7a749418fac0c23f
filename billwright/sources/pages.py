"""Stored web pages to flat element rows.

One Arrow-batched pass reads the markup; everything after it is DataFrame code. Elements are numbered in the order
of their start tags, and each carries the number of the last element inside it, so what lies
inside an element is an interval. A page is fed to the parser piece by piece and its closed elements leave in frames of bounded
size while the parser goes on, so a task never holds all elements of a page, let alone of a batch.
"""

import re
from functools import partial
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F

ELEMENTS = (
    "page_id bigint, url string, node int, last int, parent int, tag string, attrs map<string,string>, "
    "classes array<string>, ancestors array<int>, in_nav boolean, in_pager boolean, "
    "in_submenu boolean, text string, text_len int"
)
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("node", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("classes", pa.list_(pa.string())), ("ancestors", pa.list_(pa.int32())),
    ("in_nav", pa.bool_()), ("in_pager", pa.bool_()), ("in_submenu", pa.bool_()), ("text", pa.string()), ("text_len", pa.int32()),
])
#: Characters fed to the parser at once; elements and characters of one output frame.
PIECE, FRAME_ROWS, FRAME_SIZE = 1 << 16, 5_000, 8 << 20

# Markup facts
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "nav", "main"}
_TEXT_TAGS = {
    "title", "h1", "h2", "h3", "h4", "h5", "h6", "a", "p", "li", "span", "b", "strong", "em", "td",
    "th", "dt", "dd", "button", "label", "figcaption", "small", "script",
}
_TEXT_NAMES = re.compile(r"title|name|heading|desc|content|detail|attribute|info", re.I)
_NAV_NAMES = re.compile(r"menu|nav|sidebar", re.I)
_AMPERSAND = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
_SUBMENU = {"sub-menu", "dropdown-menu", "dropdown"}


def _wants_text(tag, attrs):
    if tag == "script":
        return "ld+json" in attrs.get("type", "")
    return tag in _TEXT_TAGS or bool(_TEXT_NAMES.search(" ".join((attrs.get("class", ""), attrs.get("id", ""), attrs.get("itemprop", "")))))


class _Element:
    """An open element: its place, its text if anyone asks for it, and the length of its stripped text."""

    __slots__ = ("node", "last", "parent", "tag", "attrs", "classes", "ancestors", "flags", "parts", "size", "tail")

    def __init__(self, node, above, tag, attrs):
        self.node, self.last, self.tag, self.attrs = node, node, tag, attrs
        self.parent = above.node if above else -1
        self.ancestors = [*above.ancestors, above.node] if above else []
        self.classes = attrs.get("class", "").split()
        own = (
            tag in ("nav", "header") or bool(_NAV_NAMES.search(attrs.get("class", ""))),
            bool({"pagination", "pager"} & set(self.classes)),
            bool(_SUBMENU & set(self.classes)),
        )
        self.flags = tuple(a or b for a, b in zip(above.flags, own, strict=True)) if above else own
        self.parts = [] if _wants_text(tag, attrs) else None
        self.size = self.tail = 0

    def add(self, data):
        if self.parts is not None:
            self.parts.append(data)
        if not self.size:
            data = data.lstrip()
        core = data.rstrip()
        if core:
            self.size += self.tail + len(core)
            self.tail = len(data) - len(core)
        elif self.size:
            self.tail += len(data)


class _Reader(HTMLParser):
    """Open elements on a stack; closed ones wait in a list until the caller takes them."""

    def __init__(self, ampersand="&"):
        super().__init__(convert_charrefs=True)
        self.stack, self.closed, self.count, self.ampersand = [], [], 0, ampersand

    def handle_starttag(self, tag, attrs):
        self._close_implied(tag)
        row = _Element(self.count, self.stack[-1] if self.stack else None, tag, {k: (v or "").replace(self.ampersand, "&") for k, v in attrs})
        self.count += 1
        if tag in _VOID:
            self.closed.append(row)
        else:
            self.stack.append(row)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self._leave(i)
                return

    def handle_data(self, data):
        data = data.replace(self.ampersand, "&")
        if self.stack and self.stack[-1].tag in ("script", "style"):
            self.stack[-1].add(data)
            return
        for row in self.stack:
            row.add(data)

    def _leave(self, i):
        for row in self.stack[i:]:
            row.last = self.count - 1
        self.closed += self.stack[i:]
        del self.stack[i:]

    def _close_implied(self, tag):
        if tag != "li" and tag not in _BLOCK:
            return
        tags = [r.tag for r in self.stack]
        if tag == "li" and "li" in tags:
            last = len(tags) - 1 - tags[::-1].index("li")
            if not {"ul", "ol"} & set(tags[last:]):
                self._leave(last)
        elif tag in _BLOCK and "p" in tags:
            last = len(tags) - 1 - tags[::-1].index("p")
            if not {"div", "article", "section", "td", "li", "button"} & set(tags[last:]):
                self._leave(last)

    def taken(self):
        out, self.closed = self.closed, []
        return out


def _read(html, piece=PIECE, closed_references=False):
    """Lists of closed elements, as the parser gets on."""
    reader = _Reader()
    if closed_references:
        # Every other ampersand passes the parser as a character that the page does not hold.
        stand_in = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in html)
        reader, html = _Reader(stand_in), _AMPERSAND.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else stand_in + m[0][1:], html)
    for at in range(0, len(html), piece):
        reader.feed(html[at : at + piece])
        yield reader.taken()
    reader.close()
    reader._leave(0)
    yield reader.taken()


def _frame(rows):
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _parse_batches(batches, closed_references=False):
    held, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            page_id, url, html = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html"))
            for closed in _read(html or "", closed_references=closed_references):
                for e in closed:
                    text = "".join(e.parts) if e.parts is not None else None
                    held.append((page_id, url, e.node, e.last, e.parent, e.tag, list(e.attrs.items()), e.classes, e.ancestors, *e.flags, text, e.size))
                    size += len(text or "") + 4 * len(e.ancestors)
                    if len(held) >= FRAME_ROWS or size >= FRAME_SIZE:
                        yield _frame(held)
                        held, size = [], 0
    if held:
        yield _frame(held)


def read_pages(spark, path):
    return spark.read.parquet(path).select("page_id", "url", "html")


def page_elements(pages, closed_references=False):
    """Element rows of every page. With ``closed_references`` a character reference counts only with its semicolon, so the stub of a cut one stays text."""
    parse = partial(_parse_batches, closed_references=closed_references)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(parse, ELEMENTS)
