"""Visible text of HTML pages, laid out as a reader sees it.

A tree builder supplies the end tags that HTML lets authors leave out; the renderer
walks the tree without recursion, leaves out what a browser would not show, and
keeps the text of formulas and the labels of drawings, block spacing, list markers with nesting, preformatted text, and table cells
aligned in columns.

Defined results: null and empty html give an empty text; malformed markup is
repaired, never refused; text of very long or deeply nested pages is kept whole;
rows come out one for one, nulls and repeats included, with every column of the input;
an input column named like the output is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import prepare

# fixed values: classes of HTML elements
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table pre figure hr fieldset".split())
BLOCKS = SPACED | set(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html "
    "legend li main menu nav optgroup option search section summary tbody td tfoot th thead tr".split())
HIDDEN = set("head title script style template noscript iframe object embed audio video canvas datalist "
             "noframes noembed param source track meta link base".split())
# elements of SVG and MathML that hold HTML, what is unseen in each, and the HTML start tags that end both
HOLDS_HTML = {"svg": {"foreignobject", "desc", "title"}, "math": {"mi", "mo", "mn", "ms", "mtext", "annotation-xml"}}
UNSEEN = {"svg": set("title desc metadata defs style script symbol clippath mask pattern marker filter lineargradient radialgradient".split()),
          "math": {"annotation", "annotation-xml"}}
BREAKS_OUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol "
                 "p pre ruby s small span strong strike sub sup table tt u ul var".split())
IN_HEAD = set("title script style template noscript meta link base".split())
# start tag: elements it ends, and the elements beyond which it ends nothing
ENDS: dict[str, tuple[set[str], set[str]]] = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"})),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
CELLS = {"td", "th", "caption", "table"}
TABLE_PARTS = {"table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}
HEADINGS = {f"h{i}" for i in range(1, 7)}
ALIGN_TO = 40   # columns wider than this are not padded further

_SPACES = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"\b(display|visibility)\s*:\s*([a-z-]+)", re.I)


def unseen_by(style: str | None) -> str:
    """What a style attribute hides by: display, visibility or nothing; the last declaration of each counts."""
    last = {name.lower(): value.lower() for name, value in _STYLE.findall(style)} if style else {}
    if last.get("display") == "none":
        return "display"
    return "visibility" if last.get("visibility") in ("hidden", "collapse") else ""


class Node:
    __slots__ = ("tag", "attrs", "kids", "space", "drawn")

    def __init__(self, tag: str, attrs: dict[str, str | None], space: str = "", drawn: bool = True):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.space = space   # svg, math or, for HTML, nothing
        self.drawn = drawn   # text right inside is shown: in SVG only that of <text>

    def within(self) -> str:
        """``space`` of what the element holds."""
        return "" if not self.space or self.tag in HOLDS_HTML[self.space] else self.space


class TreeBuilder(HTMLParser):
    """Builds a tree of :class:`Node` and text strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.path, self.open = [self.root], Counter()

    def _pop(self) -> None:
        self.open[self.path.pop().tag] -= 1

    def _end(self, tags: set[str], bounds: set[str]) -> bool:
        """Close up to and with the outermost of ``tags`` inside ``bounds``."""
        if not any(self.open[t] > 0 for t in tags):
            return False
        at = None
        for i in range(len(self.path) - 1, 0, -1):
            tag = self.path[i].tag
            if tag in tags:
                at = i
                if len(tags) == 1:
                    break
            elif tag in bounds:
                break
        if at is None:
            return False
        while len(self.path) > at:
            self._pop()
        return True

    def _foreign(self, tag, attrs, closed: bool) -> None:
        """An element of SVG or MathML; ``closed`` if it ends at once."""
        above = self.path[-1]
        space = above.within() or tag
        drawn = space == "math" or tag in ("text", "foreignobject") or above.space == "svg" and above.within() == "svg" and above.drawn
        node = Node(tag, dict(attrs), space, drawn)
        above.kids.append(node)
        if not closed:
            self.path.append(node)
            self.open[tag] += 1

    def handle_starttag(self, tag, attrs, closed=False):
        if self.path[-1].within():
            if tag not in BREAKS_OUT:
                self._foreign(tag, attrs, closed)
                return
            while self.path[-1].within():
                self._pop()
        if tag in ("html", "body"):
            self._end({"head"}, set())
            for name, value in attrs:
                self.root.attrs.setdefault(name, value)
            return
        if self.open["head"] and tag not in IN_HEAD:
            self._end({"head"}, set())
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in BLOCKS and self.open["p"]:
            self._end({"p"}, CELLS | {"button"})
        if tag in HEADINGS and self.path[-1].tag in HEADINGS:
            self._pop()
        if tag == "table" or not self.open["table"] or tag in TABLE_PARTS or self.path[-1].tag not in ("table", "tr", "tbody", "thead", "tfoot"):
            pass
        elif tag not in ("colgroup", "col", "script", "style", "template", "form", "input"):
            self.handle_starttag("td" if self.path[-1].tag == "tr" else "caption", [])  # stray content in a table
        if tag in ("svg", "math"):
            self._foreign(tag, attrs, closed)
            return
        node = Node(tag, dict(attrs))
        self.path[-1].kids.append(node)
        if tag not in VOID:
            self.path.append(node)
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.handle_starttag("br", [])
        elif not self._end({tag}, {"table"} if tag in TABLE_PARTS - {"table"} else CELLS - {tag}) and tag == "p":
            self.path[-1].kids.append(Node("p", {}))

    # What is never closed runs to the end of the page and shows nothing. All of the page is
    # there from the start, so this is known at once, and no piece is looked through twice.

    def _to_end(self, found: int) -> int:
        return len(self.rawdata) if found < 0 else found

    def parse_starttag(self, i):
        return super().parse_starttag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def parse_endtag(self, i):
        if i + 2 == len(self.rawdata):
            return super().parse_endtag(i)  # "</" at the end is text
        return super().parse_endtag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def parse_comment(self, i, report=1):
        return self._to_end(super().parse_comment(i, report))

    def parse_pi(self, i):
        return self._to_end(super().parse_pi(i))

    def parse_html_declaration(self, i):
        """``<![...>`` is a comment up to the next ``>`` or the end; HTMLParser itself refuses some of them."""
        if not self.rawdata.startswith("<![", i):
            return self._to_end(super().parse_html_declaration(i))
        if self.path[-1].within() and self.rawdata.startswith("<![CDATA[", i):
            end = self.rawdata.find("]]>", i)
            self.handle_data(self.rawdata[i + 9:end if end >= 0 else len(self.rawdata)])
            return end + 3 if end >= 0 else len(self.rawdata)
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def handle_data(self, data):
        if self.open["head"] and self.path[-1].tag == "head" and data.strip():
            self._end({"head"}, set())
        self.path[-1].kids.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html.replace("\x00", ""))
    builder.close()
    return builder.root


def shown(node: Node) -> bool:
    """Whether a browser would show the element."""
    attrs = node.attrs
    if node.space:
        unseen = node.space == "svg" and (attrs.get("display") == "none" or attrs.get("visibility") in ("hidden", "collapse"))
        return not (unseen or unseen_by(attrs.get("style")))
    if node.tag in HIDDEN or "hidden" in attrs:
        return False
    if node.tag == "dialog" and "open" not in attrs:
        return False
    return not unseen_by(attrs.get("style"))


def _own_line(node: Node) -> bool:
    """Labels of a drawing and displayed formulas."""
    return node.space == "svg" and node.tag in ("text", "foreignobject") or node.tag == "math" and node.attrs.get("display") == "block"


class Page:
    """Lines of text with pending spacing; a table cell has a page of its own."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.space = False
        self.pre = 0
        self.indent = ""
        self.marker = ""

    def text(self, data: str) -> None:
        if self.pre:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self._put(first)
            for part in rest:
                self._flush(True)
                self._put(part)
            return
        for k, word in enumerate(_SPACES.split(data)):
            if k:
                self.space = True
            if word:
                if self.space and self.line:
                    self.line.append(" ")
                self.space = False
                self._put(word)

    def _put(self, text: str) -> None:
        if text:
            if not self.line and self.blank and self.lines:
                self.lines.append("")
            self.blank = self.blank and not text
            self.line.append(text)

    def _flush(self, even_empty: bool = False) -> None:
        text = "".join(self.line)
        if text.strip() or even_empty and self.lines:
            first = self.indent[:-len(self.marker)] + self.marker if self.marker else self.indent
            self.lines.append((first + text).rstrip())
            self.marker = ""
        self.line, self.space = [], False

    def end_line(self, blank: bool = False) -> None:
        if self.line:
            self._flush()
        self.space = False
        self.blank = self.blank or blank

    def result(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _aligned(rows: list[list[str]]) -> list[str]:
    widths: dict[int, int] = {}
    for row in rows:
        for k, cell in enumerate(row):
            widths[k] = max(widths.get(k, 0), min(_width(cell), ALIGN_TO))
    return ["  ".join(c + " " * (widths[k] - _width(c)) for k, c in enumerate(row)).rstrip() for row in rows]


class Rows:
    """Cells of a table by row and column; a cell over several rows keeps its column free below."""

    def __init__(self):
        self.rows: list[list[str]] = []
        self.below: dict[int, int] = {}   # column: rows still covered from above
        self.taken: set[int] = set()

    def row(self) -> None:
        self.rows.append([])
        self.taken = set(self.below)
        self.below = {c: n - 1 for c, n in self.below.items() if n > 1}

    def cell(self, text: str, wide: int, high: int) -> None:
        row = self.rows[-1]
        while len(row) in self.taken:
            row.append("")
        if high > 1:
            self.below.update(dict.fromkeys(range(len(row), len(row) + wide), high - 1))
        row += [text] + [""] * (wide - 1)


def _count(text: str | None, most: int) -> int:
    return min(int(text), most) if text and re.fullmatch(r"[0-9]{1,5}", text) else 1


def _whole(text: str | None, otherwise: int) -> int:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,9}", text) else otherwise


def render(root: Node) -> str:
    """Text of everything shown under ``root``."""
    pages, tables, lists = [Page()], [], []

    def enter(node: Node) -> None:
        page, tag = pages[-1], node.tag
        if node.space:
            if _own_line(node):
                page.end_line()
        elif tag == "br":
            if page.line:
                page._flush(True)
            else:
                page.blank = True
        elif tag == "table":
            page.end_line(True)
            tables.append(Rows())
        elif tag == "tr" and tables:
            tables[-1].row()
        elif tag in ("td", "th") and tables:
            if not tables[-1].rows:
                tables[-1].row()
            pages.append(Page())
        elif tag in BLOCKS:
            page.end_line(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu", "dir"):
                back = tag == "ol" and "reversed" in node.attrs
                first = sum(isinstance(k, Node) and k.tag == "li" for k in node.kids) if back else 1
                lists.append([tag == "ol", _whole(node.attrs.get("start"), first), -1 if back else 1])
            elif tag == "li":
                numbered = lists and lists[-1][0]
                if numbered:
                    lists[-1][1] = _whole(node.attrs.get("value"), lists[-1][1])
                page.marker = f"{lists[-1][1]}. " if numbered else "- "
                if numbered:
                    lists[-1][1] += lists[-1][2]
                page.indent += " " * len(page.marker)
                node.attrs["_indent"] = len(page.marker)
            elif tag in ("blockquote", "dd"):
                page.indent += "  "
            elif tag == "pre":
                page.pre += 1
            elif tag == "hr":
                page.blank = True
        elif tag == "textarea":
            page.pre += 1

    def leave(node: Node) -> None:
        page, tag = pages[-1], node.tag
        if node.space:
            if _own_line(node):
                page.end_line()
            elif tag in ("mtd", "mtr") or stack[-1][0].tag == "mfrac":
                page.space = True
        elif tag == "table":
            lines = _aligned([r for r in tables.pop().rows if any(r)])
            for line in lines:
                page._put(line)
                page._flush()
            page.end_line(True)
        elif tag in ("td", "th") and tables:
            text = _SPACES.sub(" ", pages.pop().result())
            high = _count(node.attrs.get("rowspan"), 65534)
            tables[-1].cell(text, max(_count(node.attrs.get("colspan"), 1000), 1), high or 65534)  # 0: down to the end
        elif tag == "tr" and tables:
            pass
        elif tag in BLOCKS:
            page.end_line(tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1))
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif tag == "li":
                page.indent = page.indent[:len(page.indent) - node.attrs["_indent"]]
                page.marker = ""
            elif tag in ("blockquote", "dd"):
                page.indent = page.indent[:-2]
            elif tag == "pre":
                page.pre -= 1
        elif tag == "textarea":
            page.pre -= 1

    if not shown(root):
        return ""
    stack = [(root, iter(root.kids))]
    while stack:
        node, kids = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                if node.drawn:
                    pages[-1].text(kid)
            elif kid.space:
                if shown(kid) and kid.tag not in UNSEEN.get(node.within(), ()):
                    enter(kid)
                    stack.append((kid, iter(kid.kids)))
                    break
            elif kid.tag in BLOCKS and unseen_by(kid.attrs.get("style")) == "visibility":
                pages[-1].end_line(kid.tag in SPACED)  # unseen, but it keeps its place
            elif shown(kid) and not (node.tag == "details" and "open" not in node.attrs and kid.tag != "summary"):
                enter(kid)
                stack.append((kid, iter(kid.kids)))
                break
        else:
            stack.pop()
            if stack:
                leave(node)
    return pages[0].result()


def visible_text(html: str | None) -> str:
    return render(parse(html)) if html else ""


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """All rows of ``pages`` with the visible text of ``html`` in ``text``; other columns pass through."""
    prepare(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, text)]
    inner = pages.select(F.struct(F.lit(0).alias("_"), *keep).alias("row"), F.col(html).cast("string").alias("html"))
    schema = T.StructType([inner.schema["row"], T.StructField(text, T.StringType())])

    def run(batches):
        for batch in batches:
            out = [visible_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", text])

    done = inner.mapInArrow(run, schema)
    return done.select(*(F.col("row")[c].alias(c) for c in keep), text)


def text_digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "html")).withColumn("n_chars", F.length("text").cast("long"))
