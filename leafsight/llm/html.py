"""HTML to text by layout: a tree is built with implied tags, then its visible text is rendered.

Block elements stand on lines of their own, paragraphs and the like between blank lines, list
items behind bullets or numbers at their depth, table cells in columns of equal width, and what
stands between a table's cells before the table. What a browser hides (scripts, styles, templates,
the hidden attribute, display:none, closed dialogs, closed details but for their summary, and so
on) is left out; display in a style attribute makes blocks of inline elements and the reverse; of a style attribute whole declarations count, of a drop-down list the
selected option, of an input field what it says, of svg its text elements. Style sheets are not
read.

Time and memory grow with the length of a page, whatever its tags: open elements are looked up
by their names, and nesting takes no recursion, so that pages may be nested to any depth. Lists
are indented up to MOST_INDENT and tables within more than MOST_TABLES others have their cells
one after another; no text is lost by either.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html import unescape
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
HIDDEN = frozenset("head script style template title meta link base noscript iframe noembed noframes object audio video canvas progress meter datalist param source track area annotation annotation-xml rp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p pre search section summary table ul caption tbody thead tfoot tr td th xmp plaintext textarea option optgroup foreignobject mtr".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre listing xmp plaintext figure table fieldset hr article section".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul listing xmp plaintext li dd dt".split())
#: Opening a tag of the first kind closes an open element of the second, no further up than the third.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir", "table"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "thead": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset({"html"})),
    "input": (frozenset({"select"}), frozenset({"table"})),
    "textarea": (frozenset({"select"}), frozenset({"table"})),
    "select": (frozenset({"select"}), frozenset({"table"})),
}
HEAD_ONLY = frozenset("title meta link base style script noscript template head html".split())
BARRIER = frozenset("table td th caption html template button object".split())

_TAG = re.compile(r"<(?:!--(?:.*?(?:--!?>|\Z)|>)|![^>]*>?|\?[^>]*>?|/([a-zA-Z][^\s/>]*)[^>]*>?|([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(>|\Z))", re.S)
_ATTR = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Searched in the page itself: lower-casing may lengthen it. ASCII, as the Kelvin sign is no k in a tag.
_END = {tag: re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I | re.A) for tag in RAW}
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: Declarations end at semicolons outside of strings and brackets.
_DECLARATION = re.compile(r"(?:[^;\"'(]|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|\((?:[^)\"']|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+(?:\)|\Z))++", re.S)
_IMPORTANT = re.compile(r"\s*!\s*important\s*\Z")
_VISIBILITY = frozenset("visible hidden collapse inherit initial unset revert revert-layer".split())
_DISPLAY = frozenset(
    "none block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-caption table-column table-column-group table-row-group table-header-group table-footer-group flow flow-root list-item contents run-in math ruby ruby-base ruby-text ruby-base-container ruby-text-container -webkit-box -webkit-inline-box -webkit-flex -webkit-inline-flex inherit initial unset revert revert-layer".split()
)
_BLOCKS = frozenset("block flex grid table list-item flow flow-root table-row table-caption table-row-group table-header-group table-footer-group -webkit-box -webkit-flex".split())
_INLINE = frozenset("inline inline-block inline-flex inline-grid inline-table table-cell contents run-in ruby -webkit-inline-box -webkit-inline-flex".split())
_FLEX = frozenset("flex inline-flex grid inline-grid -webkit-box -webkit-inline-box -webkit-flex -webkit-inline-flex".split())
# Elements of svg that are not drawn where they stand, and those of html that end an open svg or math.
SVG_HIDDEN = frozenset("defs desc metadata symbol clippath mask pattern marker".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
MATH_TEXT = frozenset("mi mo mn ms mtext".split())
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+/\Z")


def style(text: str) -> dict[str, str]:
    """The values of display and visibility that hold in a style attribute; values unknown to browsers don't count."""
    held: dict[str, tuple[bool, str]] = {}
    for d in _DECLARATION.findall(_COMMENT.sub(" ", text)):
        name, colon, value = d.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if not colon or name not in ("display", "visibility"):
            continue
        short = _IMPORTANT.sub("", value)
        words = short.split()
        known = _DISPLAY if name == "display" else _VISIBILITY
        if "var(" not in short and not (words and known.issuperset(words) and (len(words) == 1 or name == "display" and "none" not in words)):
            continue
        important = short != value
        if important or not held.get(name, (False,))[0]:
            held[name] = (important, short)
    return {k: v for k, (_, v) in held.items()}


class Node:
    """An element.

    space: "svg", "text" (of svg), "math" or "" (html); seen: its visibility, inherited; gone: not
    displayed, with all within; block: whether it stands on lines of its own; holds: cells or rows
    of the table around it stand within it, though it is no part of a table.
    """

    __slots__ = ("tag", "attrs", "kids", "space", "seen", "gone", "display", "block", "holds")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.space, self.seen = (parent.space, parent.seen) if parent else ("", True)
        if tag in ("svg", "math"):
            self.space = tag
        elif self.space:
            self.space = "" if tag == "foreignobject" else "text" if tag == "text" and self.space == "svg" else self.space
        self.gone = tag in HIDDEN or self.space in ("svg", "text") and tag in SVG_HIDDEN
        rules = style(attrs["style"]) if "style" in attrs else {}
        if self.space in ("svg", "text"):
            rules = {k: attrs[k].strip().lower() for k in ("display", "visibility") if k in attrs} | rules
        look = rules.get("visibility", "inherit")
        if look in ("hidden", "collapse"):
            self.seen = False
        elif look in ("visible", "initial"):
            self.seen = True
        if "display" in rules:
            self.gone = self.gone or rules["display"] == "none"
        elif not self.gone:
            self.gone = "hidden" in attrs or tag == "dialog" and "open" not in attrs
        if tag == "input" and attrs.get("type", "").lower() == "hidden":
            self.gone = True
        self.display, self.holds = rules.get("display", ""), False
        first = self.display.partition(" ")[0]
        usual = tag in BLOCK or tag == "text" and self.space == "text"
        # children of flex boxes and grids are boxes of their own
        self.block = first in _BLOCKS or (usual and first not in _INLINE) or parent is not None and not parent.space and parent.display.rpartition(" ")[2] in _FLEX

    @property
    def shows(self) -> bool:
        """Whether text right within it can be seen."""
        return self.seen and self.space != "svg"


class _Open:
    """The open elements, and for each name where among them it stands."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    @property
    def last(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, i: int) -> None:
        """Close all from number i on."""
        while len(self.stack) > i:
            self.at[self.stack.pop().tag].pop()

    def near(self, tags: Iterable[str]) -> int:
        """The number of the innermost of these; 0 if none is open."""
        return max([x[-1] for t in tags if (x := self.at.get(t))], default=0)

    def outermost(self, tags: Iterable[str], within: int) -> int:
        """The number of the outermost of these within that element; 0 if there is none."""
        found = [x[k] for t in tags if (x := self.at.get(t)) and (k := bisect_right(x, within)) < len(x)]
        return min(found, default=0)


_CELLS = ("td", "th", "caption", "table")
_TABLE_PARTS = frozenset("table tr td th tbody thead tfoot caption".split())
_TABLE_ENDS = frozenset("table tr tbody thead tfoot body html".split())


def build(html: str) -> Node:
    """The tree of a page. Never fails: what can't be a tag is text, what isn't closed ends with the page.

    A tag that the page ends within is no text, and neither is what follows its name.
    """
    root = Node("#root", {})
    open_ = _Open(root)
    pos, n = 0, len(html)

    def text(t: str) -> None:
        if t:
            if open_.last.tag == "head" and t.strip():
                open_.cut(len(open_.stack) - 1)
            open_.last.kids.append(t)

    while pos < n:
        m = _TAG.search(html, pos)
        if m is None:
            text(unescape(html[pos:]))
            break
        if m.start() > pos:
            text(unescape(html[pos : m.start()]))
        pos = m.end()
        if open_.last.space and html.startswith("<![CDATA[", m.start()):
            end = html.find("]]>", m.start() + 9)
            text(html[m.start() + 9 : end if end >= 0 else n])
            pos = end + 3 if end >= 0 else n
            continue
        if m[1]:
            tag = m[1].lower()
            if tag == "p" and not open_.at.get("p") or tag == "br":
                open_.last.kids.append(Node(tag, {}, open_.last))
                continue
            i = open_.near(_HEADINGS if tag in _HEADINGS else (tag,))
            if i and (tag in _TABLE_ENDS or i >= open_.near(_CELLS)):
                open_.cut(i)
        elif m[2]:
            if not m[4]:
                break
            tag = m[2].lower()
            attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])} if m[3] and not m[3].isspace() else {}
            if open_.last.space and open_.last.tag not in MATH_TEXT and tag in BREAKOUT:
                while open_.last.space and open_.last.tag not in MATH_TEXT:
                    open_.cut(len(open_.stack) - 1)
            if tag not in HEAD_ONLY:
                while open_.last.tag == "head":
                    open_.cut(len(open_.stack) - 1)
            if tag in CLOSES_P and (i := open_.near(("p",))) > open_.near(BARRIER):
                open_.cut(i)
            if tag in _HEADINGS and open_.last.tag in _HEADINGS:
                open_.cut(len(open_.stack) - 1)
            if tag in IMPLIED:
                ends, limit = IMPLIED[tag]
                if i := open_.outermost(ends, open_.near(limit - ends)):
                    open_.cut(i)
            if tag in ("td", "th") and open_.last.tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr", {}, open_.last)
                open_.last.kids.append(row)
                open_.push(row)
            node = Node(tag, attrs, open_.last)
            open_.last.kids.append(node)
            if tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):
                # a form around cells, say; those marked before end the way up, so that all ways together are short
                for x in reversed(open_.stack):
                    if x.tag in _TABLE_PARTS or x.holds:
                        break
                    x.holds = True
            if (node.space or tag == "foreignobject") and m[3].endswith("/") and not _UNQUOTED.search(m[3]):
                continue
            if tag in RAW:
                ended = None if tag == "plaintext" else _END[tag].search(html, pos)
                end = ended.start() if ended else -1
                body = html[pos:] if end < 0 else html[pos:end]
                node.kids.append(unescape(body) if tag in ("textarea", "title") else body)
                close = n if end < 0 else html.find(">", end)
                pos = n if close < 0 else min(n, close + 1)
            elif tag not in VOID:
                open_.push(node)
    return root


_HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})


def _options(select: Node) -> list[str]:
    """What a select shows: all options of a list box, else the selected one (the first that can be chosen if none is)."""
    found: list[tuple[Node, bool, bool]] = []

    def gather(x: Node, gone: bool, off: bool) -> None:
        for k in x.kids:
            if isinstance(k, Node):
                if k.tag == "option":
                    found.append((k, gone or k.gone, off or "disabled" in k.attrs))
                elif k.tag == "optgroup" and x is select:
                    gather(k, gone or k.gone, "disabled" in k.attrs)

    gather(select, False, False)
    size = select.attrs.get("size", "").strip()
    if "multiple" in select.attrs or size.isascii() and size.isdigit() and int(size[:9]) > 1:
        shown = [o for o, gone, _ in found if not gone]
    else:
        shown = [o for o, _, _ in found if "selected" in o.attrs][-1:] or [o for o, _, off in found if not off][:1]
    return [o.attrs.get("label") or "".join(_plain(o)) for o in shown if o.seen]


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in s)


class _Page:
    """Lines of text as they grow: inline text is gathered, blocks break it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.indent, self.lead = "", None
        self.tables = 0
        # the list around: whether it is numbered, the next number, and what is added to it
        self.items: list | None = None

    def put(self, t: str) -> None:
        self.now.append(t)

    def end(self) -> None:
        line = _SPACE.sub(" ", "".join(self.now)).strip(" ")
        self.now = []
        if line:
            self.lines.append((self.lead if self.lead is not None else self.indent) + line)
            self.lead = None

    def gap(self) -> None:
        self.end()
        if self.lines and self.lines[-1]:
            self.lines.append("")


#: Lines of cells wider than this are not padded to, and move what stands to their right; likewise columns beyond MOST_WIDE.
WIDEST, MOST_WIDE = 80, 4000
MOST_INDENT, MOST_TABLES = 120, 16
#: What is yet to be rendered: a generator that yields those to be rendered before it goes on.
_Work = Iterator["_Work"]


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "").strip()
    return min(int(value[:9]), most) if value.isascii() and value.isdigit() else 1


def _table(node: Node, page: _Page, within: int) -> _Work:
    """Cells in columns: a cell goes to the first column that no cell of its row, nor one that reaches down from above, has taken."""
    rows: list[dict[int, list[str]]] = []
    # columns taken from above: (first column, columns, rows left, -1: as many as the section has)
    above: list[tuple[int, int, int]] = []

    def row(tr: Node) -> _Work:
        nonlocal above
        cells: dict[int, list[str]] = {}
        taken, kept, at = sorted(above), [], 0
        left = iter([*taken, None])
        block = next(left)
        rest: list[Node] = []
        work = [iter(tr.kids)]
        shows = [tr.shows]
        while work:
            c = next(work[-1], None)
            if c is None:
                work.pop()
                shows.pop()
                continue
            # what is no cell stands before the table, as in browsers; cells within it are the row's
            if isinstance(c, str):
                if shows[-1] and c.strip():
                    page.put(f" {c} ")
                continue
            if c.gone:
                continue
            if c.tag in ("tr", "tbody", "thead", "tfoot"):
                rest.append(c)
                continue
            if c.tag not in ("td", "th"):
                if c.holds:
                    work.append(iter(c.kids))
                    shows.append(c.shows)
                else:
                    yield _element(c, page)
                continue
            while block is not None and at >= block[0]:
                at = max(at, block[0] + block[1])
                block = next(left)
            if within >= MOST_TABLES:
                page.end()
                yield _render(c, page)
                page.end()
                continue
            inner = _Page()
            inner.tables = within + 1
            yield _render(c, inner)
            inner.end()
            cells[at] = inner.lines
            wide, deep = max(1, _span(c, "colspan", 1000)), _span(c, "rowspan", 65534)
            if deep != 1:
                kept.append((at, wide, deep - 1))
            at += wide
        above = [(a, w, r - (r > 0)) for a, w, r in taken if r != 1] + kept
        rows.append(cells)
        for r in rest:
            yield row(r) if r.tag == "tr" else gather(r)

    def gather(x: Node) -> _Work:
        nonlocal above
        for k in x.kids:
            if isinstance(k, str):
                if x.shows and k.strip():
                    page.put(k)
            elif k.gone:
                continue
            elif k.tag == "tr":
                yield row(k)
            elif k.tag in ("tbody", "thead", "tfoot"):
                above = []
                yield gather(k)
                above = []
            elif k.tag == "caption":
                page.end()
                yield _render(k, page)
                page.end()
            elif k.holds:
                yield row(k) if any(isinstance(c, Node) and c.tag in ("td", "th") for c in k.kids) else gather(k)
            elif k.tag not in ("colgroup", "col"):
                yield _element(k, page)

    yield gather(node)
    page.end()
    if within >= MOST_TABLES:
        return
    # one enormous cell doesn't pad all others: they align among themselves
    wide: dict[int, int] = {}
    for cells in rows:
        for at, lines in cells.items():
            wide[at] = max([wide.get(at, 0), *(w for w in map(_width, lines) if w <= WIDEST)])
    columns = sorted(wide)
    total = 0
    for c in columns:
        total += wide[c] + 2
        if total > MOST_WIDE:
            wide[c] = 0
    for cells in rows:
        if not cells:
            continue
        mine = columns[: columns.index(max(cells)) + 1] if len(columns) < 64 else [c for c in columns if c <= max(cells)]
        for k in range(max(map(len, cells.values()))):
            parts = [(x[k] if (x := cells.get(c)) and k < len(x) else "", wide[c]) for c in mine]
            line = "  ".join(t + " " * max(0, w - _width(t)) for t, w in parts).rstrip()
            if line.strip():
                page.lines.append(page.indent + line)


def _input(x: Node) -> str:
    """What a field or button says."""
    kind, value = x.attrs.get("type", "text").strip().lower(), x.attrs.get("value", "")
    if kind in ("hidden", "checkbox", "radio", "range", "color", "file", "image"):
        return ""
    if kind in ("submit", "reset", "button"):
        return value
    return "" if kind == "password" and value else value or x.attrs.get("placeholder", "")


def _element(x: Node, page: _Page) -> _Work:
    tag = x.tag
    if x.gone:
        return
    if tag == "br":
        page.end()
        return
    if tag == "hr":
        page.gap()
        return
    if tag == "img":
        return
    if tag == "input":
        if x.seen and (said := _input(x)):
            page.put(f" {said} ")
        return
    if tag == "select":
        for i, o in enumerate(_options(x)):
            if i:
                page.end()
            page.put(f" {o} ")
        return
    if tag == "mfrac":
        for k in x.kids:
            if isinstance(k, Node):
                yield _element(k, page)
                page.put(" ")
        return
    if not x.block and tag not in _OWN:
        apart = tag == "mtd" or x.display == "table-cell"
        if apart:
            page.put(" ")
        yield _render(x, page)
        if apart:
            page.put(" ")
        return
    if tag == "li" and page.items is not None:
        numbered, number, step = page.items
        if numbered and re.fullmatch(_NUMBER, x.attrs.get("value", "").strip()):
            number = int(x.attrs["value"])
        page.items[1] = number + step
        page.end()
        depth, mark = page.indent, f"{number}. " if numbered else "- "
        page.lead, page.indent = depth + (mark if x.seen else " " * len(mark)), _deeper(depth, len(mark))
        yield _render(x, page)
        page.end()
        page.indent, page.lead = depth, None
        return
    spaced = tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and page.indent)
    page.gap() if spaced else page.end()
    if tag in ("pre", "listing", "xmp", "plaintext", "textarea"):
        raw = "".join(_plain(x)).replace("\r\n", "\n").replace("\r", "\n")
        raw = raw.removeprefix("\n")
        if tag == "textarea" and not raw and x.seen:
            raw = x.attrs.get("placeholder", "")
        page.lines += [page.indent + l.rstrip() for l in raw.rstrip("\n").split("\n")] if raw.strip() else []
    elif tag == "table":
        yield _table(x, page, page.tables)
    elif tag in ("ul", "ol", "menu", "dir"):
        depth, outer = page.indent, page.items
        start, back = x.attrs.get("start", "").strip(), tag == "ol" and "reversed" in x.attrs
        number = int(start) if tag == "ol" and re.fullmatch(_NUMBER, start) else _items(x) if back else 1
        page.items = [tag == "ol", number, -1 if back else 1]
        yield _render(x, page)
        page.end()
        page.indent, page.items = depth, outer
    elif tag in ("dd", "blockquote"):
        depth = page.indent
        page.indent = _deeper(depth, 4)
        yield _render(x, page)
        page.end()
        page.indent = depth
    else:
        yield _render(x, page)
    page.gap() if spaced else page.end()


#: Elements with a layout of their own, whatever their display.
_OWN = frozenset("pre listing xmp plaintext textarea table ul ol menu dir".split())
_NUMBER = r"-?[0-9]{1,9}"


def _items(x: Node) -> int:
    """The number of a list's items, without those of lists within."""
    n, stack = 0, list(x.kids)
    while stack:
        k = stack.pop()
        if isinstance(k, Node) and not k.gone:
            n += k.tag == "li"
            stack += k.kids if k.tag not in ("li", "ul", "ol", "menu", "dir", "table") else []
    return n


def _deeper(indent: str, by: int) -> str:
    return indent + " " * by if len(indent) < MOST_INDENT else indent


def _plain(x: Node) -> Iterator[str]:
    stack = [(x, iter(x.kids))]
    while stack:
        k = next(stack[-1][1], None)
        if k is None:
            stack.pop()
        elif isinstance(k, str):
            if stack[-1][0].shows:
                yield k
        elif k.tag == "br":
            yield "\n"
        elif k.tag == "select":
            if not k.gone:
                yield f" {' '.join(_options(k))} "
        elif not k.gone:
            stack.append((k, iter(k.kids)))


def _render(x: Node, page: _Page) -> _Work:
    if x.tag == "details" and "open" not in x.attrs:
        # closed: its first summary only
        for k in [k for k in x.kids if isinstance(k, Node) and k.tag == "summary"][:1]:
            yield _element(k, page)
        return
    for k in x.kids:
        if isinstance(k, str):
            if x.shows:
                page.put(k)
        elif not k.gone:
            yield _element(k, page)


def render(html: str | None) -> str:
    """The visible text of a page; empty for null, empty or wholly hidden pages."""
    if not html:
        return ""
    page = _Page()
    work = [_render(build(html), page)]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
        else:
            work.append(inner)
    page.end()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    return "\n".join(page.lines)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of pages (page_id, url, html). Rows that repeat stay repeated.

    A null html gives an empty text, null ids and URLs stay null, an empty table gives no rows;
    other columns of pages are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [render(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string")
