"""HTML extraction by layout: all visible text of a page, laid out as a reader sees it.

A small tree builder takes care of implied tags (an open paragraph ends before a block, list items, table
rows and cells end one another, rows and bodies of tables are supplied), of stray end tags, and of what is misplaced in
tables (text and other elements move before the table, forms there hold nothing). Visibility rules follow the page: elements
without boxes, `hidden`, closed `details`, and `display` and `visibility` of inline styles and style sheets, by specificity and order.
Sheets count where their media are a screen `VIEWPORT` pixels wide; selectors are tags, classes and ids and what is compounded of
them. A rule with any other selector is left aside, so in doubt text is shown.
Rendering collapses white space outside `pre`, puts blocks on lines of their own with an empty line where browsers leave a
margin, numbers and indents lists, and pads table cells into aligned columns, cells over several rows or columns among them.

Work is per page in Arrow batches without a shuffle. Null html counts as empty and renders as the empty string, as does a page
with nothing visible. Elements may be nested to any depth (rendering keeps a stack of its own), and pages be of any length. Repeated
rows render alike; other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, table, type_of

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NO_BOX = frozenset("script style template noscript title head meta link base iframe noembed noframes object svg canvas audio video map datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption ul xmp".split())
MARGIN = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul fieldset xmp".split())
ENDS_P = BLOCK - frozenset("body html optgroup option caption legend dd dt li".split()) | {"li", "dd", "dt"}
#: What an opening tag ends, and the elements that shelter from it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "colgroup": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "col": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, set()),
}
IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
TABLE_SCOPE = frozenset("td th caption table".split())
#: Elements that hold only parts of tables; all else in them is moved before the table.
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
SECTIONS = frozenset("tbody thead tfoot".split())
#: The parts of tables, and what each may stand in.
STANDS_IN = dict.fromkeys(("caption", "colgroup", "tbody", "thead", "tfoot"), {"table"}) | {"col": {"table", "colgroup"}, "tr": SECTIONS | {"table"}, "td": TABLE_PARTS, "th": TABLE_PARTS}
STAYS = frozenset(STANDS_IN) | {"script", "style", "template"}
VIEWPORT = 1_024

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACES = re.compile(r"[ \t\n\f\r]+")
SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
DECLARATION = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.IGNORECASE)
MEDIUM = re.compile(r"\s*(not\b|only\b)?\s*([a-z-]+)?(.*)", re.IGNORECASE | re.DOTALL)
WIDTH = re.compile(r"\(\s*(min|max)-(?:device-)?width\s*:\s*([\d.]+)\s*(px|em|rem)\s*\)", re.IGNORECASE)


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    children: list = field(default_factory=list)


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        value = m[2] or ""
        found.setdefault(m[1].lower(), html.unescape(value[1:-1] if value[:1] in "\"'" and value else value))
    return found


def build(page: str) -> tuple[Element, list[str]]:
    """The page's tree, and the style sheets that count on a screen."""
    root = Element("html", {})
    stack, sheets, at, n = [root], [], 0, len(page)
    opened: Counter = Counter()  # how many elements of a tag are open

    def cut(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    def place(node: str | Element, moves: bool) -> None:
        """Appends the node where it belongs: before the table if it may not stand in that."""
        if moves and stack[-1].tag == "colgroup":
            cut(len(stack) - 1)
        if moves and stack[-1].tag in TABLE_PARTS and (i := last({"table"})):
            stack[i - 1].children.insert(-1, node)  # an open table is the last child of its parent
        else:
            stack[-1].children.append(node)

    def last(tags: set | frozenset) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        if not any(opened[t] for t in tags):
            return 0
        return next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in tags)

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and s.strip():
                cut(len(stack) - 1)
            place(html.unescape(s) if "&" in s else s, s.strip(" \t\n\f\r") != "")

    def close_upto(tags: set, shelter: set) -> None:
        while any(opened[t] for t in tags):
            i = last(tags | shelter)
            if stack[i].tag in shelter:
                return
            cut(i)

    def add(tag: str, attrs: dict, stay: bool = True) -> Element:
        own = Element(tag, attrs)
        place(own, tag not in STAYS)
        if stay:
            stack.append(own)
            opened[tag] += 1
        return own

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not opened["p"]:
                add("p", {}, stay=False)
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                own = stack[i].tag
                if own == tag:
                    cut(i)
                    break
                if own in TABLE_SCOPE and (tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") or (own == "table" and tag != "table")):
                    break
            continue
        attrs = attributes(m[3]) if m[3].strip(" /\n\t") else {}
        if tag == "html" or (tag == "body" and opened["body"]):
            own = stack[last({"body"}) if tag == "body" else 0]
            own.attributes = attrs | own.attributes
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            cut(len(stack) - 1)
        if tag in ENDS_P and opened["p"]:
            close_upto({"p"}, {"td", "th", "caption", "table", "button"})
        if tag in ("form", "table") and stack[last(TABLE_SCOPE | TABLE_PARTS | {"template"})].tag in TABLE_PARTS:
            if tag == "form":
                continue
            cut(last({"table"}))  # a table right in a table ends that
        parts = tag in STANDS_IN and stack[last({"table", "template"})].tag != "template"
        if parts and not opened["table"]:
            continue
        if tag in ENDS:
            close_upto(*ENDS[tag])
        if parts:
            while stack[-1].tag not in STANDS_IN[tag]:
                cut(len(stack) - 1)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            add("tr", {})
        if tag in VOID:
            add(tag, attrs, stay=False)
        elif tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            body = page[at : end.start()] if end else page[at:]
            at = end.end() if end else n
            if tag == "style" and on_screen(attrs.get("media", "")):
                sheets.append(body)
            own = add(tag, attrs, stay=False)
            if body:
                own.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
        else:
            add(tag, attrs, stay=not m[3].endswith("/") or tag not in ("svg", "path"))
    return root, sheets


def on_screen(query: str) -> bool:
    """Whether a list of media holds for a screen `VIEWPORT` pixels wide; features other than the width count as given."""

    def one(q: str) -> bool:
        m = MEDIUM.match(q)
        holds = (m[2] or "all").lower() in ("all", "screen")
        for side, number, unit in WIDTH.findall(m[3]):
            width = float(number or 0) * (1 if unit.lower() == "px" else 16) if number.count(".") < 2 else 0
            holds = holds and (VIEWPORT >= width if side.lower() == "min" else VIEWPORT <= width)
        return holds != ((m[1] or "").lower() == "not")

    return any(map(one, query.split(",")))


def blocks_of(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a sheet's rules that count."""
    head, body, groups = "", None, []
    for part in re.findall(r"[^{}]+|[{}]", re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.DOTALL)):
        if part == "{":
            own = head.rsplit(";", 1)[-1].strip()
            if own.startswith("@"):
                kind, _, query = own[1:].partition(" ")
                groups.append(kind.lower() in ("supports", "layer", "container") or (kind.lower() == "media" and on_screen(query)))
            else:
                body = own
            head = ""
        elif part == "}":
            if body is not None:
                if all(groups):
                    yield body, head
                body = None
            elif groups:
                groups.pop()
            head = ""
        else:
            head = part
    if body is not None and all(groups):  # a sheet may end inside a rule
        yield body, head


def declared(text: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of display and visibility."""
    return [(p.lower(), v.lower(), bool(i)) for p, v, i in DECLARATION.findall(text)]


class Sheets:
    """Rules of display and visibility, by the tag, class or id that their selectors need."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[str, list[tuple]] = defaultdict(list)
        order = 0
        for sheet in sheets:
            for selectors, body in blocks_of(sheet):
                found = declared(body)
                for s in selectors.split(",") if found else ():
                    m = SELECTOR.fullmatch(s.strip())
                    if m and m[0]:
                        tag = (m[1] or "*").lower()
                        more = re.findall(r"[.#][\w-]+", m[2])
                        rank = (sum(x[0] == "#" for x in more), sum(x[0] == "." for x in more), tag != "*")
                        order += 1
                        self.rules[more[0] if more else tag].append((rank, order, tag, frozenset(more), found))

    def of(self, e: Element) -> dict[str, str]:
        """display and visibility of the element, where declared."""
        a = e.attributes
        style = a.get("style")
        if not self.rules and not style:
            return {}
        own = {"." + c for c in a.get("class", "").split()} | ({"#" + a["id"]} if "id" in a else set())
        found = [((important, False, rank, order), p, v) for key in (e.tag, "*", *own) for rank, order, tag, more, body in self.rules.get(key, ()) if tag in ("*", e.tag) and more <= own for p, v, important in body]
        found += [((important, True, (), 0), p, v) for p, v, important in declared(style or "")]
        return {p: v for _, p, v in sorted(found, key=lambda x: x[0])}


class Layout:
    """Lines of text under construction."""

    def __init__(self, in_list: bool = False):
        self.lines: list[str] = []
        self.in_list = in_list
        self.line, self.space, self.gap, self.indent = "", False, 0, ""

    def text(self, s: str) -> None:
        if s[0] in " \t\n\f\r":
            self.space = True
        words = SPACES.sub(" ", s).strip(" ")
        if not words:
            return
        if not self.line:
            self.open()
        elif self.space:
            self.line += " "
        self.line += words
        self.space = s[-1] in " \t\n\f\r"

    def open(self) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        self.line = self.indent

    def end_line(self, gap: int = 1) -> None:
        """Ends the line if one is open; at least gap line breaks come before what follows."""
        if self.line:
            self.lines.append(self.line.rstrip(" "))
            self.line = ""
        self.gap, self.space = max(self.gap, gap), False

    def verbatim(self, s: str) -> None:
        parts = s.expandtabs(8).split("\n")
        for k, p in enumerate(parts):
            if k:
                if self.line:
                    self.end_line()
                else:
                    self.open()
                    self.lines.append("")
                    self.line = ""
            if p:
                if not self.line:
                    self.open()
                self.line += p
        self.space = False

    def done(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


class Renderer:
    """Renders a tree. Its methods are generators that yield the call they wait for, so depth is bounded by memory only."""

    def __init__(self, sheets: list[str]):
        self.sheets = Sheets(sheets)

    def look(self, e: Element, visible: bool) -> tuple[bool, bool]:
        """Whether the element has a box, and whether text right in it is visible, given that of its parent."""
        a = e.attributes
        if e.tag in NO_BOX or (a and ("hidden" in a or (e.tag == "input" and a.get("type", "").lower() == "hidden"))):
            return False, visible
        own = self.sheets.of(e)
        value = own.get("visibility")
        if value in ("visible", "hidden", "collapse"):
            visible = value == "visible"
        return own.get("display") != "none", visible

    def block(self, children: list, visible: bool = True) -> Generator:
        out = Layout()
        yield self.inside(children, out, visible, False)
        return out.done()

    def inside(self, children: list, out: Layout, visible: bool, pre: bool) -> Generator:
        for c in children:
            if isinstance(c, str):
                if visible:
                    out.verbatim(c) if pre else out.text(c)
            else:
                boxed, seen = self.look(c, visible)
                if boxed:
                    yield self.element(c, out, seen, pre)

    def element(self, e: Element, out: Layout, visible: bool, pre: bool) -> Generator:
        """Lays out an element that has a box; text right in it is visible or not."""
        tag, a = e.tag, e.attributes
        if tag == "br":
            if out.line:
                out.end_line()
            else:
                out.gap += 1
            return
        if tag == "input":
            if a.get("type", "text").lower() not in ("checkbox", "radio", "file", "image", "password", "range", "color") and a.get("value") and visible:
                out.text(a["value"])
            return
        if tag == "table":
            out.end_line(2)
            yield self.table(e, out, visible)
            out.end_line(2)
            return
        if tag == "select":
            options = [(o, self.look(o, visible)) for o in walk(e, "option")]
            options = [(o, seen) for o, (boxed, seen) in options if boxed]
            for o, seen in [x for x in options if "selected" in x[0].attributes] or options[:1]:
                yield self.inside(o.children, out, seen, False)
            return
        block = tag in BLOCK
        gap = 2 if tag in MARGIN and not (tag in ("ul", "ol", "menu") and out.in_list) else 1
        if block:
            out.end_line(gap)
        if tag in ("ul", "ol", "menu", "dir"):
            yield self.list_items(e, out, visible)
        elif tag in ("blockquote", "dd"):
            before, out.indent = out.indent, out.indent + "  "
            yield self.inside(e.children, out, visible, pre)
            out.end_line(1)
            out.indent = before
        elif tag == "details" and "open" not in a:
            yield self.inside([c for c in e.children if not isinstance(c, str) and c.tag == "summary"][:1], out, visible, pre)
        elif tag == "q" and visible:
            out.text('"') if not out.line or out.space else setattr(out, "line", out.line + '"')
            out.space = False
            yield self.inside(e.children, out, visible, pre)
            out.line += '"'
        else:
            yield self.inside(e.children, out, visible, pre or tag in ("pre", "textarea", "xmp", "listing"))
        if block:
            out.end_line(gap)

    def list_items(self, e: Element, out: Layout, visible: bool) -> Generator:
        start = e.attributes.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        before = out.indent
        for c in e.children:
            if isinstance(c, str) or c.tag != "li":
                yield self.inside([c], out, visible, False)
                continue
            boxed, seen = self.look(c, visible)
            if boxed:
                out.end_line(1)
                marker = f"{number}. " if e.tag == "ol" else "- "
                number += 1
                # The first line carries the marker, those below are set in.
                item = Layout(in_list=True)
                yield self.inside(c.children, item, seen, False)
                text = item.done()
                if text:
                    own = text.split("\n")
                    if out.gap > 1 and out.lines:
                        out.lines.append("")
                    out.gap = 0
                    out.lines += [before + marker + own[0], *(before + " " * len(marker) + x if x else "" for x in own[1:])]
                out.end_line(1)

    def table(self, e: Element, out: Layout, visible: bool) -> Generator:
        """Rows of cells, each column as wide as its widest cell of one column."""
        rows: list[list[tuple]] = []
        for part in e.children:
            if isinstance(part, str):
                if part.strip() and visible:
                    out.text(part)
                    out.end_line(1)
                continue
            boxed, seen = self.look(part, visible)
            if not boxed:
                continue
            if part.tag == "tr":
                rows.append((yield self.cells(part, seen)))
            elif part.tag in SECTIONS:
                for r in part.children:
                    if not isinstance(r, str) and r.tag == "tr":
                        boxed, inner = self.look(r, seen)
                        if boxed:
                            rows.append((yield self.cells(r, inner)))
            else:
                yield self.element(part, out, seen, False)
                out.end_line(1)
        rows = [r for r in placed(rows) if any(lines for *_, lines in r)]
        if not rows:
            return
        widths = [0] * max(at + span for r in rows for at, span, _ in r)
        for single in (True, False):  # cells over several columns widen the last of them if they must
            for r in rows:
                for at, span, lines in r:
                    if (span == 1) == single and lines:
                        room = sum(widths[at : at + span]) + 2 * (span - 1)
                        widths[at + span - 1] += max(0, max(map(len, lines)) - room)
        if out.gap > 1 and out.lines:
            out.lines.append("")
        out.gap = 0
        begin = [0]
        for w in widths:
            begin.append(begin[-1] + w + 2)
        for r in rows:
            for k in range(max(len(lines) for *_, lines in r)):
                line = ""
                for at, _, lines in r:
                    if k < len(lines):
                        line = line.ljust(begin[at]) + lines[k]
                out.lines.append((out.indent + line).rstrip())

    def cells(self, row: Element, visible: bool) -> Generator:
        """(columns, rows, lines) of the row's cells."""
        found = []
        for c in row.children:
            if not isinstance(c, str) and c.tag in ("td", "th"):
                boxed, seen = self.look(c, visible)
                if boxed:
                    own = yield self.block(c.children, seen)
                    found.append((spanned(c, "colspan", 1, 1_000), spanned(c, "rowspan", 0, 65_534), own.split("\n") if own else []))
        return found


def spanned(cell: Element, name: str, least: int, most: int) -> int:
    """The columns or rows of a cell, within the limits that HTML sets."""
    value = cell.attributes.get(name, "1").strip()
    return min(most, max(least, int(value))) if re.fullmatch(r"\d{1,6}", value) else 1


def placed(rows: list[list[tuple]]) -> list[list[tuple]]:
    """Rows of (column, columns, lines): cells take the first columns that cells of rows above don't reach into."""
    taken: dict[int, int] = {}
    out = []
    for n, row in enumerate(rows):
        taken = {c: k - 1 for c, k in taken.items() if k > 1}
        at, own = 0, []
        for span, deep, lines in row:
            while at in taken:
                at += 1
            own.append((at, span, lines))
            if deep != 1:
                for c in range(at, at + span):
                    taken[c] = deep or len(rows) - n
            at += span
        out.append(own)
    return out


def walk(e: Element, tag: str) -> Iterator[Element]:
    """Elements of a tag below e, in order."""
    left = e.children[::-1]
    while left:
        c = left.pop()
        if not isinstance(c, str):
            if c.tag == tag:
                yield c
            left += c.children[::-1]


def result_of(call: Generator) -> str:
    """Runs a generator and those it waits for."""
    stack, value = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def render(page: str) -> str:
    """The visible text of a page."""
    root, sheets = build(page)
    return result_of(Renderer(sheets).block(root.children))


def extract_text(pages: DataFrame, page_id: str = "page_id", content: str = "html") -> DataFrame:
    """(page_id, text, n_lines) of every page."""
    rows = pages.select(pages[page_id].alias("page_id"), F.coalesce(pages[content], F.lit("")).alias("html"))

    def kernel():
        def run(part: dict) -> dict:
            texts = [render(p) for p in part["html"].to_pylist()]
            return {"page_id": part["page_id"], "text": texts, "n_lines": [t.count("\n") + bool(t) for t in texts]}

        return run

    return map_slices(rows, kernel, f"page_id {type_of(pages, page_id)}, text string, n_lines long")


def op4(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
