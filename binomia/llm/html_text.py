"""HTML extraction: a tree with implied tags, visibility rules, and a layout that keeps blocks, lists and tables.

The page becomes a tree: void elements, optional end tags and tags that close others are filled in as
browsers do, and what stands in a table outside its cells moves before the table. What is not displayed
is dropped: scripts, heads, templates, the hidden attribute, and styles (inline or by simple selectors of
the page's style elements) that say display:none. Hidden visibility is inherited, until an element below
says it is visible. What is left is laid out as text: white space collapses, blocks stand on lines of
their own, paragraphs apart, list items carry bullets or numbers and are indented by level. The cells of
a table are laid out in lines like a page, and padded to the width of their column.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from binomia.llm.common import map_batches, needed

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "head script style template noscript title iframe object audio video canvas datalist rp noembed noframes"
    " defs desc metadata symbol annotation annotation-xml".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody thead tfoot tr ul"
    " select optgroup option textarea text foreignobject".split()
)
#: Blocks with an empty line before and after.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
FOREIGN = frozenset(("svg", "math"))
#: Elements that hold rows or cells, and nothing else.
_TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
#: Where an element of a table belongs: the nearest of these that is open.
_BELONGS = {
    "td": {"tr", "tbody", "thead", "tfoot", "table"},
    "th": {"tr", "tbody", "thead", "tfoot", "table"},
    "tr": {"tbody", "thead", "tfoot", "table"},
    **dict.fromkeys(("tbody", "thead", "tfoot", "caption", "colgroup", "col"), {"table"}),
}
#: What may stand in a table beside rows and cells.
_STAYS = frozenset(("style", "script", "template"))
_CELLS = {"table", "td", "th"}
#: An opening tag closes these open elements, up to the fence.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"} | _CELLS),
    "dt": ({"dt", "dd"}, {"dl"} | _CELLS),
    "dd": ({"dt", "dd"}, {"dl"} | _CELLS),
    "option": ({"option"}, {"select", "optgroup"} | _CELLS),
    "optgroup": ({"option", "optgroup"}, {"select"} | _CELLS),
    "body": ({"head"}, {"html"}),
}
#: A paragraph ends where one of these begins.
_ENDS_P = BLOCK - set("li dt dd tr tbody thead tfoot caption html body legend summary select optgroup option textarea text foreignobject".split())
#: Input elements that show their value.
_SHOWS_VALUE = frozenset("text search url email tel number date month week time datetime-local submit reset button".split())
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_SIMPLE = re.compile(r"[.#]?[A-Za-z_][\w-]*$")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: Numbers in attributes, as far as 32 bits hold them.
_NUMBER = re.compile(r"[0-9]{1,9}$")
#: Spans browsers allow, and the width up to which cells are padded; wider ones run on.
MAX_COLSPAN, MAX_ROWSPAN, MAX_PAD = 1000, 65534, 120


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds the tree; the stack holds the open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.stack, self.css = [self.root], []
        self.any_foreign = False

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if self.any_foreign and tag in BLOCK and tag not in ("text", "foreignobject"):
            self._leave_foreign()
        if tag in _BELONGS:
            at = self._nearest(_BELONGS[tag])
            if not at:
                return
            del self.stack[at + 1 :]
            if tag in ("td", "th") and self.stack[-1].tag != "tr":
                self._open("tr", {})
        elif tag == "table" and self.stack[-1].tag in _TABLE_PARTS:
            self._end("table", set())
        elif tag in _CLOSES:
            closed, fence = _CLOSES[tag]
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in fence:
                    break
                if self.stack[k].tag in closed:
                    del self.stack[k:]
                    break
        if tag in _ENDS_P:
            self._end("p", {"li", "button", "caption"} | _CELLS)
        if tag in BLOCK and self.stack[-1].tag == "head":
            self.stack.pop()
        form = tag == "form" and self.stack[-1].tag in _TABLE_PARTS
        self._open(tag, {k: v or "" for k, v in attrs})
        if tag in VOID or form:
            self.stack.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # only foreign elements can close themselves
        if self.any_foreign and self.stack[-1].tag == tag and tag not in VOID and any(n.tag in FOREIGN for n in self.stack):
            self.stack.pop()

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and not self._nearest({"p"}, _CELLS):
            self._open("p", {})
            self.stack.pop()
        elif tag not in VOID and tag not in ("html", "body"):
            self._end(tag, {"table"} - {tag})

    def handle_data(self, data):
        if self.stack[-1].tag == "style":
            self.css.append(data)
        if self.stack[-1].tag == "head" and data.strip():
            self.stack.pop()
        self._insert(data)

    def parse_marked_section(self, i, report=1):
        """A marked section of any name is skipped as browsers do, not an error."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def _nearest(self, tags, fence=frozenset(("table",))) -> int:
        """Place of the nearest open element of these tags, looking no further than the fence; 0 if none is open."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                return k
            if self.stack[k].tag in fence:
                return 0
        return 0

    def _leave_foreign(self):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in FOREIGN:
                del self.stack[k:]
                return
            if self.stack[k].tag in ("foreignobject", "desc", "table", "td", "th"):
                return

    def _insert(self, item):
        """Put a node or text below the open element; before the table where a table has no place for it."""
        top = self.stack[-1]
        if top.tag in _TABLE_PARTS:
            stray = item.strip() if isinstance(item, str) else item.tag not in _BELONGS and item.tag not in _STAYS and item.tag != "form"
            if stray:
                at = len(self.stack) - 1
                while self.stack[at].tag != "table":
                    at -= 1
                table, beside = self.stack[at], self.stack[at - 1].children
                place = len(beside) - 1
                while beside[place] is not table:
                    place -= 1
                beside.insert(place, item)
                return
        top.children.append(item)

    def _open(self, tag, attrs):
        node = Node(tag, attrs)
        self.any_foreign = self.any_foreign or tag in FOREIGN
        self._insert(node)
        self.stack.append(node)

    def _end(self, tag, fence):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in fence:
                return


def styles(css: list[str]) -> dict[str, list[tuple]]:
    """Declarations of display and visibility by simple selector (tag, .class, #id): (weight, property, value)."""
    found: dict[str, list[tuple]] = {}
    for order, (selectors, rule) in enumerate(_RULE.findall(re.sub(r"/\*.*?\*/", "", " ".join(css), flags=re.S))):
        declared = _STYLE.findall(rule)
        for selector in selectors.split(",") if declared else ():
            selector = selector.strip()
            if _SIMPLE.match(selector):
                rank = {"#": 2, ".": 1}.get(selector[0], 0)
                found.setdefault(selector, []).extend(((bool(must), rank, order), name.lower(), value.lower()) for name, value, must in declared)
    return found


def shown(node: Node, rules: dict[str, list[tuple]], inherited: bool) -> tuple[bool, bool]:
    """Whether a node is displayed, and whether what stands in it is visible."""
    if node.tag in UNSEEN or (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden"):
        return False, False
    display = "none" if "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs) else ""
    inline = node.attrs.get("style", "")
    if not rules and not inline:
        return display != "none", inherited
    names = (node.tag, *(f".{c}" for c in node.attrs.get("class", "").split()), f"#{node.attrs.get('id', '')}")
    matched = [d for name in names for d in rules.get(name, ())]
    matched += [((bool(must), 3, 0), name.lower(), value.lower()) for name, value, must in _STYLE.findall(inline)]
    state = {"display": display, "visibility": ""}
    for _, name, value in sorted(matched, key=lambda d: d[0]):
        state[name] = value
    if state["visibility"] in ("hidden", "collapse"):
        inherited = False
    elif state["visibility"] in ("visible", "initial"):
        inherited = True
    return state["display"] != "none", inherited


def prune(root: Node, rules: dict[str, list[tuple]]) -> list[Node]:
    """Take what is not visible out of the tree; returns its tables, outer ones first."""
    tables, work = [], [(root, True)]
    while work:
        node, visible = work.pop()
        if node.tag == "table":
            tables.append(node)
        kept = []
        for child in node.children:
            if isinstance(child, str):
                if visible:
                    kept.append(child)
                continue
            displayed, seen = shown(child, rules, visible)
            if not displayed:
                continue
            if not seen:
                child.attrs = {k: v for k, v in child.attrs.items() if k not in ("alt", "value", "label")}
            kept.append(child)
            work.append((child, seen))
        node.children = kept
    return tables


def own_text(node: Node) -> str:
    """Text that an element shows by its attributes."""
    if node.tag == "img" or (node.tag == "input" and node.attrs.get("type", "").lower() == "image"):
        return node.attrs.get("alt", "")
    if node.tag == "input" and (node.attrs.get("type") or "text").lower() in _SHOWS_VALUE:
        return node.attrs.get("value", "")
    return node.attrs.get("label", "") if node.tag == "optgroup" else ""


def _span(node: Node, name: str, least: int, most: int) -> int:
    value = node.attrs.get(name, "1").strip()
    return min(max(int(value), least), most) if _NUMBER.match(value) else 1


class Layout:
    """Lays a pruned tree out as lines. Nesting of any depth is walked with a stack of its own.

    `tables` holds the lines of the tables below the root, by node.
    """

    def __init__(self, tables: dict[int, list[str]]):
        self.tables = tables
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.indent, self.mark = False, 0, ""

    def add(self, text: str, pre: bool = False) -> None:
        if pre:
            first, *rest = text.split("\n")
            self.line.append(first)
            for line in rest:
                self.end(keep=True)
                self.line.append(line)
            return
        text = _SPACE.sub(" ", text)
        if not self.line or self.line[-1].endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.line.append(text)

    def end(self, apart: bool = False, keep: bool = False) -> None:
        """End the line; apart: an empty line shall follow."""
        text = "".join(self.line).rstrip()
        self.line = []
        if text or keep:
            if self.gap and self.lines and self.lines[-1] != "":
                self.lines.append("")
            self.gap = False
            self.lines.append("  " * max(self.indent - (1 if self.mark else 0), 0) + self.mark + text if text else "")
            if self.mark:
                self.mark = ""
        self.gap = self.gap or apart

    def lay(self, root: Node) -> list[str]:
        work: list = [(root, False)]
        counters: list[int | None] = []
        pre = 0
        while work:
            item, leaving = work.pop()
            if isinstance(item, str):
                self.add(item, pre > 0)
                continue
            tag = item.tag
            if leaving:
                if tag in BLOCK:
                    self.end(tag in APART and not (tag in ("ul", "ol") and len(counters) > 1))
                if tag in ("ul", "ol", "menu", "dir"):
                    counters.pop()
                    self.indent -= 1
                elif tag in ("blockquote", "dd"):
                    self.indent -= 1
                elif tag == "li":
                    self.mark = ""
                elif tag in ("pre", "textarea"):
                    pre -= 1
                continue
            if tag == "br":
                self.end(keep=True)
            elif tag == "hr":
                self.end()
                self.line.append("---")
                self.end()
            elif tag in ("img", "input"):
                self.add(own_text(item))
            elif tag == "table":
                self.end(True)
                for row in self.tables[id(item)]:
                    self.line.append(row)
                    self.end(keep=True)
                self.end(True)
            else:
                if tag in BLOCK:
                    self.end(tag in APART and not (tag in ("ul", "ol") and counters))
                if tag in ("ul", "ol", "menu", "dir"):
                    start = item.attrs.get("start", "1")
                    counters.append(int(start) if tag == "ol" and _NUMBER.match(start) else 1 if tag == "ol" else None)
                    self.indent += 1
                elif tag in ("blockquote", "dd"):
                    self.indent += 1
                elif tag == "li":
                    if counters and counters[-1] is not None:
                        self.mark = f"{counters[-1]}. "
                        counters[-1] += 1
                    else:
                        self.mark = "- "
                elif tag in ("pre", "textarea"):
                    pre += 1
                elif tag == "optgroup":
                    self.add(own_text(item))
                    self.end()
                work.append((item, True))
                work += [(c, False) for c in reversed(item.children)]
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def table_lines(root: Node, tables: dict[int, list[str]]) -> list[str]:
    """The lines of a table: captions, then rows whose cells are padded to their columns.

    A cell stands in the first column that no cell of a row above reaches into.
    """
    head: list[str] = []
    rows: list[dict[int, list[str]]] = []
    wide: dict[int, int] = {}
    sections: list[list[Node]] = []
    direct: list[Node] | None = None
    for node in root.children:
        if isinstance(node, str):
            continue
        if node.tag == "caption":
            head += Layout(tables).lay(node)
        elif node.tag == "tr":
            if direct is None:
                direct = []
                sections.append(direct)
            direct.append(node)
        else:
            direct = None
            sections.append([c for c in node.children if isinstance(c, Node) and c.tag == "tr"])
    for section in sections:
        reach: dict[int, int] = {}
        for at, row in enumerate(section):
            cells, column = {}, 0
            for cell in row.children:
                if isinstance(cell, str) or cell.tag not in ("td", "th"):
                    continue
                while reach.get(column, 0) > at:
                    column += 1
                across, down = _span(cell, "colspan", 1, MAX_COLSPAN), _span(cell, "rowspan", 0, MAX_ROWSPAN)
                lines = Layout(tables).lay(cell)
                cells[column] = lines
                if lines and across == 1:
                    wide[column] = max(wide.get(column, 0), min(max(map(len, lines)), MAX_PAD))
                if down != 1:
                    for k in range(column, column + across):
                        reach[k] = at + down if down else len(section)
                column += across
            rows.append(cells)
    starts, place = {}, 0
    for column in range(max((max(r) for r in rows if r), default=-1) + 1):
        starts[column] = place
        place += wide[column] + 2 if wide.get(column) else 0
    out = [h for h in head if h]
    for cells in rows:
        for k in range(max(map(len, cells.values()), default=0)):
            line = ""
            for column, lines in cells.items():
                if k < len(lines) and lines[k]:
                    line = (line.ljust(starts[column]) if len(line) + 2 <= starts[column] or not line else line + "  ") + lines[k]
            out.append(line.rstrip())
    return out


def rendered(html: str) -> str:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    tables: dict[int, list[str]] = {}
    for table in reversed(prune(builder.root, styles(builder.css))):
        tables[id(table)] = table_lines(table, tables)
    return "\n".join(Layout(tables).lay(builder.root))


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines of every row of pages (page_id, html).

    A null page gives a null text and zero counts, an empty or broken one what can be read of it; every
    row gives one row, repeated and null ids too; other columns are ignored; an empty table gives an
    empty one. Pages of any length and depth are read whole.
    """

    def run(batch):
        texts = [None if v.as_py() is None else rendered(v.as_py()) for v in batch.column("html")]
        yield {
            "page_id": batch.column("page_id"),
            "text": texts,
            "n_chars": [len(t or "") for t in texts],
            "n_lines": [t.count("\n") + 1 if t else 0 for t in texts],
        }

    return map_batches(needed(pages, "page_id", "html"), run, "page_id long, text string, n_chars long, n_lines long")
