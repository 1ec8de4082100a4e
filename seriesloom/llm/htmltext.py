"""Text of HTML pages, laid out: a tree with implied tags, visibility, and a rendering of blocks, lists and tables.

Start tags close what HTML says they close (a paragraph before a block, a list item before the next, cells, rows, options, a head
before anything that doesn't belong there, text too),
void elements have no content, and end tags close what stands open inside. Nothing is shown of head matter, scripts, styles,
templates, input values, suggestions (datalist) and what stands in for frames and media, nor of elements that are hidden by
attribute, inline style or the page's own style sheets (rules for an element's name, classes and id, not for its surroundings, and none
inside at-rules); what is visible again inside of something invisible is shown. Options, text areas, formulas, the text of drawings, and what
stands in for objects are shown.
Rows and cells end what stands open in their table and imply a row; what else stands in a table or row, outside of cells
and captions, is shown before the table. Blocks begin on lines of their own,
paragraphs, headings, lists and tables are set off by an empty line, items have bullets or numbers, and the cells of a
table are padded to columns, of 200 characters at most (a longer cell pushes its row to the right). White space is collapsed but in ``pre``.

Defined results: null for a null page; an empty text for one that shows nothing; elements nested deeper than 200 are
laid out as if they stood in the one at that depth, so no page exhausts the stack; behind a tag that never ends, tags end at the next
``>``, whatever the quotes, and where there is none all is text; time and memory are in proportion to a page, of any length.
Pages are independent of each other, so ties and repeated pages have no effect; an empty table gives an empty result; other columns, of any
name, are kept by :func:`extract`, but the text takes the place of a column of its name.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import columns_of, table, whole_row

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTES = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+(?=>)")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NUMBER = re.compile(r"\s*(-?\d+)")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SELECTOR = re.compile(r"(\*|[a-zA-Z][a-zA-Z0-9-]*)?((?:[.#][\w-]+)*)")
DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([a-z-]+)", re.I)
VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*([a-z-]+)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("head script style template title noembed noframes iframe datalist audio video canvas annotation annotation-xml".split())
#: Of a drawing, what is drawn only elsewhere or not at all; and what shows text.
UNDRAWN, DRAWN = frozenset("defs symbol clippath mask pattern marker desc metadata".split()), frozenset("text foreignobject".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
CLOSES_P = BLOCK - {"html", "body", "li", "dd", "dt", "legend", "summary", "figcaption", "option", "optgroup"}
#: A start tag of the first kind ends an open element of the second, unless one of the third stands between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "thead": (("thead", "tbody", "tfoot"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)), "body": (("head",), ()),
}
#: Start tags that leave an open head open; any other, and text, ends it.
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
#: What a table, and its groups and rows, hold; and which of these a part of a table is put into, where they stand open.
GROUPS = ("thead", "tbody", "tfoot")
PARTS = {"caption": (), "colgroup": (), "col": ("colgroup",), **dict.fromkeys(GROUPS, ()), "tr": GROUPS, "td": ("tr", *GROUPS), "th": ("tr", *GROUPS)}
BETWEEN_CELLS = frozenset(("table", "tr", "colgroup", *GROUPS))
KEPT_BETWEEN = frozenset("script style template".split())
DEEPEST, WIDEST = 200, 200


class Node:
    """An element. shown is False where nothing in it is; visible is None where it is as its surroundings are."""

    __slots__ = ("tag", "attrs", "inside", "shown", "visible")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.inside, self.visible = tag, [], None
        self.shown = tag not in SILENT
        self.attrs: dict[str, str] = {}
        if attrs:
            for m in ATTRIBUTE.finditer(attrs):
                self.attrs.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            if self.shown:
                self.style([self.attrs["style"]] if "style" in self.attrs else [])

    def style(self, declared: list[str]) -> None:
        """Applies declarations, the weightiest last."""
        display = visible = None
        for css in declared:
            display = (DISPLAY.findall(css) or [display])[-1]
            visible = (VISIBILITY.findall(css) or [visible])[-1]
        self.shown = display.lower() != "none" if display else "hidden" not in self.attrs
        self.visible = None if visible is None else visible.lower() not in ("hidden", "collapse")

    def number(self, name: str) -> int | None:
        m = NUMBER.match(self.attrs.get(name, ""))
        return int(m[1][:9]) if m else None


class Rule:
    """A selector of one element, by name, id and classes, and its declarations."""

    def __init__(self, name: str, marks: str, css: str, order: int):
        named = re.findall(r"([.#])([\w-]+)", marks)
        self.name, self.css = name.lower() if name and name != "*" else "", css
        self.ids, self.classes = ({x for k, x in named if k == kind} for kind in "#.")
        self.weight = (len(self.ids), len(self.classes), bool(self.name), order)

    def fits(self, node: Node, classes: set[str]) -> bool:
        return (not self.name or self.name == node.tag) and self.classes <= classes and self.ids <= {node.attrs.get("id")}


def rules_of(css: str) -> list[Rule]:
    css, at, found = COMMENT.sub(" ", css), 0, []
    while (start := css.find("{", at)) >= 0:
        names, depth, end = css[at:start].rsplit(";", 1)[-1].strip(), 1, start + 1
        if names.startswith("@"):
            for m in re.compile("[{}]").finditer(css, end):
                depth += 1 if m[0] == "{" else -1
                end = m.end()
                if not depth:
                    break
            at = end if not depth else len(css)
            continue
        end = css.find("}", start)
        end = len(css) if end < 0 else end
        declared, at = css[start + 1 : end], end + 1
        if DISPLAY.search(declared) or VISIBILITY.search(declared):
            for name in names.split(","):
                m = SELECTOR.fullmatch(name.strip())
                if m and m[0]:
                    found.append(Rule(m[1], m[2], declared, len(found)))
    return sorted(found, key=lambda r: r.weight)


def styled(root: Node, rules: list[Rule]) -> None:
    """Applies style sheets to the tree; rules are looked up by name, class and id."""
    by: dict[str, list[Rule]] = {}
    for r in rules:
        key = f"#{min(r.ids)}" if r.ids else f".{min(r.classes)}" if r.classes else r.name
        by.setdefault(key, []).append(r)
    todo = [root]
    while todo:
        node = todo.pop()
        todo += [x for x in node.inside if isinstance(x, Node)]
        if node.tag in SILENT:
            continue
        classes = set(node.attrs.get("class", "").split())
        keys = ["", node.tag, *(f".{c}" for c in classes), f"#{node.attrs.get('id')}"]
        found = sorted((r for k in keys for r in by.get(k, ()) if r.fits(node, classes)), key=lambda r: r.weight)
        if found:
            node.style([*(r.css for r in found), *([node.attrs["style"]] if "style" in node.attrs else [])])


class Stack:
    """The open elements. Below DEEPEST, what stands in an element that is shown goes to the one it stands in."""

    def __init__(self, root: Node):
        self.nodes, self.open = [root], Counter([root.tag])

    def push(self, node: Node) -> None:
        if len(self.nodes) >= DEEPEST and node.shown:
            node, outer = Node(node.tag), self.top.inside  # what stands for it here; it stays empty in the tree
            node.inside = outer
        self.nodes.append(node)
        self.open[node.tag] += 1

    def cut(self, i: int) -> None:
        for k, node in enumerate(self.nodes[i:], i):
            self.open[node.tag] -= 1
            if k >= DEEPEST and node.tag in BLOCK:  # what follows it begins a line
                node.inside.append(Node("p" if node.tag in SPACED else "div"))
        del self.nodes[i:]

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def add(self, x: Node | str) -> None:
        self.top.inside.append(x)

    def end_head(self) -> None:
        """Closes a head that is the open element, and begins the body that is implied then."""
        self.cut(len(self.nodes) - 1)
        if not self.open["body"]:
            body = Node("body")
            self.add(body)
            self.push(body)

    def table(self) -> int:
        """The place of the innermost open table, or 0."""
        return next((i for i in range(len(self.nodes) - 1, 0, -1) if self.nodes[i].tag == "table"), 0) if self.open["table"] else 0

    def before_table(self, x: Node | str) -> None:
        """Puts x, which no table, group or row holds, before the innermost table; an open one is the last its parent holds."""
        at = self.table()
        (self.nodes[at - 1].inside.insert(-1, x) if at else self.add(x))

    def close(self, tag: str) -> None:
        """An end tag: closes the innermost element of its name, but none outside of a cell or table, unless it ends those."""
        if not self.open[tag]:
            return
        for i in range(len(self.nodes) - 1, 0, -1):
            if self.nodes[i].tag == tag:
                return self.cut(i)
            if self.nodes[i].tag in ("td", "th", "table") and tag not in ("tr", "table", "tbody", "thead", "tfoot", "body", "html"):
                return

    def imply(self, tag: str) -> None:
        """Closes what a start tag ends."""
        ends, fence = IMPLIED.get(tag, ((), ()))
        if tag in CLOSES_P:
            ends, fence = (*ends, "p"), (*fence, "td", "th", "button", "table")
        if any(self.open[t] for t in ends):
            for i in range(len(self.nodes) - 1, 0, -1):
                if self.nodes[i].tag in ends:
                    return self.cut(i)
                if self.nodes[i].tag in fence:
                    return


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes); kinds are text, start, end, and raw for the text behind the start of an element without tags in it."""
    at, size, quotes, ends = 0, len(page), True, True
    while at < size:
        if page[at] != "<" or not ends:
            stop = page.find("<", at) if ends else -1
            text, at = page[at : stop if stop >= 0 else size], stop if stop >= 0 else size
            yield "text", text, ""
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else size
            continue
        name = NAME.match(page, at)
        if name is None and page[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            yield "text", "<", ""
            continue
        begin = name.end() if name else at + 1
        attributes = ATTRIBUTES.match(page, begin) if quotes and name else None
        if attributes is None:
            quotes = quotes and name is None
            stop = page.find(">", begin)
        else:
            stop = attributes.end()
        if stop < 0:
            ends = False
            continue
        at = stop + 1
        if name:
            tag = name[2].lower()
            yield "end" if name[1] else "start", tag, page[begin:stop]
            if not name[1] and tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                raw = page[at : end.start() if end else size]
                stop = page.find(">", end.end()) if end else -1
                at = stop + 1 if stop >= 0 else size
                yield "raw", raw, ""


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree, and the texts of its style sheets."""
    root, sheets = Node("html"), []
    stack = Stack(root)
    for kind, tag, attrs in tokens(page):
        top = stack.top
        if kind == "raw":  # follows the start tag of what it stands in
            node.inside.append(html.unescape(tag.removeprefix("\n")) if node.tag == "textarea" else tag)
            if node.tag == "style":
                sheets.append(tag)
            continue
        if kind == "text":
            blank = SPACE.fullmatch(tag)
            if top.tag == "head" and not blank:
                stack.end_head()
            text = tag if "&" not in tag else html.unescape(tag)
            if stack.top.tag in BETWEEN_CELLS and not SPACE.fullmatch(text):
                stack.before_table(text)
            else:
                stack.add(text)
            continue
        if kind == "end":
            if tag == "p" and not stack.open["p"]:
                stack.add(Node("p"))
            stack.close(tag)
            continue
        node = Node(tag, attrs)
        if tag in ("html", "body") and len(stack.nodes) > 1 and stack.open[tag]:
            continue
        if tag == "head" and (stack.open["head"] or stack.open["body"]):
            continue
        if top.tag == "head" and tag not in IN_HEAD and tag not in ("html", "body"):
            stack.end_head()
        table_at, fostered = stack.table() if tag in PARTS or stack.top.tag in BETWEEN_CELLS else 0, False
        if table_at and tag in PARTS:
            stack.cut(next((i for i in range(len(stack.nodes) - 1, table_at, -1) if stack.nodes[i].tag in PARTS[tag]), table_at) + 1)
            if tag in ("td", "th") and stack.top.tag != "tr":
                row = Node("tr")
                stack.add(row)
                stack.push(row)
        elif table_at and tag == "table":
            stack.cut(table_at)
        elif table_at and tag not in KEPT_BETWEEN:
            if tag == "form":
                continue
            fostered = True
        stack.imply(tag)
        stack.before_table(node) if fostered and stack.top.tag in BETWEEN_CELLS else stack.add(node)
        if tag not in RAW and tag not in VOID and not attrs.endswith("/"):
            stack.push(node)
    return root, sheets


class Page:
    """Lines in the making: text is added inline; blocks end lines."""

    def __init__(self):
        self.lines, self.now, self.gap = [], [], False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            self.flush_gap()
            first, *rest = s.split("\n")
            self.add(first)
            for line in rest:
                self.end_line(forced=True)
                self.add(line)
            return
        s = SPACE.sub(" ", s)
        if s[:1] == " " and (not self.now or self.now[-1][-1] == " "):
            s = s[1:]
        if s:
            self.flush_gap()
            self.add(s)

    def add(self, s: str) -> None:
        if s:
            self.now.append(s)

    def flush_gap(self) -> None:
        if self.gap:
            if self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False

    def end_line(self, forced: bool = False) -> None:
        line = "".join(self.now)
        if forced or line.strip():
            self.lines.append(line.rstrip())
        self.now = []

    def space(self) -> None:
        self.end_line()
        self.gap = True

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def seen_in(node: Node) -> bool:
    """Whether something in an invisible element is visible again."""
    return any(isinstance(x, Node) and x.shown and (x.visible or seen_in(x)) for x in node.inside)


def drawn(node: Node) -> Iterator[Node]:
    """The elements of a drawing that show text."""
    for x in node.inside:
        if isinstance(x, Node) and x.shown and x.tag not in UNDRAWN:
            if x.tag in DRAWN:
                yield x
            else:
                yield from drawn(x)


def lay_out(node: Node, page: Page, pre: bool = False, bullet: list | None = None, seen: bool = True) -> None:
    """Adds what node holds to page. bullet: whether the list is numbered, and the next number; seen: whether text is visible."""
    for x in node.inside:
        if isinstance(x, str):
            if seen:
                page.text(x, pre)
            continue
        if x.tag == "br":
            if seen:
                page.flush_gap()
                page.end_line(forced=True)
            continue
        visible = seen if x.visible is None else x.visible
        if not x.shown or not visible and not seen_in(x):
            continue
        if x.tag == "svg":
            for text in drawn(x):
                page.text(" ", pre)
                lay_out(text, page, pre, seen=visible)
                page.text(" ", pre)
        elif x.tag == "table":
            page.space()
            for line in table_lines(x, visible):
                page.flush_gap()
                page.lines.append(line)
            page.space()
        elif x.tag in BLOCK:
            page.space() if x.tag in SPACED and bullet is None else page.end_line()
            if x.tag in ("ul", "ol", "menu", "dir"):
                start = x.number("start")
                lay_out(x, page, pre, [x.tag == "ol", 1 if start is None else start], visible)
            elif x.tag == "li":
                inner = Page()
                lay_out(x, inner, pre, [False, 1], visible)
                lines = [line for line in inner.done() if line or pre]
                mark = f"{bullet[1]}. " if bullet and bullet[0] else "- "
                if bullet:
                    bullet[1] += 1
                page.flush_gap()
                page.lines += [mark + lines[0] if lines else mark.rstrip(), *(" " * len(mark) + line for line in lines[1:])]
            else:
                lay_out(x, page, pre or x.tag == "pre", None if x.tag in ("td", "th") else bullet if x.tag in ("div", "section") else None, visible)
            page.space() if x.tag in SPACED and bullet is None else page.end_line()
        else:
            lay_out(x, page, pre or x.tag == "textarea", bullet, visible)


def rows_of(node: Node) -> Iterator[Node]:
    for x in node.inside:
        if isinstance(x, Node) and x.shown:
            if x.tag in ("thead", "tbody", "tfoot"):
                yield from rows_of(x)
            elif x.tag == "tr":
                yield x


def table_lines(node: Node, seen: bool = True) -> list[str]:
    head, rows = [], []
    loose = Node("div")
    for x in node.inside:
        if isinstance(x, str) or x.tag not in ("thead", "tbody", "tfoot", "tr", "colgroup", "col"):
            loose.inside.append(x)
    page = Page()
    lay_out(loose, page, seen=seen)
    head = page.done()
    for tr in rows_of(node):
        cells = []
        for td in tr.inside:
            if isinstance(td, Node) and td.shown and td.tag in ("td", "th"):
                inner = Page()
                visible = next((x for x in (td.visible, tr.visible) if x is not None), seen)
                lay_out(td, inner, seen=visible)
                cells += [[line for line in inner.done() if line], *([[]] * (min(td.number("colspan") or 1, 100) - 1))]
        rows.append(cells)
    widths = [max((len(line) for r in rows if i < len(r) for line in r[i]), default=0) for i in range(max(map(len, rows), default=0))]
    out = []
    for r in rows:
        for k in range(max((len(c) for c in r), default=0)):
            out.append("  ".join((c[k] if k < len(c) else "").ljust(min(w, WIDEST)) for c, w in zip(r, widths, strict=False)).rstrip())
    return head + out


def text_of(page: str | None) -> str | None:
    if page is None:
        return None
    root, sheets = parse(page)
    if sheets and (rules := rules_of("\n".join(sheets))):
        styled(root, rules)
    out = Page()
    lay_out(root, out)
    return "\n".join(out.done())


def extract(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages without html_col, with its text in out_col (in place of a column of that name)."""
    others = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in (html_col, out_col)))
    kept = pages.select(whole_row(others) if others.columns else F.lit(None).cast("int").alias("row"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_of(x.as_py()) for x in b.column(1)], pa.string())], names=["row", "text"])

    done = kept.mapInArrow(run, f"row {kept.schema['row'].dataType.simpleString()}, text string")
    return done.select(*columns_of(others), F.col("text").alias(out_col))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
