"""HTML to text by layout: a tree with implied tags, visibility rules, then block spacing, lists and aligned tables.

The tree builder closes and opens what HTML lets an author leave out (p, li, dt/dd, option, tr, td/th, table parts, head and body). Hidden are elements that
never show (script, style, template, head's own, what a drawing only defines and nowhere uses), the attribute `hidden`, display:none and visibility:hidden (a descendant may be
visible again) by inline styles or by rules of the page's style elements that name one element, class or id, and closed dialogs and details (but for the summary). Scripts aren't run,
so noscript is shown; other rules and style sheets elsewhere are not read, nor are rules for media other than a screen of SCREEN pixels. All other text is in the result, whole. Blocks start a line, paragraphs and headings stand between
blank lines, list items have a bullet or number and an indent (of at most MOST_INDENT columns), rows of a table are a line each with cells padded to their column (cells wider than WIDE are
not waited for, nothing is padded beyond column MOST_PADDED, a column in which no cell begins takes no room), cells that span rows keep their columns in the rows below;
tables in more than MOST_TABLES tables are laid out as blocks. Preformatted text keeps its white space. Images give their alternative text. Forms give what their fields show: the value or else the
placeholder of an input (not of hidden, password, check and file fields), all options, the content of a textarea. Of drawings and formulas the text is given, each label of a
drawing on a line. In them a slash ends an element, and tags that can only be HTML end them.

Null and empty pages give the empty text. Repeated rows give repeated results; other columns are not read; an empty table gives no rows. Nesting is worked off
without recursion and open elements are found by their name, so time and output are in proportion to the page, however deep or broken its markup.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from provenant.llm.common import map_arrow

#: Element classes as the HTML standard has them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER_SHOWN = set("head title script style template noframes datalist iframe object audio video canvas".split())
#: Never shown in drawings and formulas.
UNSEEN = set("desc metadata annotation annotation-xml".split())
#: Drawn only where something uses them.
DEFINED = set("defs symbol clippath mask pattern marker".split())
FOREIGN = {"svg", "math"}
#: Foreign elements whose content is HTML.
HTML_INSIDE = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Start tags that end foreign content.
BREAKS_OUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Fields that show no text of theirs.
NO_CAPTION = set("hidden password checkbox radio file range color".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol optgroup option p plaintext pre search section select summary table textarea caption tbody thead tfoot tr ul".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl menu dir table pre plaintext figure fieldset hr".split())
HEAD_ONLY = set("base link meta title style script template noscript".split())
#: An open element that a start tag closes, if no barrier stands between.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"},
    "thead": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"},
}
BARRIER = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
P_ENDS = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p plaintext pre search section summary table ul".split())
SCOPE = set("table td th caption button object html body".split())
WIDE = 40
#: Columns of the deepest indent, columns up to which cells are padded, and tables in one another that are aligned.
MOST_INDENT, MOST_PADDED, MOST_TABLES = 40, 400, 6
#: Columns in which a cell that spans rows keeps its place; text further right is beyond MOST_PADDED, so not aligned in any case.
MOST_TALL = 200


class Node:
    __slots__ = ("before", "children", "props", "tag")

    def __init__(self, tag: str, props: dict[str, str | None]):
        self.tag, self.props, self.children = tag, props, []
        self.before: object = None  # what the renderer puts back at the element's end


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.used: set[str] = set()  # ids that a drawing uses
        self.open = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}  # where the open elements of a name are
        self.styles: list[str] = []
        self.marks: list[int] = []  # where drawings, formulas and HTML in them begin among the open elements

    def _push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _pop_to(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()
        while self.marks and self.marks[-1] >= at:
            self.marks.pop()

    def _last(self, names: set[str]) -> int:
        """The place of the innermost open element of these names; 0 if none is open (the root never closes)."""
        found, places = 0, self.places
        for name in names:
            if (own := places.get(name)) and own[-1] > found:
                found = own[-1]
        return found

    def _close(self, names: set[str], barrier: set[str]) -> None:
        while (at := self._last(names)) and at > self._last(barrier):
            tag = self.open[at].tag
            self._pop_to(at)
            names = names - {tag} if tag in ("td", "th", "tr") else names

    def _enter(self, tag: str, props: dict) -> None:
        node = Node(tag, props)
        self.open[-1].children.append(node)
        if tag not in VOID:
            if tag in FOREIGN:
                self.marks.append(len(self.open))
            self._push(node)

    def _foreign(self) -> int:
        """Where the drawing or formula begins that the next tag is in; 0 for HTML."""
        return self.marks[-1] if self.marks and self.open[self.marks[-1]].tag in FOREIGN else 0

    def _in_textarea(self) -> bool:
        return self.open[-1].tag == "textarea" and not self._foreign()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self._in_textarea():
            self.open[-1].children.append(self.get_starttag_text())
            return
        props = dict(attrs)
        if at := self._foreign():
            if tag not in BREAKS_OUT:
                if tag == "use":
                    self.used.add((props.get("href") or props.get("xlink:href") or "").removeprefix("#"))
                node = Node(tag, props)
                self.open[-1].children.append(node)
                if tag in FOREIGN or tag in HTML_INSIDE:
                    self.marks.append(len(self.open))
                self._push(node)
                return
            while at := self._foreign():
                self._pop_to(at)
        if tag == "html":
            self.root.props = props | self.root.props
            return
        if tag == "body":
            self._close({"head"}, set())
            if self.places.get("body"):
                return
        elif len(self.open) == 2 and self.open[1].tag == "head" and tag not in HEAD_ONLY:
            self._pop_to(1)
        if tag in P_ENDS:
            self._close({"p"}, SCOPE)
        if tag in CLOSES:
            self._close(CLOSES[tag], BARRIER[tag])
        if tag[:1] == "h" and tag[1:] in tuple("123456") and re.fullmatch("h[1-6]", self.open[-1].tag):
            self._pop_to(len(self.open) - 1)
        # a cell implies its row
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._enter("tr", {})
        self._enter(tag, props)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        inside = not self._in_textarea() and (tag in FOREIGN or self._foreign() and tag not in BREAKS_OUT)
        self.handle_starttag(tag, attrs)  # a slash ends no element that isn't void, but for foreign ones
        if inside:
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if self._in_textarea() and tag != "textarea":
            self.open[-1].children.append(f"</{tag}>")
            return
        if tag == "p" and not self.places.get("p"):
            self._enter("p", {})
        if tag == "br":
            self._enter("br", {})
            return
        at = self._last({tag})
        if at and (tag in _ENDS_CELLS or at >= self._last(_CELLS)):
            self._pop_to(at)

    def handle_comment(self, data: str) -> None:
        if self._in_textarea():
            self.open[-1].children.append(f"<!--{data}-->")

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "style":
            if on_screen(self.open[-1].props.get("media") or ""):
                self.styles.append(data)
            return
        if len(self.open) == 2 and self.open[1].tag == "head" and data.strip():
            self._pop_to(1)
        self.open[-1].children.append(data)


#: End tags that end the cells they are around; others stay within their cell.
_ENDS_CELLS = set("table tr tbody thead tfoot body html".split())
_CELLS = {"td", "th", "table"}
_BRACE = re.compile(r"[{}]")
#: Media types of a screen, and at-rules whose rules count as if they stood alone.
ON_SCREEN, PLAIN_GROUPS = {"all", "screen"}, {"@layer", "@scope"}
#: Width in CSS pixels of the screen that a page is read on.
SCREEN = 1280
_WIDTH_RULE = re.compile(r"\(\s*(min|max)-width\s*:\s*(\d{1,6})px\s*\)")
_SELECTOR = re.compile(r"([a-z][a-z0-9]*|\*)?([.#][\w-]+)?", re.IGNORECASE)


@lru_cache(4096)
def _said(style: str) -> tuple[bool | None, bool | None]:
    """Whether declarations say that an element is displayed, and that it is visible; None where they don't say."""
    display = visibility = None
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        value = value.replace("!important", "").strip()
        if name.strip() == "display" and value:
            display = value != "none"
        elif name.strip() == "visibility" and value:
            visibility = value not in ("hidden", "collapse")
    return display, visibility


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds for a screen of SCREEN pixels. A query with other conditions than the width's doesn't: what it hides is shown."""

    def holds(query: str) -> bool:
        kind, *conditions = (x.strip() for x in re.split(r"\band\b", query))
        if kind.startswith("("):
            kind, conditions = "all", [kind, *conditions]
        words = kind.split()
        wanted = words[-1:] != [] and words[-1] in ON_SCREEN
        if words[:1] == ["not"]:
            return not wanted and not conditions
        widths = [_WIDTH_RULE.fullmatch(c) for c in conditions]
        return wanted and all(m and (int(m[2]) <= SCREEN if m[1] == "min" else int(m[2]) >= SCREEN) for m in widths)

    return not media.strip() or any(holds(q) for q in media.lower().split(","))


def _without_comments(css: str) -> str:
    parts, at = [], 0
    while (begin := css.find("/*", at)) >= 0:
        parts.append(css[at:begin])
        end = css.find("*/", begin + 2)
        if end < 0:  # goes on to the end
            return "".join(parts)
        at = end + 2
    return "".join([*parts, css[at:]])


def _rule_sets(css: str) -> list[tuple[str, str]]:
    """Selectors and declarations of the rules that hold on a screen, each brace looked at once. Rules within rules don't count; what isn't closed is closed at the end."""
    found, open_at, last = [], [], 0  # open_at: prelude, place behind the brace, whether it holds, whether it holds rules
    for brace in (*_BRACE.finditer(css), None):
        at = brace.start() if brace else len(css)
        if brace and brace[0] == "{":
            prelude = css[last:at].rpartition(";")[2].strip()
            holds, groups = open_at[-1][2:] if open_at else (True, True)
            if prelude.startswith("@"):
                name = re.split(r"[\s(]", prelude, maxsplit=1)[0].lower()
                rest = prelude[len(name) :]
                fits = name == "@media" and on_screen(rest) or name == "@supports" and not rest.strip().lower().startswith("not") or name in PLAIN_GROUPS
                open_at.append((prelude, at + 1, holds and groups and fits, True))
            else:
                open_at.append((prelude, at + 1, holds and groups, False))
        else:
            while open_at:
                prelude, begin, holds, groups = open_at.pop()
                if holds and not groups:
                    found.append((prelude, css[begin:at].partition("{")[0]))
                if brace:
                    break
        last = at + 1
    return found


def _rules(styles: list[str]) -> dict[str, tuple[bool | None, bool | None]]:
    """Selector -> what it says, for selectors of one element, class or id, or an element with one of these; later rules count."""
    found: dict[str, tuple[bool | None, bool | None]] = {}
    for selectors, body in _rule_sets(_without_comments("\n".join(styles))):
        said = _said(body)
        if said != (None, None):
            for one in selectors.split(","):
                if (one := one.strip()) and (m := _SELECTOR.fullmatch(one)):
                    name = (m[1] or "").lower().replace("*", "") + (m[2] or "")
                    old = found.get(name, (None, None))
                    found[name] = tuple(o if n is None else n for o, n in zip(old, said, strict=True))
    return found


def shown(node: Node, rules: dict[str, tuple[bool | None, bool | None]]) -> tuple[bool, bool | None]:
    """Whether an element is displayed, and what it says of its visibility (None: as its parent)."""
    if node.tag in NEVER_SHOWN or "hidden" in node.props or node.tag == "dialog" and "open" not in node.props:
        return False, None
    display = visibility = None
    if rules:
        names = ["", *(f".{c}" for c in (node.props.get("class") or "").split()), *([f"#{i}"] if (i := node.props.get("id")) else [])]
        for name in names:
            for key in (name, node.tag + name):
                if key in rules:
                    d, v = rules[key]
                    display, visibility = display if d is None else d, visibility if v is None else v
    if style := node.props.get("style"):
        d, v = _said(style)
        display, visibility = display if d is None else d, visibility if v is None else v
    return display is not False, visibility


def _caption(node: Node) -> str:
    """What an input shows."""
    kind = (node.props.get("type") or "text").strip().lower()
    if kind in NO_CAPTION:
        return ""
    if kind == "image":
        return node.props.get("alt") or ""
    return node.props.get("value") or ("" if kind in ("submit", "reset", "button") else node.props.get("placeholder") or "")


class _Sink:
    """Lines of text; white space collapses, blocks ask for line ends, paragraphs for a blank line."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # line ends owed: 1 for a block, 2 for a paragraph
        self.space = False
        self.indent = 0
        self.mark = ""

    def words(self, text: str) -> None:
        parts = text.split()
        if not parts:
            self.space = self.space or bool(text)
            return
        self._settle()
        if self.now and (self.space or text[0].isspace()):
            self.now.append(" ")
        self.now.append(" ".join(parts))
        self.space = text[-1].isspace()

    def _settle(self) -> None:
        if self.gap:
            self._flush()
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
        if not self.now and (self.indent or self.mark):
            room = min(self.indent, MOST_INDENT)
            self.now.append(" " * (room - len(self.mark)) + self.mark)
            self.mark = ""
            self.space = False
            self.now.append("")

    def _flush(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def block(self, gap: int) -> None:
        self.gap = max(self.gap, gap)
        self.space = False

    def line_break(self) -> None:
        self._settle()
        if not self.now:
            self.lines.append("")
        self._flush()

    def raw(self, text: str) -> None:
        for i, line in enumerate(text.split("\n")):
            if i:
                self._settle()
                self.lines.append("".join(self.now))
                self.now = []
            if line:
                self._settle()
                self.now.append(line)

    def text(self) -> str:
        self._flush()
        return "\n".join(self.lines).strip("\n")


def _width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else not unicodedata.combining(c) for c in text)


def _table(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of (text, columns spanned, rows spanned) as aligned lines; cells of several lines take as many. Columns are those in which some cell begins."""
    placed: list[list[tuple[list[str], int, int]]] = []  # lines, first column, column after the last
    taken: dict[int, int] = {}  # column -> rows that a cell above still takes
    for row in rows:
        at, cells, below = 0, [], {}
        for text, span, tall in row:
            while at in taken:
                at += 1
            cells.append((text.split("\n"), at, at + span))
            if tall > 1:
                below.update(dict.fromkeys(range(at, min(at + span, MOST_TALL)), tall))
            at += span
        taken = {c: n - 1 for c, n in {**taken, **below}.items() if n > 1}
        placed.append(cells)
    starts = sorted({first for cells in placed for _, first, _ in cells})
    index = {first: i for i, first in enumerate(starts)}
    widths = [0] * len(starts)
    for cells in placed:
        for lines, first, last in cells:
            if bisect.bisect_left(starts, last) == index[first] + 1:
                widths[index[first]] = max(widths[index[first]], min(WIDE, max(map(_width, lines))))
    ends = [0]  # where each column's room ends
    for width in widths:
        ends.append(ends[-1] + width + 2)
    out = []
    for cells in placed:
        for n in range(max((len(lines) for lines, _, _ in cells), default=0)):
            line: list[str] = []
            used = 0
            for lines, first, _ in cells:
                text = lines[n] if n < len(lines) else ""
                if not text:
                    continue
                room = min(ends[index[first]], MOST_PADDED)
                pad = max(room - used, 2 if used else 0)
                line += [" " * pad, text]
                used += pad + _width(text)
            out.append("".join(line).rstrip())
    return out


def _span(node: Node, name: str, most: int) -> int:
    value = (node.props.get(name) or "1").strip()
    return min(most, max(1, int(value[:6]))) if value.isdecimal() else 1


_PLAINTEXT = re.compile(r"<plaintext(?:\s[^>]*)?>", re.IGNORECASE)
_TEXT_ONLY = re.compile(r"<(?:textarea|title|plaintext|xmp)\b", re.IGNORECASE)
_BEGUN = re.compile(r"<(?:[a-zA-Z!?]|/[a-zA-Z])")


def _finished(html: str) -> str:
    """The page without a last tag that no `>` ends: a browser drops it, and the parser would look for its end from each `<` anew."""
    last = html.rfind(">") + 1
    m = _BEGUN.search(html, last)
    return html[: m.start()] if m and not _TEXT_ONLY.search(html) else html


def render(html: str | None) -> str:
    if not html:
        return ""
    builder = TreeBuilder()
    html = _finished(html)
    if (m := _PLAINTEXT.search(html)) is None:
        builder.feed(html)
    else:  # all that follows is text
        builder.feed(html[: m.start()])
        if builder.cdata_elem or builder.open[-1].tag == "textarea":
            builder.feed(html[m.start() :])
        else:
            builder.handle_starttag("plaintext", [])
            builder.open[-1].children.append(html[m.end() :])
    builder.close()
    rules = _rules(builder.styles) if builder.styles else {}
    sinks = [_Sink()]
    lists: list[list] = []  # kind, next number
    tables: list[list] = []  # rows of the tables that are open
    kept = 0  # depth of preformatted text
    drawn = 0  # depth of drawings and formulas
    veiled = False  # within visibility:hidden
    todo: list[tuple[str, Node | str]] = [("in", builder.root)]
    while todo:
        step, node = todo.pop()
        sink = sinks[-1]
        if isinstance(node, str):
            if step == "in" and not veiled:
                sink.raw(node) if kept else sink.words(node)
            continue
        tag = node.tag
        if step in ("in", "seek"):
            displayed, seen = shown(node, rules)
            if not displayed or drawn and tag in UNSEEN:
                continue
            if (step == "seek" or drawn and tag in DEFINED) and node.props.get("id") not in builder.used:
                todo.extend(("seek", c) for c in reversed(node.children))
                continue
            if tag in ("br", "img", "input"):
                if tag == "br":
                    sink.line_break()
                elif not (veiled if seen is None else not seen):
                    sink.words((node.props.get("alt") or "") if tag == "img" else _caption(node))
                continue
            todo.append(("out", node))
            node.before = veiled
            veiled = veiled if seen is None else not seen
            children = node.children
            if tag == "option" and node.props.get("label"):
                children = [node.props["label"]]
            elif tag == "optgroup" and node.props.get("label"):
                children = [node.props["label"], *children]
            elif tag == "textarea":
                # one line end after the tag is not shown
                children = ["".join(c for c in children if isinstance(c, str)).removeprefix("\n") or node.props.get("placeholder") or ""]
            elif drawn and (tag == "text" or tag == "tspan" and ("y" in node.props or "dy" in node.props)):
                sink.block(1)
            drawn += tag in FOREIGN
            if tag == "details" and "open" not in node.props:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            todo.extend(("in", c) for c in reversed(children))
            aligned = 0 < len(tables) <= MOST_TABLES
            if tag in ("td", "th") and aligned:
                sinks.append(_Sink())
                continue
            if tag in ("td", "th"):
                sink.block(1)
            if tag == "table":
                tables.append([])
                sink.block(2)
            elif tag == "tr" and aligned:
                tables[-1].append([])
            elif tag in BLOCK:
                sink.block(1 if tag in ("ul", "ol", "menu", "dir") and lists else 2 if tag in SPACED else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.props.get("start") or "1"
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start.strip()) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                if re.fullmatch(r"-?\d{1,9}", value := (node.props.get("value") or "").strip()):
                    kind[1] = int(value)
                mark = f"{kind[1]}. " if kind[0] == "ol" else "* "
                kind[1] += 1
                sink.mark = "" if veiled else mark
                sink.indent += len(mark)
                node.before = (node.before, len(mark))
            elif tag in ("blockquote", "dd"):
                sink.indent += 2
            elif tag in ("pre", "textarea", "plaintext"):
                kept += 1
            continue
        # the element's end
        aligned = 0 < len(tables) <= MOST_TABLES
        if tag in ("td", "th") and aligned:
            text = sinks.pop().text()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((text, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
        elif tag in ("td", "th"):
            sink.block(1)
        elif tag == "table":
            lines = _table(tables.pop())
            for line in lines if aligned else ():
                sink.raw(line)
                sink.block(1)
            sink.block(2)
        elif tag in BLOCK:
            sink.block(1 if tag in ("ul", "ol", "menu", "dir") and len(lists) > 1 else 2 if tag in SPACED else 1)
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            node.before, wide = node.before
            sink.indent -= wide
            sink.mark = ""
        elif tag in ("blockquote", "dd"):
            sink.indent -= 2
        elif tag in ("pre", "textarea", "plaintext"):
            kept -= 1
        elif tag in FOREIGN:
            drawn -= 1
        elif tag == "text" and drawn:
            sink.block(1)
        veiled = node.before
    return sinks[0].text()


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """`key`, text: the visible text of each row of `pages`."""
    kind = pages.schema[key].dataType.simpleString()

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({key: rows.column(0), "text": pa.array([render(h) for h in rows.column(1).to_pylist()], pa.string())})

    return map_arrow(pages.select(key, html), batch, f"`{key}` {kind}, text string")
