"""HTML as balanced events, and what is made of them: text, markdown, title and links of a page.

tokens() cuts a page into texts, tags, comments and raw texts (scripts, styles, titles). events() keeps a stack of open elements,
so that what comes out is a tree written as starts and ends: ends that are left out are put in where the standard implies them (paragraphs, list items,
cells, rows), ends without a start go, and what is open at the end is closed. An event is (kind, tag or text, attributes or whether the
end was written). Nothing recurses, so nesting may be of any depth, and every step looks at a page once.

Cases: a null page gives null; an empty one, or one without <body> and <main>, has no content; a `<` that opens no tag is text; an unclosed comment or
script runs to the end; entities are decoded once, unknown ones stay; a space that doesn't break counts as a space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5

TEXT, START, END = range(3)
Event = tuple[int, str, object]

#: An attribute's value may hold a > only within quotes.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*+)[^>]*>"""
    r"""|<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+)>|<([a-zA-Z][^\s/>]*+)([^>]*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Elements whose text is no markup; of these two, entities count.
RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes", "title", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "header", "hgroup", "hr", "html",
    "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "caption", "h1", "h2", "h3", "h4", "h5", "h6",
}
HEADINGS = {f"h{n}": n for n in range(1, 7)}
#: What a start tag ends: these elements, if they were opened after the last one of the others.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr", "td", "th"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
_P_SCOPE = ("table", "td", "th", "caption", "button", "object", "template")
#: Elements of which nothing is content.
DROPPED = {"script", "style", "noscript", "svg", "nav", "footer", "form"}
#: Signs of unordered lists by depth, and of emphasis.
BULLETS = "*+-"
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`"}

_ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")


def decode(text: str) -> str:
    """Entities by name and number, each decoded once."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            found = html5.get(name + ";", m[0])
            return " " if found == "\xa0" else found
        point = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        if not 0 < point < 0x110000 or 0xD800 <= point < 0xE000:
            return m[0]
        return chr(point)

    return _ENTITY.sub(one, text) if "&" in text else text


def tokens(html: str) -> Iterator[Event]:
    """Texts, starts with their attributes as written, and ends, in order."""
    at, low = 0, None
    for m in iter(lambda: _TOKEN.search(html, at), None):
        if m.start() > at:
            yield TEXT, html[at : m.start()], True
        at = m.end()
        if m[1]:
            yield END, m[1].lower(), True
        elif m[2] or m[4]:
            tag, rest = (m[2] or m[4]).lower(), m[3] if m[2] else m[5]
            yield START, tag, rest
            if tag in RAW and not rest.endswith("/"):
                low = html.lower() if low is None else low
                stop = low.find(f"</{tag}", at) if len(low) == len(html) else (m2.start() if (m2 := re.compile(f"</{tag}", re.I).search(html, at)) else -1)
                stop = len(html) if stop < 0 else stop
                yield TEXT, html[at:stop], tag in ("title", "textarea")
                at = stop
                if stop == len(html):
                    return
    if at < len(html):
        yield TEXT, html[at:], True


def attributes(written: str) -> dict[str, str]:
    """By lower-case name; of several of one name the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(written):
        out.setdefault(m[1].lower(), decode(m[2] or m[3] or m[4] or ""))
    return out


def events(html: str) -> list[Event]:
    """A page's tree: every start has its end, and they nest."""
    out: list[Event] = []
    stack: list[str] = []
    places: dict[str, list[int]] = {}

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close(to: int, written: bool) -> None:
        while len(stack) > to:
            tag = stack.pop()
            places[tag].pop()
            out.append((END, tag, written and len(stack) == to))

    for kind, value, more in tokens(html):
        if kind == TEXT:
            out.append((TEXT, value, more))
        elif kind == END:
            if (to := last(value)) >= 0:
                close(to, True)
        else:
            ended, within = _CLOSES.get(value, ((), ()))
            if ended:
                floor = last(*within)
                below = [p for t in ended if places.get(t) for p in places[t][-1:] if p > floor]
                if below:
                    close(min(below), False)
            if value in BLOCKS and (to := last("p")) > last(*_P_SCOPE):
                close(to, False)
            out.append((START, value, more))
            if value in VOID:
                out.append((END, value, False))
            else:
                places.setdefault(value, []).append(len(stack))
                stack.append(value)
    close(0, False)
    return out


def _end_of(tree: list[Event], at: int) -> int:
    """The place of the end of the element that starts at `at`."""
    deep = 0
    for k in range(at, len(tree)):
        deep += (tree[k][0] == START) - (tree[k][0] == END)
        if not deep:
            return k
    return len(tree)


def _without(tree: list[Event], tags: set[str]) -> list[Event]:
    out, gone = [], 0
    for e in tree:
        if gone or e[0] == START and e[1] in tags:
            gone += (e[0] == START) - (e[0] == END)
        else:
            out.append(e)
    return out


def content(tree: list[Event]) -> list[Event] | None:
    """What is inside the first <main>, else the first <body>, without what is dropped; None where there is neither."""
    kept = _without(tree, DROPPED)
    for tag in ("main", "body"):
        for k, e in enumerate(kept):
            if e[0] == START and e[1] == tag:
                return kept[k + 1 : _end_of(kept, k)]
    return None


def title(tree: list[Event], default: str = "Untitled") -> str:
    """The stripped text of the first title that isn't a drawing's; the default only where there is none."""
    kept = _without(tree, {"svg"})
    for k, e in enumerate(kept):
        if e[0] == START and e[1] == "title":
            return decode("".join(x[1] for x in kept[k : _end_of(kept, k)] if x[0] == TEXT)).strip()
    return default


def links(tree: list[Event]) -> list[str]:
    """The targets of all <a href>, in order, as they are written but for entities."""
    found = (attributes(e[2]) for e in tree if e[0] == START and e[1] == "a")
    return [a["href"] for a in found if "href" in a]


_SPACE = re.compile(r"[ \t\n\r\f\v]+")


def text(tree: list[Event]) -> str:
    """What a page says, block by line; the source's own lines stay lines, and cells of a row are parted by a space."""
    inside = content(tree)
    if inside is None:
        return ""
    out: list[str] = []
    for kind, value, _ in inside:
        if kind == TEXT:
            out.append(decode(value))
        elif value in ("td", "th"):
            out.append(" ")
        elif value in BLOCKS or value == "br":
            out.append("\n")
    line = re.sub(r" ?\n ?", "\n", re.sub(r"[ \t\r]+", " ", "".join(out)))
    return re.sub(r"\n+", "\n", line).strip(" \t\n\r\f\v")


class _Markdown:
    """Collects lines: white space is held back until something follows it."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.lines, self.breaks, self.space, self.fresh = 0, 0, False, True
        self.prefix: list[str] = []  # what begins each line inside quotes and items

    def block(self, lines: int = 2) -> None:
        """The next text begins a line, after an empty one if lines is 2; directly after an item's sign it stays on that line."""
        self.space, self.breaks = False, 0
        if not self.fresh:
            self.lines = max(self.lines, lines)

    def write(self, text: str) -> None:
        if self.lines:
            self.out += ["\n" * self.lines, "".join(self.prefix)]
        elif self.breaks:
            self.out += ["  \n" + "".join(self.prefix)] * self.breaks
        elif self.space and not self.fresh:
            self.out.append(" ")
        self.lines, self.breaks, self.space, self.fresh = 0, 0, False, False
        self.out.append(text)

    def say(self, value: str) -> None:
        line = _SPACE.sub(" ", value)
        if line[:1] == " ":
            self.space = self.space or not (self.lines or self.breaks)
        if body := decode(line.strip(" ")):
            self.write(body)
            self.space = line[-1:] == " "

    def sign(self, sign: str) -> None:
        """An item's sign or a quote's, on a line of its own until text follows."""
        self.write(sign)
        self.fresh = True


def markdown(tree: list[Event]) -> str:
    """The content with headings as #, links, emphasis, lists, tables, quotes and preformatted text."""
    inside = content(tree)
    if inside is None:
        return ""
    md = _Markdown()
    lists: list[tuple[str, int]] = []  # sign or '' for numbers, and the next number
    links: list[tuple[int, str | None]] = []
    rows: list[list[int]] = []  # of each open table: rows so far, cells of this row, cells of the first
    pre: list[list[str]] = []
    cell = heading = 0  # inside these there are no blocks, only spaces
    for kind, value, more in inside:
        if kind == TEXT:
            if pre:
                pre[-1].append(decode(value))
            else:
                md.say(value)
            continue
        start = kind == START
        if pre and value != "pre":
            if value == "br" and start:
                pre[-1].append("\n")
            continue
        if value in MARKS:
            # a sign stands where a tag stands: of an end that is only implied there is none
            if start or more:
                if start:
                    md.write(MARKS[value])
                else:
                    held, md.space = md.space, False
                    md.write((" " if held else "") + MARKS[value])
        elif value == "a":
            if start:
                href = attributes(more).get("href")
                md.write("")
                md.out.append("")  # becomes the bracket if the link's end is written
                links.append((len(md.out) - 1, href))
            elif links:
                at, href = links.pop()
                if href is not None and more:
                    md.out[at] = "["
                    held, md.space = md.space, False
                    md.write((" " if held else "") + f"]({href})")
        elif value == "br":
            if start:
                if cell or heading:
                    md.space = True
                else:
                    md.space, md.breaks = False, md.breaks + 1
        elif value == "img":
            continue
        elif (cell or heading) and value in BLOCKS and value not in HEADINGS and value not in ("table", "tr"):
            md.space = True
        elif value in HEADINGS:
            if cell:
                md.space = True
            elif start:
                md.block()
                md.sign("#" * HEADINGS[value] + " ")
                heading += 1
            else:
                heading -= 1
                md.fresh = False
                md.block()
        elif value in ("ul", "ol", "menu"):
            if not start and lists:
                lists.pop()
            md.block(1 if lists else 2)
            if start:
                n = attributes(more).get("start", "1")
                lists.append((BULLETS[len(lists) % 3] if value != "ol" else "", int(n) if n.isdecimal() and len(n) < 10 else 1))
        elif value == "li":
            if start:
                md.fresh = False if md.out else md.fresh
                md.block(1)
                bullet, n = lists[-1] if lists else (BULLETS[0], 1)
                sign = f"{bullet} " if bullet else f"{n}. "
                if lists:
                    lists[-1] = (bullet, n + 1)
                md.sign(sign)
                md.prefix.append(" " * len(sign))
            else:
                md.prefix.pop()
                md.fresh = False
                md.block(1)
        elif value == "blockquote":
            md.block()
            if start:
                md.prefix.append("> ")
                if not md.out:
                    md.out.append("".join(md.prefix))
            else:
                md.prefix.pop()
        elif value == "hr":
            if start:
                md.block()
                md.write("---")
                md.block()
        elif value == "pre":
            if start:
                pre.append([])
            else:
                body = "".join(pre.pop()).strip("\n")
                if pre:
                    pre[-1].append(body)
                else:
                    md.block()
                    md.write("```\n" + body + "\n```")
                    md.block()
        elif value == "table":
            if cell:
                md.space = True
            else:
                md.block()
            if start:
                rows.append([0, 0, 0])
            elif rows:
                rows.pop()
        elif value == "tr" and rows and cell < len(rows):
            if start:
                md.block(1)
                rows[-1][1] = 0
            elif rows[-1][1]:
                md.space = False
                md.write(" |")
                if not rows[-1][0]:
                    md.block(1)
                    md.write("|" + " --- |" * rows[-1][1])
                rows[-1][0] += 1
                md.block(1)
        elif value in ("td", "th") and rows and (cell < len(rows) if start else cell):
            if start:
                md.space = False
                md.write("| " if not rows[-1][1] else " | ")
                md.fresh = True
                rows[-1][1] += 1
                cell += 1
            else:
                cell -= 1
                md.space = md.fresh = False
        elif value in BLOCKS:
            md.block()
    found = re.sub(r"!\[[^\]]*\]\([^)]+\)", "", "".join(md.out))
    return re.sub(r"\n{3,}", "\n\n", found).strip(" \t\n\r\f\v")
