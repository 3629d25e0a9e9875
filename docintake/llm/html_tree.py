"""A lenient HTML reader: block elements as a tree, text runs in page order."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from html import unescape

#: Elements that hold blocks of text; every other element is transparent markup inside a block.
BLOCKS = frozenset(
    "html body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption "
    "thead tbody tfoot tr td th blockquote pre figure figcaption form fieldset legend label button select option textarea details "
    "summary dialog address center hgroup menu search output".split()
)
#: Elements whose content is never text of the page.
SILENT = frozenset("script style template head title iframe".split())
#: Silent elements whose content is raw up to their own end tag, whatever it looks like.
RAW = frozenset("script style title iframe".split())
#: An open element of the second kind ends where one of the first kind starts.
_P_ENDS = BLOCKS - {"label", "button", "output", "legend", "caption", "summary", "figcaption"} - {"html", "body"}
CLOSED_BY = {"p": _P_ENDS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
#: Elements whose start tags no implied end reaches beyond.
FENCES = {"p": {"td", "th", "li", "dd", "div", "article", "section", "body", "blockquote", "main", "aside", "form"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][-\w:.@]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements that part words; all other inline elements, `wbr` and `img` too, leave the text around them joined.
BREAKS = frozenset(("br", "hr"))


RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Page:
    """Nodes in document order (node 0 is the root) and text runs as (node, text, whether it is link text)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    marks: list[str] = field(default_factory=lambda: [""])
    runs: list[tuple[int, str, bool]] = field(default_factory=list)


def read(html: str | None) -> Page:
    """The page in time proportional to its length: open elements are found by name, never by walking the stack."""
    page, html = Page(), html or ""
    stack: list[int] = [0]
    names: list[str] = ["#root"]
    #: Places in the stack of the open elements of each name.
    open_at: defaultdict[str, list[int]] = defaultdict(list)
    pieces: list[str] = []
    silent = {tag: 0 for tag in SILENT - RAW}
    link, linked, at, n = 0, False, 0, len(html)
    last = html.rfind(">")

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.runs.append((stack[-1], text, linked))
            pieces.clear()
        linked = link > 0

    def close(depth: int) -> None:
        flush()
        for name in names[depth:]:
            open_at[name].pop()
        del stack[depth:], names[depth:]

    def innermost(tags: Iterable[str]) -> int:
        return max((open_at[t][-1] for t in tags if open_at[t]), default=0)

    while at < n:
        start = html.find("<", at)
        if start < 0:
            start = n
        quiet = any(silent.values())
        if start > at and not quiet:
            pieces.append(unescape(html[at:start]))  # by itself: a tag ends a character reference
        if start == n:
            break
        # beyond the last > there is no tag, but perhaps an open comment
        m = TOKEN.match(html, start) if start < last or html.startswith(("<!", "<?"), start) else None
        if not m:
            if not quiet:
                pieces.append("<")
            at = start + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        ends, tag = bool(m[1]), m[2].lower()
        if tag in SILENT:
            if tag in RAW and not ends and not m[3].endswith("/"):
                stop = RAW_END[tag].search(html, at)
                at = stop.end() if stop else n
            elif tag in silent and not m[3].endswith("/"):
                silent[tag] = max(0, silent[tag] + (-1 if ends else 1))
            continue
        if tag in BLOCKS and not silent["template"]:
            silent["head"] = 0
        if tag == "body":
            silent["template"] = 0
        if any(silent.values()):
            continue
        if tag in BREAKS:
            pieces.append(" ")
        elif tag == "a":
            if len(pieces) and (link > 0) == ends:
                linked = linked or link > 0
            link = max(0, link - 1) if ends else 1
            linked = linked or link > 0
        elif tag in BLOCKS:
            if ends:
                if open_at[tag]:
                    close(open_at[tag][-1])
                elif tag == "p":
                    flush()
                link = 0
                linked = False
                continue
            flush()
            for open_tag, starters in CLOSED_BY.items():
                if tag in starters and open_at[open_tag] and open_at[open_tag][-1] > innermost(FENCES[open_tag]):
                    close(open_at[open_tag][-1])
            page.parent.append(stack[-1])
            page.tag.append(tag)
            page.marks.append(marks_of(m[3]) if m[3] else "")
            stack.append(len(page.parent) - 1)
            open_at[tag].append(len(names))
            names.append(tag)
    flush()
    return page


def marks_of(attributes: str) -> str:
    """What the attributes say about an element; a style that hides it counts as the word hidden."""
    out = []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "style":
            out.append("hidden" if HIDES.search(value) else "")
        elif name == "aria-hidden":
            out.append("hidden" if value == "true" else "")
        elif name in ("class", "id", "role", "hidden", "aria-label", "itemprop"):
            out.append(value or name)
    return " ".join(out)
