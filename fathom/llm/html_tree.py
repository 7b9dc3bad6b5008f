"""A tolerant HTML reader that yields a tree of blocks, each with its own runs of text."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that run on inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rb rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
#: For a start tag, the open elements that it ends, and the elements beyond which it does not look.
_BLOCKS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
IMPLIED = {tag: (frozenset({"p"}), frozenset({"button", "table", "td", "th", "object"})) for tag in _BLOCKS} | {
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), frozenset({"table"})), "tfoot": (frozenset({"tbody", "thead", "tr", "td", "th"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})), "body": (frozenset({"head"}), frozenset({"html"})),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)
_SKIPPED = frozenset("script style noscript template head title iframe object svg math select textarea button canvas audio video".split())


@dataclass(slots=True)
class Node:
    """An element, or (tag "#text") a run of text and inline elements inside one."""

    tag: str
    attrs: str = ""
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    text: str = ""
    links: int = 0  # characters of a run that stand inside links


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)


def parse(source: str) -> Node:
    """The tree of a page. Comments, scripts, styles, forms' controls and what is not shown leave no text.

    Unclosed and crossed tags are accepted: an end tag closes the nearest open element of its name, and a start tag of
    a block closes an open paragraph. A run of text ends where a block begins or ends; a line break is a blank. The time
    grows with the page's length, however deep its elements nest.
    """
    root = Node("#root")
    stack, inline, run, links = [root], Counter(), [], 0
    places: dict[str, list[int]] = {}  # where the open elements of each name are in the stack
    outer, inner = 0, 0  # open elements that hide their text, among blocks and among inline elements

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            stack[-1].children.append(Node("#text", "", stack[-1], [], text, min(links, len(text))))
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not outer and not inner:
            text = html.unescape(raw) if "&" in raw else raw
            run.append(text)
            links += len(text) if inline["a"] else 0

    def cut(depth: int) -> None:
        """Close the open elements from this place on."""
        nonlocal outer, inner
        while len(stack) > depth:
            tag = stack.pop().tag
            places[tag].pop()
            outer -= tag in _SKIPPED
        inline.clear()
        inner = 0

    def last(tags: frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at = 0
    while match := _TOKEN.search(source, at):
        add(source[at : match.start()])
        at = match.end()
        if (cdata := match["cdata"]) is not None:
            add(cdata)
        if not match["tag"]:
            continue
        tag = match["tag"].lower()
        if match["close"]:
            if tag in INLINE and inline[tag]:
                inline[tag] -= 1
                inner -= tag in _SKIPPED
            elif tag in ("br", "p") and not places.get(tag):
                add(" ") if tag == "br" else flush()
            elif tag not in INLINE and places.get(tag):
                flush()
                cut(places[tag][-1])
            continue
        closed = match["attrs"].endswith("/") and (tag in VOID or tag in ("svg", "math"))
        if tag in VOID or closed:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in INLINE:
            inline[tag] += 1
            inner += tag in _SKIPPED
            continue
        flush()
        if tag in IMPLIED:
            ends, limits = IMPLIED[tag]
            while (place := last(ends)) > last(limits):
                cut(place)
        attrs = " ".join(f"{m[1]}={m[2] or m[3] or m[4] or ''}" for m in _ATTR.finditer(match["attrs"]))
        node = Node(tag, attrs.lower(), stack[-1])
        if tag in RAW:
            end = _raw_end(tag).search(source, at)
            at = end.end() if end else len(source)
            continue
        places.setdefault(tag, []).append(len(stack))
        stack[-1].children.append(node)
        stack.append(node)
        outer += tag in _SKIPPED
    add(source[at:])
    flush()
    return root
