"""Main text of web pages: boosted trees score the nodes of the page tree, a tree-wide decoding decides.

Features of a node: its element, words of its class, id and role (its own and those above it), depth, how much of its
subtree's text stands in links, text per tag, sentence marks, its share of the page's prose, and how it compares with its
siblings. The trees are fitted here on pages that are written by a random generator from many templates, with the main text
known; in a third of them no name tells where it stands, or a name misleads.

A node is kept or dropped with everything in it. The decoding picks the most likely consistent choice: below a dropped
node nothing is kept, and a kept node that keeps nothing inside counts for nothing. So a paragraph cannot be kept in a
dropped sidebar, nor a footer dropped and its text kept.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .boosting import BoostedTrees, fit
from .html_tree import Node, parse

#: Words in class, id and role attributes that hint at a node's part in a page.
HINTS = {
    "main": "article content main post entry body story text page blog",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pager pagination toc tabs skip",
    "head": "header masthead banner topbar logo branding",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar side aside widget rail related recommended popular trending more",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense outbrain taboola",
    "comment": "comment comments discussion disqus reply replies respond reader",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall warning",
    "share": "share sharing social tools meta byline tags rating print",
    "form": "form search login contact",
}
_HINT_OF = {word: i for i, words in enumerate(HINTS.values()) for word in words.split()}
_TAGS = ("#text", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "body")
_TAG_CODE = {t: i for i, t in enumerate(_TAGS)}
PAGES, TRAIN_SEED = 1200, 20
#: Characters from which a run of text that is mostly no link counts as prose.
PROSE = 60


@lru_cache(maxsize=10_000)
def _hints(attrs: str) -> frozenset[int]:
    words = "".join(c if c.isalnum() else " " for c in attrs).split()
    return frozenset(_HINT_OF[w] for w in words if w in _HINT_OF)


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def node_features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    at = {id(node): i for i, node in enumerate(nodes)}
    parent = np.array([at[id(x.parent)] if x.parent is not None else -1 for x in nodes])
    prose = [len(x.text) if len(x.text) >= PROSE and 2 * x.links < len(x.text) else 0 for x in nodes]
    rows = [[len(x.text), x.links, 1, sum(map(x.text.count, ".!?,;")) if x.text else 0, x.tag == "p", x.tag in ("li", "td"), prose[i]] for i, x in enumerate(nodes)]
    for i in range(n - 1, 0, -1):
        up = rows[parent[i]]
        for j, v in enumerate(rows[i]):
            up[j] += v
    size = np.array(rows, dtype=float)
    tags = np.array([_TAG_CODE.get(x.tag, len(_TAGS)) for x in nodes])
    own = np.zeros((n, len(HINTS)))
    above = np.zeros((n, len(HINTS) + 6))
    depth, place, siblings, longest = np.zeros(n), np.zeros(n), np.ones(n), np.zeros(n)
    run, previous, following = np.array([len(x.text) for x in nodes], dtype=float), np.full(n, -1), np.full(n, -1)
    special = ("article", "nav", "header", "footer", "aside", "form")
    for i, node in enumerate(nodes):
        for hint in _hints(node.attrs) if node.attrs else ():
            own[i, hint] = 1
        if i:
            p = parent[i]
            depth[i] = depth[p] + 1
            above[i] = above[p]
            above[i, : len(HINTS)] = np.maximum(above[i, : len(HINTS)], own[p])
            if nodes[p].tag in special or nodes[p].tag == "main":
                above[i, len(HINTS) + special.index("article" if nodes[p].tag == "main" else nodes[p].tag)] = 1
        for k, child in enumerate(node.children):
            c = at[id(child)]
            place[c], siblings[c] = k, len(node.children)
            longest[i] = max(longest[i], rows[c][0])
            if k:
                before_it = at[id(node.children[k - 1])]
                previous[c], following[before_it] = before_it, c
    for i in range(n - 1, 0, -1):
        run[parent[i]] = max(run[parent[i]], run[i])
    total = max(1.0, size[0, 0])
    up = np.maximum(parent, 0)
    text, link_share = size[:, 0], size[:, 1] / np.maximum(size[:, 0], 1)
    prose_share = size[:, 6] / max(1.0, size[0, 6])
    before = np.concatenate(([0], np.cumsum([len(x.text) for x in nodes])[:-1])) / total
    columns = [
        tags, tags[up], depth, np.log1p(text), text / total, link_share, link_share[up], np.log1p(text / size[:, 2]), size[:, 3] / np.maximum(text, 1) * 100,
        size[:, 4], size[:, 5], place, place / siblings, siblings, text / np.maximum(text[up], 1), text / np.maximum(longest[up], 1), before, (size[:, 3] > 0), np.log1p(text[up]),
        prose_share, prose_share[up], prose_share[up[up]], np.log1p(run), np.log1p(run[up]), run / max(1.0, run[0]), np.full(n, math.log1p(total)), np.full(n, link_share[0]), np.full(n, math.log1p(size[0, 6])),
    ]
    for beside in (previous, following):
        columns += [np.where(beside >= 0, v[beside], -1) for v in (np.log1p(text), link_share, prose_share, tags)]
    return np.column_stack([*columns, own, own[up], above])


def decode(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """Which nodes are kept. Keeping a node earns its logit plus the best choice for its children; dropping it earns
    nothing, for the whole subtree. Elements weigh little against the text that they hold."""
    n = len(nodes)
    at = {id(node): i for i, node in enumerate(nodes)}
    worth = np.clip(logits, -6, 6) * np.array([math.sqrt(len(x.text)) if x.text else 1.0 for x in nodes])
    gain = np.zeros(n)
    for i in range(n - 1, -1, -1):
        inside = sum(gain[at[id(c)]] for c in nodes[i].children)
        leaf = nodes[i].tag == "#text"
        gain[i] = max(0.0, worth[i] + inside) if leaf or inside > 0 else 0.0
    kept = np.ones(n, dtype=bool)
    for i, node in enumerate(nodes[1:], 1):
        kept[i] = gain[i] > 0 and kept[at[id(node.parent)]]
    return kept


def main_texts(sources: list[str | None], model: BoostedTrees) -> list[str]:
    """The main text of each page: kept runs of text in page order, joined by a blank. Pages are scored together."""
    pages = [nodes_of(parse(source or "")) for source in sources]
    logits = model.logit(np.concatenate([node_features(nodes) for nodes in pages])) if pages else np.zeros(0)
    out, at = [], 0
    for nodes in pages:
        kept = decode(nodes, logits[at : at + len(nodes)])
        at += len(nodes)
        out.append(" ".join(x.text for x, k in zip(nodes, kept, strict=True) if k and x.text))
    return out


class PageMaker:
    """Writes random pages. What is main text stands between the marks \\x01 and \\x02."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.letters = "abcdefghijklmnoprstuvwxyz"

    def words(self, low: int, high: int) -> str:
        r = self.random
        out = ["".join(r.choices(self.letters, k=r.choice((2, 3, 3, 4, 5, 6, 8, 11)))) for _ in range(r.randint(low, high))]
        for i in range(len(out) - 1):
            out[i] += r.choices(("", ",", ".", "###", "&amp;"), (60, 7, 6, r.choice((0, 0, 8)), 1))[0]
        return " ".join(out).capitalize() + r.choice((".", ".", ".", "", "!"))

    def name(self, kind: str) -> str:
        """Attributes with a hint of the kind, a neutral word, or nothing."""
        r = self.random
        roll = r.random()
        if roll < 0.25:
            return ""
        word = r.choice(HINTS[kind].split()) if roll < 0.85 else r.choice(("box", "wrap", "block", "row", "col", "inner"))
        return f' {r.choice(("class", "class", "id"))}="{r.choice(("", "", "site-", "l-", "x_"))}{word}{r.choice(("", "", "-inner", " clear"))}"'

    def links(self, low: int, high: int) -> str:
        r = self.random
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(r.randint(low, high))]
        style = r.random()
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if style < 0.6 else r.choice((" | ", " ", "<br>")).join(items)

    def boilerplate(self, kind: str) -> str:
        r = self.random
        tag = {"nav": ("nav", "div", "ul"), "head": ("header", "div"), "foot": ("footer", "div", "footer"), "side": ("aside", "div"), "form": ("form", "div")}.get(kind, ("div", "section", "aside"))
        tag = r.choice(tag)
        attrs = self.name(kind) if tag != kind and r.random() < 0.95 else ""
        if tag in ("div", "section", "ul") and not attrs:
            attrs = f' class="{r.choice(HINTS[kind].split())}"'
        inside = {
            "nav": lambda: self.links(3, 9), "head": lambda: self.words(1, 5) + (self.links(2, 6) if r.random() < 0.5 else ""),
            "foot": lambda: r.choice(("&copy; 2024 ", "&copy; ", "Copyright ", "")) + self.words(1, 4) + r.choice((" &middot; ", " ", " | ")) + self.words(3, 14) + (self.links(2, 5) if r.random() < 0.4 else ""),
            "side": lambda: f"<h3>{self.words(1, 3)}</h3>" + self.links(2, 8) + (f"<p>{self.words(5, 25)}</p>" if r.random() < 0.4 else ""),
            "ad": lambda: r.choice(("{}", "<p>{}</p>", '<a href="#">{}</a>')).format(self.words(3, 25)),
            "comment": lambda: "".join(f"<{t}><b>{self.words(1, 2)}</b> {self.words(5, 40)}</{t}>" for t in [r.choice(("p", "div", "li"))] * r.randint(1, 6)),
            "notice": lambda: f"<p>{self.words(6, 25)}</p>" + ("<button>ok</button>" if r.random() < 0.5 else ""), "share": lambda: self.links(2, 5),
            "form": lambda: f'<label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 2)}</button>' + (f"<p>{self.words(3, 10)}</p>" if r.random() < 0.5 else ""),
        }[kind]()
        if tag == "ul" and not inside.startswith("<ul"):
            tag = "div"
        return f"<{tag}{attrs}>{inside}</{tag}>"

    def block(self) -> str:
        r, kind = self.random, self.random.random()
        text = self.words(*r.choice(((1, 4), (4, 20), (20, 120), (40, 260))))
        if r.random() < 0.15:
            half = len(text) // 2
            text = text[:half] + f"\x02<a href='/q'>\x01{self.words(1, 3)}\x02</a>\x01" + text[half:]
        elif r.random() < 0.12:
            text = "".join(f"{self.words(1, 4)} \x02<a href='/r{i}'>\x01{self.words(2, 9)}\x02</a>\x01 " for i in range(r.randint(1, 4))) + r.choice((".", self.words(1, 8)))
        mark = f"\x01{text}\x02"
        if kind < 0.55:
            return f"<p>{mark}</p>"
        if kind < 0.7:
            return f"<p><b>{mark}<br>"
        if kind < 0.78:
            return f"<h{r.randint(2, 3)}>{mark}</h2>" if r.random() < 0.1 else f"<h2>{mark}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>\x01{self.words(2, 18)}\x02</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{mark}</blockquote>"
        return r.choice((f"<div>{mark}</div>", f"<pre>{mark}</pre>", f"<table><tr><td>{mark}</td><td>\x01{self.words(1, 5)}\x02</td></tr></table>", f"<figure><img src=x><figcaption>{mark}</figcaption></figure>"))

    def prose(self, low: int = 1, high: int = 4) -> str:
        """Paragraphs of main text."""
        r = self.random
        return "".join(f"<p>\x01{self.words(12, 90)}\x02" + r.choice(("</p>", "</p>", "\n")) for _ in range(r.randint(low, high)))

    def unnamed(self) -> str:
        """Attributes that say nothing, or that say the wrong thing."""
        r = self.random
        if r.random() < 0.35:
            return ""
        word = "".join(r.choices(self.letters, k=r.randint(1, 6))) + r.choice(("", "1", "27")) if r.random() < 0.75 else r.choice(HINTS[r.choice(("form", "head", "side", "share"))].split()) + r.choice(("", "-text", "-results"))
        return f' {r.choice(("class", "id"))}="{word}"'

    def link_block(self) -> str:
        """A list of links that nothing but its form tells from the main text."""
        r = self.random
        tag = r.choice(("div", "div", "td", "p"))
        few = self.links(1, 6)
        if r.random() < 0.3:
            few = " | ".join(self.words(1, 2).rstrip(".!") for _ in range(r.randint(2, 5)))
        return f"<{tag}{self.unnamed() if tag == 'div' else ''}>{f'<h4>{self.words(1, 2)}</h4>' if tag == 'div' and r.random() < 0.3 else ''}{few}</{tag}>" if tag != "p" or not few.startswith("<ul") else few

    def plain_page(self) -> str:
        """A page whose main text stands in elements without a telling name, or in none."""
        r = self.random
        style = r.random()
        if style < 0.12:
            return "".join(f"<p>\x01{self.words(1, 40)}\x02" + r.choice(("", "</p>")) for _ in range(r.randint(1, 5)))
        head = f"<h{(h := r.randint(1, 3))}>\x01{self.words(1, 8)}\x02</h{h}>" if r.random() < 0.3 else ""
        if style < 0.35:
            main = head + r.choice(("", "", f"\x01{self.words(15, 60)}\x02")) + self.prose(1, 7)
        elif style < 0.75:
            many, tag = r.choice((1, 1, 1, 2, 3)), r.choice(("div", "div", "section"))
            main = "".join(f"<{tag}{self.unnamed()}>{head if not i else ''}{self.prose(1, 8) if r.random() < 0.85 else f'{chr(1)}{self.words(30, 200)}{chr(2)}'}</{tag}>" for i in range(many))
            for _ in range(r.choice((0, 0, 1, 3))):
                main = f"<div{self.unnamed()}>{main}</div>"
        elif style < 0.85:
            return f"<table><tr><td>{self.links(2, 8)}</td><td>{head}{self.prose(1, 6)}</td></tr></table>"
        else:
            main = f"<div{self.unnamed()}>{head}" + "".join(r.choice((self.block, lambda: self.prose(1, 2)))() for _ in range(r.randint(2, 8))) + self.prose(1, 2) + "</div>"
        kinds = [k for k in ("notice", "head", "nav", "ad", "form") if r.random() < 0.25]
        above = [self.boilerplate(k) for k in kinds] + [self.link_block() for _ in range(r.choice((0, 0, 1)))]
        below = [self.boilerplate(k) for k in ("comment", "side", "foot") if r.random() < 0.3] + [self.link_block() for _ in range(r.choice((0, 0, 1)))]
        r.shuffle(above)
        page = "".join([*above, main, *below])
        return f"<div{self.unnamed()}>{page}</div>" if r.random() < 0.15 else page

    def about(self) -> str:
        """Who wrote an article and when, or what it is filed under: no main text, though it stands inside."""
        r = self.random
        return r.choice((
            lambda: f'<p class="{r.choice(("byline", "meta", "author byline", "post-meta"))}">{self.words(1, 6)}</p>', lambda: f"<footer>{self.words(1, 2)} {self.links(1, 4)}</footer>",
            lambda: f'<footer>{self.words(1, 5)}</footer>', lambda: f'<div class="{r.choice(("tags", "meta", "byline", "entry-meta"))}">{self.words(1, 2)} {self.links(1, 3)}</div>', lambda: f'<div class="byline">{self.words(1, 4)}</div>',
        ))() if r.random() < 0.9 else f"<aside>{self.links(1, 4)}</aside>"

    def page(self) -> str:
        r = self.random
        if r.random() < 0.35:
            return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{self.plain_page()}</body></html>"
        body = [f"<h1>\x01{self.words(1, 12)}\x02</h1>"] if r.random() < 0.8 else []
        if body and r.random() < 0.15:
            body = [f"<header>{body[0]}</header>"]
        body += [self.block() for _ in range(r.choice((0, 1, 1, 2, 3, 5, 9, 16)) + (not body))]
        if r.random() < 0.3:
            body.insert(r.randint(1, len(body)), f"<{(t := r.choice(('div', 'section')))}{self.unnamed()}>{self.prose(1, 3)}</{t}>")
        if r.random() < 0.25:
            body.insert(r.choice((1, len(body))), self.about())
        for kind in r.sample(("ad", "share", "side", "notice", "comment", "form"), r.choice((0, 0, 1, 2))):
            body.insert(r.randint(0, len(body)) if kind in ("ad", "share") else len(body), self.boilerplate(kind))
        tag = r.choices(("article", "main", "div", "section"), (50, 15, 25, 10))[0]
        attrs = self.name("main") if tag == "article" or tag == "main" else f' class="{r.choice(HINTS["main"].split())}"'
        main = f"<{tag}{attrs}>{''.join(body)}</{tag}>"
        if r.random() < 0.3:
            main = f"<div{self.name('main')}>{main}</div>"
        above = [self.boilerplate(k) for k in ("notice", "head", "nav", "ad", "form") if r.random() < (0.2, 0.5, 0.7, 0.4, 0.15)[("notice", "head", "nav", "ad", "form").index(k)]]
        r.shuffle(above)
        below = [self.boilerplate(k) for k in ("comment", "side", "ad", "foot") if r.random() < (0.35, 0.4, 0.2, 0.8)[("comment", "side", "ad", "foot").index(k)]]
        parts = [*above, main, *below]
        if r.random() < 0.25:
            parts = [*above, f"<div class='{r.choice(('wrapper', 'container', 'row', 'page'))}'>{main}{self.boilerplate('side')}</div>", *below]
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><script>var a='</p>';</script></head><body>{''.join(parts)}</body></html>"


def training_set(pages: int = PAGES, seed: int = TRAIN_SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features of the nodes of generated pages, and whether each holds main text."""
    maker, xs, ys = PageMaker(seed), [], []
    for _ in range(pages):
        page = maker.page()
        nodes = nodes_of(parse(page))
        at = {id(x): i for i, x in enumerate(nodes)}
        label = np.zeros(len(nodes))
        for i in range(len(nodes) - 1, 0, -1):
            label[i] = max(label[i], "\x01" in nodes[i].text)
            p = at[id(nodes[i].parent)]
            label[p] = max(label[p], label[i])
        # the marks must leave no trace in the features, such as in the length of links
        bare = nodes_of(parse(page.replace("\x01", "").replace("\x02", "")))
        if [x.tag for x in bare] != [x.tag for x in nodes]:
            raise AssertionError("a mark stands where there is no text")
        xs.append(node_features(bare))
        ys.append(label)
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(maxsize=4)
def default_model(pages: int = PAGES, seed: int = TRAIN_SEED) -> BoostedTrees:
    return fit(*training_set(pages, seed), trees=80, depth=5, share=0.4)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: BoostedTrees | None = None) -> DataFrame:
    """keep columns, text and n_chars (code points) of every page. Null and empty pages, and those without main text,
    have an empty text. Other columns of pages are ignored."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html", rows=50):
            texts = main_texts(batch.column("_html").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    base = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in keep)
    return base.mapInArrow(run, f"{kinds}, text string, n_chars long")
