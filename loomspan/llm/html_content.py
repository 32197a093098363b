"""HTML extraction: a tree-structured graphical model decides which DOM nodes are content.

Nodes are joined to their parents by pair potentials; sum-product messages pass up and then down the tree, for all
trees of a chunk at once and a level at a time. The model is trained on labelled pages that :func:`labelled_pages`
makes from seeded templates, so it depends on no table.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import chunks, payload, text_or_empty

#: Elements whose inside is never text of a page, and those that have no end tag. Formulas and what media show instead of themselves are text.
RAW = frozenset("script style noscript template svg iframe textarea title annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text; all others are inline.
BLOCK = frozenset("html head body main article section nav header footer aside div form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr details summary dialog center menu legend option select button".split())
#: A start tag on the left closes an open element on the right (with what is open inside it), up to one of the bounds.
_CLOSES_P = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre div section article aside nav header footer form figure hr main address details fieldset".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
_BOUND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "body": ("html",)}
#: Elements nested deeper hang on the one at this depth; it is what common browsers allow.
MAX_DEPTH = 512
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Tree:
    """Nodes of one page in page order; node 0 is the page itself."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    names: list[str] = field(default_factory=lambda: [""])
    #: Text runs in page order: (node, text); a None text ends a block.
    runs: list[tuple[int, str | None]] = field(default_factory=list)


class _Open:
    """The open elements of a page, with the places of each name and of the blocks, so that no step looks through them all."""

    def __init__(self, tags: list[str]):
        self.tags, self.stack, self.blocks, self.where = tags, [0], [0], {}

    def push(self, node: int) -> None:
        tag = self.tags[node]
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.where.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, name: str) -> int:
        """The place of the innermost open element of a name, 0 if there is none."""
        places = self.where.get(name)
        return places[-1] if places else 0

    def cut(self, place: int) -> None:
        """Closes the element at a place and all inside it."""
        while len(self.stack) > place:
            tag = self.tags[self.stack.pop()]
            self.where[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def parent(self) -> int:
        return self.stack[min(len(self.stack), MAX_DEPTH) - 1]


def parse(page: str) -> Tree:
    """The tree of a page, however broken: unclosed and misnested elements end with what holds them.

    The time is linear in the page. Elements nested deeper than MAX_DEPTH become children of the one at that depth, as
    browsers do; their text stays.
    """
    tree, pos, n = Tree(), 0, len(page)
    parent, tags, names, runs = tree.parent, tree.tag, tree.names, tree.runs
    opened = _Open(tags)
    stack = opened.stack
    while pos < n:
        lt = page.find("<", pos)
        m = _TOKEN.match(page, lt) if lt >= 0 else None
        while lt >= 0 and m is None:  # a < that begins no tag is text
            lt = page.find("<", lt + 1)
            m = _TOKEN.match(page, lt) if lt >= 0 else None
        end = lt if lt >= 0 else n
        if end > pos:
            runs.append((stack[-1], page[pos:end]))
        if lt < 0:
            break
        pos = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            at = opened.last(name)
            if name in BLOCK:
                if at:
                    runs.append((stack[at], None))
                    opened.cut(at)
                elif name == "p":
                    runs.append((stack[-1], None))
            elif at > opened.blocks[-1]:
                opened.cut(at)
            continue
        if name in _CLOSES_P and tags[stack[opened.blocks[-1]]] == "p":
            opened.cut(opened.blocks[-1])
        elif name in _CLOSES:
            at = max(map(opened.last, _CLOSES[name]))
            if at > max(map(opened.last, _BOUND[name])):
                opened.cut(at)
        if name == "br":
            runs.append((stack[-1], " "))
            continue
        if name in BLOCK:
            runs.append((stack[-1], None))
        if name in VOID:
            continue
        at = len(parent)
        parent.append(opened.parent())
        tags.append(name)
        names.append(" ".join(a or b or c for a, b, c in _NAMED.findall(m[3])).lower() if m[3] else "")
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, pos)
            pos = stop.end() if stop else n
        elif not m[3].endswith("/") or name in BLOCK:
            opened.push(at)
            if name in BLOCK:
                runs.append((at, None))
    return tree


# --- model -----------------------------------------------------------------------------------------------------

#: Words in class, id and role that hint at what an element is for, each list one feature.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager tabs toc sitemap skip",
    "edge": "header footer masthead banner top bottom copyright colophon topbar bar site branding logo",
    "side": "sidebar side aside rail related widget recommended popular trending more also archive tags tagcloud blogroll",
    "notice": "cookie cookies consent notice alert gdpr modal popup overlay toast subscribe newsletter paywall signup promo warning",
    "advert": "ad ads advert advertisement advertising sponsor sponsored promotion promoted banner adsense dfp",
    "comment": "comment comments reply replies discussion disqus respond thread reviews review feedback",
    "share": "share sharing social follow facebook twitter print email rating login search form",
    "content": "content article post entry story body main text prose page hentry articlebody",
}
_HINT_OF = {w: i for i, (_, ws) in enumerate(HINTS.items()) for w in ws.split()}
TAGS = "#page html body head main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form button select option label input a b strong i em span font small code sup sub cite q u mark time address dialog details summary center tbody thead menu fieldset".split()
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_EXTRA = ("bias", "raw", "unknown_tag", "short", "long", "links", "all_links", "no_text", "many_stops", "most_of_page", "copyright", "some_of_page", "holds_title", "holds_main", "paragraphs", "one_paragraph", "in_article", "fields", "in_side")
WIDTH = len(TAGS) + len(HINTS) + len(_EXTRA)


def node_features(tree: Tree) -> np.ndarray:
    """A row for each node: its tag, hints in its names, and the text and links below it."""
    n = len(tree.parent)
    title, main, paras, fields = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(1, n):
        tag = tree.tag[i]
        title[i], main[i], paras[i], fields[i] = tag == "h1", tag in ("article", "main"), tag == "p", tag in ("input", "button", "select", "textarea", "label")
    own, linked, stops, odd = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    inside_link = [False] * n
    for i in range(1, n):
        inside_link[i] = tree.tag[i] == "a" or inside_link[tree.parent[i]]
    for at, text in tree.runs:
        if text:
            size = len(text) - text.count(" ")
            own[at] += size
            if inside_link[at]:
                linked[at] += size
            stops[at] += text.count(".") + text.count(",")
            odd[at] += "©" in text or "&copy;" in text
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        own[p] += own[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
        odd[p] += odd[i] if own[i] < 300 else 0
        for count in (title, main, paras, fields):
            count[p] += count[i]
    mass = own / max(own[0], 1)
    frame = [t == "form" and m > 0.5 for t, m in zip(tree.tag, mass)]  # a form around the page is a frame as any other
    in_article, in_side = [False] * n, [False] * n
    for i in range(1, n):
        p = tree.parent[i]
        in_article[i] = in_article[p] or tree.tag[p] in ("article", "main")
        in_side[i] = in_side[p] or tree.tag[p] in ("aside", "nav", "footer") or tree.tag[p] == "form" and not frame[p]
    x = np.zeros((n, WIDTH), np.float32)
    at = len(TAGS)
    for i, tag in enumerate(tree.tag):
        k = _TAG_AT.get("div" if frame[i] else tag)
        if k is not None:
            x[i, k] = 1
        else:
            x[i, at + len(HINTS) + 2] = 1
        if tree.names[i]:
            for w in _PARTS.findall(tree.names[i]):
                h = _HINT_OF.get(w)
                if h is not None:
                    x[i, at + h] = 1
        if tag in RAW or tag == "head":
            x[i, at + len(HINTS) + 1] = 1
    share = linked / np.maximum(own, 1)
    e = at + len(HINTS)
    x[:, e] = 1
    x[:, e + 3] = (own > 0) & (own < 25)
    x[:, e + 4] = own > 200
    x[:, e + 5] = share
    x[:, e + 6] = share > 0.8
    x[:, e + 7] = own == 0
    x[:, e + 8] = stops / np.maximum(own, 1) > 0.01
    x[:, e + 9] = mass > 0.5
    x[:, e + 10] = odd > 0
    x[:, e + 11] = (mass > 0.15) & (mass <= 0.5)
    x[:, e + 12] = title > 0
    x[:, e + 13] = main > 0
    x[:, e + 14] = paras > 2
    x[:, e + 15] = paras == 1
    x[:, e + 16] = in_article
    x[:, e + 17] = fields > 0
    x[:, e + 18] = in_side
    return x


@dataclass
class TreeModel:
    """Log potentials: of a node's state given its features, and of a node's state given its parent's, by kind of edge."""

    node: np.ndarray  # WIDTH
    pair: np.ndarray  # parent state x state


def messages(unary: np.ndarray, pair: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on a forest: log marginals of each node, and of each node with its parent.

    ``unary`` is n x 2; ``parent`` is -1 at roots. One pass from the leaves up and one from the roots down, each a
    level at a time over all trees.
    """
    n = len(parent)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if n else []
    belief, up = unary.copy(), np.zeros((n, 2))
    for at in reversed(levels[1:]):
        said = np.logaddexp(pair[None, :, 0] + belief[at, 0, None], pair[None, :, 1] + belief[at, 1, None])
        up[at] = said
        np.add.at(belief, parent[at], said)
    marginal, joint = belief.copy(), np.zeros((n, 2, 2))
    if len(levels):
        roots = levels[0]
        marginal[roots] -= np.logaddexp(marginal[roots, 0], marginal[roots, 1])[:, None]
    for at in levels[1:]:
        above = marginal[parent[at]] - up[at]
        both = above[:, :, None] + pair[None] + belief[at][:, None, :]
        both -= np.logaddexp.reduce(both.reshape(len(at), 4), axis=1)[:, None, None]
        joint[at] = both
        marginal[at] = np.logaddexp(both[:, 0, :], both[:, 1, :])
    return marginal, joint


def forest(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, parents, depths of all nodes, and the offset of each tree."""
    offsets = np.concatenate([[0], np.cumsum([len(t.parent) for t in trees])]).astype(np.int64)
    parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + o) for t, o in zip(trees, offsets)]) if trees else np.zeros(0, np.int64)
    depths = []
    for t in trees:
        d = [0] * len(t.parent)
        for i in range(1, len(d)):
            d[i] = d[t.parent[i]] + 1
        depths += d
    x = np.concatenate([node_features(t) for t in trees]) if trees else np.zeros((0, WIDTH), np.float32)
    return x, parent, np.array(depths, np.int64), offsets


def content_probability(trees: list[Tree], model: TreeModel) -> list[np.ndarray]:
    """Marginal probability of "content" of every node."""
    if not trees:
        return []
    x, parent, depth, offsets = forest(trees)
    unary = np.zeros((len(parent), 2))
    unary[:, 1] = x @ model.node
    marginal, _ = messages(unary, model.pair, parent, depth)
    p = np.exp(marginal[:, 1])
    return [p[a:b] for a, b in zip(offsets, offsets[1:])]


def fit(pages: list[tuple[str, list[bool]]], rounds: int = 120, rate: float = 0.2, decay: float = 2e-4) -> TreeModel:
    """Maximum likelihood of labelled trees by gradient ascent; expectations come from message passing."""
    trees = [parse(p) for p, _ in pages]
    x, parent, depth, _ = forest(trees)
    y = np.concatenate([np.array(v, int) for _, v in pages])
    model = TreeModel(np.zeros(WIDTH), np.zeros((2, 2)))
    inner = parent >= 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parent[inner]], y[inner]), 1)
    mean, var = [np.zeros(WIDTH), np.zeros((2, 2))], [np.zeros(WIDTH), np.zeros((2, 2))]
    for step in range(1, rounds + 1):
        unary = np.zeros((len(y), 2))
        unary[:, 1] = x @ model.node
        marginal, joint = messages(unary, model.pair, parent, depth)
        grads = [x.T @ (y - np.exp(marginal[:, 1])) / len(y) - decay * model.node, (seen - np.exp(joint[inner]).sum(axis=0)) / len(y) - decay * model.pair]
        for i, g in enumerate(grads):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            var[i] = 0.99 * var[i] + 0.01 * g**2
            move = rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-6)
            if i == 0:
                model.node = model.node + move
            else:
                model.pair = model.pair + move
    return model


# --- labelled pages --------------------------------------------------------------------------------------------

_SYLLABLES = "ba co di fu ga hel in jo ka lu me no or pi qua re su ti un ver wo za an er st th".split()


def _prose(rng: random.Random, words: int) -> str:
    out = []
    while len(out) < words:
        sentence = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 3))) for _ in range(rng.randint(4, 14))]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(out[:words]).rstrip(".,") + "."


def labelled_page(rng: random.Random) -> str:
    """A page whose content elements are marked with data-x; everything unmarked is boilerplate."""

    def w(a: int, b: int) -> str:
        return _prose(rng, rng.randint(a, b))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{w(1, 3).rstrip(".")}</a></li>' for i in range(k))

    def named(words: str) -> str:
        return f'{rng.choice(["class", "id"])}="{rng.choice(words.split())}{rng.choice(["", "-box", "_inner", "-1"])}"'

    def menu() -> str:
        return rng.choice([f"<nav><ul>{links(rng.randint(2, 9))}</ul></nav>", f"<div {named('menu navbar navigation breadcrumb')}><ul>{links(rng.randint(2, 8))}</ul></div>", f"<ul {named('menu nav tabs')}>{links(rng.randint(2, 8))}</ul>"])

    def para() -> str:
        t = w(1, 90)
        if rng.random() < 0.3:
            k = rng.choice(["b", "i", "em", "strong", "span", "code", "a href='/z'", "math", "video"])
            t = f"<{k}>{w(1, 6)}</{k.split()[0]}> {t}"
        if rng.random() < 0.1:
            t = f"<b>{t}<br>"
        return t

    def body() -> str:
        parts = []
        for _ in range(rng.randint(1, 8)):
            kind = rng.random()
            if kind < 0.7:
                parts.append(f"<p data-x>{para()}" + rng.choice(["</p>", "</p>", ""]))
            elif kind < 0.78:
                parts.append(f"<h{rng.randint(2, 4)} data-x>{w(1, 8)}</h2>".replace("</h2>", ""))
                parts[-1] += f"</{parts[-1][1:3]}>"
            elif kind < 0.86:
                parts.append("<ul data-x>" + "".join(f"<li data-x>{w(2, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote data-x>{rng.choice(['', '<p data-x>'])}{w(5, 40)}</blockquote>")
            elif kind < 0.96:
                parts.append("<table data-x>" + "".join(f"<tr data-x><td data-x>{w(1, 5)}</td><td data-x>{w(1, 5)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            else:
                parts.append(f"<pre data-x>{w(5, 30)}</pre>")
            if rng.random() < 0.1:
                parts.append(rng.choice([advert, side, share, notice])())
        return "".join(parts)

    def article() -> str:
        head = f"<h1 data-x>{w(1, 12)}</h1>"
        if rng.random() < 0.2:
            head = f"<header data-x>{head}</header>"
        inside = head + body()
        if rng.random() < 0.2:
            inside = f"<section data-x>{inside}</section>"
        return rng.choice([f"<article data-x>{inside}</article>", f"<main data-x><article data-x>{inside}</article></main>", f"<main data-x>{inside}</main>", f'<div {named("content post entry story article main")} data-x>{inside}</div>', f"<div data-x>{inside}</div>"])

    def advert() -> str:
        return f'<div {named("ad ads advert sponsored promo advertisement")}>{rng.choice(["", "<p>", "<a href=/b>"])}{w(2, 25)}</div>'

    def side() -> str:
        inner = rng.choice([f"<h3>{w(1, 3)}</h3><ul>{links(rng.randint(2, 6))}</ul>", f"<p>{w(5, 40)}</p>", f"<h2>{w(1, 4)}</h2><p>{w(5, 30)}</p><ul>{links(3)}</ul>"])
        return rng.choice([f"<aside>{inner}</aside>", f'<div {named("sidebar related widget side recommended")}>{inner}</div>'])

    def notice() -> str:
        return f'<{(k := rng.choice(["div", "section", "dialog"]))} {named("cookie consent notice newsletter subscribe popup alert")}><p>{w(4, 40)}</p><button>{w(1, 2)}</button></{k}>'

    def share() -> str:
        return f'<div {named("share social follow")}><a href="/s">{w(1, 2)}</a> <a href="/t">{w(1, 2)}</a></div>'

    def form() -> str:
        return f'<form action="/f"><label>{w(1, 3)}</label><input name="q"><select><option>{w(1, 1)}</option><option>{w(1, 1)}</option></select><button>{w(1, 2)}</button></form>'

    def remarks() -> str:
        inner = "".join(rng.choice([f"<p>{w(3, 60)}</p>", f'<div class="comment"><b>{w(1, 2)}</b><p>{w(3, 60)}</p></div>', f"<li><p>{w(3, 50)}</p></li>", f"<article class='comment'><p>{w(3, 40)}</p></article>"]) for _ in range(rng.randint(1, 6)))
        return f'<{(k := rng.choice(["section", "div", "ol"]))} {named("comments comment replies discussion reviews")}>{rng.choice(["", "<h3>Comments</h3>"])}{inner}</{k}>'

    def foot() -> str:
        inner = rng.choice([f"&copy; {w(1, 3)} &middot; {w(3, 12)}", f"<p>&copy; {w(3, 20)}</p>", f"<ul>{links(4)}</ul><p>{w(3, 12)}</p>", f"<p>{w(5, 30)}</p>"])
        return rng.choice([f"<footer>{inner}</footer>", f'<div {named("footer copyright bottom")}>{inner}</div>'])

    def top() -> str:
        inner = rng.choice([f'<a href="/">{w(1, 3)}</a>', f"<h1>{w(1, 3)}</h1><p>{w(2, 10)}</p>", f"<div>{w(1, 4)}</div>{menu()}"])
        return rng.choice([f"<header>{inner}</header>", f'<div {named("header masthead banner topbar")}>{inner}</div>'])

    before = [f() for f in (top, menu, notice, advert, form, share) if rng.random() < 0.45]
    after = [f() for f in (share, side, remarks, form, notice, advert, foot) if rng.random() < 0.45]
    rng.shuffle(before)
    inside = "".join(before) + article() + "".join(after)
    if rng.random() < 0.3:
        inside = f'<div {named("page wrapper container site")} data-x>{inside}</div>'
    if rng.random() < 0.1:
        inside = rng.choice([f'<form action="/" data-x>{inside}</form>', f"<div data-x><div data-x>{inside}</div></div>", f"<center data-x>{inside}</center>"])
    head = "".join(f() for f in (lambda: f"<title>{w(2, 8)}</title>", lambda: f"<style>.{w(1, 1)[:3]}{{color:#123}}</style>", lambda: f'<script>if(a<b)document.write("<div>{w(1, 3)}</div>")</script>') if rng.random() < 0.8)
    return f"<!DOCTYPE html><html data-x><head>{head}</head><body data-x>{inside}</body></html>"


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[bool]]]:
    """Pages and a label per node, in the order in which :func:`parse` numbers nodes.

    A node is content if it is marked, is inline inside a marked one, or is the page itself; frames that hold both are content
    and it is their parts that differ.
    """
    rng, out = random.Random(seed), []
    for _ in range(n):
        page = labelled_page(rng)
        tree = parse(page.replace(" data-x", " class='qqmark'").replace("class='qqmark'", "role='qqmark'"))
        marks = []
        for i, (tag, names) in enumerate(zip(tree.tag, tree.names)):
            marks.append(i == 0 or "qqmark" in names or tag not in BLOCK and tag not in RAW and marks[tree.parent[i]])
        out.append((page.replace(" data-x", ""), marks))
    return out


@cache
def trained(pages: int = 500, seed: int = 20) -> TreeModel:
    """The model that the operator uses unless given another; trained once a process."""
    return fit(labelled_pages(pages, seed))


# --- operator --------------------------------------------------------------------------------------------------


def main_text(tree: Tree, content: np.ndarray) -> str:
    """Text of the content nodes: blocks in page order, white space inside each as one space, joined by newlines."""
    live = [bool(content[0] >= 0.5)] * len(tree.parent)
    for i in range(1, len(live)):  # what lies in boilerplate is boilerplate
        live[i] = live[tree.parent[i]] and tree.tag[i] not in RAW and (content[i] >= 0.5 or tree.tag[i] not in BLOCK)
    blocks, run = [], []
    for at, text in [*tree.runs, (0, None)]:
        if text is None:
            if run:
                block = _SPACE.sub(" ", html.unescape("".join(run))).strip()
                if block:
                    blocks.append(block)
                run = []
        elif live[at]:
            run.append(text)
    return "\n".join(blocks)


def extract_main_text(pages: DataFrame, html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """One row per page: ``page`` (all columns but the html), ``text`` and ``n_chars`` (code points).

    A null or empty page gives an empty text; repeated rows give equal rows. A page's nodes are held in one
    task, so memory follows the largest page, never a group of pages.
    """
    model = model or trained()
    source = pages.select(payload(pages, html_col).alias("page"), text_or_empty(f"`{html_col}`").alias("html"))
    schema = T.StructType([source.schema["page"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch, "html", 1_000_000):
                trees = [parse(t.decode("utf-8")) for t in texts]
                found = [main_text(t, p) for t, p in zip(trees, content_probability(trees, model))]
                yield pa.RecordBatch.from_arrays([part.column("page"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)


def html_query(spark, sf_dir: str) -> DataFrame:
    """op2: the main text of every row of ``pages``."""
    out = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select(F.col("page.page_id").alias("page_id"), F.col("page.url").alias("url"), "text", "n_chars")
