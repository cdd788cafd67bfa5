"""Main text of web pages: gradient-boosted trees score DOM nodes, and a tree decoding keeps the choices consistent."""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, small_batches, whole_text

TREES, DEPTH, BINS, RATE, SAMPLE_PAGES, MADE_PAGES, SEED = 80, 4, 24, 0.25, 300, 500, 5

BLOCK = frozenset("html body div section article main header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li table thead tbody tfoot tr td th caption form fieldset figure figcaption blockquote pre dl dt dd address details summary hr menu dialog center iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select".split())
#: Those of RAW whose start tag alone is skipped where the end tag is missing; the others take the rest of the page.
SKIPPED = frozenset("noscript template svg math object select".split())
#: A start tag of the key closes open elements of the named tags, up to the nearest element of ``WALLS``.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
WALLS = frozenset("ul ol dl table div section article main body html aside nav form menu".split())
#: Beside ``WALLS``, the open elements that a block inside them does not close a paragraph beyond.
_STOPS = frozenset("td th li dd blockquote".split())
TAGS = "html body div section article main header footer nav aside p h1 h2 h3 ul ol li table td form blockquote pre figure figcaption #run".split()
WORDS = "article content post entry story text main body page nav menu header foot footer sidebar side aside ad ads advert promo sponsor banner cookie consent notice alert comment comments reply disqus form share social related recommend breadcrumb subscribe newsletter login popup modal widget copyright tag meta search hidden contentinfo navigation complementary".split()
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_WORD_AT = {w: i for i, w in enumerate(WORDS)}
#: Markup of the usual kind: a tag without "<" inside ends in group 4; where that is missing, ``_tag_end`` looks further.
_MARKUP = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/><]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)(>)?)")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s=\"'/>])([^\s=\"'/>]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.S)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    words: frozenset[str] = frozenset()
    mark: str = ""
    children: list[Node] = field(default_factory=list)
    text: str = ""
    linked: int = 0
    tags: int = 0
    # of the whole subtree
    size: int = 0
    links: int = 0
    count: int = 0
    leaves: int = 0
    stops: int = 0
    long: int = 0


class _Markup:
    """The markup of a page, one piece after another: (start, end, is an end tag, tag name or "", attributes). Linear in the page."""

    def __init__(self, page: str):
        self.page, self.dead, self.seen = page, set(), (1, 0)

    def _special(self, at: int) -> int:
        """The place of the next ">" or quote."""
        if not self.seen[0] <= at <= self.seen[1]:
            m = _SPECIAL.search(self.page, at)
            self.seen = at, m.start() if m else len(self.page)
        return self.seen[1]

    def _tag_end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends (its ">", quoted ones passed over), or -1. No place is passed twice."""
        passed = []
        while True:
            s = self._special(at)
            if s == len(self.page) or s in self.dead:
                break
            if self.page[s] == ">":
                return s
            passed.append(s)
            end = self.page.find(self.page[s], s + 1)
            if end < 0:
                break
            at = end + 1
        self.dead.update(passed)
        return -1

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while m := _MARKUP.search(page, at):
            start = m.start()
            if m[4]:
                if m[6]:
                    return start, m.end(), m[3] == "/", m[4].lower(), m[5]
                end = self._tag_end(m.start(5))
                if end >= 0:
                    return start, end + 1, m[3] == "/", m[4].lower(), page[m.start(5) : end]
                at = start + 1
                continue
            end = page.find("-->" if m[1] else ">", start + 4 if m[1] else start)
            return start, len(page) if end < 0 else end + (3 if m[1] else 1), False, "", ""
        return None


def parse(page: str) -> Node:
    """The tree of block elements; runs of inline text become leaves. Markup, comments, scripts, styles and the like go."""
    root = Node("#page", None, 0)
    here, stack = root, []  # stack: open tags, with the block node to return to
    where: dict[str, list[int]] = {}  # places in the stack by tag; of all blocks, walls and what ends a paragraph's reach
    blocks, walls, stops = [-1], [-1], [-1]
    pieces: list[str] = []
    linked = inline = in_link = 0
    unended: set[str] = set()
    markup = _Markup(page)

    def push(tag: str, back: Node | None) -> None:
        k = len(stack)
        where.setdefault(tag, []).append(k)
        if tag in BLOCK:
            blocks.append(k)
            if tag in WALLS:
                walls.append(k)
            if tag in WALLS or tag in _STOPS:
                stops.append(k)
        stack.append((tag, back))

    def last(tag: str) -> int:
        found = where.get(tag)
        return found[-1] if found else -1

    def flush() -> None:
        nonlocal pieces, linked, inline
        if pieces:
            text = _SPACE.sub(" ", html_lib.unescape("".join(pieces))).strip()
            if text:
                here.children.append(Node("#run", here, here.depth + 1, text=text, linked=min(linked, len(text)), tags=inline))
            pieces = []
        linked = inline = 0

    def close(k: int) -> None:
        nonlocal here, in_link
        if blocks[-1] >= k:
            flush()
        for t, back in reversed(stack[k:]):
            where[t].pop()
            if t == "a":
                in_link -= 1
            if back is not None:
                here = back
        for places in (blocks, walls, stops):
            while places[-1] >= k:
                places.pop()
        del stack[k:]

    def words(rest: str) -> tuple[frozenset[str], str]:
        found, mark = set(), ""
        for m in _ATTRIBUTE.finditer(rest):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                found.update(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
            elif name == "x-mark":
                mark = value
            elif name == "style" and re.search(r"display\s*:\s*none", value):
                found.add("hidden")
        if re.search(r"(?:^|\s)hidden(?:\s|$|=)", rest):
            found.add("hidden")
        return frozenset(found), mark

    at, n = 0, len(page)
    while at < n:
        m = markup.after(at)
        end = m[0] if m else n
        if end > at:
            pieces.append(page[at:end])
            if in_link:
                linked += end - at
        if not m:
            break
        _, at, ends, tag, rest = m
        if not tag:
            continue
        if ends:
            k = last(tag)
            if k >= 0 and (tag in BLOCK or k > blocks[-1]):
                close(k)
            continue
        if tag in RAW and not rest.endswith("/"):
            stop = None if tag in unended else _RAW_END[tag].search(page, at)
            if stop:
                at = stop.end()
            elif tag in SKIPPED:
                unended.add(tag)
            else:
                at = n
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in BLOCK and tag != "body" and last("p") > stops[-1]:
            close(last("p"))
        k = max((last(t) for t in CLOSES.get(tag, ())), default=-1)
        if k > walls[-1]:
            close(k)
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            found, mark = words(rest)
            node = Node(tag, here, here.depth + 1, found, mark)
            here.children.append(node)
            push(tag, here)
            here = node
        else:
            inline += 1
            if tag == "a":
                in_link += 1
            push(tag, None)
    close(0)
    flush()
    return root


def _measure(node: Node) -> None:
    """Subtree sums, without recursion: pages can nest deeply."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(x.children)
    for x in reversed(order):
        x.count = x.tags + 1
        if x.tag == "#run":
            x.size, x.links, x.leaves = len(x.text), x.linked, 1
            x.stops, x.long = sum(map(x.text.count, ".!?")), int(len(x.text) > 120)
        else:
            x.size, x.links, x.leaves, x.stops, x.long = (sum(getattr(c, k) for c in x.children) for k in ("size", "links", "leaves", "stops", "long"))
            x.count += sum(c.count for c in x.children)


def nodes_of(root: Node) -> list[Node]:
    """All nodes with text in their subtree, parents first, in page order."""
    _measure(root)
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.size:
            out.append(x)
            todo.extend(reversed(x.children))
    return out


N_FEATURES = len(TAGS) + 2 * len(WORDS) + 22


def node_features(nodes: list[Node]) -> np.ndarray:
    """Depth, subtree density, links, attribute words (own and of ancestors), sibling and page statistics of each node."""
    return np.concatenate(list(_feature_slabs(nodes)))


def _feature_slabs(nodes: list[Node], rows: int = 1 << 13) -> Iterator[np.ndarray]:
    """The nodes' features, so many rows at a time."""
    total, above, families = max(1, nodes[0].size), {}, {}
    before = 0
    for at_node, v in enumerate(nodes):
        i = at_node % rows
        if not i:
            if at_node:
                yield x
            x = np.zeros((min(rows, len(nodes) - at_node), N_FEATURES))
        own = [_WORD_AT[w] for w in v.words | {v.tag} if w in _WORD_AT]
        inherited = above.get(id(v.parent), set()) if v.parent else set()
        above[id(v)] = inherited | set(own)
        if v.tag in _TAG_AT:
            x[i, _TAG_AT[v.tag]] = 1
        if own:
            x[i, [len(TAGS) + k for k in own]] = 1
        if inherited:
            x[i, [len(TAGS) + len(WORDS) + k for k in inherited]] = 1
        if id(v.parent) not in families:
            every = v.parent.children if v.parent else [v]
            sizes = sorted(c.size for c in every)
            families[id(v.parent)] = (len(every), sum(sizes), sizes, {id(c): k for k, c in enumerate(every)}, Counter(c.tag for c in every), sum(c.long for c in every))
        family, kin, sizes, places, alike, long = families[id(v.parent)]
        rank, at = family - bisect_right(sizes, v.size), places[id(v)]
        f = [v.depth, math.log1p(v.size), v.links / v.size, v.size / v.count, math.log1p(v.size / v.leaves), v.leaves, v.stops / v.size, v.stops, v.long, v.long / v.leaves, v.size / total, v.size / max(1, kin), rank, family, at, at / family, alike[v.tag], before / total, v.tag == "#run", _TAG_AT.get(v.parent.tag, -1) if v.parent else -1, len(v.words), long]
        x[i, -22:] = f
        if v.tag == "#run":
            before += v.size
    yield x


@dataclass
class Boosted:
    """Depth-wise trees on binned features, for the log-odds that a node holds main text."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    start: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.int16)
        for j, e in enumerate(self.edges):
            if len(e):
                out[:, j] = np.searchsorted(e, x[:, j], "right")
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.bins(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> Boosted:
    """Second-order boosting of the logistic loss with histogram splits and complete trees of a fixed depth."""
    edges = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        edges.append((values[1:] + values[:-1]) / 2 if len(values) <= BINS else np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)))
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    model = Boosted(edges, [], base)
    b, f, n_f, width = model.bins(x).astype(np.int64), np.full(len(y), base), x.shape[1], BINS + 1
    used = [j for j in range(n_f) if len(edges[j])]
    flat = b[:, used] + np.arange(len(used)) * width
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, width, np.int64)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, k = 2**level - 1, 2**level
            key = ((at - first)[:, None] * (len(used) * width) + flat).ravel()
            sums = [np.bincount(key, np.repeat(v, len(used)), k * len(used) * width).reshape(k, len(used), width) for v in (g, h)]
            left_g, left_h = (s.cumsum(axis=2) for s in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
            gain[:, :, -1] = 1e-9
            best = gain.reshape(k, -1).argmax(axis=1)
            feature[first : first + k], cut[first : first + k] = np.array(used)[best // width], best % width
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        leaf_at = at - (2**DEPTH - 1)
        leaf = rate * np.bincount(leaf_at, g, 2**DEPTH) / (np.bincount(leaf_at, h, 2**DEPTH) + 1)
        f += leaf[leaf_at]
        model.trees.append((feature, cut, leaf))
    return model


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """The likeliest consistent choice: nothing is kept below a dropped node, and a kept inner node keeps something."""
    place = {id(v): i for i, v in enumerate(nodes)}
    keep, drop = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    kept, gone = keep.copy(), drop.copy()  # best sums of the subtree, the node kept or dropped
    for i in range(len(nodes) - 1, -1, -1):
        below = [place[id(c)] for c in nodes[i].children if id(c) in place]
        if below:
            gain = [kept[c] - gone[c] for c in below]
            kept[i] += sum(gone[c] + max(0.0, d) for c, d in zip(below, gain, strict=True)) + min(0.0, max(gain))
            gone[i] += sum(gone[c] for c in below)
    chosen = [False] * len(nodes)
    chosen[0] = bool(kept[0] > gone[0])
    for i, v in enumerate(nodes):
        below = [place[id(c)] for c in v.children if id(c) in place]
        if chosen[i] and below:
            gain = {c: kept[c] - gone[c] for c in below}
            for c in below:
                chosen[c] = bool(gain[c] > 0)
            if not any(chosen[c] for c in below):
                chosen[max(below, key=gain.get)] = True
    return chosen


def main_texts(pages: list[str], model: Boosted, at_once: int = 1 << 14) -> list[str]:
    """The main text of each page; the trees run over about ``at_once`` nodes together, of many pages or of a part of one."""
    out: list[str] = []
    held: list[list[Node]] = []
    slabs: list[np.ndarray] = []
    margins: list[np.ndarray] = []
    waiting = 0

    def score() -> None:
        if slabs:
            margins.append(model.margin(np.concatenate(slabs)))
            slabs.clear()

    def flush() -> None:
        score()
        margin, at = np.concatenate(margins) if margins else np.zeros(0), 0
        for nodes in held:
            chosen = decode(nodes, margin[at : at + len(nodes)]) if nodes else []
            at += len(nodes)
            out.append("\n".join(v.text for v, c in zip(nodes, chosen, strict=True) if c and v.tag == "#run"))
        held.clear()
        margins.clear()

    for page in pages:
        held.append(nodes_of(parse(page)))
        for slab in _feature_slabs(held[-1]) if held[-1] else ():
            slabs.append(slab)
            waiting += len(slab)
            if waiting >= at_once:
                score()
                waiting = 0
        if not slabs and margins:
            flush()
    flush()
    return out


def _made_page(lines: list[str], rng: random.Random) -> str:
    """A page by rule from sentences of real pages; x-mark says what is main text (1) and what is not (0)."""
    line = lambda: html_lib.escape(rng.choice(lines))
    short = lambda: " ".join(line().split()[: rng.randint(1, 5)])
    paragraph = lambda: " ".join(line() for _ in range(rng.randint(1, 3)))
    item = lambda: f'<li><a href="/x">{short()}</a></li>'
    pick = rng.choice

    def menu() -> str:
        items = "".join(item() for _ in range(rng.randint(2, 8)))
        return pick([f"<nav x-mark=0><ul>{items}</ul></nav>", f'<div class="{pick(["menu", "nav", "breadcrumb", "navbar-top"])}" x-mark=0><ul>{items}</ul></div>', f"<ul class=menu x-mark=0>{items}</ul>"])

    def boilerplate() -> str:
        kind, body = pick(["ad", "ad", "side", "notice", "form", "share", "related", "plain"]), pick([line, short, paragraph])()
        if kind == "ad":
            return f'<div class="{pick(["ad", "ads", "advert", "promo", "sponsor-box", "banner"])}" x-mark=0>{pick([body, f"<p>{body}</p>"])}</div>'
        if kind == "side":
            return pick([f"<aside x-mark=0><h3>{short()}</h3><p>{body}</p></aside>", f'<div class="{pick(["sidebar", "side-bar", "widget"])}" x-mark=0><h3>{short()}</h3><p>{body}</p></div>', f'<div id="sidebar" x-mark=0><ul>{item()}{item()}</ul><p>{body}</p></div>'])
        if kind == "notice":
            return f'<div class="{pick(["cookie", "cookie-notice", "notice", "consent", "alert", "popup", "newsletter"])}" x-mark=0><p>{body}</p></div>'
        if kind == "form":
            return f'<form x-mark=0><label>{short()}</label><input name=q>{pick(["", f"<p>{body}</p>"])}<button>{short()}</button></form>'
        if kind == "share":
            return f'<div class="{pick(["share", "social", "tags", "meta"])}" x-mark=0><a href="#">{short()}</a> <a href="#">{short()}</a></div>'
        if kind == "related":
            return f'<section class="{pick(["related", "recommend"])}" x-mark=0><h2>{short()}</h2><ul>{item()}{item()}{item()}</ul></section>'
        return f"<div x-mark=0><a href='/'>{short()}</a></div>"

    def comments() -> str:
        each = "".join(f'<div class="{pick(["comment", "reply"])}"><b>{short()}</b><p>{paragraph()}</p></div>' for _ in range(rng.randint(1, 5)))
        return pick([f'<section class="comments" x-mark=0><h2>{short()}</h2>{each}</section>', f'<div id="comments" x-mark=0>{each}</div>', f'<ol class="commentlist" x-mark=0>{each.replace("div", "li")}</ol>'])

    def block() -> str:
        kind = rng.random()
        if kind < 0.7:
            return pick([f"<p>{paragraph()}</p>", f"<p>{paragraph()}", f"<p><b>{line()}</b> {paragraph()}</p>", f"<p><b>{line()}<br>", f'<p>{line()} <a href="/y">{short()}</a> {line()}</p>', f"<p>{short()}</p>"])
        return pick([f"<h2>{short()}</h2>", f"<ul><li>{line()}</li><li>{short()}</li></ul>", f"<blockquote><p>{line()}</p></blockquote>", f"<table><tr><td>{short()}<td>{short()}</table>", f"<pre>{line()}</pre>", f"<figure><img src=a><figcaption>{short()}</figcaption></figure>"])

    body = f"<h1>{line()}</h1>" if rng.random() < 0.85 else ""
    for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14])):
        body += block() + (boilerplate() if rng.random() < 0.06 else "")
    a, z = pick([("<article x-mark=1>", "</article>")] * 4 + [("<main x-mark=1>", "</main>"), ('<div class="content" x-mark=1>', "</div>"), ('<div id="main" x-mark=1>', "</div>"), ('<div class="post-body" x-mark=1>', "</div>"), ('<div class="entry" x-mark=1>', "</div>"), ("<div x-mark=1>", "</div>"), ("<section x-mark=1>", "</section>"), ('<div class="story text" x-mark=1>', "</div>")])
    top = pick(["", "", f'<header x-mark=0><a href="/">{short()}</a>{pick(["", f"<p>{line()}</p>"])}</header>', f'<div class="header" x-mark=0>{short()}</div>'])
    foot = pick(["", f"<footer x-mark=0>&copy; {short()} &middot; {line()}</footer>", f"<footer x-mark=0><p>{line()}</p></footer>", f'<div class="footer" x-mark=0><p>{short()}</p></div>'])
    some = lambda p: boilerplate() if rng.random() < p else ""
    remarks = comments() if rng.random() < 0.3 else ""
    inner = f"{a}{body}{z}"
    if remarks and rng.random() < 0.3:
        inner, remarks = f"{a}{body}{remarks}{z}", ""
    page = f"{top}{menu() if rng.random() < 0.8 else ''}{some(0.4)}{some(0.3)}{inner}{some(0.3)}{remarks}{some(0.2)}{foot}"
    return pick([f"<html><body>{page}</body></html>", f'<html><body><div class="{pick(["page", "wrap", "container"])}">{page}</div></body></html>', page])


def _labels(nodes: list[Node]) -> np.ndarray:
    place, marks, y = {}, [], np.zeros(len(nodes))
    for i, v in enumerate(nodes):
        place[id(v)] = i
        up = marks[place[id(v.parent)]] if v.parent else "0"
        marks.append("0" if up == "00" else "00" if v.mark == "0" else v.mark or up)
        if up == "00":
            marks[-1] = "00"
        if v.tag == "#run" and marks[-1] == "1":
            w = v
            while w is not None and not y[place[id(w)]]:
                y[place[id(w)]] = 1
                w = w.parent
    return y


_ARTICLE = re.compile(r"<(article|main)(?=[\s>])", re.I)
_ASIDE = re.compile(r"<(nav|footer|aside|form|header)(?=[\s>])", re.I)


def fit(pages: list[str], made: int = MADE_PAGES, seed: int = SEED) -> Boosted:
    """Trains on pages made by rule from the sample's sentences, and on sampled pages whose tags name their parts."""
    rng, lines = random.Random(seed), []
    for page in pages:
        for v in nodes_of(parse(page)):
            if v.tag == "#run" and len(v.text) > 30:
                lines += [s for s in re.split(r"(?<=[.!?]) ", v.text) if len(s) > 8][:40]
    lines = lines or ["One plain sentence about the weather in the north.", "Another line, on trade and its long roads.", "People came from far to see it, and stayed.", "Short words help."]
    xs, ys = [], []
    real = [_ASIDE.sub(r"<\1 x-mark=0", _ARTICLE.sub(r"<\1 x-mark=1", p)) for p in pages if _ARTICLE.search(p)]
    for page in [*real, *(_made_page(lines, rng) for _ in range(made))]:
        nodes = nodes_of(parse(page))
        if nodes:
            xs.append(node_features(nodes))
            ys.append(_labels(nodes))
    return boost(np.concatenate(xs), np.concatenate(ys))


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Boosted:
    """Fits on about ``sample`` pages, those with the lowest hashes of their identifier, of under 20,000 code points."""
    some = hash_sample(pages, id_col, sample).select(whole_text(html_col).alias("h")).filter(F.length("h") < 20_000)
    return fit(sorted(r.h for r in some.collect()))


def extract(pages: DataFrame, model: Boosted, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id_col, url_col, text, n_chars (code points of the text).

    The whole html is read (null: empty). White space inside a block becomes one space, blocks are joined by a line
    feed in page order; a page without main text gives an empty text. Repeated rows are answered each; extra columns
    are ignored.
    """
    small_batches(pages.sparkSession)
    schema = f"{id_col} long, {url_col} string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), whole_text(html_col).alias("html")).mapInArrow(run, schema)


def op3_boosted_dom(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
