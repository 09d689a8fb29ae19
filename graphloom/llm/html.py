"""Main text of pages by boosted trees over DOM nodes and hierarchical decoding.

A tolerant parser makes a tree of block nodes. Gradient-boosted trees score each node by its
subtree's size, link and text density, its own and its ancestors' attribute words, depth and
sibling statistics. A node is in if it holds main text, so a node that is out can't have one
that is in below it: the best labelling under that rule is found from the leaves up.

The trees are fitted here, on layouts that ``layouts`` makes up with known main text.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ship

#: Element names, by the role the HTML standard gives them.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript iframe template".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = set("script style noscript template iframe head title svg math object select option button textarea input".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of attributes and elements that tell what a block is for.
BAD = ("nav menu footer foot header banner sidebar side aside ad ads advert sponsor promo cookie consent notice comment comments reply disqus form login "
       "signup subscribe newsletter share social related breadcrumb breadcrumbs pagination widget toolbar popup modal search masthead legal copyright tags").split()
GOOD = "article main content post entry body story text page blog paragraph prose".split()
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?[a-zA-Z](?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*>?|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: A quote opens a value behind = alone; elsewhere it is a character like others.
_ATTR = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[\s\xa0]+")
FEATURES = 24


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "texts", "links", "order")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids, self.texts, self.links = tag, attrs, parent, [], [], 0


def parse(page: str) -> list[Node]:
    """Block nodes of a page in document order; each has its own runs of text, with their place."""
    root = Node("html", "", None)
    nodes, at, open_inline, place, pos = [root], root, [], 0, 0
    held: Counter[str] = Counter()  # open blocks by name

    def close(up: Node) -> Node:
        """Close all blocks up to ``up``; its parent is what stays open."""
        x = at
        while x is not up.parent:
            held[x.tag] -= 1
            x = x.parent
        return x

    while m := _TOKEN.match(page, pos):
        t, pos = m.group(), m.end()
        if t[0] != "<" or len(t) == 1:
            place += 1
            at.texts.append((place, t, "a" in open_inline))
            continue
        if t.startswith("<![CDATA["):
            place += 1
            at.texts.append((place, t[9:].removesuffix("]]>"), False))
            continue
        if not (n := _NAME.match(t)):
            continue
        tag = n.group(1).lower()
        if t[1] == "/":
            if tag in INLINE:
                if tag in open_inline:
                    del open_inline[len(open_inline) - 1 - open_inline[::-1].index(tag) :]
                continue
            if held[tag]:
                up = at
                while up.tag != tag:
                    up = up.parent
                at, open_inline = close(up), []
            continue
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if tag in INLINE:
            if tag == "br":
                place += 1
                at.texts.append((place, " ", False))
            elif tag not in VOID:
                open_inline.append(tag)
                at.links += tag == "a"
            continue
        if tag in ("html", "body") and (tag == "html" or any(x.tag == "body" for x in nodes[:8])):
            continue
        if (tag in CLOSES_P or tag == "li") and held["p"] + held["li"]:
            up = at
            while up.parent and up.tag not in ("p", "li") and up.tag not in CLOSES_P:
                up = up.parent
            if up.parent and (up.tag == "p" and tag != "li" or up.tag == tag == "li"):
                at = close(up)
        open_inline = []
        at_attrs = " ".join(x for g in _ATTR.findall(t) for x in g if x).lower() if "=" in t else ""
        new = Node(tag, at_attrs, at)
        nodes.append(new)
        at.kids.append(new)
        if tag not in VOID:
            at = new
            held[tag] += 1
    return nodes


_BAD, _GOOD = set(BAD), set(GOOD)


@lru_cache(10_000)
def _signs(tag: str, attrs: str) -> tuple[bool, bool, int, bool]:
    """Whether an element is marked as bad or good, its role, and whether it is hidden."""
    w = set(re.split(r"[^a-z]+", attrs)) | {tag}
    return bool(w & _BAD), bool(w & _GOOD) and tag != "body", _ROLE.get(tag, 3 if tag[:1] == "h" and tag[1:].isdigit() else 0), tag in HIDDEN


_ROLE = {"nav": 1, "footer": 1, "header": 1, "aside": 1, "form": 1, "article": 2, "main": 2, "p": 3, "li": 4, "ul": 5, "ol": 5, "div": 6, "section": 6, "td": 7, "table": 7, "blockquote": 8, "pre": 8, "body": 9, "html": 9}


def features(nodes: list[Node]) -> np.ndarray:
    """A row of FEATURES numbers for each node."""
    n = len(nodes)
    for k, x in enumerate(nodes):
        x.order = k
    chars, links, sub, depth, bad, good, stops, nested, role, hidden, most = ([0.0] * n for _ in range(11))
    for k, x in enumerate(nodes):
        up = x.parent.order if x.parent else -1
        own_bad, own_good, role[k], hidden[k] = _signs(x.tag, x.attrs)
        if x.parent:
            depth[k] = depth[up] + 1
        bad[k] = own_bad or (x.parent is not None and bad[up] and not own_good)
        good[k] = own_good or (x.parent is not None and good[up] and not own_bad)
        nested[k] = 2 * own_bad + own_good
        for _, s, linked in x.texts if not hidden[k] else []:
            c = len(s.strip())
            chars[k] += c
            links[k] += c * linked
            stops[k] += s.count(".") + s.count(",")
    own = chars[:]
    for k in range(n - 1, 0, -1):
        up = nodes[k].parent.order
        chars[up] += chars[k]
        links[up] += links[k]
        stops[up] += stops[k]
        sub[up] += sub[k] + 1
        most[up] = max(most[up], chars[k])
    total, rows = max(chars[0], 1), []
    for k, x in enumerate(nodes):
        up = x.parent.order if x.parent else 0
        same = x.parent.kids if x.parent else [x]
        some = max(chars[k], 1)
        rows.append((own[k], chars[k], chars[k] / total, links[k] / some, stops[k] / some, sub[k], chars[k] / (sub[k] + 1), depth[k], bad[k], good[k], nested[k], role[k], hidden[k], len(x.kids), len(same), (k - same[0].order) / max(1, same[-1].order - same[0].order), most[up] / total, k / n, chars[up] / total, links[up] / max(chars[up], 1), role[k] == 3, own[k] / some, nested[up], x.links))
    return np.array(rows, np.float32)


class Trees:
    """Boosted regression trees of depth 3 on the logistic loss, over quantile cuts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3):
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)
        f, self.trees = np.full(len(y), self.base), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            at, tree = np.zeros(len(y), np.int64), []
            for level in range(3):
                split = []
                for node in range(1 << level):
                    own = np.flatnonzero(at == node)
                    best = (0.0, 0, -1)
                    for j in range(x.shape[1]) if len(own) else []:
                        gs, hs = (np.cumsum(np.bincount(code[own, j], v[own], len(self.cuts[j]) + 1)) for v in (g, h))
                        gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                        if len(gain) > 1 and gain[:-1].max() > best[0] + 1e-9:
                            best = (float(gain[:-1].max()), j, int(gain[:-1].argmax()))
                    split.append((best[1], self.cuts[best[1]][best[2]] if best[2] >= 0 else np.inf))
                tree.append((np.array([s[0] for s in split]), np.array([s[1] for s in split])))
                at = 2 * at + (x[np.arange(len(y)), tree[-1][0][at]] >= tree[-1][1][at])
            leaf = rate * np.bincount(at, g, 8) / (np.bincount(at, h, 8) + 1)
            self.trees.append((tree, leaf))
            f = f + leaf[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds that a node is in."""
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for tree, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for j, cut in tree:
                at = 2 * at + (x[rows, j[at]] >= cut[at])
            f += leaf[at]
        return f


#: Blocks of an article besides paragraphs, in made-up pages.
OTHER = ("<figure><img src=a.png><figcaption>{}</figcaption></figure>", "<h2>{}</h2>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<section><p>{}</p></section>", "<div><p>{}</p></div>", "<dl><dd>{}</dd></dl>")


def layouts(n: int = 300, seed: int = 5) -> Iterator[tuple[str, str]]:
    """Made-up pages; text of the main part has the word MAIN in each run, and only there."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioulnrstdm") for _ in range(rnd.randint(2, 9)))
    say = lambda k: " ".join(word() for _ in range(k)) + rnd.choice([".", ".", "", ","])
    link = lambda: f'<a href="/{word()}">{word()}</a>'

    def block(kind: str) -> str:
        k = rnd.random()
        if kind == "menu":
            items = "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 9)))
            return rnd.choice([f"<nav><ul>{items}</ul></nav>", f'<div class="{rnd.choice(["menu", "navbar nav", "breadcrumbs"])}"><ul>{items}</ul></div>', f"<ul>{items}</ul>"])
        if kind == "ad":
            return f'<{"div" if k < 0.8 else "aside"} class="{rnd.choice(["ad", "ads", "advert", "promo", "sponsor banner", "cookie-notice", "newsletter"])}">{say(rnd.randint(3, 25))}</div>'
        if kind == "footer":
            return rnd.choice([f"<footer>&copy; {say(6)} &middot; {say(5)}</footer>", f'<div id="footer"><p>{say(9)}</p>{link()}</div>'])
        if kind == "side":
            return rnd.choice([f"<aside><h3>{say(2)}</h3><p>{say(15)}</p>{link()}</aside>", f'<div class="sidebar"><ul><li>{link()}</li><li>{link()}</li></ul><p>{say(20)}</p></div>'])
        if kind == "comments":
            return rnd.choice(['<section class="comments">', '<div id="comments">']) + "".join(f'<div class="comment"><b>{word()}</b><p>{say(rnd.randint(4, 40))}</p></div>' for _ in range(rnd.randint(1, 5))) + "</div>"
        if kind == "form":
            return f'<form action="/s"><label>{word()}</label><input name="q"><button>{word()}</button></form>'
        return f"<header><h2>{say(3)}</h2><p>{say(5)}</p></header>"

    for _ in range(n):
        para = lambda: rnd.choice([*["<p>{}</p>", "<p>{}", "<p><b>{}<br></p>", "<p>{}</p>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>"] * 3, *OTHER]).format(f"MAIN {say(rnd.choice([1, 2, 4, 10, 30, 60, 120]))}{rnd.choice(['', link()])}")
        inner = f"<h1>MAIN {say(6)}</h1>" * (rnd.random() < 0.8) + "".join(para() + (block("ad") if rnd.random() < 0.06 else "") for _ in range(rnd.randint(1, 14)))
        wrap = rnd.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="post">{}</div>', '<div class="entry-content">{}</div>', "<main><article>{}</article></main>", "<div>{}</div>"])
        before = [block(rnd.choice(["menu", "header", "ad", "form", "side"])) for _ in range(rnd.randint(1, 4))]
        after = [block(rnd.choice(["footer", "side", "comments", "ad", "menu", "form"])) for _ in range(rnd.randint(1, 4))]
        yield f"<!DOCTYPE html><html><head><title>{say(4)}</title></head><body>{''.join(before)}{wrap.format(inner)}{''.join(after)}" + "</body></html>" * (rnd.random() < 0.8)


@lru_cache(1)
def model() -> Trees:
    xs, ys = [], []
    for page in layouts():
        nodes = parse(page)
        xs.append(features(nodes))
        y = np.array([any("MAIN" in s for _, s, _ in x.texts) for x in nodes])
        for k in range(len(nodes) - 1, 0, -1):
            y[nodes[k].parent.order] |= y[k]
        ys.append(y)
    return Trees(np.concatenate(xs), np.concatenate(ys).astype(float))


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The best labels in which no node that is in has an ancestor that is out."""
    n = len(nodes)
    gain = odds.astype(float).copy()  # of a node being in, over its whole subtree being out
    for k in range(n - 1, 0, -1):
        gain[nodes[k].parent.order] += max(0.0, gain[k])
    on = np.zeros(n, bool)
    for k, x in enumerate(nodes):
        on[k] = gain[k] > 0 and (x.parent is None or on[x.parent.order]) and x.tag not in HIDDEN
    return on


def text_of(nodes: list[Node], on: np.ndarray) -> str:
    """Blocks of the nodes that are in, in page order: a node's text up to its next child is one block."""
    texts = sorted((p, x.order, s) for x in nodes for p, s, _ in x.texts)  # what stands between two texts of a node is below it
    runs = ("".join(s for _, _, s in run) for k, run in groupby(texts, key=lambda t: t[1]) if on[k])
    blocks = (_SPACE.sub(" ", entities.unescape(s)).strip(" ") for s in runs)
    return "\n\n".join(b for b in blocks if b)


def extract(pages: list[str], trees: Trees) -> list[str]:
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    odds = trees.score(np.concatenate([features(x) for x in parsed]))
    out, at = [], 0
    for nodes in parsed:
        out.append(text_of(nodes, decode(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def _run(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                text = extract([x or "" for x in part.column("html").to_pylist()], trees)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of the whole html of each row of ``pages`` (page_id, url, html; others are not read).

    Gives page_id, url, text, n_chars. A null or empty page, or one without main text, has the
    empty text. Rows are independent: null ids and repeated rows stay, an empty table stays empty.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_run(model()), "page_id long, url string, text string, n_chars long")
