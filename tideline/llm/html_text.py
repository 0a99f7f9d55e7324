"""Main text of web pages: gradient-boosted trees over DOM nodes with hierarchical decoding.

A page becomes a tree of its block elements (and of others with a class, id or role); text of other inline elements
belongs to the element around them. Each node gets features: tag and attribute tokens, its own and its ancestors', depth,
sizes, text and link density of the subtree, place and size among its siblings. Trees give the log-odds that a node
belongs to the article. Decoding picks the set of nodes with the greatest sum of log-odds in which each kept node's
parent is kept, too (one pass from the leaves up, one down), so no choice contradicts an ancestor's or a descendant's.

The trees are trained here, on PAGES pages from a seeded generator of layouts with known article nodes; no page of the
input is used, so results don't depend on what else is in the table. What attribute tokens say is learned, too: from the
layouts come the log-odds of hashed tokens, which the trees take as features (while they learn, each half of the pages
with the odds of the other half) beside two counts by fixed lists, by which tokens that no layout has are known. One fit
serves a whole process.

White space inside a block becomes one space; blocks are joined in page order by one space; character references are
decoded once. Elements that the page hides (``hidden``, ``display: none``) and marked sections outside drawings and formulas are
no text. Scripts, styles, textareas and the page's title are skipped; formulas and drawings belong to the element
around them, and the content of object, canvas, noscript, template, iframe and xmp is for the trees to judge.
Broken markup: open elements end with the page, stray end tags are ignored, a tag without its end is text, an open svg or
math ends at the next block tag. Any nesting depth works, as nothing recurses, and time grows with the page's length.

Nulls and empty pages give the empty text; null ids and urls are carried on. Repeated rows give repeated results, an
empty table an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from tideline.llm.boosting import Trees
from tideline.llm.frames import received, send

PAGES = 700
#: HTML element names by their role.
BLOCKS = "html body div section article main nav aside header footer p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th caption blockquote pre form fieldset figure figcaption address details summary dialog menu center button select option label hgroup search xmp".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Nodes of their own without a block's edges, and elements that a block tag ends unless it is in one of the last.
EMBEDDED = frozenset("noscript template iframe object canvas noframes".split())
FOREIGN, GUESTS = frozenset(["svg", "math"]), frozenset("foreignobject annotation-xml".split())
ENDS_P = frozenset(BLOCKS) - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button", "select", "option", "label", "li", "dt", "dd"} | {"hr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol table dl body html article section div select td th menu".split())
#: Attribute tokens that speak against and for an article (fixed values).
AGAINST = "ad ads advert advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside widget related recommended popular share social follow comment comments reply replies disqus discussion responses cookie consent notice alert popup modal overlay newsletter subscribe signup login search form toolbar tags pagination pager copyright legal disclaimer gdpr toc skip hidden outbrain taboola feedback teaser".split()
FOR = "article content post entry story text body main page prose copy detail".split()
_ACT = {t: k for k, t in enumerate(BLOCKS)}
_AGAINST, _FOR = frozenset(AGAINST), frozenset(FOR)
_TOKENS = 4096
#: A comment, a marked section, a declaration, or the start of a tag: its slash and its name.
_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*")
GROUPS = {"nav": 1, "menu": 1, "header": 2, "footer": 3, "aside": 4, "form": 5, "button": 5, "select": 5, "option": 5, "label": 5, "fieldset": 5, "dialog": 5, "search": 5, "article": 6, "main": 7, "p": 8, "blockquote": 9, "pre": 9, "xmp": 9, **dict.fromkeys(EMBEDDED, 14), "ul": 10, "ol": 10, "li": 11, "table": 12, "tr": 12, "td": 12, "th": 12, "section": 13, "div": 14, "h1": 15, "h2": 16, "h3": 16, "h4": 16, "h5": 16, "h6": 16, "body": 17, "html": 17}


class _Ends:
    """Where tags end: at the first ``>`` outside quotes. Places from which a search has run to the page's end are kept, so
    that no part is searched again in the same state."""

    def __init__(self, page: str):
        self.page, self.dead = page, set()
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def find(self, at: int) -> int:
        passed = [at]
        while at not in self.dead and at <= self.last[">"]:
            m = _STOP.search(self.page, at)
            if m[0] == ">":
                return m.start()
            if m.start() == self.last[m[0]]:
                break
            at = self.page.find(m[0], m.end()) + 1
            passed.append(at)
        self.dead.update(passed)
        return -1


def parse(page: str) -> tuple[list[tuple], list[tuple[int, str | None]]]:
    """Nodes (parent, tag, marks against, marks for, hidden, attribute tokens) and segments (node, text, or None for a
    block's edge)."""
    nodes: list[tuple] = [(-1, "html", 0, 0, 0, ())]
    segments: list[tuple[int, str | None, bool]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # (tag, node); inline elements have the node around them
    open_: Counter = Counter()  # elements of each name in the stack
    ends, links = _Ends(page), 0
    at, n = 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a:
            s = page[a:b]
            segments.append((stack[-1][1], html.unescape(s) if "&" in s else s, links > 0))

    def close(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            tag, _ = stack.pop()
            open_[tag] -= 1
            links -= tag == "a"
            if tag in _ACT:
                segments.append((0, None, False))

    said = 0  # the text before is in segments
    while at < n:
        m = _OPEN.search(page, at)
        if m is None:
            break
        stop = m.end()
        if m[3] is not None or m.end() - m.start() == 2:
            stop = (ends.find(m.end()) if m[3] is not None else page.find(">", m.end()) if m.end() <= ends.last[">"] else -1) + 1
            if not stop:  # no tag
                at = m.end()
                continue
        text(said, m.start())
        at = said = stop
        if m[3] is None:
            if m[1] is not None and (open_["svg"] or open_["math"]):  # elsewhere it is a comment
                segments.append((stack[-1][1], m[1], links > 0))
            continue
        tag, rest = m[3].lower(), page[m.end() : stop - 1]
        if tag in _ACT and (open_["svg"] or open_["math"]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in FOREIGN:
                    close(k)
                    break
                if stack[k][0] in GUESTS or stack[k][0] in _ACT:
                    break
        if m[2] and not open_[tag]:
            if tag == "br" or tag == "p":
                segments.append((0, None, False))
            continue
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in _ACT and stack[k][0] in _ACT and tag != "a":
                    if stack[k][0] in SCOPES:
                        break  # an inline end tag ends nothing outside
            else:
                if tag == "br" or tag == "p":
                    segments.append((0, None, False))
            continue
        if tag in RAW and not (tag == "title" and (open_["svg"] or open_["math"])):
            if not rest.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                stop = page.find(">", end.end()) if end else -1
                at = said = n if stop < 0 else stop + 1
            continue
        if tag == "head" or tag == "html":
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                if tag == "hr" and open_["p"]:
                    _end_p(stack, close)
                segments.append((0, None, False))
            continue
        if tag in ENDS_P and open_["p"]:
            _end_p(stack, close)
        if tag in SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SAME[tag]:
                    close(k)
                    break
                if stack[k][0] in SCOPES and stack[k][0] not in SAME[tag]:
                    break
        against = kept = 0
        hidden = bool(rest) and _HIDDEN.search(rest) is not None
        tokens: set = set()
        for _, a, b, c in _ATTRIBUTE.findall(rest) if rest else ():
            parts = {x.lower() for x in _PART.findall(a or b or c)}
            against += len(parts & _AGAINST)
            kept += len(parts & _FOR)
            tokens |= {zlib.crc32(x.encode()) % _TOKENS for x in parts}
        node = stack[-1][1]
        if tag in _ACT or tag in EMBEDDED or against or kept or hidden:
            nodes.append((node, tag, against, kept, int(hidden), tuple(sorted(tokens))))
            node = len(nodes) - 1
        if tag in _ACT:
            segments.append((0, None, False))
        if rest.endswith("/") and tag not in _ACT:
            continue
        links += tag == "a"
        stack.append((tag, node))
        open_[tag] += 1
        if tag == "xmp":  # its content is text, tags and references included
            end = re.compile("</xmp", re.I).search(page, at)
            stop = end.start() if end else n
            segments.append((node, page[at:stop], links > 0))
            at = said = stop
    text(said, n)
    return nodes, segments


def _end_p(stack, close) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] == "p":
            close(k)
            return
        if stack[k][0] in _ACT:
            return


def _layers(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth from 1 on."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:] if len(depth) else []


def features(pages: list[tuple[list, list]], odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of the nodes of all pages, their parents, depths and pages; ``odds``: log-odds of hashed attribute tokens."""
    parent, page, tag, marks, own, link, commas, words, level, said = [], [], [], [], [], [], [], [], [], []
    for i, (nodes, segments) in enumerate(pages):
        base = len(parent)
        parent += [x[0] + base if x[0] >= 0 else -1 for x in nodes]
        page += [i] * len(nodes)
        tag += [GROUPS.get(x[1], 0) for x in nodes]
        marks += [x[2:5] for x in nodes]
        said += [float(odds[list(x[5])].sum()) if x[5] else 0.0 for x in nodes]
        depths = [0] * len(nodes)  # parents come before their children
        for i_, x in enumerate(nodes):
            depths[i_] = depths[x[0]] + 1 if x[0] >= 0 else 0
        level += depths
        o, k, c, w = ([0] * len(nodes) for _ in range(4))
        for at, s, linked in segments:
            if s is not None and not s.isspace():
                o[at] += len(s)
                k[at] += len(s) * linked
                c[at] += s.count(",") + s.count(".")
                w[at] += s.count(" ") + 1
        own += o
        link += k
        commas += c
        words += w
    parent, page, tag = np.array(parent), np.array(page), np.array(tag)
    marks, n = np.array(marks, dtype=float).reshape(-1, 3), len(parent)
    own, link, commas, words = (np.array(x, dtype=float) for x in (own, link, commas, words))
    up = np.maximum(parent, 0)
    depth, said = np.array(level, dtype=np.int64), np.array(said, dtype=float)
    layers = _layers(depth)
    sums = np.stack([own, link, commas, words, np.ones(n), (tag == 8) * 1.0, (tag == 11) * 1.0, (tag == 15) * 1.0, marks[:, 0] * 1.0, (tag == 6) * 1.0], axis=1)
    for layer in reversed(layers):
        np.add.at(sums, parent[layer], sums[layer])
    above = np.zeros((n, 9))  # ancestors: against, for, hidden, nav or header or footer or aside, form, article or main, list, table, odds of tokens
    mine = np.stack([marks[:, 0], marks[:, 1], marks[:, 2], (tag >= 1) & (tag <= 4), tag == 5, (tag == 6) | (tag == 7), tag == 10, tag == 12, said], axis=1).astype(float)
    for layer in layers:
        above[layer] = above[parent[layer]] + mine[parent[layer]]
    root = np.maximum.accumulate(np.where(parent < 0, np.arange(n), 0)) if n else up
    siblings = np.bincount(up, minlength=n).astype(float) if n else own
    order = np.argsort(up, kind="stable")
    place = np.zeros(n)
    starts = np.searchsorted(up[order], up[order])
    place[order] = np.arange(n) - starts
    same = np.unique(up * 32 + tag, return_inverse=True)[1] if n else up
    alike = np.bincount(same)[same] if n else own
    total = np.maximum(sums[:, 0], 1)
    cols = [
        tag, marks[:, 0], marks[:, 1], marks[:, 2], said, *above.T, depth, np.log1p(own), np.log1p(sums[:, 0]), sums[:, 1] / total, link / np.maximum(own, 1), np.log1p(sums[:, 2]), sums[:, 2] / np.maximum(sums[:, 3], 1),
        np.log1p(sums[:, 3]), np.log1p(sums[:, 4]), sums[:, 0] / sums[:, 4], sums[:, 5], sums[:, 6] / sums[:, 4], sums[:, 7], sums[:, 8] / sums[:, 4], sums[:, 9],
        siblings[up], place / np.maximum(siblings[up], 1), alike, sums[:, 0] / total[up], sums[:, 0] / total[root], (np.arange(n) - root) / sums[root, 4],
    ]
    return np.stack([np.asarray(c, dtype=float) for c in cols], axis=1), parent, depth, page


def decode(logit: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The kept nodes: the closed set under parents with the greatest sum; roots are kept for free."""
    best = np.where(parent < 0, 0.0, logit)
    layers = _layers(depth)
    for layer in reversed(layers):
        np.add.at(best, parent[layer], np.maximum(best[layer], 0))
    keep = parent < 0
    for layer in layers:
        keep[layer] = keep[parent[layer]] & (best[layer] > 0)
    return keep


def join_blocks(segments: list[tuple], keep: np.ndarray) -> str:
    """The text of kept nodes: white space runs are one space, block edges are spaces."""
    return " ".join("".join(" " if s is None else s for at, s, _ in segments if s is None or keep[at]).split())


# --- layouts to learn from -------------------------------------------------------------------------------------------


def _layout(rng: random.Random) -> tuple[str, list[str]]:
    """A page, and marks: article text holds the letter ``\\u0394`` in each block."""
    syllable = ["ba", "ke", "lo", "mi", "ra", "ten", "us", "or", "ve", "du", "san", "pi"]
    word = lambda: "".join(rng.choice(syllable) for _ in range(rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() + rng.choice(["", "", "", "", ",", "."]) for _ in range(rng.randint(a, b)))
    good = lambda a, b: "Δ" + say(a, b).capitalize() + "."
    pick = rng.choice
    at = lambda names: pick([f' class="{pick(names)}"', f' id="{pick(names)}"', f' class="{pick(names)} {word()}"', ""])
    tags = lambda n: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))
    menu = lambda: pick([f"<nav><ul>{tags(rng.randint(2, 9))}</ul></nav>", f'<div class="{pick(["menu", "navbar", "breadcrumbs", "nav-main"])}"><ul>{tags(rng.randint(2, 9))}</ul></div>', f"<nav>{' | '.join(f'<a href=/x>{word()}</a>' for _ in range(5))}</nav>", f"<ul>{tags(rng.randint(4, 9))}</ul>"])
    head = lambda: pick(["", f"<header{at(['masthead', 'site-header'])}><h2>{say(1, 4)}</h2><p>{say(2, 8)}</p></header>", f'<div class="header">{say(2, 9)}</div>', f"<header>{say(1, 4)}{menu()}</header>"])
    ad = lambda: pick([f'<div class="{pick(["ad", "ads", "advert", "sponsored", "promo-box", "banner"])}">{pick([say(3, 25), "<p>" + say(4, 40) + "</p>", f"<a href=x>{say(2, 9)}</a>"])}</div>', f'<aside class="{pick(["advertisement", "promo"])}"><p>{say(4, 30)}</p></aside>'])
    note = lambda: pick([f'<div class="{pick(["cookie-notice", "consent", "alert", "notice", "gdpr-banner", "popup"])}"><p>{say(5, 40)}</p><button>{word()}</button></div>', f'<div role="alert">{say(4, 25)}</div>', f'<div id="newsletter"><p>{say(4, 20)}</p><form><label>{word()}</label><input><button>{word()}</button></form></div>'])
    form = lambda: f"<form action=/s><fieldset><label>{say(1, 4)}</label><input name=q><select><option>{word()}</option><option>{word()}</option></select><p>{say(2, 12)}</p><button>{word()}</button></fieldset></form>"
    side = lambda: pick([f"<aside{at(['sidebar', 'related', 'widget'])}><h3>{say(1, 3)}</h3>{pick([f'<ul>{tags(rng.randint(2, 7))}</ul>', f'<p>{say(5, 60)}</p>', f'<p>{say(5, 30)}</p><p>{say(5, 30)}</p>'])}</aside>", f'<div class="{pick(["sidebar", "related-posts", "share", "popular", "side-col"])}"><h4>{say(1, 3)}</h4><ul>{tags(rng.randint(2, 7))}</ul></div>', f'<div id="sidebar"><p>{say(5, 60)}</p></div>'])
    talk = lambda: (lambda n, kind: f"<{kind}{pick([' class=comments', ' id=comments', ' class=comment-list', ' class=discussion'])}><h3>{say(1, 3)}</h3>" + "".join(pick([f"<div class=comment><p>{say(4, 60)}</p></div>", f"<li class=reply>{say(4, 60)}</li>", f"<article class=comment><h4>{word()}</h4><p>{say(4, 60)}</p></article>"]) for _ in range(n)) + f"</{kind}>")(rng.randint(1, 6), pick(["section", "div"])) if rng.random() < 0.7 else thread(rng.randint(2, 6), pick(["post", "item", "entry", "message"]))
    # a thread: equal posts, each with who wrote it
    thread = lambda n, one: f"<div class={pick(['thread', 'posts', 'board', 'answers'])}>" + "".join(f"<div class={one}>{pick([f'<span class=author>{word()}</span> <time>{word()} 3</time>', f'<b>{word()}</b> said:', f'<h4>{word()}</h4>'])}<p>{say(4, 60)}</p></div>" for _ in range(n)) + "</div>"
    foot = lambda: pick([f"<footer>&copy; {say(2, 15)}</footer>", f"<footer><p>{say(3, 20)}</p><ul>{tags(3)}</ul></footer>", f'<div class="footer">&copy; {say(3, 20)}</div>'])

    def body() -> str:
        out = []
        if rng.random() < 0.85:
            out.append(f"<h1>{good(2, 12)}</h1>")
        if rng.random() < 0.25:
            out.insert(0 if rng.random() < 0.5 else len(out), f"<header><h2>{good(2, 9)}</h2><p>{good(3, 9)}</p></header>" if rng.random() < 0.3 else f"<p>{good(1, 5)}</p>")
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            out.append(pick([
                f"<p>{good(1, 120)}</p>", f"<p>{good(15, 150)}</p>", f"<p>{good(8, 60)} <a href=/y>{say(1, 4)}</a> {say(4, 30)}</p>", f"<p><b>{good(3, 12)}<br><p>{good(5, 80)}</p>", f"<p>{good(1, 6)}</p>", f"<p>{good(1, 1)}</p>", f"<p>{good(1, 2)}</p>", f"<p>{(good(1, 1) + ' ') * rng.randint(2, 300)}</p>",
                f"<h2>{good(1, 7)}</h2><p>{good(10, 60)}</p>", f"<blockquote><p>{good(5, 40)}</p></blockquote>", f"<ul>{''.join(f'<li>{good(2, 20)}</li>' for _ in range(rng.randint(2, 6)))}</ul>", f"<ol>{''.join(f'<li>{good(1, 5)}</li>' for _ in range(rng.randint(2, 6)))}</ol>",
                f"<table><tr><th>{good(1, 2)}</th><td>{good(1, 9)}</td></tr><tr><td>{good(1, 4)}</td><td>{good(1, 4)}</td></tr></table>", f"<div>{good(10, 90)}</div>", f"<pre>{good(4, 30)}</pre>", f"<figure><img src=a><figcaption>{good(3, 12)}</figcaption></figure>", f"<section><h3>{good(1, 5)}</h3><p>{good(10, 60)}</p></section>",
            ]))
            if rng.random() < 0.12:
                out.append(pick([ad, ad, note, side, form])())
        return "".join(out)

    shell = pick(["article", "article", "article", "main", "section", "div", "div"])
    names = ["content", "article-body", "post", "entry-content", "story", "main-text"]
    attr = f' class="{pick(names)}"' if shell in ("div", "section") and rng.random() < 0.6 else at(names) if rng.random() < 0.4 else ""
    parts = [f"<{shell}{attr}>{body()}{talk() if rng.random() < 0.08 else ''}</{shell}>"]
    if rng.random() < 0.25:
        parts = [f"<div class={pick(['wrapper', 'container', 'page', 'row'])}>{side() if rng.random() < 0.5 else ''}{parts[0]}{side() if rng.random() < 0.4 else ''}</div>"]
    if rng.random() < 0.3:
        parts = [f"<main>{parts[0]}{talk() if rng.random() < 0.3 else ''}</main>"] if shell != "main" else parts
    front = [f() for f, p in ((note, 0.25), (head, 0.4), (menu, 0.85), (ad, 0.5), (form, 0.12), (side, 0.15)) if rng.random() < p]
    back = [f() for f, p in ((ad, 0.2), (side, 0.3), (talk, 0.35), (form, 0.15), (note, 0.1), (menu, 0.1), (foot, 0.85)) if rng.random() < p]
    page = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{''.join(front + parts + back)}" + "</body></html>" * (rng.random() < 0.8)
    return page


@functools.cache
def train() -> Trees:
    """Trees from PAGES generated pages, with the odds of attribute tokens; the same each time, fitted once a process."""
    rng = random.Random(7)
    pages = [parse(_layout(rng)) for _ in range(PAGES)]
    good = []
    for nodes, segments in pages:
        y = np.zeros(len(nodes))
        for at, s, _ in segments:
            if s is not None and "Δ" in s:
                while at >= 0 and not y[at]:
                    y[at] = 1
                    at = nodes[at][0]
        good.append(y)
    half = PAGES // 2
    seen = np.zeros((2, 2, _TOKENS))
    for i, (nodes, _) in enumerate(pages):
        for x, kind in zip(nodes, good[i], strict=True):
            for token in x[5]:
                seen[i // half, int(kind), token] += 1
    odds = lambda n: np.log((n[1] + 0.5) / (n[0] + 0.5))
    x = [features(own, odds(seen[1 - k]))[0] for k, own in enumerate((pages[:half], pages[half:]))]
    trees = Trees().fit(np.concatenate(x), np.concatenate(good))
    trees.odds = odds(seen.sum(0))
    return trees


def extract(pages: list[str], trees: Trees) -> list[str]:
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    x, parent, depth, page = features(parsed, trees.odds)
    hidden = x[:, 3] > 0  # what a page hides is no text, whatever the trees say
    keep = decode(np.where(hidden, -1e9, trees.logits(x)), parent, depth)
    first = np.searchsorted(page, np.arange(len(pages) + 1))
    return [join_blocks(segments, keep[first[i] : first[i + 1]]) for i, (_, segments) in enumerate(parsed)]


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text, n_chars of every page."""
    import pyarrow as pa

    sent = send(pages.sparkSession, train())  # some kilobytes

    def run(batches):
        trees = received(sent)
        for batch in batches:
            k = 0
            while k < batch.num_rows:  # parts of at most 2 MB, or one page
                end, size = k, 0
                while end < batch.num_rows and (end == k or size < 2_000_000) and end - k < 256:
                    size += len(batch.column(2)[end].as_buffer() or b"") if batch.column(2)[end].is_valid else 0
                    end += 1
                part = batch.slice(k, end - k)
                texts = extract([x or "" for x in part.column(2).to_pylist()], trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])
                k = end

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    return pages.select(key, url, page).mapInArrow(run, f"{key} {kinds[key]}, {url} {kinds[url]}, text string, n_chars long")
