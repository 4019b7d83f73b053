"""Main text of web pages by minimum cut.

A page becomes a list of text blocks (runs of inline content between block-level tags). A logistic classifier gives each
block the log odds of being content, which becomes the capacity of its edge to the content or the boilerplate terminal.
Smoothness edges join neighbours in page order (``NEXT``) and successive blocks below the same parent (``SIBLING``), so one doubtful
block follows its surroundings. The side of the minimum cut, found by maximum flow, is the labelling of least cost.

The classifier is fitted in ``fit`` on the blocks of ``FIT_PAGES`` pages made by rule, in several layouts with known main text (a
bound that doesn't grow with the data); its weights are a few numbers and go to every task.

Character references are decoded, white space inside a block (line breaks included) becomes one space, blocks are trimmed and
joined in page order by one newline. Scripts, styles, comments and the head never are text. Null html counts as empty and
gives an empty text; repeated rows give repeated results; an empty table gives none. One pass without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.tables import take_columns, tidy

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is no text of the page: code, a document of its own, or a part of a form. All others' content is text, formulas and what stands in for a picture included.
NO_TEXT = {"script", "style", "template", "textarea", "title", "iframe", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "center", "caption", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
    "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: A start tag ends these open elements first.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = {"table", "ul", "ol", "dl", "div", "article", "section", "main", "body", "td"}

ROLES = ("nav", "header", "footer", "side", "notice", "ad", "form", "comment", "share", "article")
BY_TAG = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "side", "form": "form", "button": "form", "fieldset": "form", "dialog": "notice", "article": "article", "main": "article"}
BY_WORD = {
    word: role
    for role, words in {
        "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip sitemap",
        "header": "header masthead topbar toolbar logo branding banner",
        "footer": "footer foot colophon copyright contentinfo",
        "side": "sidebar side aside widget widgets recommended recommendations trending popular rail complementary",
        "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer",
        "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense dfp",
        "form": "form login search contactform",
        "comment": "comment comments disqus discussion reply replies respond reactions",
        "share": "share sharing social tags byline tools",
        "article": "article content post entry story articlebody main",
    }.items()
    for word in words.split()
}
#: Words that a token may have beside those of a role, words that claim nothing below an article, and whole tokens of a role.
FILLING = set("area bar banner block bottom box buttons col container global group head inner item items left links list outer page panel primary right row secondary section site slot top unit wrap wrapper".split())
WEAK = set("alert copyright disclaimer discussion foot search side story tags tools".split())
BY_TOKEN = {f"related-{x}": "side" for x in ("articles", "links", "posts", "stories")}
ARTICLE, HEADER = 1 << ROLES.index("article"), 1 << ROLES.index("header")
CLOSING = tuple(".!?:;\"'”»)…。")
FEATURES = [*ROLES, "heading", "paragraph", "item", "link_share", "article_links", "log_words", "closed", "few_words", "constant"]
NEXT, SIBLING, CLIP = 0.4, 0.8, 6.0
FIT_PAGES, FIT_SEED = 240, 11

_words = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Block:
    __slots__ = ("linked", "parent", "parts", "roles", "tag")

    def __init__(self, tag: str, roles: int, parent: int) -> None:
        self.tag, self.roles, self.parent = tag, roles, parent
        self.parts: list[str] = []
        self.linked = 0


@lru_cache(maxsize=4096)
def roles_of(tag: str, attributes: str) -> tuple[int, int]:
    """Bits of the roles that an element's name, class, id and role claim; those of words that mean little within an article apart.

    A class or id is looked at token by token, and a token claims a role only if all of its words are known: ad-slot does, ad-hoc doesn't.
    """
    bits, weak = 1 << ROLES.index(BY_TAG[tag]) if tag in BY_TAG else 0, 0
    for name, a, b, c in ATTR.findall(attributes) if attributes else ():
        if name.lower() not in ("class", "id", "role", "aria-label", "itemprop"):
            continue
        value = a or b or c
        for token in [value] if name.lower() == "aria-label" else value.split():
            parts = [w.lower() for w in _words.findall(token)]
            if "-".join(parts) in BY_TOKEN:
                bits |= 1 << ROLES.index(BY_TOKEN["-".join(parts)])
            elif all(w in BY_WORD or w in FILLING for w in parts) and not set(re.sub("[A-Za-z _-]", "", token)) - set("0123456789"):
                for word in parts:
                    role = BY_WORD.get(word)
                    if role and (role != "article" or tag in ("div", "section", "main", "article", "td")):
                        if word in WEAK:
                            weak |= 1 << ROLES.index(role)
                        else:
                            bits |= 1 << ROLES.index(role)
    return bits, weak


def blocks(page: str) -> list[tuple[str, Block]]:
    """(text, block) of each block with text, in page order."""
    out: list[tuple[str, Block]] = []
    stack: list[tuple[str, int, int]] = []  # tag, roles so far, number
    number, at, links, quiet = 0, 0, 0, 0
    current: Block | None = None

    def close() -> None:
        nonlocal current
        if current is not None:
            text = " ".join("".join(current.parts).split())
            if text:
                out.append((text, current))
            current = None

    def say(raw: str) -> None:
        nonlocal current
        if quiet or not raw:
            return
        if current is None:
            if raw.isspace():
                return
            block = next((x for x in reversed(stack) if x[0] in BLOCK), ("body", 0, 0))
            above = next((x for x in reversed(stack) if x[0] in BLOCK and x[2] != block[2]), block)
            current = Block(block[0], stack[-1][1] if stack else 0, above[2] if block[0] not in ("body", "div", "article", "section", "main") else block[2])
        text = html.unescape(raw) if "&" in raw else raw
        current.parts.append(text)
        if links:
            current.linked += len("".join(text.split()))

    def pop(k: int) -> None:
        nonlocal links, quiet
        for tag, _, _ in stack[k:]:
            links -= tag == "a"
            quiet -= tag == "head"
        del stack[k:]

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                close()
            elif tag == "br":
                say(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in BLOCK or all(x[0] not in BLOCK for x in stack[k + 1 :]):
                        pop(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break
            continue
        if tag in NO_TEXT:
            if not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            elif tag == "br":
                say(" ")
            continue
        if tag in BLOCK:
            close()
            k = len(stack) - 1
            ends = ENDS.get(tag, ())
            while k >= 0 and ends and not (stack[k][0] in SCOPE and stack[k][0] not in ends):
                if stack[k][0] in ends:
                    pop(k)
                    break
                k -= 1
            for k in range(len(stack) - 1, -1, -1):  # a paragraph ends where a block begins, and what is open inline in it
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        own, weak = roles_of(tag, (m[3] or m[6] or "").strip())
        number += 1
        above = stack[-1][1] if stack else 0
        if not above & ARTICLE:
            own |= weak
        elif tag == "header":
            own &= ~HEADER  # an article's own header holds its title
        bits = above | own
        quiet += tag == "head"
        links += tag == "a"
        stack.append((tag, bits, number))
    close()
    return out


def features(text: str, block: Block) -> list[float]:
    letters = len(text) - text.count(" ")
    n = text.count(" ") + 1
    tag = block.tag
    return [
        *(float(block.roles >> k & 1) for k in range(len(ROLES))), float(tag[0] == "h" and tag[1:].isdigit()), float(tag in ("p", "blockquote", "pre")), float(tag in ("li", "dt", "dd", "td", "th", "option")),
        (linked := min(1.0, block.linked / letters)), linked * bool(block.roles & ARTICLE), math.log1p(n), float(text.endswith(CLOSING)), float(n < 4), 1.0,
    ]


def _page(rng: np.random.Generator) -> list[tuple[str, int]]:
    """One made page: (html, label) pieces, label 1 for blocks of the main text, 0 for others."""
    word = lambda: "".join(rng.choice(list("abcdeilmnorst"), rng.integers(2, 8)))
    line = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    sentence = lambda a, b: line(a, b).capitalize() + "."
    pick = lambda *x: x[rng.integers(len(x))]
    menu = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' for _ in range(rng.integers(3, 8))) + "</ul>"
    extra = {
        "nav": lambda: pick(f"<nav>{menu()}</nav>", f'<div class="menu">{menu()}</div>', f'<div id="breadcrumbs"><a href="/">{word()}</a> / <a href="/x">{word()}</a></div>'),
        "header": lambda: pick(f"<header><a href='/'>{line(1, 4)}</a><p>{sentence(3, 9)}</p></header>", f'<div class="masthead"><h2>{line(1, 4)}</h2></div>'),
        "footer": lambda: pick(f"<footer>&copy; {word()}.example &middot; {sentence(3, 12)}</footer>", f'<div id="footer"><p>{sentence(4, 14)}</p>{menu()}</div>'),
        "side": lambda: pick(f"<aside><h3>{line(1, 3)}</h3>{menu()}<p>{sentence(4, 20)}</p></aside>", f'<div class="sidebar"><p>{sentence(5, 25)}</p></div>', f'<div class="related-posts"><h3>{line(2, 4)}</h3>{menu()}</div>'),
        "notice": lambda: pick(f'<div class="cookie-notice"><p>{sentence(8, 25)}</p><button>ok</button></div>', f'<div id="newsletter"><p>{sentence(6, 20)}</p></div>', f'<div class="alert">{sentence(5, 15)}</div>'),
        "ad": lambda: pick(f'<div class="ad">{sentence(3, 15)}</div>', f'<div class="sponsored"><p>{sentence(5, 20)}</p></div>', f'<div id="ad-top"><a href="x">{line(3, 9)}</a></div>'),
        "form": lambda: f"<form><label>{line(1, 3)}</label><input name=q><button>{word()}</button><p>{sentence(4, 12)}</p></form>",
        "comment": lambda: pick(*(f'<{t} {a}><h3>{line(1, 3)}</h3>' + "".join(f'<div class="{c}"><p>{sentence(4, 40)}</p></div>' for _ in range(rng.integers(1, 5))) + f"</{t}>" for t, a, c in (("section", 'id="comments"', "comment"), ("div", 'class="comments"', "body"), ("div", 'class="replies"', "reply")))),
        "share": lambda: f'<div class="share"><a href="x">{word()}</a> <a href="y">{word()}</a></div>',
    }
    out: list[tuple[str, int]] = []
    for k in rng.permutation(["nav", "header", "notice", "ad", "side", "form"])[: rng.integers(1, 6)]:
        out.append((extra[k](), 0))
    opened, closed = pick(("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ("<div>", "</div>"), ("<section>", "</section>"))
    out.append((opened, -1))
    out.append((f"<h1>{line(2, 12)}</h1>", 1))
    for _ in range(rng.integers(1, 14)):
        if "article" in opened and rng.random() < 0.15:  # a list of links may be what an article says
            out.append((menu(), 1))
        body = " ".join(sentence(*pick((1, 4), (4, 18), (10, 40))) for _ in range(rng.integers(1, 4)))
        out.append((pick(f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}</p>", f"<h2>{line(1, 6)}</h2>", f"<ul><li>{body}</li><li>{sentence(2, 12)}</li></ul>", f"<blockquote>{body}</blockquote>", f'<p>{body} <a href="z">{line(1, 4)}</a>, {sentence(2, 8)}</p>', f"<div>{body}</div>"), 1))
        if rng.random() < 0.12:
            out.append((extra[pick("ad", "notice", "share", "side", "form")](), 0))
    if rng.random() < 0.3:
        out.append((extra["comment"](), 0))
    out.append((closed, -1))
    for k in rng.permutation(["comment", "footer", "side", "ad", "nav", "share"])[: rng.integers(1, 6)]:
        out.append((extra[k](), 0))
    return out


@lru_cache(maxsize=4)
def fit(n_pages: int = FIT_PAGES, seed: int = FIT_SEED) -> tuple[float, ...]:
    """Weights of the logistic classifier from the blocks of n_pages made pages, by gradient ascent with a weak ridge."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(n_pages):
        pieces = _page(rng)
        marked = "".join(p if label < 0 else f"<section data-y={label}>{p}</section>" for p, label in pieces)
        for text, block in blocks("<html><body>" + re.sub(r"<section data-y=(\d)>", r"<section><div>@@\1</div>", marked) + "</body></html>"):
            if text.startswith("@@"):
                label = int(text[2])
            else:
                xs.append(features(text, block))
                ys.append(label)
    x, y = np.array(xs), np.array(ys, float)
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(np.round(w, 6).tolist())


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: |odds| for each label against its sign, an edge's weight where its ends differ.

    Maximum flow by blocking flows over level graphs, from nodes of positive to nodes of negative odds.
    """
    n = len(odds)
    if all(x > 0 for x in odds) or all(x <= 0 for x in odds):
        return [x > 0 for x in odds]
    supply = [max(0, round(1000 * x)) for x in odds]
    demand = [max(0, round(-1000 * x)) for x in odds]
    graph: list[list[list[int]]] = [[] for _ in range(n)]  # [to, capacity, place of the reverse edge]
    for a, b, w in edges:
        graph[a].append([b, round(1000 * w), len(graph[b])])
        graph[b].append([a, round(1000 * w), len(graph[a]) - 1])
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i])
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached |= demand[i] > 0
            for to, capacity, _ in graph[i]:
                if capacity and level[to] < 0:
                    level[to] = level[i] + 1
                    queue.append(to)
        if not reached:
            return [x >= 0 for x in level]
        place = [0] * n
        for start in (i for i in range(n) if supply[i]):
            while supply[start]:
                path: list[tuple[int, list[int]]] = []
                i = start
                while not demand[i]:
                    while place[i] < len(graph[i]):
                        edge = graph[i][place[i]]
                        if edge[1] and level[edge[0]] == level[i] + 1:
                            break
                        place[i] += 1
                    if place[i] < len(graph[i]):
                        path.append((i, graph[i][place[i]]))
                        i = graph[i][place[i]][0]
                    elif path:
                        i = path.pop()[0]
                        place[i] += 1
                    else:
                        break
                if not demand[i]:
                    break
                flow = min(supply[start], demand[i], *(e[1] for _, e in path))
                supply[start] -= flow
                demand[i] -= flow
                for _, edge in path:
                    edge[1] -= flow
                    graph[edge[0]][edge[2]][1] += flow


def main_text(page: str | None, weights: tuple[float, ...]) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    if not TAG.search(page or ""):
        return "\n".join(text for text, _ in found)  # a page without any markup is text
    odds = [max(-CLIP, min(CLIP, x)) for x in (np.array([features(t, b) for t, b in found]) @ np.array(weights)).tolist()]
    edges = [(i, i + 1, NEXT) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, (_, block) in enumerate(found):
        if block.parent in last:
            edges.append((last[block.parent], i, SIBLING))
        last[block.parent] = i
    return "\n".join(text for (text, _), content in zip(found, minimum_cut(odds, edges), strict=True) if content)


def extract(pages: DataFrame, n_pages: int = FIT_PAGES) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    weights = fit(n_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return take_columns(pages, "page_id", "url", "html").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
