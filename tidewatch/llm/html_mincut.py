"""Main text of HTML pages by minimum-cut labelling of text blocks.

A page is scanned once into text blocks with their open elements. Elements that
hold no prose by the standard (scripts, styles, forms, controls, ...) give no
blocks at all. Each block is a node of a graph:

* terminal capacities are classifier costs: a logistic regression over length,
  link share, punctuation, headings, cue words in tags, classes, ids and roles,
  and membership of a thread; a positive logit ties the block to the content
  terminal, a negative one to the boilerplate terminal; menus, footers, asides
  and the like are tied to boilerplate without limit. A bad cue word outweighs
  good ones of the same class and of all elements around ("comment-content");
* a thread is what comments look like without any cue: two or more sibling
  elements without headings that each begin or end with a byline (a short line
  with a time or a verb of saying), or one element of bylines and prose in turn;
* a form is furniture and goes, unless it wraps the page: with an article, a main
  part, a first heading or more than half of the page's prose inside, only its
  controls go;
* smoothness edges join neighbours in page order, the stronger the closer they
  are in the DOM, and successive blocks of one container that something stands
  between.

The minimum cut, found by max-flow (Dinic), labels all blocks at once: a short
line between two paragraphs goes with them, a long legal text in a footer does
not. The regression is trained here, on pages generated from rules below.

Texts: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one line feed. Line breaks
by <br> stay inside their block.

Defined cases: null and empty pages give an empty text; unclosed and stray tags
are read as browsers do for paragraphs, lists and tables and else ignored; a
page of very many blocks is one graph of linear size; repeated rows give equal
texts.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)[^<>]*+>?|<[!?/][^>]*+>?|[^<]++|<", re.S)
VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
HIDDEN = re.compile(r"(?:^|[\s/])hidden(?:[\s/]|$)", re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp".split())
SILENT = set("head noscript template svg iframe object canvas button select option datalist dialog audio video map label legend".split())
BLOCK = set("html body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main nav header footer aside blockquote pre figure figcaption address hr center details summary fieldset menu hgroup search".split())
CLOSES_P = BLOCK - set("html body tr td th thead tbody tfoot caption li dt dd summary".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
HARD = set("nav footer aside menu search".split())
HARD_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
GOOD = set("article content main post entry story body text page prose".split())
BAD = set(
    "nav navbar navigation menu menubar sidebar aside footer foot masthead topbar header breadcrumb breadcrumbs ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations more comment comments reply replies respond disqus discussion widget toolbar pagination pager copyright legal disclaimer tags skip search".split()
)
FEATURES = ("bias", "log words", "link share", "ends like a sentence", "heading", "paragraph", "list item", "table cell", "inside article or main", "good cue", "bad cue", "no letters", "very short", "caption", "in a thread")
#: Shares of a page's prose that make an element its wrapper: with the first heading, and without one.
WRAPPED, ALONE = 0.3, 0.8
#: What comes after these in a class word tells of the page, not of the element.
ABOUT = set("has with without no is not category tag type status format wp js".split())
TITLED = re.compile(r"\b(?:entry|article|post|story)[-_]?header\b", re.I).search
BYLINE = re.compile(
    r"\d{1,2}[:.]\d{2}\b|\d{4}-\d\d?-\d\d?|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\b(?:ago|yesterday|today|hours?|minutes?|mins?|days?|says|said|wrote|writes|replied|reply|posted|commented|hier|heures?|jours?|écrit|répond|gestern|heute|stunden?|minuten|tagen?|schrieb|sagt|antwortet|ayer|hoy|horas?|minutos?|días?|escribió|dice|responde)\b", re.I
)


class Block:
    __slots__ = ("text", "links", "tag", "hard", "good", "bad", "inside", "box", "holder", "thread")


class _Element:
    __slots__ = ("tag", "hard", "good", "bad", "inside", "silent", "link", "number", "up", "depth", "form", "wraps", "prose", "heads", "first", "thread")


def _inside(up: _Element | None, tag: str) -> _Element:
    """An element without cues inside up."""
    e = _Element()
    e.tag, e.up, e.depth, e.form, e.wraps, e.prose, e.heads, e.first, e.thread = tag, up, up.depth + 1 if up else 0, up.form if up else None, False, 0, False, False, False
    return e


def _box(e: _Element) -> _Element:
    """The nearest element that makes blocks, e or around it."""
    while e.up and e.tag not in BLOCK:
        e = e.up
    return e


def meeting(a: _Element, b: _Element) -> tuple[_Element, int]:
    """The innermost block-making element around both, and how many such levels the deeper one lies below it."""
    i = j = 0
    while a is not b:
        if a.depth >= b.depth:
            a, i = _box(a.up), i + 1
        else:
            b, j = _box(b.up), j + 1
    return a, max(i, j)


def _cues(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element is hidden, whether its role rules it out, and good and bad cue words of class and id."""
    hidden, hard = bool(HIDDEN.search(VALUE.sub(" ", attributes))), False
    words: set[str] = set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            hidden = hidden or name == "class" and "hidden" in value.lower().split()
            for token in value.split():
                parts = re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower().replace("_", " ").replace("-", " ").split()
                parts = parts[: next((k for k, x in enumerate(parts) if x in ABOUT), None)]
                # the header of an article or entry holds its title
                words.update(x for x in parts if not (x == "header" and not GOOD.isdisjoint(parts)))
        elif name == "role":
            hard = hard or value.lower() in HARD_ROLES
            if value.lower() in ("main", "article"):
                words.add("main")
        elif name == "itemprop" and value.lower() == "articlebody":
            words.add("article")
        elif name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    bad = not words.isdisjoint(BAD)
    return hidden, hard, not bad and not words.isdisjoint(GOOD), bad


def blocks_of(page: str) -> list[Block]:
    root = _inside(None, "")
    root.hard, root.good, root.bad, root.inside, root.silent, root.link, root.number = False, False, False, False, False, False, 0
    stack, blocks, pieces, n_links, every = [root], [], [], 0, []
    at, n, blank = 0, len(page), True
    any_first: list[Block] = []

    def flush():
        nonlocal pieces, n_links, blank
        if pieces:
            text = " ".join(_html.unescape("".join(pieces)).split())
            if text:
                b, e = Block(), holder
                b.text, b.links, b.hard, b.inside, b.holder = text, min(n_links, len(text)), e.hard, e.inside, e
                b.box, b.thread = _box(stack[-1]), False
                b.tag = b.box.tag
                if b.tag[0:1] == "h" and b.tag[1:].isdigit():
                    while e and not e.heads:
                        e.heads, e = True, e.up
                elif not b.hard and text.count(" ") > 8:
                    b.box.prose += text.count(" ")
                if b.tag == "h1" and not b.hard and not any_first:
                    any_first.append(b)
                    e = b.box
                    while e and not e.first:
                        e.first, e = True, e.up
                blocks.append(b)
            pieces, n_links, blank = [], 0, True

    opened: Counter = Counter()

    def close(k):
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    holder = root  # the innermost element around all text of the block so far
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            first = m[0][0]
            if first != "<" or m.end() - m.start() == 1:
                e = stack[-1]
                if not e.silent:
                    pieces.append(m[0])
                    if blank:
                        holder = e
                    elif not m[0].isspace():
                        while holder.depth >= len(stack) or stack[holder.depth] is not holder:
                            holder = holder.up
                    blank = blank and m[0].isspace()
                    if e.link:
                        n_links += len(m[0])
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append("\n")
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
            if opened[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in BLOCK:
            flush()
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in IMPLIED:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in IMPLIED[tag]:
                    close(k)
                    break
                if stack[k].tag in SCOPE[tag]:
                    break
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        up = stack[-1]
        e = _inside(up, tag)
        every.append(e)
        hidden, hard, good, bad = _cues(m[3]) if m[3] and tag not in ("html", "body") else (False, False, False, False)
        e.number, e.link = len(every), up.link or tag == "a"
        if tag == "form":
            e.form = e
        elif e.form and tag in ("article", "main", "h1"):
            e.form.wraps = True
        # what is hidden inside a block is skipped, hidden blocks are ruled out
        e.silent = up.silent or tag in SILENT or hidden and tag not in BLOCK
        if tag == "body" and up.tag in ("html", "", "head"):
            e.silent = False
        e.inside = up.inside or tag in ("article", "main")
        e.hard = up.hard or hidden or hard or tag in HARD or tag == "header" and not up.inside and not TITLED(m[3])
        e.good, e.bad = good, bad
        stack.append(e)
        opened[tag] += 1
    flush()
    _inherit(root, every, bool(any_first))
    for b in blocks:
        b.good, b.bad = b.holder.good, b.holder.bad
        b.hard = b.hard or bool(b.box.form and not b.box.form.wraps and 2 * b.box.form.prose <= root.prose)
    _mark_threads(blocks, every)
    return blocks


def _inherit(root: _Element, every: list[_Element], headed: bool) -> None:
    """Sums prose over the elements around it, then hands cues down from elements that don't wrap the page."""
    for e in reversed(every):
        e.up.prose += e.prose
    for e in every:
        share = e.prose / root.prose if root.prose else 0
        wraps = e.first and share >= WRAPPED if headed else share >= ALONE
        e.bad = e.up.bad or e.bad and not wraps
        e.good = not e.bad and (e.up.good or e.good)


def _mark_threads(blocks: list[Block], every: list[_Element]) -> None:
    """Sets thread of blocks in comment-like units."""
    headed = lambda b: b.tag[:1] == "h" and b.tag[1:].isdigit()
    lines = [k for k, b in enumerate(blocks) if b.text.count(" ") < 12 and not headed(b) and BYLINE.search(b.text)]
    units: dict[tuple, dict[int, _Element]] = {}
    met: dict[int, tuple[_Element, int]] = {}
    marked = set(lines)
    for k in lines:
        for other in (k + 1, k - 1):
            if 0 <= other < len(blocks) and other not in marked and not headed(blocks[other]):
                unit, _ = meeting(blocks[k].box, blocks[other].box)
                if unit.up and not unit.heads and unit.tag not in ("body", "html", "main"):
                    units.setdefault((unit.up.number, unit.tag), {})[unit.number] = unit
                    if other > k:
                        met[unit.number] = unit, met.get(unit.number, (unit, 0))[1] + 1
                break
    for found in units.values():
        if len(found) > 1:
            for e in found.values():
                e.thread = True
    for unit, n in met.values():
        if n > 1 and unit.tag != "article":
            unit.thread = True
    for e in every:
        e.thread = e.thread or e.up.thread
    for b in blocks:
        b.thread = b.box.thread


def features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), len(FEATURES)))
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        x[k] = (
            1, np.log1p(words), b.links / max(1, len(b.text)), b.text[-1] in ".!?…:;\"”»)", b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag in ("p", "blockquote", "pre"), b.tag in ("li", "dd", "dt"), b.tag in ("td", "th"),
            b.inside, b.good, b.bad, not any(map(str.isalpha, b.text)), words <= 2, b.tag == "figcaption", b.thread,
        )
    return x


class Flow:
    """Max-flow by Dinic's method on arc lists; arc i and i ^ 1 are each other's reverse."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.left: list[float] = []

    def arc(self, a: int, b: int, forward: float, backward: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [forward, backward]

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = [source]
        for a in queue:
            for i in self.out[a]:
                b = self.to[i]
                if level[b] < 0 and self.left[i] > 1e-9:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def run(self, source: int, sink: int) -> list[int]:
        """Levels after the last phase: nodes with a level are on the source's side of the cut."""
        out, to, left = self.out, self.to, self.left
        while (level := self.levels(source))[sink] >= 0:
            nxt, path, a = [0] * len(out), [], source
            while True:
                if a == sink:
                    flow = min(left[i] for i in path)
                    for i in path:
                        left[i] -= flow
                        left[i ^ 1] += flow
                    k = next(k for k, i in enumerate(path) if left[i] <= 1e-9)
                    a = to[path[k] ^ 1]
                    del path[k:]
                    continue
                arcs, k = out[a], nxt[a]
                while k < len(arcs) and not (left[arcs[k]] > 1e-9 and level[to[arcs[k]]] == level[a] + 1):
                    k += 1
                nxt[a] = k
                if k < len(arcs):
                    path.append(arcs[k])
                    a = to[arcs[k]]
                elif path:
                    a = to[path.pop() ^ 1]
                    nxt[a] += 1
                else:
                    break
        return level


def closeness(a: Block, b: Block) -> float:
    """1 for blocks of one container, halved for each level up to the common one."""
    return 0.5 ** max(0, meeting(a.box, b.box)[1] - 1)


NEXT, SIBLING = 2.0, 1.0


def content_blocks(blocks: list[Block], weights: np.ndarray) -> list[Block]:
    if not blocks:
        return []
    logit = features(blocks) @ weights
    n = len(blocks)
    g, source, sink = Flow(n + 2), n, n + 1
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if b.hard:
            g.arc(k, sink, 1e9)
        elif logit[k] > 0:
            g.arc(source, k, float(logit[k]))
        else:
            g.arc(k, sink, float(-logit[k]))
        if k:
            w = NEXT * closeness(blocks[k - 1], b)
            if w > 1e-3:
                g.arc(k - 1, k, w, w)
        parent = _box(b.box.up).number if b.box.up else -1
        before = last.get(parent)
        if before is not None and before < k - 1:
            g.arc(before, k, SIBLING, SIBLING)
        last[parent] = k
    side = g.run(source, sink)
    return [b for k, b in enumerate(blocks) if side[k] >= 0]


def generated_pages(n: int = 80, seed: int = 5, named=tuple(sorted(BAD))):
    """Pages whose content blocks start with the letter Q, other blocks with X; named are the class words of furniture."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("lo", "ra", "tem", "is", "un", "der", "qua", "en")) for _ in range(r.randrange(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randrange(a, b)))
    good = lambda tag, a, b, end=".": f"<{tag}>Q {words(a, b)}{end}</{tag}>"
    bad = lambda tag, a, b, cls="", end="": f"<{tag}{cls}>X {words(a, b)}{end}</{tag}>"
    menu = lambda: "<ul>" + "".join(f'<li><a href="#">X {words(0, 3)}</a></li>' for _ in range(r.randrange(2, 7))) + "</ul>"
    cls = lambda: f' class="{r.choice(named)}{r.choice(("", "-box", " c1"))}"'
    for _ in range(n):
        parts = [good("h1", 2, 9, "")]
        for _ in range(r.randrange(1, 9)):
            parts.append(r.choice((lambda: good("p", 1, 8), lambda: good("p", 10, 90), lambda: good("p", 10, 60), lambda: good("h2", 1, 6, ""), lambda: "<ul>" + good("li", 2, 20, "") * 2 + "</ul>", lambda: "<table><tr>" + good("td", 1, 12, "") * 2 + "</tr></table>", lambda: good("blockquote", 5, 30), lambda: good("figcaption", 2, 9, ""))))
        parts = [p() if callable(p) else p for p in parts]
        if r.random() < 0.4:
            parts.insert(r.randrange(1, len(parts) + 1), bad("div", 2, 25, cls(), r.choice((".", ""))))
        if r.random() < 0.3:
            parts.append(f"<div{cls()}>" + bad("p", 3, 40, "", ".") * 2 + "</div>")
        if r.random() < 0.3:
            a, z, u = r.choice((("<div>", "</div>", "div"), ("<ul>", "</ul>", "li"), ("<section>", "</section>", "article")))
            by = lambda: r.choice((f"X {word()}, {r.randrange(2, 23)} hours ago", f"X {word()} {word()} says:", f"X {word()} 2021-03-{r.randrange(10, 29)}", f"X {word()} {r.randrange(1, 23)}:{r.randrange(10, 59)}"))
            thread = a + "".join(f"<{u}><div>{by()}</div>{bad('p', 5, 60, '', '.')}</{u}>" for _ in range(r.randrange(2, 5))) + z
            parts.insert(len(parts), thread)
        wrap = r.choice((("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<div>", "</div>"), ('<div id="c7">', "</div>")))
        outer = [f"<div>{menu()}</div>", bad("div", 2, 25, cls(), r.choice((".", "")))] + [f"<div{cls()}>{bad('p', 3, 60, '', '.')}{menu()}</div>"] * (r.random() < 0.5)
        r.shuffle(outer)
        yield "<body>" + outer[0] + wrap[0] + "".join(parts) + wrap[1] + "".join(outer[1:]) + bad("div", 2, 6, "", "") * (r.random() < 0.5) + "</body>"


@lru_cache(maxsize=2)
def trained(steps: int = 400, named=tuple(sorted(BAD))) -> np.ndarray:
    """Regularised logistic regression by Newton steps on the generated pages' blocks."""
    every = [b for page in generated_pages(named=named) for b in blocks_of(page)]
    x, y = features(every), np.array([b.text[0] == "Q" for b in every], float)
    w = np.zeros(x.shape[1])
    for _ in range(min(steps, 25)):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w)), x.T @ (p - y) + 0.3 * w)
    return w


def main_text(page: str | None, weights: np.ndarray) -> str:
    return "\n".join(b.text for b in content_blocks(blocks_of(page or ""), weights))


def _extractor(weights: np.ndarray, key: str):
    def run(batches):
        for pdf in batches:
            texts = [main_text(h if isinstance(h, str) else "", weights) for h in pdf["html"]]
            yield pd.DataFrame({key: pdf[key], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return run


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """A row per page: key, url, text, n_chars."""
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "url", "html").mapInPandas(_extractor(trained(), key), f"`{key}` {kind}, url string, text string, n_chars long")
