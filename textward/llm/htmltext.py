"""Main text of web pages: wrappers of a host from all its pages, by counts and tree matching, applied to every page."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: A text may be template if it is on SHARE of the pages that could have it, on two at least; trees must align it in SHARE of
#: the pairs of neighbouring pages that both have it. The same holds for any number of pages.
SHARE = 0.75
#: How many other pages must agree on a text in :func:`induce`, if not told.
AGREE = 5
#: If more than this part of the text would be template, the pages are copies of one article. Of d pages it is :func:`most` of
#: it: each page is held against the d - 1 others.
COPIES = 0.9
#: How many neighbouring pages are matched with each other in one go.
ROW = 50
PARSED = "page_id long, url string, host string, h long, content long, sig long, found array<struct<path:long,key:long,len:long>>, keys array<long>, texts array<string>"
MATCHED = pa.schema([("host", pa.string()), ("key", pa.int64()), ("both", pa.int64()), ("same", pa.int64())])
SURVEYED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("h", pa.int64()), ("content", pa.int64()), ("sig", pa.int64()), ("found", pa.list_(pa.struct([("path", pa.int64()), ("key", pa.int64()), ("len", pa.int64())]))), ("keys", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))])

# Names of HTML elements and of common page furniture.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
OUT = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "head", "title", "textarea", "select", "button", "dialog", "menu", "svg", "iframe", "object", "canvas", "search", "xmp", "noembed", "noframes"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}
FURNITURE = re.compile(
    r"ads?|adv|advert.*|ads?[-_].*|.*[-_]ads?|sponsor.*|promo.*|banner.*|cookie.*|consent.*|gdpr.*|notice.*|.*[-_]notice|alert.*|side-?bar.*|.*[-_]sidebar|widget.*|menu.*|.*[-_]menu|"
    r"nav|nav[-_].*|navbar.*|navigation.*|.*[-_]nav|bread-?crumbs?.*|footer.*|.*[-_]footer|(site|page|global)[-_]?header|masthead|top-?bar|"
    r"share|sharing.*|share[-_].*|social|social[-_]?(links?|shar.*|media|icons?|buttons?|bar|nets?|networks?|follow)([-_].*)?|related|related[-_].*|recommend.*|newsletter.*|subscri.*|popup.*|modal.*|overlay.*|pagination|pager|skip[-_]?link.*|toolbar|hidden|sr-only|visually-hidden|login.*|sign-?up.*|search[-_]?(form|box).*",
    re.IGNORECASE,
)
COMMENTS = re.compile(r"(.*[-_])?(comments?|comment[-_]?list|disqus|replies)([-_].*)?|respond", re.IGNORECASE)
#: Names that on a paragraph or a figure of an article tell what it is about.
LOOSE = re.compile(r"related|widget|social|shar", re.IGNORECASE)
CONTENT = re.compile(r"((post|entry|article|story|page|main)[-_]?)?(content|body|text)|post|entry|story|article|main", re.IGNORECASE)
COMMENTS_TITLE = re.compile(r"(\d+\s+)?((reader|user)\s+)?(comments?|responses|replies|kommentare?|commentaires?|comentarios?|commenti)(\s*[:(].{0,20})?", re.IGNORECASE)
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.DOTALL)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTR.finditer(text)} if text else {}


#: An element named like furniture stays if it holds more than this part of the page's text ...
MOST = 0.5
#: ... and what is in articles or named content outside it is less than this part of its own, if its name is of several
#: words ("related-work"); with a name of one word ("related") there must be none.
ELSEWHERE = 0.25


class Element:
    """An open element. ``key``: of its path; ``out``: it or one around it is furniture by what it is; ``mark``: the nearest that is by name."""

    __slots__ = ("inside", "key", "kids", "kind", "main", "mark", "name", "out", "shape", "tag", "text", "top", "up", "whole")

    def __init__(self, up: Element | None, tag: str, name: str, a: dict[str, str]):
        self.up, self.tag, self.name, self.kids, self.text, self.top = up, tag, name, None, None, up is None
        if up is None:
            self.key, self.out, self.inside, self.main, self.mark, self.kind = 0, False, False, False, None, ""
            return
        self.key = chain(up.key, name)
        names = (a.get("class", "") + " " + a.get("id", "")).split() if a else ()
        self.out = up.out or tag in OUT or tag == "header" and not up.inside or bool(a) and ("hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or "display:none" in a.get("style", "").replace(" ", "").lower())
        self.kind = ""
        if names and tag not in ("html", "body", "main"):
            self.kind = "comments" if any(COMMENTS.fullmatch(n) for n in names) else ("named" if all("-" in n or "_" in n for n in bad) else "plain") if (bad := [n for n in names if FURNITURE.fullmatch(n) and not (tag in ("p", "figure") and up.inside and LOOSE.match(n))]) else ""
        self.mark = self if self.kind else up.mark
        self.inside = up.inside or tag in ("article", "main") or bool(a) and a.get("role") == "main"
        # what tells where the article is, unless the name says otherwise
        self.main = self.mark is None and (self.inside or up.main or any(CONTENT.fullmatch(n) for n in names))

    def path(self) -> str:
        names, node = [], self
        while node.up is not None:
            names.append(node.name)
            node = node.up
        return "".join("/" + n for n in reversed(names))


_chained: dict[tuple[int, str], int] = {}


def chain(key: int, name: str) -> int:
    """The key of a path's next step: a path of any depth is a number."""
    got = _chained.get((key, name))
    if got is None:
        if len(_chained) > 200_000:
            _chained.clear()
        got = _chained[key, name] = key_of(str(key), name)
    return got


def path_key(path: str) -> int:
    key = 0
    for name in path.split("/")[1:]:
        key = chain(key, name)
    return key


def parse(page: str) -> list[tuple[Element, str]]:
    """The page's blocks in order: (element, text with each white space run one space). <p>, <li>, table and list parts end where HTML lets them.

    Time is in proportion to the page, however deep: where elements of a name are open is kept by name.
    """
    out: list[tuple[Element, str]] = []
    root = Element(None, "", "", {})
    stack = [root]
    held: list[str] = []
    where = root
    at_of: dict[str, list[int]] = {}  # by name, the places in the stack
    blocks_to = [0]  # how many of the stack's elements up to here are blocks

    def flush():
        nonlocal held
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((where, text))
            held = []

    def say(raw: str):
        nonlocal where
        if raw:
            now = stack[-1]
            if not held or now.out != where.out or now.mark is not where.mark:
                if held:
                    flush()
                where = now
            held.append(entities.unescape(raw) if "&" in raw else raw)

    def pop(k: int):
        if blocks_to[-1] > blocks_to[k - 1]:
            flush()
        for e in stack[k:]:
            at_of[e.tag].pop()
        del stack[k:], blocks_to[k:]

    def last(tags) -> int:
        return max((at_of[t][-1] for t in tags if at_of.get(t)), default=0)

    at, end = 0, page.rfind(">") + 1
    while at < end:
        m = TAG.search(page, at, end)
        if not m:
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if not m[0].endswith("-->" if m[0].startswith("<!--") else ">"):
                at = end = len(page)  # a comment without an end
            continue
        tag = m[2].lower()
        if m[1]:
            k = last((tag,))
            # an inline element's end doesn't close blocks around it
            if k and (tag in BLOCK or blocks_to[-1] == blocks_to[k]):
                pop(k)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK:
            flush()
            k = last(("p",))
            if k and blocks_to[-1] == blocks_to[k]:
                pop(k)
            if tag in CLOSES:
                ends, bounds = CLOSES[tag]
                k = last(ends)
                if k > last(bounds):
                    pop(k)
        if tag in VOID:
            continue
        a = attributes(m[3])
        if tag in RAW or m[3].endswith("/") and tag in ("svg", "math"):
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.IGNORECASE).search(page, at)
                at = close.end() if close else len(page)
            continue
        name = tag + "".join("." + c for c in sorted(a.get("class", "").split())) if a else tag
        e = Element(stack[-1], tag, name, a)
        at_of.setdefault(tag, []).append(len(stack))
        blocks_to.append(blocks_to[-1] + (tag in BLOCK))
        stack.append(e)
    if at < len(page):
        rest = page[at:]
        cut = re.search("<[!?]", rest)
        say(rest[: cut.start()] if cut else rest)
    flush()
    return out


def article(found: list[tuple[Element, str]]) -> list[tuple[Element, str]]:
    """The blocks that are no furniture.

    What an element is decides at once (nav, footer, form, roles, hidden). A name doesn't: an element that is named like
    furniture but holds MOST of the text stays, unless there is ELSEWHERE text in an article or in named content. Reader
    comments go, by name or by the title of their section, unless the page has no other text or they hold an h1, an
    article or a main that isn't named like comments.
    """
    live = [(e, t) for e, t in found if not e.out]
    for e, text in live:
        up = e.up
        if e.tag in ("h2", "h3", "h4", "h5", "h6") and up is not None and up.tag in ("div", "section", "details", "ol", "ul") and not up.kind and COMMENTS_TITLE.fullmatch(text):
            up.kind = "titled"
    if not any(e.mark for e, _ in live) and not any(e.up is not None and e.up.kind == "titled" for e, _ in live):
        return live
    # each element's text, and which of them have a sign of an article, from the blocks up to the root
    size: dict[int, int] = {}
    sign: set[int] = set()
    node_of: dict[int, Element] = {}
    for e, text in live:
        if id(e) not in node_of:
            node_of[id(e)] = e
        size[id(e)] = size.get(id(e), 0) + len(text)
    order: list[Element] = []
    depth: dict[int, int] = {}
    for e in list(node_of.values()):
        way = []
        while id(e) not in depth and e.up is not None:
            way.append(e)
            e = e.up
        depth.setdefault(id(e), 0)
        n = depth[id(e)]
        for x in reversed(way):
            n += 1
            depth[id(x)] = n
            order.append(x)
    for e in sorted(order, key=lambda e: -depth[id(e)]):
        size[id(e.up)] = size.get(id(e.up), 0) + size.get(id(e), 0)
        if id(e) in sign or e.tag in ("h1", "article", "main") and e.kind != "comments":
            sign.add(id(e.up))
    total = sum(len(t) for _, t in live)
    gone: dict[int, bool] = {}

    def settle(kinds, decide):
        for e in order:  # what is around comes first
            own = e.kind in kinds and decide(e)
            gone[id(e)] = gone.get(id(e), False) or own or gone.get(id(e.up), False)

    settle(("comments", "titled"), lambda e: size[id(e)] < total and id(e) not in sign)
    left = [(e, t) for e, t in live if not gone.get(id(e))]
    total = sum(len(t) for _, t in left)
    main = sum(len(t) for e, t in left if e.main)
    kept: dict[int, int] = {}  # of each element, what of it is left
    told: dict[int, int] = {}  # ... and in an article or named content
    for e, t in left:
        kept[id(e)] = kept.get(id(e), 0) + len(t)
        told[id(e)] = told.get(id(e), 0) + (len(t) if e.main else 0)
    for e in sorted(order, key=lambda e: -depth[id(e)]):
        kept[id(e.up)] = kept.get(id(e.up), 0) + kept.get(id(e), 0)
        told[id(e.up)] = told.get(id(e.up), 0) + told.get(id(e), 0)
    most = lambda e: kept[id(e)] > MOST * total and (main == told[id(e)] or e.kind == "named" and main - told[id(e)] < ELSEWHERE * kept[id(e)])
    settle(("named", "plain"), lambda e: not most(e))
    return [(e, t) for e, t in left if not gone.get(id(e))]


def blocks(page: str) -> list[tuple[Element, str]]:
    """The blocks of the page that are no furniture, in order."""
    return article(parse(page))


def tree(found: list[tuple[Element, str]]) -> Element:
    """The elements around a page's blocks, from the root; each block is a leaf ``#`` of its element."""
    root = Element(None, "", "", {})
    root.kids = []
    for e, text in found:
        leaf = Element(None, "#", "#", {})
        leaf.up, leaf.text, leaf.kids = e, text, []
        x = leaf
        while x.up is not None:
            up = root if x.up.up is None else x.up
            new = up.kids is None
            if new:
                up.kids = []
            up.kids.append(x)
            if not new or up is root:
                break
            x = up
    return root


def number(root: Element, known: dict) -> None:
    """Gives each element its shape, equal for equal subtrees of names, and whole, equal for equal subtrees with their texts."""
    todo = [(root, False)]
    while todo:
        e, done = todo.pop()
        if not done:
            todo.append((e, True))
            todo += [(k, False) for k in e.kids]
            continue
        shape = (e.name, tuple(k.shape for k in e.kids))
        e.shape = known.setdefault(shape, len(known))
        e.whole = known.setdefault((e.name, e.text, tuple(k.whole for k in e.kids)), len(known))
        if (e.shape, "n") not in known:
            known[e.shape, "n"] = 1 + sum(known[k.shape, "n"] for k in e.kids)
            known[e.shape, "is"] = (e.name, [k.shape for k in e.kids])


#: What equal subtrees count more, so that what is constant is aligned to itself.
EQUAL = 0.25


def align(w_of, a: list[int], b: list[int], shapes: tuple[list[int], list[int]], need: list[int] | None = None) -> list[tuple[int, int]]:
    """The places (i, j) of an order-keeping alignment of a and b of the largest weight, in linear memory.

    Equal heads and tails are aligned at once: no alignment is better; where nothing equal is left, those of equal
    ``shapes``. ``w_of(i, j0, j1)``: the weights of a[i] with b[j0:j1], 0 where names differ. The rest goes by halves
    (Hirschberg), a row at a time. ``need``: the places of a that are asked for, if not all; where heads and tails hold them
    the rest is left out.
    """
    lo, tail, n, m = 0, 0, len(a), len(b)
    for x, y in ((a, b), shapes):
        while lo + tail < min(n, m) and x[lo] == y[lo]:
            lo += 1
        while lo + tail < min(n, m) and x[n - 1 - tail] == y[m - 1 - tail]:
            tail += 1
        if not set(a[lo : n - tail]).isdisjoint(b[lo : m - tail]):
            break
    out = [(k, k) for k in range(lo)]
    todo = [(lo, n - tail, lo, m - tail)] if need is None or any(lo <= i < n - tail for i in need) else []
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        if i1 - i0 == 1:
            w = w_of(i0, j0, j1)
            if w.max() > 0:
                out.append((i0, j0 + int(w.argmax())))
            continue
        mid = (i0 + i1) // 2
        head, back = np.zeros(j1 - j0 + 1), np.zeros(j1 - j0 + 1)
        for i in range(i0, mid):
            head[1:] = np.maximum.accumulate(np.maximum(head[1:], head[:-1] + w_of(i, j0, j1)))
        for i in range(i1 - 1, mid - 1, -1):
            back[1:] = np.maximum.accumulate(np.maximum(back[1:], back[:-1] + w_of(i, j0, j1)[::-1]))
        j = j0 + int((head + back[::-1]).argmax())
        todo += [(i0, mid, j0, j), (mid, i1, j, j1)]
    return sorted(out) + [(n - k, m - k) for k in range(tail, 0, -1)]


def rows_of(a: list[Element], b: list[Element], weight: dict):
    """The function that :func:`align` asks for weights of a row."""
    shapes, at = np.unique(np.array([e.shape for e in a], np.int64), return_inverse=True)
    others, to = np.unique(np.array([e.shape for e in b], np.int64), return_inverse=True)
    table = np.array([[weight.get((x, y), 0.0) for y in others.tolist()] for x in shapes.tolist()]).reshape(len(shapes), len(others))
    mine, whole = [e.whole for e in a], np.array([e.whole for e in b], np.int64)

    def row(i, j0, j1):
        w = table[at[i]][to[j0:j1]]
        return w + EQUAL * ((whole[j0:j1] == mine[i]) & (w > 0))

    return row


def weights_of(a: list[Element], b: list[Element], known: dict, weight: dict):
    """:func:`rows_of` with the weights it needs, made when first asked."""
    row = None

    def w_of(i, j0, j1):
        nonlocal row
        if row is None:
            shape_weights({k.shape for k in a}, {k.shape for k in b}, known, weight)
            row = rows_of(a, b, weight)
        return row(i, j0, j1)

    return w_of


def by_names(a: list[Element], b: list[Element]) -> list[tuple[int, int]] | None:
    """The alignment, if every name is once at most in a and in b and those in both keep their order: no other has more pairs."""
    at = {e.name: j for j, e in enumerate(b)}
    if len(at) < len(b) or len({e.name for e in a}) < len(a):
        return None
    pairs = [(i, at[e.name]) for i, e in enumerate(a) if e.name in at]
    return pairs if all(x[1] < y[1] for x, y in zip(pairs, pairs[1:])) else None


def match(a: Element, b: Element, known: dict, weight: dict, within: set[int] | None = None) -> list[tuple[Element, Element]]:
    """Simple tree matching: the pairs of leaves that a largest order-keeping match of two numbered trees aligns.

    Of elements of one name a match counts 1 and the largest alignment of their kids; equal subtrees are aligned first.
    The weight goes by shapes, so a list of thousands of items of few shapes costs few matches. No recursion. ``within``: the
    ids of the elements of a that are looked into, if not all.
    """
    out = []
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if within is not None and id(x) not in within:
            continue
        if x.text is not None:
            out.append((x, y))
            continue
        pairs = by_names(x.kids, y.kids)
        if pairs is None:
            need = None if within is None else [i for i, k in enumerate(x.kids) if id(k) in within]
            pairs = align(weights_of(x.kids, y.kids, known, weight), *([k.whole for k in z.kids] for z in (x, y)), tuple([k.shape for k in z.kids] for z in (x, y)), need)
        todo += [(x.kids[i], y.kids[j]) for i, j in pairs]
    return out


def shape_weights(a: set[int], b: set[int], known: dict, weight: dict) -> None:
    """Puts the weights of all pairs of these shapes into ``weight``; nothing for those of different names."""
    todo = [(x, y) for x in a for y in b]
    while todo:
        x, y = todo[-1]
        if (x, y) in weight:
            todo.pop()
            continue
        if x == y:
            weight[x, y] = float(known[x, "n"])
            continue
        (name, mine), (other, theirs) = known[x, "is"], known[y, "is"]
        if name != other:
            weight[x, y] = 0.0
            continue
        need = [p for p in {(u, v) for u in set(mine) for v in set(theirs)} if p not in weight]
        if need:
            todo += need
            continue
        kinds, at = np.unique(np.array(mine, np.int64), return_inverse=True)
        others, to = np.unique(np.array(theirs, np.int64), return_inverse=True)
        table = np.array([[weight[u, v] for v in others.tolist()] for u in kinds.tolist()]).reshape(len(kinds), len(others))
        best = np.zeros(len(theirs) + 1)
        for i in at:
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + table[i][to]))
        weight[x, y] = 1.0 + float(best[-1])


def key_of(*parts: str) -> int:
    """A 64-bit key."""
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def text_key(path: int, text: str) -> int:
    return key_of(str(path), text)


def layout_of(clean: list[tuple[Element, str]]) -> int:
    """A key of the set of paths that a page's blocks have: pages of one set are of one layout."""
    return key_of(*map(str, sorted({e.key for e, _ in clean})))


def induce(pages: list[str], agree: int = AGREE) -> dict:
    """The wrapper of pages of one host: ``template``, the texts that stay the same where pages align; ``slots``, the paths of what varies.

    The first page is aligned with each other one. A text is template if it is equal in ``agree`` pages aligned to it and
    different in none; where texts differ is a slot.
    """
    found = [parse(p) for p in pages]
    known, weight = {}, {}
    root = tree(found[0] if found else [])
    number(root, known)
    same: dict[int, int] = {}
    differ: set[int] = set()
    for other in found[1:]:
        top = tree(other)
        number(top, known)
        for x, y in match(root, top, known, weight):
            if x.text == y.text:
                same[id(x)] = same.get(id(x), 0) + 1
            else:
                differ.add(id(x))
    template, slots = [], {}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.text is None:
            todo += reversed(node.kids)
        elif id(node) in differ:
            path = node.up.path()
            slots[path] = slots.get(path, 0) + len(node.text)
        elif same.get(id(node), 0) >= agree:
            template.append([node.up.path(), node.text])
    return {"template": template, "slots": sorted(slots, key=lambda p: (-slots[p], p))}


def main_text(page: str | None, wrapper: dict | None = None) -> str:
    """The article's blocks, each with its white space runs as one space, joined by a line feed.

    ``wrapper``: as of :func:`induce`, or with ``keys``, the template's keys by layout; those of layout None are on all layouts.
    """
    wrapper = wrapper or {}
    own = clean = blocks(page or "")
    if template := wrapper.get("template"):
        fixed = {text_key(path_key(p), t) for p, t in template}
        own = [b for b in own if text_key(b[0].key, b[1]) not in fixed] or own
    if keys := wrapper.get("keys"):
        fixed = keys.get(None, set()) | keys.get(layout_of(clean), set())
        if fixed:
            own = [b for b in own if text_key(b[0].key, b[1]) not in fixed] or own
    return "\n".join(t for _, t in own)


def aligned(rows):
    """For each two neighbours of one group: the group, the wanted keys that both pages have, and those of them that tree matching aligns.

    ``rows``: (group, page, wanted keys), neighbours one after another.
    """
    group, before = None, None
    for now, page, wanted in rows:
        if now != group:
            group, before, known, weight = now, None, {}, {}
        elif len(weight) > 1_000_000:
            weight.clear()
        root = tree(parse(page))
        number(root, known)
        within, keys, todo = {id(root)}, {}, [root]
        while todo:
            e = todo.pop()
            todo += e.kids
            if e.text is not None and (k := text_key(e.up.key, e.text)) in wanted:
                keys[id(e)] = k
                while e.up is not None and id(e) not in within:
                    within.add(id(e))
                    e = e.up
        if before and (both := set(before[2].values()).intersection(keys.values())):
            yield group, both, {keys[id(y)] for x, y in match(before[0], root, known, weight, before[1]) if id(y) in keys and before[2].get(id(x)) == keys[id(y)]}
        before = root, within, keys


def most(d):
    """What part of the text of d pages may be template."""
    return COPIES * (1 - 1 / d)


def learn(pages: list[str]) -> list[int]:
    """Keys of the template of pages of one layout, in the order in which they are neighbours: the rule of :func:`wrappers` for pages at hand."""
    clean = [{text_key(e.key, t): (e.key, len(t)) for e, t in blocks(p)} for p in pages]
    on = Counter(k for found in clean for k in found)
    having = Counter(path for found in clean for path in {path for path, _ in found.values()})
    size = {k: on[k] * n for found in clean for k, (path, n) in found.items() if on[k] >= max(2, SHARE * having[path])}
    if not size or sum(size.values()) > most(len(pages)) * sum(n for found in clean for _, n in found.values()):
        return []
    both, same = Counter(), Counter()
    for _, there, equal in aligned((0, p, size.keys()) for p in pages):
        both.update(there)
        same.update(equal)
    return sorted(k for k in size if same[k] and same[k] >= SHARE * both[k])


def parsed(pages: DataFrame) -> DataFrame:
    """PARSED, a row for each page: its layout, and the keys and texts of its blocks that are no furniture. Html is read here alone."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows = []
                for page_id, url, host, h, page in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    clean = blocks(page or "")
                    keys = [text_key(e.key, t) for e, t in clean]
                    found = {k: {"path": e.key, "key": k, "len": len(t)} for k, (e, t) in zip(keys, clean, strict=True)}
                    content = key_of(*(x for e, t in clean for x in (str(e.key), t)))
                    rows.append({"page_id": page_id, "url": url, "host": host, "h": h, "content": content, "sig": layout_of(clean), "found": list(found.values()), "keys": keys, "texts": [t for _, t in clean]})
                yield pa.RecordBatch.from_pylist(rows, schema=SURVEYED)

    with common.batches(pages.sparkSession, 1000):
        return common.materialize(pages.select("page_id", "url", "host", "h", "html").mapInArrow(run, PARSED), "parsed")


def wrappers(pages: DataFrame, read: DataFrame) -> DataFrame:
    """(host, sig, fixed): the template's keys on the pages of a layout, from every page of a host; pages that differ only in furniture or not at all count once.

    A text is template if SHARE of the pages that have its path, or of the pages of its layout, have it there, two at least,
    and :func:`matched` trees align it. Equal texts that trees would align have equal paths, so counts miss none of them; all
    are sums of partial counts, whatever a host's share of the pages. One rule holds for any number of pages. A row has but
    the keys that occur in its layout, so it is no larger than the blocks of such a page, however many layouts a host has.
    """
    seen = read.filter("host != '' and size(keys) > 0").groupBy("host", "content").agg(F.min("h").alias("h"), F.first("sig").alias("sig"), F.first("found").alias("found"))
    seen = common.materialize(seen, "blocks")
    flat = seen.select("host", "sig", F.explode("found").alias("b")).select("host", "sig", "b.*")
    often = common.materialize(flat.groupBy("host", "path", "key").agg(F.count("*").alias("c"), F.max("len").alias("len")).filter("c >= 2"), "repeated")
    layouts = common.materialize(seen.groupBy("host", "sig").agg(F.count("*").alias("d"), F.sum(F.aggregate("found", F.lit(0).cast("long"), lambda t, b: t + b["len"])).alias("total")), "layouts")
    hosts = layouts.groupBy("host").agg(F.sum("d").alias("d"), F.sum("total").alias("total"))
    having = seen.select("host", F.explode(F.array_distinct("found.path")).alias("path")).groupBy("host", "path").agg(F.count("*").alias("d"))

    def constant(counted: DataFrame, all_of: DataFrame, *by: str) -> DataFrame:
        """Of what is on SHARE of d: the groups of which it is no copy of one article."""
        fixed = counted.groupBy(*by).agg(F.sum(F.col("c") * F.col("len")).alias("fixed"))
        return fixed.join(all_of, [*by]).filter(F.col("fixed") <= most(F.col("d")) * F.col("total")).select(*by)

    enough = (F.col("c") >= 2) & (F.col("c") >= SHARE * F.col("d"))
    own = flat.join(common.few(often.select("host", "path", "key")), ["host", "path", "key"]).groupBy("host", "sig", "path", "key").agg(F.count("*").alias("c"), F.max("len").alias("len"))
    own = common.materialize(own, "repeated-in-layouts")
    # of the texts that are template wherever their path is: those that a layout has
    wide = often.join(having, ["host", "path"]).filter(enough)
    wide = wide.join(constant(wide, hosts, "host"), "host", "left_semi").select("host", "path", "key").join(own.select("host", "sig", "path", "key"), ["host", "path", "key"]).select("host", "sig", "key")
    narrow = own.join(layouts.drop("total"), ["host", "sig"]).filter(enough)
    narrow = narrow.join(constant(narrow, layouts, "host", "sig"), ["host", "sig"], "left_semi").select("host", "sig", "key")
    counted = common.materialize(wide.unionByName(narrow).distinct(), "counted")
    right = counted.join(matched(pages, seen, counted), ["host", "key"], "left_semi")
    return common.materialize(right.groupBy("host", "sig").agg(F.collect_set("key").alias("fixed")), "wrappers")


def matched(pages: DataFrame, seen: DataFrame, counted: DataFrame) -> DataFrame:
    """(host, key) of the ``counted`` texts that tree matching aligns in SHARE of the pairs of neighbours that both have them, in one at least.

    All pages of layouts with counted texts are in one order, by host, layout and hash; each is matched with the next one of
    its host, ROW pages in a row. A row's last page is the next one's first, so no pair is lost and no host fills a task.
    """
    wanted = common.materialize(counted.groupBy("host", "sig").agg(F.collect_set("key").alias("wanted")), "wanted")
    order = common.numbered(seen.select("host", "sig", "h").join(common.few(wanted.select("host", "sig"), 100_000), ["host", "sig"]), "host", "sig", "h", name="n")
    row = F.floor(F.col("n") / ROW)
    order = order.withColumn("row", F.explode(F.when(F.col("n") % ROW == 0, F.array(row - 1, row)).otherwise(F.array(row)))).join(wanted, ["host", "sig"])
    html = pages.select("host", "h", "html").join(common.few(common.materialize(order.select("host", "h").distinct(), "compared")), ["host", "h"], "left_semi").dropDuplicates(["host", "h"])
    rows = order.join(html, ["host", "h"]).repartition("row").sortWithinPartitions("row", "n").select("row", "host", "html", "wanted")

    def run(batches):
        def read():
            for batch in batches:
                for row, host, html, wanted in zip(*batch.columns, strict=True):
                    yield (row.as_py(), host.as_py()), html.as_py(), set(wanted.as_py())

        both, same = Counter(), Counter()

        def out():
            keys = list(both)
            table = pa.RecordBatch.from_pydict({"host": [h for h, _ in keys], "key": [k for _, k in keys], "both": [both[k] for k in keys], "same": [same[k] for k in keys]}, schema=MATCHED)
            both.clear()
            same.clear()
            return table

        for (_, host), there, equal in aligned(read()):
            both.update((host, k) for k in there)
            same.update((host, k) for k in equal)
            if len(both) > 10_000:
                yield out()
        yield out()

    with common.batches(pages.sparkSession, 2 * ROW):
        pairs = common.materialize(rows.mapInArrow(run, "host string, key long, both long, same long"), "matched")
    return pairs.groupBy("host", "key").agg(F.sum("both").alias("both"), F.sum("same").alias("same")).filter(F.col("same") >= SHARE * F.col("both")).filter("same > 0").select("host", "key")


def extract(pages: DataFrame, broadcast: int = 16 << 20, split: int = 20_000) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, the main text of its whole html, n_chars.

    Null html is the empty page, a page without content has the empty text. A null or odd url has no host; such pages
    have no wrapper and go by elements and names alone, as do hosts with a single page. Rows with one page_id
    are each extracted. Other columns are ignored; an empty table gives no rows.

    Html is parsed once; what is left of a page are its blocks, which its layout's wrapper parts in template and content.
    Wrappers of up to ``broadcast`` bytes in all go to every task; more are joined by a shuffle on host and layout, in which
    the pages of one layout are dealt out to a key for each ``split`` of them.
    """
    with common.scratch(pages.sparkSession) as keep:
        # what the result reads stays: the pages' blocks are not written a second time
        rows = common.columns(pages, page_id="long", url="string", html="string").withColumn("host", host_of(F.col("url"))).withColumn("h", F.xxhash64("html"))
        read = keep(parsed(rows))
        learned = keep(wrappers(rows, read))
        read, on = read.select("page_id", "url", "h", "host", "sig", "keys", "texts"), ["host", "sig"]
        if (learned.agg(F.sum(F.size("fixed") * 8 + F.length("host") + 16)).first()[0] or 0) <= broadcast:
            learned = F.broadcast(learned)
        else:
            hot = read.groupBy(on).agg(F.count("*").alias("n")).filter(F.col("n") > split).select(*on, F.ceil(F.col("n") / split).alias("dealt"))
            hot = keep(hot, "large-layouts")
            n = F.coalesce("dealt", F.lit(1).cast("long"))
            read = read.join(common.few(hot), on, "left").withColumn("key", F.pmod(F.xxhash64("page_id", "url", "h"), n))
            learned = learned.join(common.few(hot), on, "left").select(*on, "fixed", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("key"))
            on = [*on, "key"]
        # what of the wrapper the page has, by hashes; a page that is template alone stays as it is
        hit = F.array_intersect("keys", F.coalesce("fixed", F.array().cast("array<long>")))
        out = read.join(learned, on, "left").select("page_id", "url", "keys", "texts", hit.alias("hit"))
        left = F.filter("texts", lambda t, i: ~F.array_contains("hit", F.get("keys", i)))
        out = out.withColumn("left", F.when(F.size("hit") == 0, F.col("texts")).otherwise(left))
        text = F.array_join(F.when(F.size("left") == 0, F.col("texts")).otherwise(F.col("left")), "\n")
        return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
