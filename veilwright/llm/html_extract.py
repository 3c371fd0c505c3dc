"""Main text of web pages by wrapper induction.

A page is parsed into its tree of block elements, whole: menus and adverts too. All pages of a host that hold most of their text
below the same tags (a layout) are aligned, element by element, with the one of least id, by simple tree matching: the
largest order-preserving mapping of nodes with equal tags whose parents are mapped. A text that is the same at its place on more pages than not, with 95%
confidence (the lower end of Wilson's interval), is template; all other text varies. From the top, the wrapper goes down to the element
that holds ``SHARE`` of all varying text that is no link, and stops where it spreads over several, or at a paragraph. That element is the content slot: on every page of
the layout the main text is what stands at its path, whatever surrounds it. Template inside the slot goes, unless it is more than half of the slot's text: then the
pages are versions of one article.

What varies inside the slot and is still no article (adverts, forms, comments) is told by tag, role, class and id. These
lists alone decide for pages that have no other page to be compared with: hosts or layouts with one distinct page, pages without a host, and pages
without the slot's path. There the article, or else the main element, or else the page counts.

Only skeletons move (a few numbers a node, equal skeletons of a host once). Wrappers, a few hashes
a layout, are joined to the pages by host: Spark broadcasts them when their measured size is small and
sorts and merges otherwise, splitting hot hosts.

Defined cases: null html is an empty page with empty text; a page without host belongs to no wrapper;
unclosed and misnested elements are closed as browsers do for paragraphs and list items; trees of any depth and width are parsed and aligned without
recursion; children that are many (``CELLS`` pairs, or ``ASKED`` pairs to be matched themselves) are weighed a level at a time, with a table in parts, and get the same mapping as few;
rows that share an id are extracted each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm import _io
from veilwright.llm.url_filter import url_host

SHARE, CELLS, ASKED, Z2 = 0.6, 1 << 20, 1 << 14, 3.84
HELD, BAND, FEW = 1 << 23, 32, 64  # numbers held at once by the matching of many children, how far off the diagonals it looks first, and pairs that are asked for however large
_ROW = np.dtype([("depth", "<i4"), ("tag", "<i4"), ("path", "<i8"), ("key", "<i8"), ("plain", "<i4"), ("size", "<i4"), ("holder", "?")])
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?>[^<>=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s<>"'][^\s<>]*+)|=)*+)>|<[!?][^>]*>""", re.S
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_DROP = frozenset("script style noscript template iframe object embed svg canvas audio video head title nav footer aside form button select option textarea input label fieldset dialog menu map applet xmp noembed noframes datalist".split())
_BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header hgroup address center details summary hr search".split()) | _DROP
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hgroup address center details summary hr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
_BAD = frozenset(
    "nav navbar navigation navlinks menu menubar submenu breadcrumb breadcrumbs header masthead topbar footer foot bottombar colophon sidebar side sidenav aside rail notice notices notification alert banner "
    "cookie cookies cookiebar consent gdpr ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion promotions comment comments commentlist disqus discussion replies reply respond social share sharing "
    "related recommended newsletter subscribe subscription signup login popup modal overlay widget widgets search form pagination pager toc tags skip skiplink legal copyright disclaimer paywall".split()
)
#: Words that make a name one of a page without such a part or with its layout, and words that may follow a part's name.
_STATES = frozenset("has have with without no not non is hide hides hidden free less".split())
_PARTS = frozenset(
    "box block wrapper wrap container list bar area section panel unit slot item items link links inner outer left right top bottom title text button buttons icon icons message main primary secondary mobile desktop "
    "placeholder label posts articles stories news topics x col column columns row group body".split()
)
#: Parts that are dropped even if they hold articles.
_OTHERS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promotions comment comments commentlist disqus discussion replies reply respond related recommended".split())
_WORDS = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    tag: str
    bad: bool = False
    children: list = field(default_factory=list)  # nodes and strings
    name: str = ""  # its first class or its id


def _name(part: str) -> int:
    """How surely a class or id names what is not content: 0 not, 1 it may also name a wrapper, 2 unless it holds the article, 3 always."""
    words = _WORDS.findall(part)
    if not words or _STATES.intersection(words):
        return 0
    if "".join(words) in _BAD or all(w in _BAD for w in words):
        return 3 if _OTHERS.intersection(words) else 2
    if words[-1] in _BAD or words[0] in _BAD and all(w in _BAD or w in _PARTS for w in words[1:]):
        return 3 if _OTHERS.intersection(words) else 1
    return 0


def _attributes(tag: str, raw: str) -> int:
    """How surely they mark what is not content, as :func:`_name` tells it."""
    sure = 0
    for m in _ATTR.finditer(raw):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if m.start() and not raw[m.start() - 1].isspace():
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return 3
        if name == "role" and value in _ROLES:
            return 3
        if name in ("class", "id") and tag not in ("html", "body", "main", "article"):
            for part in value.split():
                sure = max(sure, _name(part))
        if name in ("class", "id") and tag == "article" and {"comment", "comments", "reply", "ad", "advert", "promo", "sponsored", "related"} & set(_WORDS.findall(value)):
            return 3
    return sure


def _own_name(raw: str) -> str:
    """The first word of an element's class, else its id, without digits (which number parts of one kind)."""
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(raw) if m[1].lower() in ("class", "id")}
    words = (found.get("class") or found.get("id") or "").split()
    return re.sub(r"\d+", "", words[0].lower()) if words else ""


def _spare(root: Node, doubt: dict[int, int]) -> None:
    """Keep elements that only their names mark (``doubt``: how surely, by identity) but that hold the page's article, its main element or most of its text.

    Articles count where the page has none elsewhere, text where it is no link, and only for names that a wrapper may have.
    """
    nodes, todo = [], [(root, -1, False)]
    while todo:
        node, up, link = todo.pop()
        if node.bad and id(node) not in doubt:
            continue
        link = link or node.tag == "a"
        nodes.append((node, up, 0 if link else sum(len(x.strip()) for x in node.children if isinstance(x, str))))
        todo.extend((x, len(nodes) - 1, link) for x in node.children if isinstance(x, Node))
    size = [n for _, _, n in nodes]
    holds = [node.tag in ("article", "main") and not node.bad for node, _, _ in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k][1]
        size[up] += size[k]
        holds[up] = holds[up] or holds[k] and doubt.get(id(nodes[k][0])) != 3
    found = any(x.tag in ("article", "main") for x in _roots(root))
    for k, (node, _, _) in enumerate(nodes):
        sure = doubt.get(id(node), 3)
        if sure < 3 and not found and (holds[k] or sure == 1 and not holds[0] and 2 * size[k] > size[0]):
            node.bad = False


def parse(text: str) -> Node:
    """The tree of a page. Inline elements that carry nothing of note are not kept: their text joins the block's."""
    root = Node("#root")
    stack = [root]
    doubt: dict[int, int] = {}
    at, find, n = 0, _TOKEN.search, len(text)
    while at < n:
        m = find(text, at)
        if m is None:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                stack[-1].children.append(" ")
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(text, at)
            at = end.end() if end else n
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table", "button", "object"):
                    break
        if tag in _SIBLING:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SIBLING[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE[tag]:
                    break
        sure = 3 if tag in _DROP else _attributes(tag, m[3]) if m[3] else 0
        node = Node(tag, sure > 0, name=_own_name(m[3]) if m[3] else "")
        if 0 < sure < 3:
            doubt[id(node)] = sure
        stack[-1].children.append(node)
        if not m[3].endswith("/") or tag not in ("svg", "path"):
            stack.append(node)
    if doubt:
        _spare(root, doubt)
    return root


def _roots(root: Node) -> list[Node]:
    """The articles outside what is not content, else main elements, else the page; articles inside a main element only if they hold most of its text."""
    articles: list[tuple[Node, Node | None]] = []
    mains: list[Node] = []
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        node, main = todo.pop()
        if node.bad:
            continue
        if node.tag == "article":
            articles.append((node, main))
            continue
        if node.tag == "main" and main is None:
            mains.append(node)
            main = node
        todo.extend((x, main) for x in reversed(node.children) if isinstance(x, Node) and not (x.tag == "header" and node.tag in ("body", "#root", "html")))
    for main in mains:
        own = [x for x, of in articles if of is main]
        if own and 2 * sum(map(_length, own)) < _length(main):
            return [*(x for x, of in articles if of not in mains), *mains]
    return [x for x, _ in articles] or mains or [root]


def _length(node: Node) -> int:
    """Characters of text below a node, outside what is not content."""
    total, todo = 0, [node]
    while todo:
        for x in todo.pop().children:
            if isinstance(x, str):
                total += len(x.strip())
            elif not x.bad:
                todo.append(x)
    return total


def path_of(above: int, node: Node) -> int:
    """A signed 64-bit hash of a block's place: tags and names from the top."""
    return xxhash.xxh64_intdigest(f"{above}/{node.tag}.{node.name}", 2) - (1 << 63)


def clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def node_key(path: int, text: str) -> int:
    """A signed 64-bit hash of a text and its place."""
    return xxhash.xxh64_intdigest(f"{path}\x00{text}", 1) - (1 << 63)


def blocks(text: str | Node, slots: frozenset[int] = frozenset()) -> list[tuple[int, str]]:
    """Place and text of each block of content, in page order: of the elements at ``slots``, else of what tags and names tell."""
    root = parse(text) if isinstance(text, str) else text
    starts: list[tuple[Node, int]] = []
    todo: list[tuple] = [(root, 0)]
    wanted = set() if slots else {id(x) for x in _roots(root)}
    while todo:  # the outermost elements at a slot
        node, above = todo.pop()
        path = path_of(above, node) if node.tag in _BLOCK else above
        if node.tag in _BLOCK and path in slots or id(node) in wanted:
            starts.append((node, path))
        else:
            todo.extend((x, path) for x in reversed(node.children) if isinstance(x, Node))
    if slots and not starts:
        return blocks(root)
    out: list[tuple[int, str]] = []
    for top, place in starts:
        whole = top.tag not in ("article", "main")
        held: list[str] = []

        def flush(path: int, held: list[str] = held) -> None:
            if held:
                line = clean(held)
                held.clear()
                if line:
                    out.append((path, line))

        todo = [(x, place) for x in reversed(top.children)]
        while todo:
            node, path = todo.pop()
            if node is None:
                flush(path)
            elif isinstance(node, str):
                held.append(node)
            elif node.bad or whole and node.tag == "header":
                if node.tag in _BLOCK:
                    flush(path)
                else:
                    held.append(" ")
            elif node.tag in _BLOCK:
                flush(path)
                own = path_of(path, node)
                todo.append((None, own))
                todo.extend((x, own) for x in reversed(node.children))
            else:
                todo.extend((x, path) for x in reversed(node.children))
        flush(place)
    return out


def skeleton(text: str | Node) -> tuple[bytes, int]:
    """The tree of all block elements and texts of a page, from the top down, and a hash of its layout: the longest path of tags below which half of its text stands.

    A text is a leaf; ``plain``: its characters outside links; ``holder``: no paragraph or other running text.
    """
    rows: list[tuple] = []
    mass: dict[int, int] = {}
    order: list[tuple[int, int]] = [(0, 0)]  # paths of tags: hash and the one above
    held: list[tuple[str, bool]] = []

    def flush(path: int, tags: list[int], depth: int) -> None:
        line = clean([x for x, _ in held])
        if line:
            plain = len(clean([x for x, link in held if not link]))
            rows.append((depth, 0, path, node_key(path, line), plain, len(line), False))
            for t in tags:
                mass[t] = mass.get(t, 0) + plain
        held.clear()

    todo: list[tuple] = [(parse(text) if isinstance(text, str) else text, 0, [], 0, False)]
    while todo:
        node, path, tags, depth, link = todo.pop()
        if node is None:
            flush(path, tags, depth)
        elif isinstance(node, str):
            held.append((node, link))
        elif node.tag in _BLOCK:
            flush(path, tags, depth)
            own = path_of(path, node)
            kind = xxhash.xxh32_intdigest(node.tag) >> 1
            rows.append((depth, kind, own, 0, 0, 0, node.tag not in _PROSE))
            if node.tag not in _PROSE and len(tags) < 64:
                order.append((xxhash.xxh64_intdigest(f"{tags[-1] if tags else 0}/{node.tag}", 3) - (1 << 63), 0))
                tags = [*tags, order[-1][0]]
            todo.append((None, own, tags, depth + 1, link))
            todo.extend((x, own, tags, depth + 1, link) for x in reversed(node.children))
        else:
            inside = link or node.tag == "a"
            todo.extend((x, path, tags, depth, inside) for x in reversed(node.children))
    flush(0, [], 0)
    total, best = sum(r[4] for r in rows), 0
    for hashed, _ in order:
        if total and 2 * mass.get(hashed, 0) >= total:
            best = hashed  # found from the top down: the last is the deepest of its branch
    keep = np.zeros(len(rows), bool)
    last = -1  # the depth above which elements have text below
    for k in range(len(rows) - 1, -1, -1):
        if rows[k][3] or rows[k][0] < last:
            keep[k], last = True, rows[k][0]
    return np.array(rows, _ROW)[keep].tobytes() if rows else b"", best


class Tree:
    """A skeleton with its children, subtree sizes and subtree hashes. Place 0 is above all."""

    def __init__(self, raw: bytes):
        rows = np.frombuffer(raw, _ROW)
        self.depth, self.tag, self.path, self.key = ([-1 if name == "depth" else 0, *rows[name].tolist()] for name in ("depth", "tag", "path", "key"))
        self.plain, self.size, self.holder = ([0, *rows[name].tolist()] for name in ("plain", "size", "holder"))
        n = len(self.tag)
        self.up, self.below = [0] * n, [[] for _ in range(n)]
        stack = [0]
        for k in range(1, n):
            while self.depth[stack[-1]] >= self.depth[k]:
                stack.pop()
            self.up[k] = stack[-1]
            self.below[stack[-1]].append(k)
            stack.append(k)
        self.count, self.hash = [1] * n, [0] * n
        for k in range(n - 1, -1, -1):
            self.hash[k] = hash((self.tag[k], self.key[k], *(self.hash[c] for c in self.below[k])))
            if k:
                self.count[self.up[k]] += self.count[k]
        self.lone = [len(x) == 1 and not self.tag[x[0]] for x in self.below]


def _pair_children(left: Tree, right: Tree, a: list[int], b: list[int], many: bool, levels: Levels | None):
    """A generator: asks for the matches of pairs of children, and returns the best weight and the chosen matches.

    ``many``: the trees have many pairs to be asked for; ``levels``: weights that are already known. Neither changes the result.
    """
    n, head, tail = min(len(a), len(b)), 0, 0  # equal beginnings and ends match in some best mapping
    while head < n and left.hash[a[head]] == right.hash[b[head]]:
        head += 1
    while tail < n - head and left.hash[a[-1 - tail]] == right.hash[b[-1 - tail]]:
        tail += 1
    ends = [*zip(a[:head], b[:head], strict=True), *zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
    chosen = [(1.5 * left.count[x], x, y, None) for x, y in ends]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) == len(b) == 1:
        if left.tag[a[0]] == right.tag[b[0]]:
            chosen.append((yield a[0], b[0], levels))
    elif a and b:
        wide = [sum(bool(t.below[x]) and not t.lone[x] for x in own) for t, own in ((left, a), (right, b))]
        asks = wide[0] * len(b) + len(a) * wide[1]
        if not levels and (len(a) * len(b) > CELLS or asks > ASKED or many and asks):
            levels = Levels(left, right, a, b)
            if levels.kept is None and len(a) * len(b) <= CELLS and asks <= FEW:
                levels = None  # a few large children: each pair finds its own way
        way = _pair_levels(left, right, a, b, levels) if levels else _pair_table(left, right, a, b)
        del levels  # the generator holds them as long as it needs them
        chosen += yield from way
    return sum(x[0] for x in chosen), chosen


def _pair_table(left: Tree, right: Tree, a: list[int], b: list[int]):
    """By a table of all pairs. What holds one text alone (as paragraphs do) is not asked for: two such match with 2, or 3 if they are equal."""
    lb, kb = np.array([right.tag[x] for x in b]), np.array([right.hash[x] for x in b])
    lone_b = np.array([right.lone[x] for x in b])
    deep_b = np.array([bool(right.below[x]) for x in b])
    found: dict[tuple[int, int], tuple] = {}
    best = np.zeros((len(a) + 1, len(b) + 1))
    for i, x in enumerate(a):
        same = lb == left.tag[x]
        w = same * np.where(kb == left.hash[x], 1.5, 1.0)
        if left.below[x]:
            ask = same & deep_b
            if left.lone[x]:
                w[ask & lone_b] *= 2
                ask &= ~lone_b
            for j in np.flatnonzero(ask).tolist():
                found[i, j] = yield x, b[j], None
                w[j] = found[i, j][0]
        np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + w), out=best[i + 1, 1:])
    out, i, j = [], len(a), len(b)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(found.get((i, j)) or _plain_pair(left, right, a[i], b[j]))
    return out[::-1]


def _plain_pair(left: Tree, right: Tree, x: int, y: int) -> tuple:
    """The match of two leaves, of two nodes with one text each, or of a leaf and another node."""
    if left.hash[x] == right.hash[y]:
        return 1.5 * left.count[x], x, y, None
    if left.lone[x] and right.lone[y]:
        return 2.0, x, y, [(1.0, left.below[x][0], right.below[y][0], [])]
    return 1.0, x, y, []


class _Level:
    """Nodes of one depth, parent by parent: each parent takes a place for "none of its children" and one a child.

    ``base`` is the number of the parent times a step larger than any weight, so that one running maximum serves all parents.
    Weights are counted in halves.
    """

    def __init__(self, tree: Tree, families: list[list[int]], step: int):
        sizes = np.array([len(x) + 1 for x in families], np.int64)
        self.last = np.cumsum(sizes) - 1  # of each parent
        self.first = self.last - sizes + 1
        self.nodes = [y for x in families for y in x]
        of = np.repeat(np.arange(len(families)), sizes)
        at = np.ones(len(of), bool)
        at[self.first] = False
        self.at = np.flatnonzero(at)
        self.kind = np.int32 if step * len(families) < 1 << 31 else np.int64
        self.base = (of * step).astype(self.kind)
        self.tag = np.array([tree.tag[y] for y in self.nodes], np.int64)
        self.deep = any(tree.below[y] for y in self.nodes)
        self.text = np.array([2 * any(not tree.tag[c] for c in tree.below[y]) for y in self.nodes], self.kind)
        self.equal: dict[int, list[int]] = defaultdict(list)
        self.texts: dict[int, list[int]] = defaultdict(list)  # places of parents of a text
        for k, y in zip(self.at.tolist(), self.nodes, strict=True):
            self.equal[tree.hash[y]].append(k)
            for c in tree.below[y]:
                if not tree.tag[c]:
                    self.texts[tree.hash[c]].append(k)
        self.flat: dict[tuple[int, bool], np.ndarray] = {}
        self.same: dict[int, np.ndarray] = {}

    def alone(self, tag: int, text: bool) -> np.ndarray:
        """By place: the weight of an element of that tag without children, or with one text alone that differs from all."""
        if (tag, text) not in self.flat:
            out = np.zeros(len(self.base), self.kind)
            out[self.at] = self.like(tag) * (2 + self.text * text)
            self.flat[tag, text] = out
        return self.flat[tag, text]

    def like(self, tag: int) -> np.ndarray:
        if tag not in self.same:
            self.same[tag] = self.tag == tag
        return self.same[tag]


class Levels:
    """Weights of a left node against all nodes of one depth below the children ``b`` at once; all of them are kept when they are few."""

    def __init__(self, left: Tree, right: Tree, a: list[int], b: list[int]):
        self.left, step = left, 3 * len(right.tag) + 1
        self.levels = [_Level(right, [b], step)]
        while self.levels[-1].deep:
            self.levels.append(_Level(right, [right.below[y] for y in self.levels[-1].nodes], step))
        self.top = left.depth[a[0]]
        self.place = {y: k for level in self.levels for y, k in zip(level.nodes, level.at.tolist(), strict=True)}
        cells, row = 0, a
        for level in self.levels:
            cells += len(row) * len(level.base)
            row = [c for x in row for c in left.below[x]]
        self.kept: dict[int, np.ndarray] | None = {} if cells <= HELD else None
        self.whole = self.cuts(0, len(b))

    def cuts(self, p: int, q: int) -> list[tuple]:
        """By level, what lies below the children ``p`` to ``q`` of the first: its places, parents and nodes, each from and to."""
        out = [(p, q + 1, 0, 1, p, q)]
        for level in self.levels[1:]:
            f, g = out[-1][4:]
            if f == g:
                break
            s, t = int(level.first[f]), int(level.last[g - 1]) + 1
            out.append((s, t, f, g, s - f, t - g))
        return out

    def row(self, x: int, p: int, q: int) -> np.ndarray:
        """The best weight of ``x`` with each of the children ``p`` to ``q``, behind one number of no meaning."""
        if self.kept is None:
            return self._row(x, self.cuts(p, q))
        return self._row(x, self.whole)[p : q + 1]

    def _row(self, x: int, cuts: list[tuple]) -> np.ndarray:
        """By place in its level: the best weight of ``x`` with the node there. No recursion: open elements stand on a list."""
        left, kept = self.left, self.kept
        opened: list[tuple] = []
        while True:
            d = left.depth[x] - self.top
            level = self.levels[d]
            if kept is not None and x in kept:
                w = kept[x]
            elif left.below[x] and not left.lone[x] and d + 1 < len(cuts) and level.like(left.tag[x])[cuts[d][4] : cuts[d][5]].any():
                rest = iter(left.below[x])
                opened.append((x, rest, self.levels[d + 1].base[cuts[d + 1][0] : cuts[d + 1][1]].copy()))
                x = next(rest)
                continue
            else:
                w = self._weight(cuts, x, None)
            while True:
                if kept is not None:
                    kept[x] = w
                if not opened:
                    return w
                x, rest, best = opened[-1]
                _add(best, w, best)
                child = next(rest, None)
                if child is not None:
                    x = child
                    break
                opened.pop()
                w = self._weight(cuts, x, best)

    def _weight(self, cuts: list[tuple], x: int, best: np.ndarray | None) -> np.ndarray:
        left, tag, d = self.left, self.left.tag[x], self.left.depth[x] - self.top
        level, (s, t, _, _, g, h) = self.levels[d], cuts[d]
        equal = _between(level.equal.get(left.hash[x]), s, t)
        if best is not None:
            below, (base, _, f, e, _, _) = self.levels[d + 1], cuts[d + 1]
            last = below.last[f:e]
            w = np.zeros(t - s, level.kind)
            w[level.at[g:h] - s] = level.like(tag)[g:h] * (2 + best[last - base] - below.base[last])
        else:
            w = level.alone(tag, left.lone[x])[s:t]
            near = _between(level.texts.get(left.hash[left.below[x][0]]), s, t) if left.lone[x] else None
            if near or equal:
                w = w.copy()
            if near:
                w[near] = np.where(w[near] > 0, 5, 0)
        if equal:
            w[equal] = 3 * left.count[x]
        return w


def _between(places: list[int] | None, s: int, t: int) -> list[int]:
    """Those of ascending places from ``s`` up to ``t``, counted from ``s``."""
    return [k - s for k in places[bisect_left(places, s) : bisect_left(places, t)]] if places else []


def _add(best: np.ndarray, w: np.ndarray, out: np.ndarray) -> None:
    """The next row of a table of best weights."""
    new = best[:-1] + w[1:]
    np.maximum(new, best[1:], out=new)
    np.maximum.accumulate(new, out=out[1:])


def _bounds(left: Tree, right: Tree, a: list[int], b: list[int]) -> list[int]:
    """By number of pairs: a bound for the weight that so many of ``a`` can have. Nodes count 2, or 3 where the right has an equal one."""
    mine, other = slice(a[0], a[-1] + left.count[a[-1]]), slice(b[0], b[-1] + right.count[b[-1]])
    hashes, tags = set(right.hash[other]), set(right.tag[other])
    sums = [0]
    for h, tag in zip(left.hash[mine], left.tag[mine], strict=True):
        sums.append(sums[-1] + (2 + (h in hashes)) * (tag in tags))
    each = sorted((sums[x - a[0] + left.count[x]] - sums[x - a[0]] for x in a), reverse=True)
    return [0, *accumulate(each)]


def _pair_levels(left: Tree, right: Tree, a: list[int], b: list[int], levels: Levels):
    """The mapping :func:`_pair_table` gives, in bounded memory and without asking for each pair.

    Only cells ``k`` off the diagonals of both ends are looked at. A path beyond these has ``k + 1`` pairs less than there may be;
    if so many cannot have the weight found, all best paths are inside. If they can, ``k`` grows.
    """
    n, m, k = len(a), len(b), BAND
    at = levels.place[b[0]] - 1  # b is a part of one family
    kind = np.int32 if 3 * len(right.tag) < 1 << 31 else np.int64
    if levels.kept is None:
        outside = [*map(min, _bounds(left, right, a, b), _bounds(right, left, b, a))]  # up to the shorter list
    else:
        k, outside = max(n, m), [0]
    path = None
    while path is None:
        weight, path = _best_path(n, m, lambda i, p, q: levels.row(a[i], at + p, at + q), kind, k, outside[min(n, m) - k - 1] if k < min(n, m) else -1)
        k = min(8 * k, min(n, m) - bisect_left(outside, weight))
    known = None if levels.kept is None else levels
    del levels
    out = []
    for i, j in path:
        out.append((yield a[i], b[j], known))
    return out


def _best_path(n: int, m: int, row: Callable[[int, int, int], np.ndarray], kind: type, k: int, outside: int) -> tuple[int, list[tuple[int, int]] | None]:
    """The best weight and the pairs of a table's best path up to ``k`` off its diagonals; no pairs if the weight is not above ``outside``.

    ``HELD`` cells are held: every so many rows first, then those between, from the last.
    """
    under, over = min(0, m - n) - k, max(0, m - n) + k
    width = min(m + 1, over - under + 1)
    keep = max(2, HELD // (m + 1), (isqrt(width * width + 4 * HELD) - width) // 2)
    weight, out, j = 0, [], m
    todo = [(0, n, np.zeros(min(m, over) + 1, kind))]  # rows from and to, and the cells of the first
    while todo and j:
        lo, hi, first = todo.pop()
        c, e = max(0, lo + under), min(j, hi + over) + 1  # columns
        if hi - lo <= keep:
            table = np.full((hi - lo + 1, e - c), -1, kind)
            table[0, : len(first)] = first[: e - c]
            for i in range(lo, hi):
                p, q = max(0, i + under), min(j, i + 1 + over)
                if i + 1 + under <= 0:
                    table[i + 1 - lo, 0] = 0
                if q > p:
                    _add(table[i - lo, p - c : q + 1 - c], row(i, p, q), table[i + 1 - lo, p - c : q + 1 - c])
            if hi == n:
                weight = int(table[-1, m - c])
                if weight <= outside:
                    return weight, None
            i = hi
            while i > lo and j:
                here = table[i - lo, j - c]
                if here == table[i - lo - 1, j - c]:
                    i -= 1
                elif j > c and here == table[i - lo, j - 1 - c]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i, j))
        else:
            cuts = [lo + (hi - lo) * x // keep for x in range(keep + 1)]
            best = np.zeros(m + 1, kind)
            best[c : c + len(first)] = first
            todo.append((lo, cuts[1], first))
            for x in range(1, keep):
                for i in range(cuts[x - 1], cuts[x]):
                    p, q = max(0, i + under), min(j, i + 1 + over)
                    if q > p:
                        _add(best[p : q + 1], row(i, p, q), best[p : q + 1])
                todo.append((cuts[x], cuts[x + 1], best[max(0, cuts[x] + under) : min(j, cuts[x] + over) + 1].copy()))
    return weight, out[::-1]


def _asks(left: Tree, right: Tree) -> int:
    """Pairs of branching nodes at equal depths."""
    a, b = (Counter(t.depth[x] for x in range(len(t.tag)) if t.below[x] and not t.lone[x]) for t in (left, right))
    return sum(n * b[depth] for depth, n in a.items())


def simple_tree_matching(left: Tree, right: Tree) -> tuple[float, list[tuple[int, int]]]:
    """The weight of the best mapping of two trees, and its pairs of places.

    A pair of nodes counts 1 and, where the two are equal, a little more, so that equal texts align. Matches of children are asked for by
    generators on a stack of our own, so depth costs no recursion.
    """
    many = len(left.tag) * len(right.tag) > 4 * ASKED and _asks(left, right) > ASKED

    def solve(x: int, y: int, levels: Levels | None):
        if left.hash[x] == right.hash[y] or not left.below[x] or not right.below[y] or left.lone[x] and right.lone[y]:
            return _plain_pair(left, right, x, y)
        score, below = yield from _pair_children(left, right, left.below[x], right.below[y], many, levels)
        return 1.0 + score, x, y, below

    stack, answer = [solve(0, 0, None)], None
    while stack:
        try:
            ask = stack[-1].send(answer)
            stack.append(solve(*ask))
            answer = None
        except StopIteration as done:
            stack.pop()
            answer = done.value
    out, todo = [], [answer]
    while todo:
        _, x, y, below = todo.pop()
        if below is None:
            out.extend((x + k, y + k) for k in range(left.count[x]))
        else:
            out.append((x, y))
            todo.extend(below)
    return answer[0], out


def compare(page: Tree, reference: Tree, stats: np.ndarray) -> None:
    """Add to ``stats``, by place of the reference: pages with an equal text there, and varying and constant characters outside links."""
    of = [-1] * len(page.tag)
    for x, y in simple_tree_matching(page, reference)[1]:
        of[x] = y
    for x in range(1, len(of)):
        y = of[x]
        if y < 0:
            of[x] = of[page.up[x]]  # what has no partner varies inside its parent's
        if page.key[x]:
            if y >= 0 and page.key[x] == reference.key[y]:
                stats[y, 0] += 1
                stats[y, 2] += page.plain[x]
            else:
                stats[of[x], 1] += page.plain[x]


def wrapper(reference: Tree, pages: int, stats: np.ndarray) -> tuple[list[int], list[int]]:
    """The content slot (its path, if there is one), and keys of the template's texts inside it."""
    n = len(reference.tag)
    share = stats[:, 0] / pages
    low = (share + Z2 / (2 * pages) - np.sqrt(Z2 * (share * (1 - share) / pages + Z2 / (4 * pages * pages)))) / (1 + Z2 / pages)
    fixed = (low >= 0.5) & (np.array(reference.key) != 0)
    varying = stats[:, 1] + np.where(fixed, 0, stats[:, 2])
    own_fixed, below = np.where(fixed, stats[:, 2], 0), varying.tolist()
    for k in range(n - 1, 0, -1):
        below[reference.up[k]] += below[k]
    at = 0
    while below[at]:
        inner = max((k for k in reference.below[at] if reference.holder[k]), key=below.__getitem__, default=0)
        if not inner or below[inner] < SHARE * below[at]:
            break
        at = inner
    if not below[at]:
        return [], []
    inside = [False] * n  # at the slot's path or below: several elements may stand there
    for k in range(n):
        inside[k] = not at or k > 0 and (inside[reference.up[k]] or reference.path[k] == reference.path[at])
    live = np.flatnonzero(inside)
    keys = [reference.key[k] for k in live.tolist() if fixed[k]] if own_fixed[live].sum() <= varying[live].sum() else []
    return [reference.path[at]] if at else [], keys


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrappers (layout, slots, keys) of hosts that have any; ``pages`` has page_id, host, html."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [skeleton(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for _, x in made], pa.int64()), pa.array([x for x, _ in made], pa.binary())], ["page_id", "host", "layout", "skeleton"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[str, int], tuple[Tree, np.ndarray]] = {}
            for host, kind, own, other in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (host, kind) not in held:
                    tree = Tree(other)
                    held[host, kind] = tree, np.zeros((len(tree.tag), 3), np.int64)
                compare(Tree(own), *held[host, kind])
            for (host, kind), (_, stats) in held.items():
                at = np.flatnonzero(stats.any(axis=1))
                columns = [pa.array([host] * len(at), pa.string()), pa.array([kind] * len(at), pa.int64()), pa.array(at), *(pa.array(stats[at, k]) for k in range(3))]
                yield pa.RecordBatch.from_arrays(columns, ["host", "layout", "node", "same", "varying", "constant"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                tree = Tree(row["reference"])
                stats = np.zeros((len(tree.tag), 3), np.int64)
                for x in row["stats"]:
                    stats[x["node"]] = x["same"], x["varying"], x["constant"]
                slots, keys = wrapper(tree, row["pages"], stats)
                if slots or keys:
                    out.append({"host": row["host"], "layout": row["layout"], "slots": slots, "keys": keys})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("host", pa.string()), ("layout", pa.int64()), ("slots", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))]))

    trees = pages.filter("host <> ''").select("page_id", "host", "html").mapInArrow(_io.tidy(cut), "page_id long, host string, layout long, skeleton binary")
    own = _io.stash(trees.filter(F.length("skeleton") > 0).groupBy("host", "layout", "skeleton").agg(F.min("page_id").alias("page_id")), "skeletons")
    first = F.min_by("skeleton", F.struct("page_id", "skeleton")).alias("reference")
    each = _io.stash(own.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("pages"), first).filter("pages > 1"), "references")
    rows = own.join(each.select("host", "layout", "reference"), ["host", "layout"]).select("host", "layout", "skeleton", "reference")
    seen = rows.mapInArrow(_io.tidy(align), "host string, layout long, node long, same long, varying long, constant long")
    summed = seen.groupBy("host", "layout", "node").agg(F.sum("same").alias("same"), F.sum("varying").alias("varying"), F.sum("constant").alias("constant"))
    packed = summed.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "same", "varying", "constant")).alias("stats"))  # a row a node of one page
    made = each.join(packed, ["host", "layout"]).mapInArrow(_io.tidy(decide), "host string, layout long, slots array<long>, keys array<long>")
    return _io.stash(made.groupBy("host").agg(F.collect_list(F.struct("layout", "slots", "keys")).alias("wrappers")), "wrappers")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    narrow = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    narrow = narrow.withColumn("host", url_host(F.col("url")))
    common = wrappers(narrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for raw, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                page, slots, drop = parse(raw or ""), frozenset(), frozenset()
                if found:
                    own = skeleton(page)[1]
                    for x in found:
                        if x["layout"] == own:
                            slots, drop = frozenset(x["slots"]), frozenset(x["keys"])
                texts.append(" ".join(text for path, text in blocks(page, slots) if not drop or node_key(path, text) not in drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = narrow.join(common, "host", "left").select("page_id", "url", "html", "wrappers")
    return joined.mapInArrow(_io.tidy(work), "page_id long, url string, text string, n_chars long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_io.read(spark, sf_dir, "pages"))
