"""Main text of web pages by wrapper induction.

The pages of a host are made by templates. Pages of one layout (the tags of their upper levels) are aligned with a
reference, one of them, by simple tree matching (the largest top-down, order-keeping set of pairs of equal tags); layouts
that few pages have are aligned with the host's commonest one. Each reference node gathers how many pages have it, how many
with the same text, and the characters and linked characters below it. What nearly all pages have is the template:

* nodes with the same text everywhere are constant and left out;
* of the varying rest, the slot that holds most unlinked text is the content: from the root downwards, a template node
  gives way to a child that holds SHARE_DOWN of its varying text, unless a varying heading stands beside that child;
* below it, elements that are links for the most part, that HTML marks as no content, or whose class or id names say
  so (whole words, a tie-break for what varies like content) are left out.

Menus, adverts and footers thus go because they lie beside the slot, whatever they are called. A page of a host without
a template (fewer than LEAST different pages) or without the content node is its own evidence: <article> or <main> if
it has one, else the same descent over its own characters.

Votes are summed by host, layout and node before the shuffle; tables of references (one row a layout) are broadcast only when
their counted bytes are at most BROADCAST_BYTES, else joined by shuffle, where Spark splits a hot host.

Defined results: a null or empty html has the empty text; pages without a host in the url
form one group; equal pages of a host vote once; equal page ids, null ids and repeated rows are independent rows, as ids are not read; trees of any depth
and width are aligned in full; other columns pass through, whatever their names (one named `main_text` is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, unused, written

#: Different pages that make a template, at least; the share of them that must have a node, and with equal text.
LEAST, SHARE = 3, 0.9
#: The share of a node's varying text that its child must hold to be the content in its place.
SHARE_DOWN = 0.7
#: A layout has a reference of its own if at least this share of the host's different pages has it.
SHARE_LAYOUT = 0.05
#: An element with this share of its characters in links is a menu; levels of tags that tell layouts apart.
LINKED, LEVELS = 0.8, 3
#: Rows of children whose lengths multiply to more keep only some rows of the table and compute the others again.
WIDE = 20_000
#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp svg math".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES_SAME = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
SCOPE = {k: frozenset(v.split()) for k, v in {"li": "ul ol", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr table", "th": "tr table", "option": "select"}.items()}
NOT_CONTENT = frozenset("nav footer aside button select input label script style noscript iframe template textarea title head svg math dialog menu object".split())
HEADINGS = frozenset("h1 h2 h3".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd".split())
LISTS = frozenset("ul ol dl div section table".split())
FIELDS = frozenset("input textarea select button".split())
#: Words of class and id names: any of the first, or only words of all three with one of the second, mark what is no content.
ALWAYS = frozenset("comments comment replies disqus cookie cookies consent gdpr advert adverts advertisement advertising sponsor sponsored sidebar breadcrumb breadcrumbs newsletter".split())
ALONE = frozenset("ad ads banner promo side widget widgets menu nav navbar navigation header masthead footer notice alert modal popup overlay subscribe signup login search share sharing social related recommended reply pagination pager copyright".split())
FILLER = frozenset("site page main top bottom left right bar box block area list container wrapper inner outer slot unit section buttons links items icons form posts stories message global primary secondary sticky".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL)
_WORDS = re.compile(r"[a-z]+")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


@lru_cache(10_000)
def no_content(names: str) -> bool:
    """Whether one of the class, id or role names says so."""
    for name in names.split():
        words = _WORDS.findall(name.lower())
        if any(w in ALWAYS for w in words) or words and any(w in ALONE for w in words) and all(w in ALONE or w in FILLER for w in words):
            return True
    return False


@contextmanager
def deep_trees():
    """Recursion as deep as any page; frames of Python functions are on the heap."""
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(10_000_000)
    try:
        yield
    finally:
        sys.setrecursionlimit(old)


class Node:
    __slots__ = ("_blocks", "chars", "children", "links", "names", "shape", "size", "tag")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.children, self._blocks = tag, names, [], None
        self.chars = self.links = self.shape = self.size = 0

    def blocks(self) -> list[Node]:
        """Child elements that are no inline markup; asked for when the tree is complete."""
        if self._blocks is None:
            self._blocks = [c for c in self.children if isinstance(c, Node) and c.tag not in INLINE]
        return self._blocks

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def parse(page: str | None) -> Node:
    """The DOM tree; raw elements stay empty, end tags that HTML lets authors omit are supplied."""
    root = Node("#root")
    stack, at, text = [root], 0, page or ""
    low = None
    tokens = _TOKEN.finditer(text)
    while True:
        for m in tokens:
            start, before = m.start(), at
            if start > before:
                stack[-1].children.append(text[before:start])
            at = m.end()
            closing, tag, rest = m.groups()
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                depth = len(stack) - 1
                while depth and stack[depth].tag != tag:
                    depth -= 1
                if depth:
                    del stack[depth:]
                continue
            if tag in CLOSES_P:
                depth = len(stack) - 1
                while depth and (stack[depth].tag in INLINE):
                    depth -= 1
                if stack[depth].tag == "p":
                    del stack[depth:]
            if tag in CLOSES_SAME:
                same, scope, depth, cut = CLOSES_SAME[tag], SCOPE[tag], len(stack) - 1, 0
                while depth and stack[depth].tag not in scope:
                    cut = depth if stack[depth].tag in same else cut
                    depth -= 1
                if cut:
                    del stack[cut:]
            node = Node(tag, " ".join(x for g in _NAMES.findall(rest) for x in g if x) if rest else "")
            stack[-1].children.append(node)
            if tag in RAW:
                if low is None:
                    low = text.lower()
                    if len(low) != len(text):
                        low = "".join(c.lower() if c.isascii() else c for c in text)
                end = low.find(f"</{tag}", at)
                close = text.find(">", end) if end >= 0 else -1
                at = len(text) if close < 0 else close + 1
                tokens = _TOKEN.finditer(text, at)
                break
            if tag not in VOID and not rest.endswith("/"):
                stack.append(node)
        else:
            if at < len(text):
                stack[-1].children.append(text[at:])
            return root


def text_of(node: Node, keep=lambda n: True) -> str:
    """The text below a node, of the elements that `keep` admits."""
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c is node or keep(c):
            if c.tag in INLINE:
                todo += reversed(c.children)
            else:
                out.append("\n")
                todo.append("\n")
                todo += reversed(c.children)
    return " ".join(entities.unescape("".join(out)).split())


def in_order(root: Node) -> list[Node]:
    """Nodes in page order, each before its children."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        if n.children:
            todo += [c for c in reversed(n.children) if c.__class__ is Node]
    return out


def measured(root: Node) -> list[Node]:
    """The nodes in page order, each with the characters below it (white space left out), those of them in links, and
    for blocks the number of blocks and a name of their tree (equal for equal trees)."""
    nodes = in_order(root)
    for n in reversed(nodes):
        chars = links = 0
        size, shapes, blocks = 1, [n.tag], []
        for c in n.children:
            if c.__class__ is str:
                chars += len("".join(c.split()))
            else:
                chars += c.chars
                links += c.links
                if c.tag not in INLINE:
                    blocks.append(c)
                    size += c.size
                    shapes.append(c.shape)
        n.chars, n.links, n._blocks, n.size, n.shape = chars, chars if n.tag == "a" else links, blocks, size, hash(tuple(shapes))
    return nodes


def match(a: Node, b: Node, pairs: list | None = None) -> int:
    """Simple tree matching over block elements of measured trees: the size of the largest matching of two trees with equal
    roots. Its pairs of nodes go to `pairs`."""
    kept: dict[tuple[int, int], tuple] = {}
    with deep_trees():
        size = _weigh(a, b, kept)
        if pairs is not None:
            todo = [(a, b)]
            while todo:
                p, q = todo.pop()
                pairs.append((p, q))
                if p.shape == q.shape:
                    todo += zip(p.blocks(), q.blocks())
                    continue
                if (id(p), id(q)) not in kept:  # left out by _wide
                    _weigh(p, q, kept)
                x, y, head, tail, best = kept.get((id(p), id(q)), ((), (), 0, 0, None))
                todo += zip(x[:head], y[:head])
                todo += zip(x[len(x) - tail :], y[len(y) - tail :])
                if isinstance(best, tuple):
                    todo += best
                    continue
                i, j = len(x) - tail, len(y) - tail
                while best and i > head and j > head:
                    here = best[i - head][j - head]
                    if here == best[i - head - 1][j - head]:
                        i -= 1
                    elif here == best[i - head][j - head - 1]:
                        j -= 1
                    else:
                        todo.append((x[i - 1], y[j - 1]))
                        i, j = i - 1, j - 1
    return size


def _weigh(a: Node, b: Node, kept: dict) -> int:
    if a.shape == b.shape:
        return a.size
    x, y = a.blocks(), b.blocks()
    if not x or not y:
        return 1
    # Equal trees at the start or the end of two rows are in some largest matching: no partner weighs more.
    head, tail, n, ends = 0, 0, min(len(x), len(y)), 0
    while head < n and x[head].shape == y[head].shape:
        ends += x[head].size
        head += 1
    while tail < n - head and x[-1 - tail].shape == y[-1 - tail].shape:
        ends += x[-1 - tail].size
        tail += 1
    p, q = x[head : len(x) - tail], y[head : len(y) - tail]
    if len(p) * len(q) > WIDE:
        most, found = _wide(p, q)
        kept[id(a), id(b)] = (x, y, head, tail, tuple(found))
        return 1 + ends + most
    best = [[0] * (len(q) + 1)]
    for u in p:
        row, above = [0], best[-1]
        for k, v in enumerate(q):
            w = above[k] + _weigh(u, v, kept) if u.tag == v.tag else 0
            row.append(max(above[k + 1], row[k], w))
        best.append(row)
    kept[id(a), id(b)] = (x, y, head, tail, best)
    return 1 + ends + best[-1][-1]


def _wide(x: list[Node], y: list[Node]) -> tuple[int, list[tuple[Node, Node]]]:
    """Size and pairs of the largest matching of two rows; of its table each k-th row stays, k near the root of the length."""
    k = max(1, round(len(x) ** 0.5))

    def below(above: list[int], p: Node, n: int) -> list[int]:
        row, flat, left = [0], not p.blocks(), 0
        for c in range(n):
            q, best = y[c], above[c + 1]
            if left > best:
                best = left
            if p.tag == q.tag:
                w = above[c] + (1 if flat or not q.blocks() else _weigh(p, q, {}))
                if w > best:
                    best = w
            row.append(best)
            left = best
        return row

    row = [0] * (len(y) + 1)
    marks = [row]
    for i, p in enumerate(x, 1):
        row = below(row, p, len(y))
        if i % k == 0:
            marks.append(row)
    found, i, j = [], len(x), len(y)
    while i and j:
        base = (i - 1) // k * k
        rows = [marks[base // k]]
        for p in x[base:i]:
            rows.append(below(rows[-1], p, j))
        while i > base and j:
            here = rows[i - base][j]
            if here == rows[i - base - 1][j]:
                i -= 1
            elif here == rows[i - base][j - 1]:
                j -= 1
            else:
                found.append((x[i - 1], y[j - 1]))
                i, j = i - 1, j - 1
    return row[-1], found


def layout_of(page: str | None, root: Node | None = None) -> str:
    """The tags of the upper levels of a page's body, neighbours of one tag told once; empty for a page without text."""

    def told(node: Node, level: int) -> str:
        below = []
        for b in node.blocks() if level else ():
            here = told(b, level - 1)
            if not below or below[-1] != here:
                below.append(here)
        return f"{node.tag}({','.join(below)})" if below else node.tag

    root = root or parse(page)
    nodes = in_order(root)
    if not any(c.__class__ is str and not c.isspace() for n in nodes for c in n.children):
        return ""
    return told(next((n for n in nodes if n.tag == "body"), root), LEVELS - 1)


def _form(node: Node) -> bool:
    """A form of fields, not one that wraps a page: it holds little text for its fields."""
    fields = sum(n.tag in FIELDS for n in in_order(node))
    return fields > 0 and node.chars < 200 * fields or node.chars == 0


def _unfit(node: Node, inside: bool) -> bool:
    """What HTML or names mark as no content. inside: below the content node, where a header may hold the title."""
    if node.tag in NOT_CONTENT:
        return True
    if node.tag == "form":
        return _form(node)
    if node.tag == "header" and not inside:
        return True
    return bool(node.names) and node.tag not in ("html", "body", "main", "article") and no_content(node.names)


def _menu(node: Node) -> bool:
    return node.tag in LISTS and node.chars > 0 and node.links >= LINKED * node.chars and sum(n.tag == "a" for n in in_order(node)) > 2


def descend(root: Node, mass, varies=lambda n: True) -> Node:
    """The node that the content fills: downwards while one child holds SHARE_DOWN of the mass and no heading stands beside it."""
    at = root
    while True:
        below = at.blocks()
        best = max(below, key=mass, default=None)
        if best is None or best.tag in TEXTUAL or mass(best) < SHARE_DOWN * mass(at) or mass(best) <= 0:
            return at
        if any(n.tag in HEADINGS and n.chars and varies(n) for b in below if b is not best and mass(b) > 0 for n in in_order(b)):
            return at
        if at.tag == "article":
            return at
        at = best


class Reference:
    """A reference page, with its nodes numbered in page order."""

    def __init__(self, page: str | None):
        self.root = parse(page)
        self.nodes = measured(self.root)
        self.number = {id(n): k for k, n in enumerate(self.nodes)}
        self.text = {id(n): text_of(n) for n in self.nodes if n.chars and not n.blocks()}

    def aligned(self, root: Node) -> list[tuple[Node, int]]:
        """Nodes of a measured page and the numbers of those they are aligned with."""
        pairs: list[tuple[Node, Node]] = []
        match(root, self.root, pairs)
        return [(a, self.number[id(b)]) for a, b in pairs]

    def votes(self, page: str | Node | None) -> np.ndarray:
        """(number, same text, characters, linked characters) for each reference node that the page has."""
        root = page if isinstance(page, Node) else parse(page)
        measured(root)
        out = []
        for a, k in self.aligned(root):
            same = a.chars and not a.blocks() and self.text.get(id(self.nodes[k])) == text_of(a)
            out.append((k, int(bool(same)), a.chars, a.links))
        return np.array(out, np.int64).reshape(-1, 4)

    def template(self, votes: np.ndarray) -> tuple[int, list[int]]:
        """The number of the content node, and those of constant blocks and of menus. votes: (number, pages, same, chars, links)."""
        n = votes[:, 1].max()  # every page has the root
        has, same, chars, links = (np.zeros(len(self.nodes)) for _ in range(4))
        at = votes[:, 0].astype(int)
        has[at], same[at], chars[at], links[at] = votes[:, 1:].T
        common = has >= SHARE * n
        constant = common & (same >= SHARE * has) & (same > 0)
        mass = {}
        for k in range(len(self.nodes) - 1, -1, -1):  # children before parents
            node = self.nodes[k]
            if constant[k] or _unfit(node, False):
                mass[id(node)] = 0.0
                continue
            lost = sum((chars[j] - links[j]) - mass[id(b)] for b in node.blocks() for j in [self.number[id(b)]])
            mass[id(node)] = max(0.0, chars[k] - links[k] - lost) if has[k] else 0.0
        content = descend(self.root, lambda m: mass[id(m)], lambda m: not constant[self.number[id(m)]])
        held = {id(m) for m in in_order(content)}
        gone = [k for k, m in enumerate(self.nodes) if id(m) in held and m is not content and (constant[k] or common[k] and m.tag in LISTS and _menu(m) and links[k] >= LINKED * chars[k])]
        return self.number[id(content)], gone


def extract(page: str | Node | None, reference: Reference | None = None, content: int = 0, template: frozenset[int] = frozenset()) -> str:
    """The main text: below the node aligned with the content node, less what is aligned with constant nodes of equal text and menus."""
    root = page if isinstance(page, Node) else parse(page)
    nodes = measured(root)
    gone: set[int] = set()
    tops: list[Node] = []
    if reference is not None:
        for a, k in reference.aligned(root):
            if k == content and a.chars:
                tops = [a]
            if k in template and (a.blocks() or reference.text.get(id(reference.nodes[k])) == text_of(a)):
                gone.add(id(a))
    if not tops:
        fits = {id(n) for n in in_order_if(root, lambda n: not _unfit(n, False))}
        for tag in ("article", "main"):
            found = [n for n in nodes if n.tag == tag and id(n) in fits]
            inner = {id(m) for n in found for m in in_order(n) if m is not n}
            tops = tops or [n for n in found if id(n) not in inner]
        mass = lambda n: n.chars - n.links if id(n) in fits and not _menu(n) else 0
        tops = tops or [descend(root, mass)]
    keep = lambda n: id(n) not in gone and not _unfit(n, True) and not _menu(n)
    return " ".join(x for x in (text_of(t, keep) for t in tops) if x)


def in_order_if(root: Node, keep) -> list[Node]:
    """Nodes in page order without the trees of those that `keep` refuses."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.elements()) if keep(c)]
    return out


@lru_cache(300)
def reference_of(page: str) -> Reference:
    """The references that a worker met last; the number bounds memory."""
    return Reference(page)


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """pages with `main_text`. page_id is not read."""
    pages = pages.drop("main_text")
    h, key, refs_ = (unused(n, pages.columns) for n in ("host", "key", "refs"))
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.withColumn(h, host)
    plain = rows.select(F.col(h).alias("host"), F.col(html).alias("page"), F.md5(F.col(html).cast("binary")).alias("key"))

    @F.pandas_udf("string")
    def layout(part: pd.Series) -> pd.Series:
        return pd.Series([md5(x.encode()).hexdigest() if x else None for x in map(layout_of, part)], dtype=object)

    # Layouts by host, from different pages with a text; the reference of each is the page of smallest MD5.
    seen = plain.where(F.col("page") != "").select("host", "key", layout("page").alias("layout")).where(F.col("layout").isNotNull())
    seen = written(seen.groupBy("host", "layout", "key").agg(F.count(F.lit(1)).alias("copies")), "pages-seen")
    groups = seen.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    whole = groups.groupBy("host").agg(F.sum("n").alias("total"), F.max(F.struct("n", "layout"))["layout"].alias("main"))
    groups = groups.join(whole, "host").where(f"total >= {LEAST} AND (layout = main OR n >= greatest({LEAST}, {SHARE_LAYOUT} * total))")
    groups = written(groups.select("host", "layout", "key", (F.col("layout") == F.col("main")).alias("main")), "layouts")
    picked = plain.join(small(groups), ["host", "key"])
    refs = written(picked.groupBy("host", "layout").agg(F.first("page").alias("ref"), F.first("main").alias("main")), "references")

    def assigned(df: DataFrame, by_host: str, table: DataFrame, to: str, *more: str) -> DataFrame:
        """df with the references of its host (at most 1 / SHARE_LAYOUT), the main one first."""
        name = unused("host_", df.columns)
        of = table.groupBy(F.col("host").alias(name)).agg(F.sort_array(F.collect_list(F.struct("main", "layout", "ref", *more)), asc=False).alias(to))
        return df.join(small(of), F.col(by_host) == F.col(name), "left").drop(name)

    def chosen(found, page: str | None):
        """The reference of the page's layout, or else the main one, and the parsed page."""
        if found is None or not len(found):
            return None, parse(page)
        root = parse(page)
        kind = layout_of(page, root)
        own = md5(kind.encode()).hexdigest()
        return next((r for r in found if r["layout"] == own), found[0]) if kind else None, root

    def votes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            total: dict[tuple[str, str], np.ndarray] = {}
            for name, found, text, weight in zip(part["host"], part["refs"], part["page"], part["weight"]):
                r, root = chosen(found, text)
                if r is not None:
                    reference = reference_of(r["ref"])
                    v, at = reference.votes(root), (name, r["layout"])
                    if at not in total:
                        total[at] = np.zeros((len(reference.nodes), 4))
                    total[at][v[:, 0], 0] += weight
                    total[at][v[:, 0], 1:] += v[:, 1:] * weight
            for (name, kind), t in total.items():
                at = np.flatnonzero(t[:, 0])
                yield pd.DataFrame({"host": name, "layout": kind, "node": at, "has": t[at, 0], "same": t[at, 1], "chars": t[at, 2], "links": t[at, 3]})

    # Copies of a page share one vote.
    copies = small(written(seen.where("copies > 1").select("host", "key", "copies"), "copies"))
    voters = assigned(plain.join(copies, ["host", "key"], "left"), "host", refs, "refs").where("refs IS NOT NULL AND page <> ''")
    voters = voters.select("host", "page", "refs", F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("weight"))
    cast = voters.mapInPandas(votes, "host string, layout string, node int, has double, same double, chars double, links double")
    cast = cast.groupBy("host", "layout", "node").agg(*[F.sum(c).alias(c) for c in ("has", "same", "chars", "links")])
    cast = cast.groupBy("host", "layout").agg(F.array_sort(F.collect_list(F.array(F.col("node").cast("double"), "has", "same", "chars", "links"))).alias("votes"))  # nodes of one page

    @F.pandas_udf("content int, gone array<int>")
    def template(ref: pd.Series, votes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([Reference(r).template(np.stack([np.asarray(x) for x in v])) for r, v in zip(ref, votes)], columns=["content", "gone"])

    made = cast.join(refs, ["host", "layout"]).withColumn("t", template("ref", "votes"))
    made = written(made.select("host", "layout", "main", "ref", "t.content", "t.gone"), "templates")

    @F.pandas_udf("string")
    def main_text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, founds in parts:
            out = []
            for text, found in zip(texts, founds):
                r, root = chosen(found, text)
                out.append(extract(root) if r is None else extract(root, reference_of(r["ref"]), int(r["content"]), frozenset(r["gone"])))
            yield pd.Series(out, dtype=object)

    out = assigned(rows, h, made, refs_, "content", "gone")
    return out.withColumn("main_text", main_text(F.col(html), F.col(refs_))).select(*pages.columns, "main_text")
