"""Main texts of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a tree of elements; its expression lists each element's children in order, where what repeats is folded into (a? b?)+. Two
expressions are aligned from the top: children that share a label match; one that only one side has becomes optional; labels that come
again, or in another order, become a repeated group; texts that differ become a slot, and those that are equal on every page stay
fixed. So there is never a choice between alternatives, a label stands once among an element's children, and an expression is bounded by the distinct
labels of a host, not by its pages.

Spark aligns within tasks first, then the parts of a host in pieces, then the pieces; only expressions are shuffled. A host's
expression then says where the article is, and what lies in it that isn't the article's, for all of its pages alike.

Defined results: null html is empty; a page without an article's text has an empty one; a page whose url is null or names no host is taken by itself,
as is one in which its host's wrapper finds no text; repeated rows are repeated; other columns are ignored. A page must fit a worker's memory, about 20 times over.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .markup import Element, parse, runs
from .shared import blank, prepare, table, written

TEXT = "#"

#: Copies of a host's verdict, dealt among its pages where it is joined by shuffle; pieces that a host's expressions are merged in first.
PIECES = 16

#: Hosts whose expressions a task holds before it passes them on.
HELD = 2000

#: A text that stands unchanged on so many pages of a host is part of its layout, where no element says what the article is.
FIXED_PAGES = 8

#: An element is descended into when it holds this share of the text; lists with more of their text in links are menus.
SHARE, LINKED = 0.75, 0.6

#: Elements that aren't an article's text, and words that classes, ids and roles of such elements have.
ASIDE = set("nav header footer aside form script style noscript template head iframe button select textarea menu dialog svg object audio video canvas label input option fieldset search title noembed noframes xmp datalist map".split())
WORDS = set(
    "ad ads adbox adslot adunit advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners"
    " nav navbar navigation topnav subnav menu menus submenu menubar breadcrumb breadcrumbs pagination pager toolbar"
    " sidebar sidebars rail widget widgets complementary related recommended recommendations trending popular share sharing social"
    " cookie cookies consent gdpr notice notices alert popup modal overlay dialog subscribe subscription newsletter signup login search"
    " comment comments disqus replies reply respond discussion guestbook footer masthead header contentinfo copyright".split()
)
#: Of these an article element's own name may have, and a heading's too.
COMMENTS = set("comment comments disqus replies reply respond discussion guestbook ad ads advert advertisement sponsored promo".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


class Node:
    """An element or, under the label TEXT, a text run: in how many places (n) and pages it stands, its characters in all and in links.

    groups are (members [(node, optional)], repeated, optional). value is a text's hash while it is fixed.
    """

    __slots__ = ("chars", "groups", "label", "linked", "n", "pages", "value")

    def __init__(self, label, n=1, pages=1, chars=0, linked=0, value=None, groups=()):
        self.label, self.n, self.pages, self.chars, self.linked, self.value, self.groups = label, n, pages, chars, linked, value, list(groups)

    @property
    def tag(self) -> str:
        return re.match(r"[^#.@]*", self.label)[0]

    def child(self, label: str):
        return next((m for members, *_ in self.groups for m, _ in members if m.label == label), None)

    def members(self):
        return (m for members, *_ in self.groups for m, _ in members)

    def dump(self) -> list:
        return [self.label, self.n, self.pages, self.chars, self.linked, self.value, [[[[m.dump(), o] for m, o in members], r, q] for members, r, q in self.groups]]

    @classmethod
    def load(cls, d: list) -> Node:
        return cls(*d[:6], [([(cls.load(m), o) for m, o in members], r, q) for members, r, q in d[6]])

    def pattern(self) -> str:
        """The expression as text: slots are TEXT, fixed texts TEXT!."""
        if self.label == TEXT:
            return TEXT + ("!" if self.value else "")
        inner = []
        for members, repeated, optional in self.groups:
            body = " ".join(m.pattern() + ("?" if o else "") for m, o in members)
            inner.append((f"({body})" if len(members) > 1 or repeated else body) + {(0, 0): "", (0, 1): "?", (1, 0): "+", (1, 1): "*"}[bool(repeated), bool(optional)])
        return f"<{self.label}>{' '.join(inner)}</>"


def expression(element: Element) -> Node:
    """A page's own expression: each element's children, with what repeats folded."""
    node = Node(element.label)
    children = []
    for c in element.children:
        if isinstance(c, tuple):
            children.append(Node(TEXT, chars=len(c[0]), linked=c[1], value=hashlib.md5(c[0].encode("utf-8", "surrogatepass")).hexdigest()[:16]))
        else:
            children.append(expression(c))
    node.groups = fold(children)
    for m in node.members():
        node.chars += m.chars
        node.linked += m.linked
    return node


def fold(children: list[Node]) -> list:
    """Groups of one instance's children. From the first to the last of a label that comes again is one repeated group."""
    last = {c.label: k for k, c in enumerate(children)}
    out, k = [], 0
    while k < len(children):
        end, at = last[children[k].label], k
        while at <= end:
            end = max(end, last[children[at].label])
            at += 1
        if end == k:
            out.append(([(children[k], False)], False, False))
        else:
            out.append((_turns(children[k : end + 1]), True, False))
        k = end + 1
    return out


def _turns(children: list[Node]) -> list[tuple[Node, bool]]:
    """Members of a repeated group in order of first appearance; optional are those that some turn lacks."""
    order: dict[str, int] = {}
    for c in children:
        order.setdefault(c.label, len(order))
    merged: dict[str, Node] = {}
    seen: dict[str, int] = dict.fromkeys(order, 0)
    turns, before = 0, len(order)
    for c in children:
        if order[c.label] <= before:
            turns += 1
        before = order[c.label]
        seen[c.label] += 1
        merged[c.label] = join(merged[c.label], c, same_page=True) if c.label in merged else c
    return [(merged[x], seen[x] < turns) for x in order]


def join(a: Node, b: Node, same_page: bool = False) -> Node:
    """The expression of what either side accepts."""
    out = Node(a.label, a.n + b.n, max(a.pages, b.pages) if same_page else a.pages + b.pages, a.chars + b.chars, a.linked + b.linked, a.value if a.value == b.value else None)
    out.groups = align(a.groups, b.groups, same_page)
    return out


def _labels(group) -> set:
    return {m.label for m, _ in group[0]}


def align(left: list, right: list, same_page: bool) -> list:
    """Groups of both sides in one order: the longest run of matches, what is between them optional, labels that cross as one repeated group."""
    ll, rl = [_labels(g) for g in left], [_labels(g) for g in right]
    if ll == rl:
        return [_both(g, h, same_page) for g, h in zip(left, right, strict=True)]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if ll[i] & rl[j] else 0)
    out, i, j = [], 0, 0
    while i < len(left) or j < len(right):
        if i < len(left) and j < len(right) and ll[i] & rl[j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(_both(left[i], right[j], same_page))
            i, j = i + 1, j + 1
        elif j == len(right) or i < len(left) and best[i + 1][j] >= best[i][j + 1]:
            out.append((*left[i][:2], True))
            i += 1
        else:
            out.append((*right[j][:2], True))
            j += 1
    return _refold(out, same_page)


def _both(g, h, same_page: bool):
    theirs = dict((m.label, (m, o)) for m, o in h[0])
    mine = {m.label for m, _ in g[0]}
    if len(theirs) == len(g[0]) == 1 and mine == set(theirs):
        (m, o), (n, q) = g[0][0], h[0][0]
        return ([(join(m, n, same_page), o or q)], g[1] or h[1], g[2] or h[2])
    common_here = [m.label for m, _ in g[0] if m.label in theirs]
    common_there = [x for x in theirs if x in mine]
    loose = common_here != common_there  # in another order no member can be relied on
    members: list[tuple[Node, bool]] = []
    waiting = list(theirs)
    for m, o in g[0]:
        if m.label not in theirs:
            members.append((m, True))
            continue
        while not loose and waiting[0] != m.label:  # what only the other side has keeps its place
            members.append((theirs[waiting.pop(0)][0], True))
        waiting.remove(m.label)
        members.append((join(m, theirs[m.label][0], same_page), o or theirs[m.label][1] or loose))
    members += [(theirs[x][0], True) for x in waiting]
    return (members, True, g[2] or h[2])


def _refold(groups: list, same_page: bool) -> list:
    """A label stands in one group: those from its first to its last become one, whose members are all optional."""
    last = {x: k for k, g in enumerate(groups) for x in _labels(g)}
    out, k = [], 0
    while k < len(groups):
        end, at = k, k
        while at <= end:
            end = max(end, *(last[x] for x in _labels(groups[at])))
            at += 1
        if end == k:
            out.append(groups[k])
        else:
            merged: dict[str, Node] = {}
            for members, *_ in groups[k : end + 1]:
                for m, _ in members:
                    merged[m.label] = join(merged[m.label], m, same_page) if m.label in merged else m
            out.append(([(m, True) for m in merged.values()], True, all(g[2] for g in groups[k : end + 1])))
        k = end + 1
    return out


def accepts(node: Node, element: Element) -> bool:
    """Whether a page's element is in the expression's language."""
    names = {m.label: (chr(0xE000 + k), m) for k, m in enumerate(node.members())}
    word = []
    for c in element.children:
        label = TEXT if isinstance(c, tuple) else c.label
        if label not in names or not isinstance(c, tuple) and not accepts(names[label][1], c):
            return False
        word.append(names[label][0])
    rule = "".join("(?:" + "".join(names[m.label][0] + "?" * bool(o) for m, o in members) + ")" + {(0, 0): "", (0, 1): "?", (1, 0): "+", (1, 1): "*"}[bool(r), bool(q)] for members, r, q in node.groups)
    return re.fullmatch(rule, "".join(word)) is not None


def _words(label: str) -> set:
    names = re.sub(r"([a-z])([A-Z])", r"\1-\2", re.sub(r"^[^#.@]*", "", label)).lower()
    names = re.sub(r"\b(?:has|with|without|no|show|hide)[-_]+[a-z]+", "", names)  # these tell what is around
    return set(re.findall(r"[a-z]+", names))


def beside(node: Node) -> bool:
    """Whether an element is beside the article by what it is or is called; one that holds an article is only if it holds comments."""
    tag = node.tag
    if node.label == TEXT or tag in ("body", "main"):
        return False
    if tag in ASIDE:
        return True
    names = _words(node.label)
    if tag == "article" or tag in HEADINGS:
        return bool(names & COMMENTS)
    return bool(names & WORDS) and (bool(names & COMMENTS) or not _holds_article(node))


def _holds_article(node: Node) -> bool:
    return any(m.label != TEXT and (is_article(m) or _holds_article(m)) for m in node.members())


def is_article(node: Node) -> bool:
    return node.tag in ("article", "main") and not _words(node.label) & COMMENTS or node.label.endswith("@main")


def weight(node: Node) -> int:
    """Characters of running text, without links and what is beside the article."""
    if node.label == TEXT:
        return node.chars - node.linked
    return 0 if beside(node) else sum(weight(m) for m in node.members())


def locate(root: Node) -> dict:
    """{main: path of the article's element, drop: paths in it that aren't the article's, told: whether an element says what the article is}."""
    best, told = (), False
    found: list[tuple[int, tuple, Node]] = []

    def look(node: Node, path: tuple) -> None:
        for m in node.members():
            if m.label != TEXT and not beside(m):
                if is_article(m):
                    found.append((weight(m), (*path, m.label), m))
                look(m, (*path, m.label))

    look(root, ())
    node = root
    if any(w for w, *_ in found):
        told = True
        most = max(w for w, *_ in found)
        # the innermost that holds most of what the greatest holds
        _, best, node = max((x for x in found if 2 * x[0] >= most), key=lambda x: (len(x[1]), x[0], x[1]))
    else:
        while node.groups:
            whole = weight(node)
            inner = [(weight(m), m.label, m) for m in node.members() if m.label != TEXT and not _reading(m)]
            top = max(inner, default=None, key=lambda x: x[:2])
            if not top or not whole or top[0] < SHARE * whole:
                break
            node, best = top[2], (*best, top[1])
    drop: list[tuple] = []
    slots = sum(m.chars for m in _texts(node) if m.value is None)

    def cut(n: Node, path: tuple) -> None:
        for m in n.members():
            here = (*path, m.label)
            fixed = not told and m.label == TEXT and m.value is not None and m.pages >= FIXED_PAGES and slots > m.chars
            menu = not told and m.tag in ("ul", "ol", "div", "table", "dl", "section") and m.linked > LINKED * m.chars and weight(m) < 0.2 * slots
            if beside(m) or fixed or menu:
                drop.append(here)
            elif m.label != TEXT:
                cut(m, here)

    cut(node, ())
    return {"main": best, "drop": drop, "told": told}


def _reading(node: Node) -> bool:
    """Elements of running text, which an article's element isn't."""
    return node.tag in HEADINGS or node.tag in ("p", "ul", "ol", "dl", "pre", "blockquote", "li", "table", "tr", "td", "th", "figure", "figcaption", "dd", "dt")


def _texts(node: Node) -> Iterator[Node]:
    for m in node.members():
        if m.label == TEXT:
            yield m
        elif not beside(m):
            yield from _texts(m)


def blocks(root: Element, verdict: dict) -> list[str]:
    """The article's text runs of a page by a verdict."""
    main, drop = tuple(verdict["main"]), {tuple(p) for p in verdict["drop"]}
    places = [root]
    for label in main:
        places = [c for p in places for c in p.children if not isinstance(c, tuple) and c.label == label]
    out: list[str] = []

    def walk(e: Element, path: tuple) -> None:
        for c in e.children:
            here = (*path, TEXT if isinstance(c, tuple) else c.label)
            if here in drop:
                continue
            if isinstance(c, tuple):
                out.append(c[0])
            else:
                walk(c, here)

    for p in places:
        walk(p, ())
    return out


def host_of(url: str = "url"):
    """The host that a url names, in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _merge(it: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Join expressions of neighbouring rows with equal fields."""
    key, node, out = None, None, []
    for b in it:
        rows = zip(*(b.column(b.schema.get_field_index(f)).to_pylist() for f in [*fields, "expression"]), strict=True)
        for *k, e in rows:
            e = Node.load(json.loads(e))
            if k == key:
                node = join(node, e)
                continue
            if key:
                out.append((key, node))
            key, node = k, e
        if len(out) >= 256:
            yield _batch(out, fields)
            out = []
    if key:
        yield _batch([*out, (key, node)], fields)


def _batch(rows: list, fields: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if f == "host" else pa.int32() for f in fields]
    cols = [pa.array([k[i] for k, _ in rows], t) for i, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*cols, pa.array([json.dumps(n.dump(), separators=(",", ":")) for _, n in rows], pa.string())], [*fields, "expression"])


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, expression): one wrapper for each host that pages name."""
    prepare(pages.sparkSession)
    named = pages.select(host_of(url).alias("host"), blank(html).alias("html")).filter("host <> ''")

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Node] = {}
        for b in it:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                e = expression(parse(page))
                held[host] = join(held[host], e) if host in held else e
            if len(held) > HELD:
                yield _batch([([h], n) for h, n in held.items()], ["host"])
                held = {}
        if held:
            yield _batch([([h], n) for h, n in held.items()], ["host"])

    kind = "host string, expression string"
    parts = named.mapInArrow(partial, kind).withColumn("piece", F.pmod(F.xxhash64("expression"), F.lit(PIECES)).cast("int"))
    pieces = parts.repartition("host", "piece").sortWithinPartitions("host", "piece", "expression").select("host", "piece", "expression").mapInArrow(lambda it: _merge(it, ["host", "piece"]), "host string, piece int, expression string")
    return pieces.repartition("host").sortWithinPartitions("host", "piece").select("host", "expression").mapInArrow(lambda it: _merge(it, ["host"]), kind)


def verdicts(wrappers: DataFrame) -> DataFrame:
    """(host, verdict): where the article is, as JSON."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [json.dumps(locate(Node.load(json.loads(e)))) for e in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["host", "verdict"])

    return wrappers.select("host", "expression").mapInArrow(run, "host string, verdict string")


def main_text(page: str, verdict: dict | None) -> str:
    """A page's article by its host's verdict; by itself if there is none, or none of its text is found there."""
    root = parse(page)
    found = blocks(root, verdict) if verdict else []
    return "\n\n".join(found or blocks(root, locate(expression(root))))


def extract(pages: DataFrame, wrappers: DataFrame | None = None, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; wrappers are inferred from the same pages if none are given."""
    wrappers = written(infer(pages, url, html) if wrappers is None else wrappers, "wrappers")
    # Spark broadcasts the verdicts if their file is below its threshold; else pages of a host meet one of its copies
    told = written(verdicts(wrappers).withColumn("piece", F.explode(F.array(*map(F.lit, range(PIECES))))), "verdicts")
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), blank(html).alias("html"), host_of(url).alias("host"))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(PIECES)).cast("int"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for b in it:
            texts = []
            for page, v in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if v is not None and v not in known:
                    known = known if len(known) < HELD else {}
                    known[v] = json.loads(v)
                texts.append(main_text(page, known[v] if v is not None else None))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.join(told, ["host", "piece"], "left").select("page_id", "url", "html", "verdict").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op11_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages by their hosts' wrappers."""
    return extract(table(spark, sf_dir, "pages"))
