"""Wrappers of web pages: parsing, alignment, where the article is, the query against a plain reading of the given template."""

import html
import json
import random
import re

import pytest

from streetloom.llm import wrappers
from streetloom.llm.markup import DEEPEST, parse, runs

SMALL = "/root/testdata/sf0.001"


def wrapper(pages):
    out = None
    for p in pages:
        e = wrappers.expression(parse(p))
        out = wrappers.join(out, e) if out else e
    return out


def texts(pages):
    told = wrappers.locate(wrapper(pages))
    return [wrappers.main_text(p, told) for p in pages]


def test_parsing():
    got = lambda s: list(runs(parse(s)))
    assert got("a <b>b</b>\n\t<i>c</i><br>d&amp;e &am &copy &#233;") == ["a b c d&e &am © é"]
    assert got("<p>one<p><b>two<br><p>three</b></p>four") == ["one", "two", "three", "four"]
    assert got('<script>var t="</p>";</script><style>p{}</style><title>t</title>x<!-- y --><!-- z') == ["x"]
    assert got("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert got("<table><tr><td>a<td>b<tr><td><table><tr><td>c</table>d</table>") == ["a", "b", "c", "d"]
    assert got("1 < 2 <p title='a>b'>x</p> <broken y=\"1 >z") == ["1 < 2", "x", "z"]
    assert got("<div>" * 3 * DEEPEST + "x" + "</div>" * 3 * DEEPEST + "y") == ["x", "y"]
    assert got("") == got(" \n") == []
    assert [c.tag for c in parse("<head><title>t</title><p>x").children] == ["head", "p"]


def test_long_texts_stay_linear():
    for s in ("<a href=\"" * 20000, "<p" * 50000, "<!--" * 20000, "&" * 200000, "<div class='" * 20000, "<p>x" * 30000, "<" * 100000):
        wrappers.main_text(s, None)
    assert len(wrappers.main_text("<article><p>" + "wörd " * 400_000 + "</article>", None)) == 5 * 400_000 - 1


def test_mismatches_become_slots_optionals_and_repeats():
    w = wrapper(["<h1>A</h1><p>x</p><div id=f>end</div>", "<h1>B</h1><p>x</p><p>y</p><div id=f>end</div>"])
    assert w.pattern() == "<body><h1>#</> (<p>#</>)+ <div#f>#!</></>"
    w = wrapper(["<h1>A</h1><h2>s</h2><p>x</p>", "<h1>A</h1><p>x</p>"])
    assert w.pattern() == "<body><h1>#!</> <h2>#!</>? <p>#!</></>"
    assert wrapper(["<dl><dt>a<dd>b<dt>c<dd>d</dl>"]).pattern() == "<body><dl>(<dt>#</> <dd>#</>)+</></>"
    assert wrapper(["<h2>a</h2><p>b</p><p>c</p><h2>d</h2>"]).pattern() == "<body>(<h2>#</>? <p>#</>?)+</>"
    w = wrapper(["<h2>a</h2><ul></ul>", "<ul></ul><h2>a</h2>"])  # crossing labels
    assert w.pattern() == "<body>(<h2>#!</>? <ul></>?)+</>"


@pytest.mark.parametrize("seed", range(40))
def test_a_wrapper_accepts_its_pages(seed):
    rnd = random.Random(seed)

    def some(depth):
        out = []
        for _ in range(rnd.randint(0, 5)):
            tag = rnd.choice(["div", "section", "p", "h2", "div class=a", "TEXT"])
            out.append(rnd.choice("xyz") if tag == "TEXT" else f"<{tag}>{some(depth - 1) if depth else rnd.choice('xyz')}</{tag.split()[0]}>")
        return "".join(out)

    pages = [some(3) for _ in range(8)]
    whole = wrapper(pages)
    halves = wrappers.join(wrapper(pages[:4]), wrapper(pages[4:]))
    again = wrappers.Node.load(json.loads(json.dumps(whole.dump())))
    assert again.pattern() == whole.pattern()
    for p in pages:
        assert wrappers.accepts(whole, parse(p)) and wrappers.accepts(halves, parse(p)) and wrappers.accepts(again, parse(p))
    assert whole.n == len(pages) and whole.chars == halves.chars == sum(len(r) for p in pages for r in runs(parse(p)))


def prose(rnd, n=40):
    return " ".join(rnd.choice(["river", "stone", "market", "engine", "over", "and", "the"]) + str(rnd.randint(0, 99)) for _ in range(n)) + "."


LAYOUTS = {
    "article": "<body><header><a href=/>Home</a> Site</header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><main><article><h1>{h}</h1>{p}<aside>See also</aside><div class='share-buttons'>Share</div></article><section class=comments><article class=comment><p>{c}</p></article></section></main><aside><p>{c}</p></aside><form>Mail <input></form><footer>End</footer>",
    "divs": "<div id=top-header>Site</div><div class=navbar><a>One</a><a>Two</a></div><div class='wrap has-sidebar'><div id=content><h2>{h}</h2>{p}<ul><li>{c}</li></ul></div><div class=sidebar>{c}</div></div><div class='cookie-notice'>We use cookies</div><div id=comments><p>{c}</p></div><div id=footer>End</div>",
    "bare": "<ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><h1>{h}</h1>{p}<p>All rights reserved by us.</p><div class=ad-slot>Buy</div>",
    "table": "<table id=layout><tr><td class=menu><a>One</a></td><td class=text><h1>{h}</h1>{p}</td></tr></table>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    rnd = random.Random(3)
    pages, want = [], []
    for k in range(12):
        paragraphs, h, c = [prose(rnd) for _ in range(rnd.randint(1, 6))], f"Title {k}", prose(rnd, 6)
        pages.append(LAYOUTS[layout].format(h=h, p="".join(f"<p>{x}</p>" for x in paragraphs), c=c))
        want.append("\n\n".join([h, *paragraphs, *([c] if layout == "divs" else []), *(["All rights reserved by us."] if layout == "bare" else [])]))
    assert texts(pages) == want
    assert [wrappers.main_text(p, None) for p in pages] == want  # a page alone


def test_copies_keep_their_text():
    page = LAYOUTS["divs"].format(h="Same", p="<p>Same text on every page of this host.</p>", c="x")
    assert texts([page] * 20) == ["Same\n\nSame text on every page of this host.\n\nx"] * 20


def test_fixed_text_of_a_layout_without_marks():
    rnd = random.Random(4)
    pages = [f"<div>{prose(rnd)}<blockquote>Follow us</blockquote>{prose(rnd)}</div>" for _ in range(10)]
    assert all("Follow" not in t and t.count("\n\n") == 1 for t in texts(pages))
    assert all("Follow" in t for t in texts(pages[:5]))  # too few pages to tell


def plain(page):
    """The given template by hand."""
    inner = page.split("<article>")[1].split("</article>")[0]
    parts = (" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?p>|</?h1>", inner))
    return "\n\n".join(x for x in parts if x)


def test_query(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    from streetloom.llm.queries import queries

    got = queries()["op11_html_wrapper"](spark, SMALL).collect()
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(((r["page_id"], r["url"], plain(r["html"]), len(plain(r["html"]))) for r in rows), key=key)


def test_odd_rows(spark):
    page = LAYOUTS["divs"].format(h="T", p="<p>Some text of the page.</p>", c="x")
    text = "T\n\nSome text of the page.\n\nx"
    rows = [(1, "http://U:p@A.example:80/x", page), (2, "https://a.example?q", page), (2, "https://a.example?q", page), (3, None, page), (None, "no host", page), (4, "http://b.example", None), (5, "http://b.example", ""), (6, "http://b.example", "<nav>x</nav>"), (7, "http://a.example/other", "<article>Other layout</article>")]
    full = spark.createDataFrame([(*r, "h", "e", 1, "v") for r in rows], "page_id long, url string, html string, host string, expression string, piece int, verdict string")
    got = sorted((tuple(r) for r in wrappers.extract(full).collect()), key=str)
    want = {1: text, 2: text, 3: text, None: text, 4: "", 5: "", 6: "", 7: "Other layout"}
    assert got == sorted(((i, u, want[i], len(want[i])) for i, u, _ in rows), key=str)
    assert wrappers.extract(full.limit(0)).count() == 0
    hosts = {r["host"]: wrappers.Node.load(json.loads(r["expression"])).pages for r in wrappers.infer(full).collect()}
    assert hosts == {"a.example": 4, "b.example": 3}


def test_pieces_of_a_host_meet(spark):
    pages = [(n, "http://one.example", f"<article><h1>{n}</h1>{'<p>x</p>' * (n % 4)}{'<h2>y</h2>' if n % 7 == 0 else ''}</article><footer>f</footer>") for n in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(12)
    (row,) = wrappers.infer(df).collect()
    node = wrappers.Node.load(json.loads(row["expression"]))
    assert node.pages == 300 and all(wrappers.accepts(node, parse(p)) for *_, p in pages)
