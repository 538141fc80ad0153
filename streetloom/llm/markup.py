"""HTML as a tree of blocks with their text runs.

Only elements that break lines make nodes; inline ones belong to the text around them. Omitted end tags are
implied as browsers do for paragraphs, list items, table parts and the head. Contents of scripts, styles and the like are skipped whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Elements of the HTML standard by what they do here.
INLINE = set("a abbr acronym b basefont bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr picture q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp".split())
HEAD = set("title style script meta link base noscript template".split())
CLOSES_PARAGRAPH = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: An element of the first kind ends an open one of the second, unless one of the third lies between.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}
IMPLIED |= {t: IMPLIED["tbody"] for t in ("thead", "tfoot")}

#: Elements nested deeper aren't nodes; their text runs belong to the one at this depth.
DEEPEST = 100

#: A comment, a declaration, a tag with its attributes, or what is left of a broken tag.
TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Element:
    """label tells elements of a page's layout apart; children are elements and (text, characters of it in links)."""

    __slots__ = ("children", "label", "linked", "parts", "tag")

    def __init__(self, tag: str, label: str, linked: bool = False):
        self.tag, self.label, self.linked = tag, label, linked
        self.children: list = []
        self.parts: list[tuple[str, bool]] = []

    def flush(self) -> None:
        """End the current text run."""
        if self.parts:
            text = " ".join("".join(p for p, _ in self.parts).split())
            if text:
                self.children.append((text, min(len(text), sum(len("".join(p.split())) for p, a in self.parts if a))))
            self.parts = []


def label_of(tag: str, attributes: str) -> str:
    """tag#id.class@role; digits become N, and names that look random are left out, so that pages of one layout agree."""
    if not attributes:
        return tag
    got = {"id": "", "class": "", "role": ""}
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        got[name] = got[name] or "".join(values)
    plain = lambda s, mark: "".join(mark + re.sub(r"\d+", "N", w) for w in sorted(set(s.split()))[:6] if not (len(w) > 7 and re.search(r"\d.*\d.*\d", w)))
    return tag + plain(got["id"][:80], "#") + plain(got["class"][:200], ".") + plain(got["role"].lower()[:40], "@")


def parse(page: str) -> Element:
    """The body of a page; its head is an element of its own."""
    root = Element("body", "body")
    stack = [root]
    lost: dict[str, int] = {}  # open elements that lie too deep
    at, n = 0, len(page)

    def text(s: str) -> None:
        if s:
            stack[-1].parts.append((html.unescape(s), stack[-1].linked))

    def end(size: int) -> None:
        while len(stack) > size:
            stack.pop().flush()

    def last(tags: set, fence: set = frozenset()) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in fence:
                break
        return 0

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or tag in ("html", "body"):
            if tag == "body" and (k := last({"head"})):
                end(k)
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "br":
                stack[-1].parts.append((" ", False))
            elif tag == "a":
                stack[-1].linked = not closing
            elif closing:
                continue
            continue
        if closing:
            if lost.get(tag):
                lost[tag] -= 1
                stack[-1].flush()
            elif k := last({tag}):
                end(k)
            continue
        if tag not in HEAD and (k := last({"head"})):
            end(k)
        if tag in CLOSES_PARAGRAPH and (k := last({"p"}, {"button", "td", "th", "table", "caption"})):
            end(k)
        if tag in IMPLIED:
            ends, fence = IMPLIED[tag]
            while k := last(ends, fence):
                end(k)
        parent = stack[-1]
        parent.flush()
        element = Element(tag, label_of(tag, attributes), parent.linked)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
            parent.children.append(element)
        elif tag in VOID or attributes.endswith("/") and tag not in CLOSES_PARAGRAPH:
            continue
        elif len(stack) < DEEPEST:
            parent.children.append(element)
            stack.append(element)
        else:
            lost[tag] = lost.get(tag, 0) + 1
    end(0)
    return root


def runs(element: Element, dropped=lambda path: False, path: tuple = ()) -> Iterator[str]:
    """Text runs in page order, but for those in elements whose path (labels below element) is dropped."""
    for c in element.children:
        if isinstance(c, tuple):
            yield c[0]
        elif not dropped(here := (*path, c.label)):
            yield from runs(c, dropped, here)
