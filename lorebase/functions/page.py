"""One pass over the text of a page: title, description, links, main text, blocks.

No tree is built. The reader keeps the names of the open elements, which is enough to know
where the main content ends, and the formatting in force, which as in browsers outlives an
enclosing paragraph until its own end tag.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from lorebase.functions.blocks import BlockWriter

# Fixed values of the HTML standard: element categories.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
ESCAPABLE = frozenset("textarea title".split())
HEAD_ONLY = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = HEADINGS | frozenset(
    """address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure
    footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul
    xmp""".split()
)
TABLE_PARTS = frozenset("caption colgroup tbody td tfoot th thead tr".split())
BOUNDARY = frozenset("applet caption html marquee object table td template th".split())
SPECIAL = ENDS_PARAGRAPH | TABLE_PARTS | BOUNDARY | frozenset("body button head select title".split())
# An element of the first kind ends open elements of the second, up to an element of the third.
IMPLIED_ENDS = {
    "li": ({"li"}, SPECIAL - {"address", "div", "p", "li"}),
    "dd": ({"dd", "dt"}, SPECIAL - {"address", "div", "p", "dd", "dt"}),
    "dt": ({"dd", "dt"}, SPECIAL - {"address", "div", "p", "dd", "dt"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}

SPACE = " \t\n\f\r"
ATTRIBUTE = re.compile(
    r"""[\s/]*+(?P<name>=?[^\s/>=]++|=)
        (?:\s*+=\s*+(?:"(?P<dq>[^"]*+)(?:"|\Z)|'(?P<sq>[^']*+)(?:'|\Z)|(?P<bare>[^\s>"'][^\s>]*+)|(?=>)))?+""",
    re.X,
)
TAG = re.compile(
    r"""<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)
        (?P<attrs>(?:[\s/]++|(?:=?[^\s/>=]++|=)
        (?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)))?+)*+)>""",
    re.X,
)
COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
BOGUS = re.compile(r"<(?:[!?]|/[^A-Za-z])[^>]*+>?")
MARKUP = re.compile(r"<(?=[A-Za-z!?/])")
REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9])))")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW_TEXT}
SPACES = re.compile(f" [{SPACE}]+|[{SPACE[1:]}][{SPACE}]*")  # not one blank already


def attribute_value(raw: str) -> str:
    """Decode references; in attributes an unterminated name before '=' or a letter stays as it is."""
    return REFERENCE.sub(lambda m: unescape(m.group()), raw) if "&" in raw else raw


def attributes(raw: str) -> list[tuple[str, str]]:
    out = []
    for m in ATTRIBUTE.finditer(raw):
        value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), "")
        out.append((m["name"].lower(), attribute_value(value)))
    return out


def collapse(text: str) -> str:
    return SPACES.sub(" ", text).strip(SPACE)


class PageReader:
    def __init__(self):
        self.title = ""
        self.description = ""
        self.hrefs: list[str] = []
        self.in_body = False
        self.open: list[str] = []
        self.how_often: Counter[str] = Counter()  # names in ``open``, so that an absent one is not searched for
        self.texts: list[str] = []
        self.main_from: int | None = None
        self.main_to: int | None = None
        self.main_depth = -1
        self.writer = BlockWriter()

    # -- results -----------------------------------------------------------------

    def main_text(self) -> str:
        if self.main_from is None:
            return collapse("".join(self.texts))
        return collapse("".join(self.texts[self.main_from : self.main_to]))

    def blocks(self) -> list[tuple]:
        return self.writer.finish()

    # -- scanning ----------------------------------------------------------------

    def read(self, html: str) -> PageReader:
        html = html.replace("\r\n", "\n").replace("\r", "\n")
        at, size = 0, len(html)
        while at < size:
            found = MARKUP.search(html, at)
            if found is None:
                self.text(unescape(html[at:]))
                break
            start = found.start()
            if start > at:
                self.text(unescape(html[at:start]))
            tag = TAG.match(html, start)
            if tag:
                at = self.tag(html, tag)
            elif html[start + 1] in "!?/" and not html[start + 2 : start + 3].isalpha():
                comment = COMMENT.match(html, start) or BOGUS.match(html, start)
                at = comment.end() if comment else start + 2
                self.texts.append(" ")
            elif html.startswith("<!", start):
                at = BOGUS.match(html, start).end()
            else:
                break  # The page ends inside a tag.
        return self

    def tag(self, html: str, tag: re.Match) -> int:
        name = tag["name"].lower()
        if tag["end"]:
            self.end(name)
            return tag.end()
        attrs = attributes(tag["attrs"]) if tag["attrs"] else []
        self.start(name, attrs, tag["attrs"].endswith("/"))
        if name == "plaintext":
            self.text(html[tag.end() :])
            return len(html)
        if name not in RAW_TEXT:
            return tag.end()
        close = RAW_END[name].search(html, tag.end())
        stop = close.start() if close else len(html)
        self.raw(name, html[tag.end() : stop])
        self.end(name)
        finish = html.find(">", stop)
        return finish + 1 if finish >= 0 else len(html)

    # -- content -----------------------------------------------------------------

    def raw(self, name: str, content: str) -> None:
        if name in ESCAPABLE:
            content = unescape(content)
        if name == "title" and not self.title:
            self.title = content
        if name in ("script", "style") or not self.in_body:
            return
        self.texts.append(content)

    def text(self, content: str) -> None:
        if not self.in_body:
            if not content.strip(SPACE):
                return
            self.in_body = True
        self.texts.append(content)
        self.writer.text(content)

    def start(self, name: str, attrs: list[tuple[str, str]], self_closing: bool) -> None:
        if name == "meta" and not self.description:
            names = {k: v for k, v in attrs}
            if ("name", "description") in attrs and "content" in names:
                self.description = names["content"]
        if name in ("html", "head"):
            return
        if name not in HEAD_ONLY:
            self.in_body = True
        ids = any(k == "id" and v in ("content", "main") for k, v in attrs)
        if name == "body":
            if ids and self.main_from is None:
                self.main_from, self.main_to = 0, None
            return
        self.imply_ends(name)
        if name == "a":
            self.hrefs.extend(v for k, v in attrs if k == "href")
            if self.how_often["a"]:
                self.end("a")
        self.texts.append(" ")
        empty = name in VOID or (self_closing and (self.how_often["svg"] or self.how_often["math"]))
        if self.in_body and self.main_from is None and (ids or name in ("main", "article")):
            self.main_from = len(self.texts)
            if empty:
                self.main_to = self.main_from
            else:
                self.main_depth = len(self.open)
        if not empty:
            self.open.append(name)
            self.how_often[name] += 1
        if self.in_body:
            self.writer.start(name, attrs)

    def end(self, name: str) -> None:
        if name in ("html", "head", "body"):
            return
        if name == "br":
            self.start("br", [], False)
            return
        names = HEADINGS if name in HEADINGS else (name,)
        limit = BOUNDARY if name in ENDS_PARAGRAPH else () if name in TABLE_PARTS | BOUNDARY else SPECIAL
        if name in FORMATTING:
            self.end_formatting(name)
            return
        if not any(self.how_often[n] for n in names):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth] in names:
                self.pop_to(depth)
                return
            if self.open[depth] in limit:
                return

    def end_formatting(self, name: str) -> None:
        """A formatting element ends on its own, leaving the blocks opened inside it open."""
        if not self.how_often[name]:
            self.writer.end(name)
            return
        depth = len(self.open) - 1 - self.open[::-1].index(name)
        if any(n in SPECIAL for n in self.open[depth + 1 :]):
            self.texts.append(" ")
            self.close_main(depth, depth + 1)
            del self.open[depth]
            self.how_often[name] -= 1
            if depth < self.main_depth:
                self.main_depth -= 1
            self.writer.end(name)
        else:
            self.pop_to(depth)

    def imply_ends(self, name: str) -> None:
        if name in ENDS_PARAGRAPH:
            self.pop_nearest({"p"}, BOUNDARY | {"button"})
        if name in HEADINGS and self.open and self.open[-1] in HEADINGS:
            self.pop_to(len(self.open) - 1)
        if name in IMPLIED_ENDS:
            self.pop_nearest(*IMPLIED_ENDS[name])

    def pop_nearest(self, names, limit) -> None:
        if not any(self.how_often[n] for n in names):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth] in names:
                self.pop_to(depth)
                return
            if self.open[depth] in limit:
                return

    def pop_to(self, depth: int) -> None:
        self.texts.append(" ")
        self.close_main(depth, len(self.open))
        last = len(self.open) - 1
        for i in range(last, depth - 1, -1):
            name = self.open.pop()
            self.how_often[name] -= 1
            # Formatting cut off by its block's end stays in force; only its own end tag, the
            # one that asked for this pop, switches it off.
            if name not in FORMATTING or i == depth:
                self.writer.end(name)

    def close_main(self, first: int, stop: int) -> None:
        if first <= self.main_depth < stop:
            self.main_to = len(self.texts)
            self.main_depth = -1
