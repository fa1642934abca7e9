"""The content of a page as an array of blocks with spans, and its Markdown in expressions.

The page reader says what begins, what ends and what is said in between; ``BlockWriter`` notes from
that which blocks there are, what they stand in and how their text is formatted. Nothing of Markdown
is written there: escapes, delimiters, fences and line prefixes are expressions over the blocks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the output format.
BULLET = "- "
QUOTE = "> "
RULE = "* * *"
LIST_SEPARATOR = "<!--THE END-->"

BOLD = frozenset("b strong".split())
ITALIC = frozenset("em i".split())
CODE = frozenset("code kbd samp tt".split())
LEVEL = {f"h{n}": n for n in range(1, 7)}
# Fixed values of the HTML standard: elements that stand on lines of their own.
BLOCK = frozenset(
    """address article aside body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form header hgroup legend listing main menu nav p search section summary table tbody tfoot thead tr""".split()
)
UNSAID = frozenset("script style title".split())

# Runs that are not already one blank, so that ordinary text has no match at all.
SPACES = re.compile(r" [ \t\n\f\r]+|[\t\n\f\r][ \t\n\f\r]*")
LANGUAGE = re.compile(r"(?:^|\s)lang(?:uage)?-([^\s`]+)")

STRING, FLAG = T.StringType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SPAN = _struct(
    kind=STRING, text=STRING, bold=FLAG, italic=FLAG, code=FLAG, href=STRING, title=STRING, source=STRING, caption=STRING
)
"""A stretch of one format. Its kind is text, image (the text stands for it) or break."""
BLOCKS = T.ArrayType(
    _struct(kind=STRING, level=T.IntegerType(), lead=STRING, first=STRING, rest=STRING, language=STRING, spans=T.ArrayType(SPAN))
)
"""Paragraphs, headings, code and rules. ``first`` and ``rest`` precede their first and their other
lines, ``lead`` is what stands between a block and the one before it, if anything."""

PLAIN = (None, False, False, False)  # no link, not bold, not italic, not code


def shared(formats: list[tuple]) -> tuple:
    """The format around blanks between two texts: what all have in common, from the link inwards."""
    out = list(PLAIN)
    for depth in range(4):
        values = {f[depth] for f in formats}
        if len(values) > 1:
            break
        out[depth] = values.pop()
    return tuple(out)


class BlockWriter:
    def __init__(self):
        self.blocks: list[tuple] = []
        self.runs: list[tuple[str, str, tuple, str | None]] = []  # (kind, text, format, source and title of an image)
        self.links: list[tuple | None] = []
        self.open = dict.fromkeys((*BOLD, *ITALIC, *CODE), 0)
        self.frames: list[dict] = []  # open lists, items and quotes
        self.lists: list[int] = []  # which of the frames are lists
        self.settled = 0  # so many frames, the outer ones, have had a block
        self.heading = 0
        self.fence: list[str] | None = None
        self.language = ""
        self.last_list: dict | None = None
        self.list_ended = False

    # -- events ------------------------------------------------------------------

    def text(self, content: str) -> None:
        if self.fence is not None:
            self.fence.append(content)
        else:
            self.runs.append(("text", content, self.format(), None))

    def start(self, name: str, attrs: list[tuple[str, str]]) -> None:
        get = dict(reversed(attrs)).get
        if name in UNSAID:
            return
        if name == "br":
            self.text("\n") if self.fence is not None else self.runs.append(("break", "", self.format(), None))
        elif name == "img":
            if get("src"):
                alt = SPACES.sub(" ", get("alt") or "")
                self.runs.append(("image", alt, self.format(), (get("src"), get("title") or None)))
        elif name == "hr":
            self.flush()
            self.block("rule")
        elif name == "a":
            self.links.append((get("href"), get("title") or None) if get("href") else None)
        elif name in self.open:
            if self.fence is None:
                self.open[name] += 1
            elif name == "code" and not self.language:
                self.language = self.class_language(get("class"))
        elif name in LEVEL:
            self.flush()
            self.heading = LEVEL[name]
        elif name == "pre":
            self.flush()
            self.fence, self.language = [], self.class_language(get("class"))
        elif name in ("ul", "ol"):
            self.flush()
            first = get("start") or "1"
            number = int(first) if first.isascii() and first.isdigit() else 1
            self.lists.append(len(self.frames))
            self.push(name, "", "", number)
        elif name == "li":
            self.flush()
            marker = self.marker()
            self.push(name, marker, " " * len(marker))
        elif name == "blockquote":
            self.flush()
            self.push(name, QUOTE, QUOTE)
        elif name in BLOCK:
            self.flush()
        elif name in ("td", "th"):
            self.runs.append(("text", " ", PLAIN, None))

    def end(self, name: str) -> None:
        if name in UNSAID:
            return
        if name == "a":
            if self.links:
                self.links.pop()
        elif name in self.open:
            self.open[name] = max(0, self.open[name] - 1)
        elif name == "pre":
            self.end_fence()
        elif name in ("ul", "ol", "li", "blockquote"):
            self.flush()
            self.close(name)
        elif name in LEVEL or name in BLOCK:
            self.flush()

    def finish(self) -> list[tuple]:
        self.end_fence() if self.fence is not None else self.flush()
        return self.blocks

    # -- frames ------------------------------------------------------------------

    def push(self, kind: str, first: str, rest: str, number: int = 0) -> None:
        outer = self.frames[-1] if self.frames else None
        before = outer["rest"] if outer else ""
        self.frames.append({"kind": kind, "first": first, "rest": before + rest, "number": number, "parent": outer})

    def close(self, kind: str) -> None:
        at = next((i for i in range(len(self.frames) - 1, -1, -1) if self.frames[i]["kind"] == kind), None)
        if at is None:
            return
        del self.frames[at:]
        self.settled = min(self.settled, at)
        while self.lists and self.lists[-1] >= at:
            self.lists.pop()
        if kind in ("ul", "ol") and not self.lists:
            self.list_ended = True

    def marker(self) -> str:
        owner = self.frames[self.lists[-1]] if self.lists else None
        if owner is None or owner["kind"] == "ul":
            return BULLET
        owner["number"] += 1
        return f"{owner['number'] - 1}. "

    # -- blocks ------------------------------------------------------------------

    @staticmethod
    def class_language(classes: str | None) -> str:
        m = LANGUAGE.search(classes or "")
        return m.group(1) if m else ""

    def format(self) -> tuple:
        """(link, bold, italic, code) in force."""
        n = self.open
        link = self.links[-1] if self.links else None
        return link, n["b"] + n["strong"] > 0, n["em"] + n["i"] > 0, n["code"] + n["kbd"] + n["samp"] + n["tt"] > 0

    def flush(self) -> None:
        runs, self.runs = self.runs, []
        level, self.heading = self.heading, 0
        spans = self.spans(self.squeezed(runs)) if runs else []
        if spans:
            self.block("heading" if level else "text", level, spans)

    @staticmethod
    def squeezed(runs: list[tuple]) -> list[tuple]:
        """Texts and blanks, each by itself. Blanks collapse, also across runs; those beside a break or at an edge go."""
        out: list[tuple] = []
        for kind, text, fmt, image in runs:
            if kind != "text":
                if kind == "break" and out and out[-1][0] == "blank":
                    out.pop()
                out.append((kind, text, fmt if kind == "break" else (*fmt[:3], False), image))
                continue
            text = SPACES.sub(" ", text)
            core = text.strip(" ")
            if text[:1] == " " and out and out[-1][0] not in ("blank", "break"):
                out.append(("blank", " ", fmt, None))
            if core:
                out.append(("text", core, fmt, None))
                if text[-1] == " ":
                    out.append(("blank", " ", fmt, None))
        while out and out[-1][0] in ("blank", "break"):
            out.pop()
        start = next((i for i, run in enumerate(out) if run[0] not in ("blank", "break")), 0)
        return out[start:]

    @staticmethod
    def spans(runs: list[tuple]) -> list[tuple]:
        """One span for each stretch of one format. Blanks and breaks belong to a format only if it goes on behind them."""
        out: list[tuple] = []

        def add(kind: str, text: str, fmt: tuple, image: tuple | None = None) -> None:
            if kind == "text" and out and out[-1][0] == "text" and out[-1][2] == fmt:
                text = out.pop()[1] + text
            out.append((kind, text, fmt, image))

        between: list[tuple] = []
        last = PLAIN
        for kind, text, fmt, image in runs:
            if kind in ("blank", "break"):
                between.append((kind, text, fmt))
                continue
            if between:
                common = shared([last, *[b[2] for b in between], fmt])
                for gap, _, _ in between:
                    as_text = gap == "blank" or common[3]
                    add("text" if as_text else "break", " " if as_text else "", common)
                between = []
            add(kind, text, fmt, image)
            last = fmt
        return out

    def end_fence(self) -> None:
        if self.fence is None:
            return
        body = "".join(self.fence)
        body = body[1:] if body.startswith("\n") else body
        self.fence = None
        if body.strip():
            self.block("code", spans=[("text", body.rstrip("\n"), (None, False, False, True), None)])

    def block(self, kind: str, level: int = 0, spans: list[tuple] = ()) -> None:
        fresh = self.frames[self.settled :]
        outer = self.frames[self.settled - 1]["rest"] if self.settled else ""
        first = outer + "".join(f["first"] for f in fresh)
        rest = self.frames[-1]["rest"] if self.frames else ""
        owner = self.frames[self.lists[0]] if self.lists else None
        lead, previous = None, self.last_list
        if self.blocks:
            # What a blank line needs to stay within the quotes that go on from the last block.
            blank = outer.rstrip()
            if self.list_ended and owner and previous and owner is not previous and owner["parent"] is previous["parent"]:
                lead = f"{blank}\n{outer}{LIST_SEPARATOR}\n{blank}"
            elif owner is not previous or not any(f["kind"] == "li" for f in fresh):
                lead = blank
        shown = [(what, text, *fmt[1:], *(fmt[0] or (None, None)), *(image or (None, None))) for what, text, fmt, image in spans]
        self.blocks.append((kind, level, lead, first, rest, self.language if kind == "code" else "", shown))
        self.settled = len(self.frames)
        self.last_list, self.list_ended = owner, False


# -- Markdown (CommonMark) -----------------------------------------------------------


def _escaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"([\\`*_\[\]<])", r"\\$1")
    return F.regexp_replace(text, r"&(#?\w+;)", r"\\&$1")


def _destination(href: Column) -> Column:
    blank = r"[\s\p{IsWhite_Space}\x1c-\x1f]"
    angled = F.regexp_replace(F.regexp_replace(F.regexp_replace(href, blank, " "), "<", "%3C"), ">", "%3E")
    return F.when(href.rlike(r"[\s\p{IsWhite_Space}\x1c-\x1f()<>]"), F.concat(F.lit("<"), angled, F.lit(">"))).otherwise(href)


def _titled(href: Column, title: Column) -> Column:
    """The part of a link or image in round brackets."""
    note = F.concat(F.lit(' "'), F.regexp_replace(title, '"', r"\\\""), F.lit('"'))
    return F.concat(F.lit("("), _destination(href), F.coalesce(note, F.lit("")), F.lit(")"))


def _longest_ticks(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), lambda t: F.length(t))), F.lit(0))


def _code(text: Column) -> Column:
    ticks = F.repeat(F.lit("`"), _longest_ticks(text) + 1)
    pad = F.when(text.startswith("`") | text.endswith("`"), " ").otherwise("")
    return F.concat(ticks, pad, text, pad, ticks)


def _delimiters(span: Column, beside: Column) -> tuple[Column, Column, Column]:
    """Whether link, bold and italic of a span begin or end where it meets ``beside``."""
    linked = beside["kind"].isNotNull() & span["href"].eqNullSafe(beside["href"]) & span["title"].eqNullSafe(beside["title"])
    bold = linked & span["bold"].eqNullSafe(beside["bold"])
    italic = bold & span["italic"].eqNullSafe(beside["italic"])
    return span["href"].isNotNull() & ~linked, span["bold"] & ~bold, span["italic"] & ~italic


def _if(condition: Column, said: Column | str) -> Column:
    return F.when(condition, said).otherwise("")


def _inline(block: Column) -> Column:
    """The spans with delimiters nested link > strong > emphasis > code, so that they always balance."""

    def shown(span: Column, i: Column) -> Column:
        link, bold, italic = _delimiters(span, F.get(block["spans"], i - 1))
        link_end, bold_end, italic_end = _delimiters(span, F.get(block["spans"], i + 1))
        image = F.concat(F.lit("!["), _escaped(span["text"]), F.lit("]"), _titled(span["source"], span["caption"]))
        text = (
            F.when(span["kind"] == "break", F.when(block["kind"] == "heading", " ").otherwise("  \n"))
            .when(span["kind"] == "image", image).when(span["code"], _code(span["text"])).otherwise(_escaped(span["text"]))
        )
        target = F.concat(F.lit("]"), _titled(span["href"], span["title"]))
        return F.concat(_if(link, "["), _if(bold, "**"), _if(italic, "*"), text, _if(italic_end, "*"), _if(bold_end, "**"), _if(link_end, target))

    return F.array_join(F.transform(block["spans"], shown), "")


def _unmarked(body: Column) -> Column:
    """Keep a line from starting a heading, list, quote, fence or underline."""
    body = F.regexp_replace(body, r"(?dm)^([#>+~=-])", r"\\$1")
    return F.regexp_replace(body, r"(?dm)^([0-9]+)([.)])", r"$1\\$2")


def _block(block: Column) -> Column:
    text = F.get(block["spans"], F.lit(0))["text"]
    fence = F.repeat(F.lit("`"), F.greatest(_longest_ticks(text) + 1, F.lit(3)))
    body = (
        F.when(block["kind"] == "heading", F.concat(F.repeat(F.lit("#"), block["level"]), F.lit(" "), _inline(block)))
        .when(block["kind"] == "code", F.concat(fence, block["language"], F.lit("\n"), text, F.lit("\n"), fence))
        .when(block["kind"] == "rule", RULE)
        .otherwise(_unmarked(_inline(block)))
    )

    def prefixed(line: Column, i: Column) -> Column:
        return F.when(i == 0, F.concat(block["first"], line)).when(line == "", F.rtrim(block["rest"])).otherwise(F.concat(block["rest"], line))

    lines = F.array_join(F.transform(F.split(body, "\n"), prefixed), "\n")
    return F.concat(F.coalesce(F.concat(block["lead"], F.lit("\n")), F.lit("")), lines)


def markdown(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, _block), "\n")
