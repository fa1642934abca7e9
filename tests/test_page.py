import random
import time

import pytest

from lorebase.functions.page import PageReader
from lorebase.operators.extract import parse_pages


def read(html):
    return PageReader().read(html)


@pytest.mark.parametrize(
    "html, title",
    [
        ("<p>none", ""),
        ("<title></title><title>later</title>", "later"),
        ("<title>a &amp; b &eacute;</title>", "a & b é"),
        ("<title> spaced </title>", " spaced "),
        ("<svg><title>in svg</title></svg>", "in svg"),
        ("<title>one</title><title>two</title>", "one"),
        ("<title>a <b>not markup</b></title>", "a <b>not markup</b>"),
        ("<TITLE>upper</TITLE>", "upper"),
        ("<!-- <title>no</title> --><title>yes</title>", "yes"),
        ("<script>'<title>no</title>'</script><title>yes</title>", "yes"),
    ],
)
def test_title(html, title):
    assert read(html).title == title


@pytest.mark.parametrize(
    "html, description",
    [
        ('<meta name="Description" content="x">', ""),
        ('<meta name="description" content=""><meta name="description" content="second">', "second"),
        ('<meta content="before" name="description">', "before"),
        ('<meta name="description">', ""),
        ("<meta name=description content='a &lt; b'>", "a < b"),
        ('<body><p><meta name="description" content="in body">', "in body"),
    ],
)
def test_description(html, description):
    assert read(html).description == description


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><p>out<main>in</main>out", "in"),
        ("<article>first</article><main>second</main>", "first"),
        ('<div id="content">x<p>y</div>z', "x y"),
        ("<div id=main>x</div>", "x"),
        ("<p id=other>x</p>y", "x y"),
        ("<head><title>t</title></head><body>b<script>s</script><style>c</style>d</body>", "b d"),
        ("<main>a<article>b</article>c</main>d", "a b c"),
        ("<main>a<b>b</b>c</main>", "a b c"),
        ("<main>a  \n\t b</main>", "a b"),
        ("<main><p><b>open<p>next</main>after", "open next"),
        ("<main>a</x>b</main>", "ab"),
        ("<main>a<!-- c -->b</main>", "a b"),
        ("<img id=content>text", ""),
        ("<b><main>x</b>y</main>z", "x y"),
        ("", ""),
    ],
)
def test_main_text(html, text):
    assert read(html).main_text() == text


def test_links_in_document_order():
    html = """<a href="/1">x</a><A HREF='/2'>y</A><a name=n>no</a><a href=/3?a=1&amp;b=2>z</a>
    <script>'<a href="/no">'</script><a href="">e</a><link href="/no"><!-- <a href="/no"> --><a href="/4" href="/5">"""
    assert read(html).hrefs == ["/1", "/2", "/3?a=1&b=2", "", "/4", "/5"]


def test_attribute_references_without_semicolon():
    assert read('<a href="/?a=1&copy=2&lt;&amp">').hrefs == ["/?a=1&copy=2<&"]


@pytest.mark.parametrize(
    "html",
    ["<p title='open", "<", "<a href=", "</", "<!--", "<!doctype", "<p <p <p", "a < b", "<title>open", "<script>x", "<a" * 5000],
)
def test_broken_pages_are_read(html):
    read(html).blocks()


MARKDOWN = (
    [
        ("<h1>A</h1><h3>B</h3><p>c", "# A\n\n### B\n\nc"),
        ("<p>a <b>b</b> <i>c</i> <strong><em>d</em></strong>", "a **b** *c* ***d***"),
        ("<p>a<b> b </b>c", "a **b** c"),
        ("<p><a href='/x' title='T'>l</a> <a href='/a b'>m</a> <a>n</a>", '[l](/x "T") [m](</a b>) n'),
        ("<p><a href='/x'><b>l</b></a>", "[**l**](/x)"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
        ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<ul><li><p>a<p>b</ul>", "- a\n\n  b"),
        ("<ul><li>a</ul><ul><li>b</ul>", "- a\n\n<!--THE END-->\n\n- b"),
        ("<blockquote><p>a<p>b</blockquote>c", "> a\n>\n> b\n\nc"),
        ("<pre><code class='language-go'>x\n  y\n</code></pre>", "```go\nx\n  y\n```"),
        ("<pre>\na ``` b</pre>", "````\na ``` b\n````"),
        ("<p>a<code>b`c</code>", "a``b`c``"),
        ("<p>a<br>b<br></p>", "a  \nb"),
        ("<h2>a<br>b</h2>", "## a b"),
        ("<p>a<hr>b", "a\n\n* * *\n\nb"),
        ("<img src=/i.png alt='x y'>", "![x y](/i.png)"),
        ("<p>*a* _b_ [c] `d` \\ &lt;e>", "\\*a\\* \\_b\\_ \\[c\\] \\`d\\` \\\\ \\<e>"),
        ("<p># a<p>- b<p>1. c<p>+ d<p>&gt; e", "\\# a\n\n\\- b\n\n1\\. c\n\n\\+ d\n\n\\> e"),
        ("<p>&amp;copy; x &amp; y", "\\&copy; x & y"),
        ("<p><b>a<p>b</b> c", "**a**\n\n**b** c"),
        ("<p>x<script>s</script><style>t</style>y<title>z</title>", "xy"),
        ("<head><title>t</title></head>", ""),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
        ("<p>a\x00b", "a\x00b"),
        ("<p><b>a <br> b</b> c<br><br>d", "**a  \nb** c  \n  \nd"),
        ("<p><b>a</b> <b>b</b> <b>c </b><i>d</i>", "**a** **b** **c** *d*"),
        ("<p><a href=/x>a</a><a href=/x>b</a> <a href=/y>c<img src=/z alt='*'></a>", "[ab](/x) [c![\\*](/z)](/y)"),
        ("<p><b><i>a</i></b><i>b</i>", "***a****b*"),
        ("<p><code>a <br>b</code> <code> ` </code>", "`a b` `` ` ``"),
        ("<p><b> </b>a<b><br></b>b", "a  \nb"),
        ("<p>a<br># b<br>2) c", "a  \n\\# b  \n2\\) c"),
        ("<ul><li><ul><li>a<li>b</ul><li>c</ul>", "- - a\n  - b\n- c"),
        ("<ul><li><blockquote>a<p>b<pre>c\n\nd</pre></blockquote></ul>", "- > a\n  >\n  > b\n  >\n  > ```\n  > c\n  >\n  > d\n  > ```"),
        ("<blockquote><ul><li>a</ul></blockquote><blockquote>b</blockquote>", "> - a\n\n> b"),
        ("<blockquote><ul><li>a</ul><ul><li>b</ul></blockquote>", "> - a\n>\n> <!--THE END-->\n>\n> - b"),
        ("<a href='/a(b)'>l</a>\u2003x", "[l](</a(b)>)\u2003x"),
        ("<a href='/x' title='say \"a\"'>l</a>", '[l](/x "say \\"a\\"")'),
    ]
)


def test_markdown(spark):
    pages = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(MARKDOWN)], "i int, html string")
    got = {r["i"]: r["markdown"] for r in parse_pages(pages).collect()}
    for i, (html, want) in enumerate(MARKDOWN):
        assert got[i] == want, html


def visible(blocks) -> str:
    return "".join(s[1] for b in blocks for s in b[6] if s[0] == "text")


def test_blocks_keep_the_text():
    """Whatever the tags, the spans hold the page's words in order, and none begins or ends a format with a blank."""
    rng = random.Random(4)
    tags = ["b", "i", "a", "code", "p", "li", "ul", "div", "blockquote", "h2", "em", "td", "br"]
    for _ in range(400):
        html, words = "<p>", []
        for k in range(rng.randrange(30)):
            tag = rng.choice(tags)
            html += rng.choice([f"<{tag} href=/{k % 3}>", f"</{tag}>", " ", f"w{k}", f" w{k} "])
            words += [f"w{k}"] if html.rstrip().endswith(f"w{k}") else []
        blocks = read(html).blocks()
        assert visible(blocks).replace(" ", "") == "".join(words), html
        for block in blocks:
            spans = block[6]
            for before, span in zip([None, *spans], spans):
                if before and span[0] == before[0] == "text":
                    assert before[2:] != span[2:], html
                for fields in ((5, 6), (5, 6, 2), (5, 6, 2, 3), (5, 6, 2, 3, 4)):
                    begins = span[fields[-1]] or (fields == (5, 6) and span[5])
                    if begins and (before is None or any(before[f] != span[f] for f in fields)):
                        assert not (span[0] == "text" and span[1].startswith(" ")), html


def test_deep_lists_take_linear_time():
    def seconds(n):
        deep = "<ul><li>" * n + "x" + "</ul>" * n
        times = []
        for _ in range(3):
            start = time.process_time()
            blocks = read(deep).blocks()
            times.append(time.process_time() - start)
        assert len(blocks) == 1 and blocks[0][3] == "- " * n
        return min(times)

    assert seconds(4000) < 8 * seconds(1000)


def test_markdown_is_written_outside_of_python(spark):
    pages = spark.createDataFrame([("u", "<p>a <b>b</b>")], "url string, html string")
    plan = parse_pages(pages).select("markdown")._jdf.queryExecution().executedPlan().toString()
    assert "array_join" in plan and "blocks" in plan
