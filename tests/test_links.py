import random

from pyspark.sql import functions as F

from lorebase.functions import links, urls
from lorebase.operators import extract


def references(seed, n):
    rng = random.Random(seed)
    bits = ["a", "b.html", "..", ".", "/", "/", "?", "#", ":", "//", "x=1", "&", "%20", "%zz", "é", " ", "@", "[", "h", "http:", "HTTPS:", "mailto:", ":8", "~", "!$'()*+,;=", "\n", "\\"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(8))) for _ in range(n)] + [
        "/a/../../b", "a/./b/..", "../../..", "..", ".", "/.", "/..", "a//b/../c", "//h/..", "//h", "//", "#", "?", "?#", "http://h", "http:///x", "HTTP://H:80/?a#b", "a\n",
        "http:/x", "http:x", ":x", "x:y", "./x:y", "javascript:void(0)", "http://u@h/", "http://h:/p", "http://[::1]/p", "?a b=é%", "a?b\x01", "#a#b", "#%41", "#é",
    ]


BASES = ["http://h", "http://h/", "https://h:8/a/b.html?q#f", "http://h/a/b/", "ftp://h/a/../b", "http://h?q", "HTTP://h/%41/", "http://h/é", "relative/x", "mailto:x", None]


def test_locate_equals_python(spark):
    rows = [(u,) for u in [*references(1, 300), *BASES]]
    got = extract.locate(spark.createDataFrame(rows, "url string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = urls.describe(urls.parse(r.url)) if r.url is not None else (None,) * 4
        at = tuple(r["_at"]) if r["_at"] is not None else (None,) * 4
        assert at == want, r.url


def test_resolution_equals_python(spark):
    rows = [(b, s, h) for h in [*references(2, 250), None] for b in BASES for s in ("http://h/", "https://h:8/", b)]
    edges = spark.createDataFrame(rows, "base_url string, page string, href string")
    got = {(r.base_url, r.page, r.href): tuple(r["_to"]) for r in extract.resolve_links(edges, "base_url", "page").collect()}
    want = {}
    for site, against, href in rows:
        home, base, ref = (urls.parse(x) if x is not None else None for x in (site, against, href))
        target = urls.resolve(base, ref) if home and base and ref else None
        if target and urls.host_of(target) == urls.host_of(home) != "":
            want[site, against, href] = (*urls.describe(target), True)
    assert got == want


def test_usual_references_need_no_python(spark):
    shown = ["", "x", "../x/y.html", "?a=b%20c&d", "#top", "/abs/path;v=1", "//h/p", "http://h:8080/p?q#f", "x/a:b"]
    odd = ["%41", "a b", "é", "x:y", "//", "http://u@h/", "a\n", "mailto:x"]
    df = spark.createDataFrame([(s,) for s in shown + odd], "href string")
    got = {r.href for r in df.filter(links.usual_reference(F.col("href"))).collect()}
    assert got == set(shown)
    edges = spark.createDataFrame([("http://h/", "mailto:x")], "base_url string, href string")
    plan = extract.resolve_links(edges)._jdf.queryExecution().executedPlan().toString()
    usual, rest = plan.split("ArrowEvalPython")
    assert "RLIKE" in rest and "RLIKE" in usual  # a branch each
