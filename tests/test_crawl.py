import random

import pytest
from pyspark.sql import functions as F

from lorebase.operators import crawl, extract
from lorebase.plans import ingest

INDEX = "key string, page_url string, hrefs array<string>, error string"


def index_of(spark, pages):
    return spark.createDataFrame([(u, u, links, None) for u, links in pages.items()], INDEX)


def run(spark, pages, base, **kw):
    seeds = spark.createDataFrame([(base,)], "base_url string")
    return {r.url: r.depth for r in crawl.crawl(index_of(spark, pages), seeds, **kw).collect()}


def test_least_depth_counts(spark):
    pages = {"http://h/": ["/b", "/c"], "http://h/b": ["/c"], "http://h/c": ["/d"], "http://h/d": ["/e"]}
    assert run(spark, pages, "http://h/", max_depth=2) == {"http://h/": 0, "http://h/b": 1, "http://h/c": 1, "http://h/d": 2}
    assert run(spark, pages, "http://h/", max_depth=0) == {"http://h/": 0}


def test_links_resolve_against_the_base_or_the_page(spark):
    pages = {"https://h/docs/": ["x/"], "https://h/docs/x/": ["y"], "https://h/docs/y": [], "https://h/docs/x/y": []}
    assert set(run(spark, pages, "https://h/docs/")) == {"https://h/docs/", "https://h/docs/x/", "https://h/docs/y"}
    by_page = run(spark, pages, "https://h/docs/", resolve="page")
    assert set(by_page) == {"https://h/docs/", "https://h/docs/x/", "https://h/docs/x/y"}


def test_only_the_host_of_the_base(spark):
    hrefs = ["mailto:a@h", "javascript:x", "http://h:81/p", "//other/p", "https://h/s", "", "%zz"]
    pages = {"http://h/": hrefs, "http://h:81/p": [], "http://other/p": [], "https://h/s": []}
    assert run(spark, pages, "http://h/") == {"http://h/": 0, "https://h/s": 1}


def test_variants_of_one_path(spark):
    pages = {"http://h/": ["/a", "/a?p=1", "/a#t"], "http://h/a": [], "http://h/a?p=1": []}
    seeds = spark.createDataFrame([("http://h/",)], "base_url string")
    reached = crawl.crawl(index_of(spark, pages), seeds)
    assert reached.count() == 4
    assert {r.path for r in crawl.crawl_paths(reached).collect()} == {"/", "/a"}
    last = {r.path: r.url for r in crawl.last_page_per_path(reached).collect()}
    assert last == {"/": "http://h/", "/a": "http://h/a?p=1"}


def test_base_without_path_and_missing_base(spark):
    assert run(spark, {"http://h/": ["/a"], "http://h/a": []}, "http://h") == {"http://h": 0, "http://h/a": 1}
    assert run(spark, {"http://h/a": []}, "http://h/") == {}


def test_links_of_a_failed_page_are_not_followed(spark):
    rows = [("http://h/", "http://h/", ["/a"], None), ("http://h/a", "http://h/a", ["/b"], "bad"), ("http://h/b", "http://h/b", [], None)]
    seeds = spark.createDataFrame([("http://h/",)], "base_url string")
    got = crawl.crawl(spark.createDataFrame(rows, INDEX), seeds).collect()
    assert {r.url for r in got} == {"http://h/", "http://h/a"}


def depth_first(pages, base, max_depth):
    """The sequential crawl, as a model."""
    visited, paths = set(), set()

    def go(url, depth):
        if depth > max_depth or url in visited:
            return
        visited.add(url)
        if url not in pages:
            return
        paths.add(url)
        for href in pages[url]:
            go(base.rstrip("/") + href, depth + 1)

    go(base, 0)
    return paths


def breadth_first(pages, base, max_depth):
    depth, level = {base: 0}, [base]
    for d in range(1, max_depth + 1):
        level = [base.rstrip("/") + h for u in level for h in pages[u]]
        level = [u for u in dict.fromkeys(level) if u in pages and u not in depth]
        depth.update((u, d) for u in level)
    return depth


def test_random_sites_against_models(spark):
    rng = random.Random(5)
    sites, pages = {}, {}
    for s in range(60):
        n = rng.randint(1, 9)
        own = {
            f"http://s{s}.x/{i if i else ''}": [f"/{rng.choice([*range(1, n + 2)])}" for _ in range(rng.randint(0, 3))]
            for i in range(n)
        }
        sites[f"http://s{s}.x/"] = own
        pages |= own
    seeds = spark.createDataFrame([(b,) for b in sites], "base_url string")
    got = {}
    for r in crawl.crawl(index_of(spark, pages), seeds, 3).collect():
        got.setdefault(r.base_url, {})[r.url] = r.depth
    for base, own in sites.items():
        assert got[base] == breadth_first(own, base, 3)
        assert set(got[base]) >= depth_first(own, base, 3)


def test_many_seeds_share_pages(spark):
    pages = {"http://h/": ["/a", "/b"], "http://h/a": ["/"], "http://h/b": ["/a"]}
    seeds = spark.createDataFrame([("http://h/",), ("http://h/a",), ("http://h/b",), ("http://h/",)], "base_url string")
    got = crawl.crawl(index_of(spark, pages), seeds).groupBy("base_url").count().collect()
    assert {r.base_url: r["count"] for r in got} == {"http://h/": 3, "http://h/a": 3, "http://h/b": 3}


SITE = [
    ("http://h/", "<title>Home</title><meta name=description content=Base><a href='/a'>a</a><a href='/e'>e</a>"),
    ("http://h/a", "<title>A</title><h1>A page</h1><a href='/a?v=2'>v</a>"),
    ("http://h/a?v=2", "<title>A2</title><h1>A two</h1>"),
    ("http://h/e", "<title>Empty</title>"),
    ("http://h/unlinked", "<p>never reached"),
    ("http://other/", "<p>other host"),
]


def site(spark):
    return spark.createDataFrame(SITE, "url string, html string"), spark.createDataFrame([("http://h/",)], "base_url string")


def test_ingest_site(spark):
    pages, seeds = site(spark)
    done = ingest.ingest_site(pages, seeds, "docs")
    docs = {r.url: r for r in done.documents.collect()}
    assert set(docs) == {"http://h//", "http://h//a"}
    page = docs["http://h//a"]
    assert (page.title, page.description, page.content, page.context) == ("Home", "Base", "# A two", "docs")
    assert page.source_type == "web_scrape" and len(page.embeddings) == 64
    assert [(r.url, r.error) for r in done.rejects.collect()] == [("http://h//e", "the embedder gave no vector")]


def test_ingest_site_per_page_and_unchanged(spark):
    pages, seeds = site(spark)
    first = ingest.ingest_site(pages, seeds, "docs", per_page=True, url_mode="page")
    docs = {r.url: r.title for r in first.documents.collect()}
    assert docs == {"http://h/": "Home", "http://h/a?v=2": "A2"}
    changed = pages.withColumn("html", F.when(F.col("url") == "http://h/a?v=2", "<h1>new</h1>").otherwise(F.col("html")))
    again = ingest.ingest_site(changed, seeds, "docs", url_mode="page", skip_unchanged=first.documents)
    assert [r.content for r in again.documents.collect()] == ["# new"]


def test_invalid_captures_are_skipped(spark):
    rows = [
        ("http://h/", "<a href=/a>a</a><a href=/b>b</a><a href=/c>c</a>", 200, "text/html; charset=utf-8"),
        ("http://h/a", "<p>a", 404, "text/html"),
        ("http://h/b", "{}", 200, "application/json"),
        ("http://h/c", "<p>c", 200, "text/html"),
    ]
    pages = spark.createDataFrame(rows, "url string, html string, status int, content_type string")
    seeds = spark.createDataFrame([("http://h/",)], "base_url string")
    winners, _ = ingest.crawl_site(pages, seeds)
    assert {r.path for r in winners.collect()} == {"/", "/c"}


def test_null_html_is_an_error_row(spark):
    parsed = extract.parse_pages(spark.createDataFrame([("u", None), ("v", "<p>x")], "url string, html string")).collect()
    assert {r.url: r.error for r in parsed} == {"u": "no html", "v": None}


@pytest.mark.parametrize("kw", [{"max_depth": -1}, {"resolve": "other"}])
def test_bad_arguments(spark, kw):
    with pytest.raises(ValueError):
        run(spark, {"http://h/": []}, "http://h/", **kw)
