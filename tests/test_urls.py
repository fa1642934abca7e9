import pytest

from lorebase.functions import urls

BASE = urls.parse("https://h:8080/docs/x/?q=1#f")


def resolved(ref):
    parsed = urls.parse(ref)
    return urls.unparse(urls.resolve(BASE, parsed)) if parsed else None


@pytest.mark.parametrize(
    "ref, url",
    [
        ("y", "https://h:8080/docs/x/y"),
        ("/z", "https://h:8080/z"),
        ("../k", "https://h:8080/docs/k"),
        ("../../../k", "https://h:8080/k"),
        ("./", "https://h:8080/docs/x/"),
        ("", "https://h:8080/docs/x/?q=1#f"),
        ("#t", "https://h:8080/docs/x/?q=1#t"),
        ("?p=2", "https://h:8080/docs/x/?p=2"),
        ("//other/a", "https://other/a"),
        ("http://h:8080/a/./b/../c", "http://h:8080/a/c"),
        ("HTTP://h", "http://h"),
        ("/a b", "https://h:8080/a%20b"),
        ("/a%20b", "https://h:8080/a%20b"),
        ("/ü", "https://h:8080/%C3%BC"),
        ("/a(b)!", "https://h:8080/a(b)!"),
        ("mailto:a@b.c", "mailto:a@b.c"),
        ("javascript:void(0)", "javascript:void(0)"),
        ("1:b", None),
        (":x", None),
        ("/%zz", None),
        ("http://h:80a/", None),
        ("http://h h/", None),
        ("/a\nb", None),
    ],
)
def test_resolution(ref, url):
    assert resolved(ref) == url


def test_columns():
    assert urls.describe(urls.parse("https://u@h:1#f")) == ("https://u@h:1#f", "h:1", "/", "https://u@h:1/")
    assert urls.describe(urls.parse("https://h/a%20b?x#f")) == ("https://h/a%20b?x#f", "h", "/a b", "https://h/a%20b?x")
    assert urls.host_of(urls.parse("mailto:a@b")) == ""
    assert urls.describe(None) == (None,) * 4


def test_paths_of_other_bytes_are_other_paths():
    paths = [urls.site_path(urls.parse(f"http://h/{p}")) for p in ("caf%E9", "caf%E8", "%C4%E3", "%BA%C3", "caf%C3%A9", "%25E9", "100%25", "a%20b")]
    assert paths == ["/caf%E9", "/caf%E8", "/%C4%E3", "/%BA%C3", "/caf\u00e9", "/%25E9", "/100%", "/a b"]
