"""URL reference resolution (RFC 3986 section 5) with the escaping a crawler needs.

Spark's URL functions split a URL but do not resolve references, so this is a small helper
applied to distinct references in Arrow batches.
"""

from __future__ import annotations

import codecs
import re
from typing import NamedTuple
from urllib.parse import quote, unquote

# Appendix B of RFC 3986: the five components, with None for a missing one.
COMPONENTS = re.compile(r"(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?", re.S)
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
CONTROL = re.compile(r"[\x00-\x1f\x7f]")
BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
PORT = re.compile(r":[0-9]*\Z")
HOST = re.compile(r"(?:\[[0-9A-Fa-f:.%]+\]|[^\s:\[\]<>\"\\^`{|}%/]*)\Z")
# Characters a path or fragment may hold unescaped; a path with any other is escaped throughout.
PATH_PLAIN = re.compile(r"[A-Za-z0-9\-._~!$&'()*+,;=:@/\[\]%]*\Z")
FRAGMENT_PLAIN = re.compile(r"[A-Za-z0-9\-._~!$&'()*+,;=:@/?\[\]%]*\Z")
PATH_SAFE = "-._~$&+,/:;=@"
FRAGMENT_SAFE = "-._~$&+,/:;=@?!()*"


class Url(NamedTuple):
    scheme: str
    authority: str | None
    path: str
    query: str | None
    fragment: str | None


def parse(text: str) -> Url | None:
    """Components of ``text``, or None when it is not a usable URL reference."""
    if CONTROL.search(text.split("#", 1)[0]):
        return None
    scheme, authority, path, query, fragment = COMPONENTS.match(text).groups()
    if scheme is not None and not SCHEME.match(scheme):
        return None  # Also a colon in the first segment of a relative path.
    if scheme is None and text.startswith(":"):
        return None
    opaque = scheme is not None and authority is None and not path.startswith("/")
    if not opaque and BAD_ESCAPE.search(path):
        return None
    if fragment and BAD_ESCAPE.search(fragment):
        return None
    if authority is not None:
        host = authority.rsplit("@", 1)[-1]
        name = PORT.sub("", host)
        if not HOST.match(name):
            return None
    return Url((scheme or "").lower(), authority, path, query, fragment or None)


def escape_with(text: str, plain: re.Pattern, safe: str) -> str:
    return text if plain.match(text) else quote(unquote(text, errors="surrogateescape"), safe=safe, errors="surrogateescape")


def unparse(u: Url) -> str:
    opaque = u.scheme and u.authority is None and u.path and not u.path.startswith("/")
    out = f"{u.scheme}:" if u.scheme else ""
    if u.authority is not None and (u.authority or u.path):
        out += f"//{u.authority}"
    path = u.path if opaque else escape_with(u.path, PATH_PLAIN, PATH_SAFE)
    if path and not path.startswith("/") and u.authority:
        path = "/" + path
    out += path
    if u.query is not None:
        out += f"?{u.query}"
    if u.fragment is not None:
        out += "#" + escape_with(u.fragment, FRAGMENT_PLAIN, FRAGMENT_SAFE)
    return out


def remove_dots(path: str) -> str:
    """Section 5.2.4; the result of a non-empty path is absolute."""
    if not path:
        return ""
    segments = path.split("/")
    kept: list[str] = []
    for segment in segments:
        if segment == "..":
            if len(kept) > 1 or (kept and kept[0] != ""):
                kept.pop()
        elif segment != ".":
            kept.append(segment)
    if segments[-1] in (".", ".."):
        kept.append("")
    joined = "/".join(kept)
    return joined if joined.startswith("/") else "/" + joined


def resolve(base: Url, ref: Url) -> Url:
    scheme = ref.scheme or base.scheme
    if ref.scheme or ref.authority:
        if ref.authority is None and ref.path and not ref.path.startswith("/"):
            return ref  # mailto:, javascript:, tel:
        return ref._replace(scheme=scheme, path=remove_dots(ref.path))
    if not ref.path:
        query = base.query if ref.query is None else ref.query
        fragment = base.fragment if ref.query is None and ref.fragment is None else ref.fragment
        return Url(scheme, base.authority, remove_dots(base.path), query, fragment)
    path = ref.path if ref.path.startswith("/") else base.path[: base.path.rfind("/") + 1] + ref.path
    return Url(scheme, base.authority, remove_dots(path), ref.query, ref.fragment)


def host_of(u: Url) -> str:
    """Host with port and without user; '' when there is none."""
    return (u.authority or "").rsplit("@", 1)[-1]


def _kept_escapes(error: UnicodeDecodeError) -> tuple[str, int]:
    return "".join(f"%{b:02X}" for b in error.object[error.start : error.end]), error.end


codecs.register_error("kept_escapes", _kept_escapes)
_LOOKS_ESCAPED = re.compile("%25(?=[0-9A-Fa-f]{2})")


def site_path(u: Url) -> str:
    """Decoded path, '/' when empty: the name of a page within its site.

    Escaped bytes that are not UTF-8 stay escaped (and so does a percent sign that would look like
    such an escape), so pages with other bytes in their addresses have other paths.
    """
    return unquote(_LOOKS_ESCAPED.sub("%2525", u.path), errors="kept_escapes") or "/"


def fetch_key(u: Url) -> str:
    """What is requested for the URL: no fragment, and '/' for an empty path."""
    return unparse(u._replace(fragment=None, path=u.path or "/"))


def describe(u: Url | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(url, host, path, key) columns of a parsed URL."""
    return (None, None, None, None) if u is None else (unparse(u), host_of(u), site_path(u), fetch_key(u))
