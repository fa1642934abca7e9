"""URL references in expressions: components, resolution (RFC 3986, section 5), names of a page.

They cover the usual references, made of characters that need no escape, and give the same columns
as ``urls`` does. ``usual`` says which these are; a caller hands the others to ``urls`` in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of RFC 3986: the characters of a path without escapes, and its appendix B with delimiters kept.
PLAIN = r"[A-Za-z0-9\-._~!$&'()*+,;=:@/]"
HOST = r"[A-Za-z0-9.\-]+(?::[0-9]+)?"
COMPONENTS = r"^([^:/?#]+:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?\z"
NAMES = ("scheme", "authority", "path", "query", "fragment")

_TAIL = rf"(?:\?[^\x00-\x1f\x7f#]*)?(?:#(?:{PLAIN}|\?)*)?\z"
_ABSOLUTE = rf"^[A-Za-z][A-Za-z0-9+.\-]*://{HOST}(?:/{PLAIN}*)?{_TAIL}"
_RELATIVE = rf"^(?://{HOST}(?:/{PLAIN}*)?|(?!//)(?![^/?#]*:){PLAIN}*){_TAIL}"
_OPAQUE = r"^(?:mailto|javascript|tel|data):"
_DOTS = r"(^|/)\.\.?(/|$)"


def usual_url(url: Column) -> Column:
    """Whether a URL with scheme and host is covered here."""
    return F.coalesce(url.rlike(_ABSOLUTE), F.lit(False))


def usual_reference(href: Column) -> Column:
    return F.coalesce(href.rlike(_RELATIVE) | href.rlike(_ABSOLUTE), F.lit(False))


def leads_nowhere(href: Column) -> Column:
    """References that name no host, whatever their base."""
    return F.coalesce(href.rlike(_OPAQUE), F.lit(False))


def with_components(df: DataFrame, url: str | Column, prefix: str) -> DataFrame:
    """Add the components, each with its delimiter and '' where it is missing. An empty fragment counts as missing."""
    parts = {f"{prefix}{name}": F.regexp_extract(url, COMPONENTS, i) for i, name in enumerate(NAMES, 1)}
    fragment = parts[f"{prefix}fragment"]
    parts[f"{prefix}fragment"] = F.when(fragment == "#", "").otherwise(fragment)
    parts[f"{prefix}scheme"] = F.lower(parts[f"{prefix}scheme"])
    return df.withColumns(parts)


def _without_dots(path: Column) -> Column:
    """Section 5.2.4; the result of a non-empty path is absolute."""
    none = F.array().cast("array<string>")
    segments = F.split(path, "/")

    def step(kept: Column, segment: Column) -> Column:
        deep = (F.size(kept) > 1) | ((F.size(kept) == 1) & (F.get(kept, F.lit(0)) != ""))
        up = F.when(deep, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        return F.when(segment == "..", up).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    joined = F.concat(F.array_join(F.aggregate(segments, none, step), "/"), F.when(ends_in_dots, "/").otherwise(""))
    shown = F.when(path.rlike(_DOTS), joined).otherwise(path)
    return F.when(path == "", "").when(shown.startswith("/"), shown).otherwise(F.concat(F.lit("/"), shown))


def _named(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    """(url, host, path, key) of components."""
    front, rooted = F.concat(scheme, authority), F.when(path == "", "/").otherwise(path)
    return F.struct(
        F.concat(front, path, query, fragment).alias("url"),
        F.substring(authority, 3, 1 << 20).alias("host"),
        rooted.alias("path"),
        F.concat(front, rooted, query).alias("key"),
    )


def located(df: DataFrame, url: str, out: str) -> DataFrame:
    """Add the struct (url, host, path, key) of a usual URL."""
    parts = [f"_u_{name}" for name in NAMES]
    return with_components(df, F.col(url), "_u_").withColumn(out, _named(*map(F.col, parts))).drop(*parts)


def resolved(df: DataFrame, site: str, against: str, href: str, out: str) -> DataFrame:
    """Add the struct (url, host, path, key, same_site) of a usual reference, resolved against a usual URL.

    ``same_site`` says whether its host is that of ``site``.
    """
    df = with_components(with_components(df, F.col(against), "_b_"), F.col(href), "_r_")
    base, ref = ({name: F.col(f"_{which}_{name}") for name in NAMES} for which in "br")
    own = ref["authority"] != ""
    here = ~own & (ref["path"] == "")
    folder = F.regexp_extract(base["path"], "^(.*/)?", 1)
    path = (
        F.when(here, base["path"]).when(own | ref["path"].startswith("/"), ref["path"])
        .otherwise(F.concat(folder, ref["path"]))
    )
    nothing = here & (ref["query"] == "")
    df = df.withColumns({
        "_t_scheme": F.when(ref["scheme"] == "", base["scheme"]).otherwise(ref["scheme"]),
        "_t_authority": F.when(own, ref["authority"]).otherwise(base["authority"]),
        "_t_path": _without_dots(path),
        "_t_query": F.when(nothing, base["query"]).otherwise(ref["query"]),
        "_t_fragment": F.when(nothing & (ref["fragment"] == ""), base["fragment"]).otherwise(ref["fragment"]),
        "_t_home": F.regexp_extract(site, COMPONENTS, 2),
    })
    target = [F.col(f"_t_{name}") for name in NAMES]
    same = (F.col("_t_authority") == F.col("_t_home")).alias("same_site")
    named = _named(*target)
    df = df.withColumn(out, F.struct(*[named[n].alias(n) for n in ("url", "host", "path", "key")], same))
    return df.drop("_t_home", *[f"_{which}_{name}" for which in "brt" for name in NAMES])
