"""Extraction from pages as one Python job, and the link tables derived from it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lorebase.functions import links, urls
from lorebase.functions.blocks import BLOCKS, markdown
from lorebase.functions.memory import text_slices, tidy
from lorebase.functions.page import PageReader
from lorebase.operators.ordering import join_one
from lorebase.session import fits_broadcast, spread_small

STRING = T.StringType()
PARSED = (
    T.StructType()
    .add("title", STRING)
    .add("description", STRING)
    .add("main_text", STRING)
    .add("blocks", BLOCKS)
    .add("hrefs", T.ArrayType(STRING))
    .add("error", STRING)
)
LOCATED = T.StructType([T.StructField(name, STRING) for name in ("url", "host", "path", "key")])
RESOLVED = T.StructType([*LOCATED.fields, T.StructField("same_site", T.BooleanType())])


def read_page(html: str | None) -> tuple:
    if html is None:
        return "", "", "", [], [], "no html"
    try:
        page = PageReader().read(html)
        return page.title, page.description, page.main_text(), page.blocks(), page.hrefs, None
    except Exception as e:  # one bad page must not fail the job
        return "", "", "", [], [], f"{type(e).__name__}: {e}"


HTML_BYTES = 1 << 20
"""Pages of about this size are read before their Python objects become Arrow arrays; a longer page is read alone."""
HTML_ROWS = 200


@F.arrow_udf(PARSED)
def _parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return tidy(_parsed)(batches)


def _parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = to_arrow_type(PARSED)
    for batch in batches:
        for lo, hi in text_slices(batch, HTML_BYTES, HTML_ROWS):
            yield pa.array([read_page(h.as_py()) for h in batch.slice(lo, hi - lo)], kind)


@F.pandas_udf(LOCATED)
def _locate(url: pd.Series) -> pd.DataFrame:
    rows = [urls.describe(urls.parse(u)) if u is not None else (None,) * 4 for u in url]
    return pd.DataFrame(rows, columns=LOCATED.names, dtype=object)


@F.pandas_udf(RESOLVED)
def _resolve(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    parse = lru_cache(100_000)(urls.parse)
    for batch in batches:
        rows = []
        for site, against, href in zip(*batch):
            home, base = parse(site), parse(against)
            ref = urls.parse(href) if href is not None else None
            target = urls.resolve(base, ref) if home and base and ref else None
            same = bool(target) and urls.host_of(target) == urls.host_of(home) != ""
            rows.append((*urls.describe(target), same))
        yield pd.DataFrame(rows, columns=RESOLVED.names)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Add title, description, main_text, markdown, hrefs and error, reading each page once.

    Only the html column travels to Python, which returns a page's blocks; their Markdown is
    written by expressions. The call is marked nondeterministic so that filters on its results
    are not turned into a second call.
    """
    parsed = spread_small(pages).withColumn("_p", _parse.asNondeterministic()("html")).select(*pages.columns, "_p.*")
    shown = [markdown(F.col("blocks")).alias("markdown") if c == "blocks" else F.col(c) for c in PARSED.names]
    return parsed.select(*pages.columns, *shown)


def locate(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``_at``: normalised url, host with port, decoded path and fetch key of a URL column.

    Usual URLs are taken apart by expressions; of the others' rows only they go to Python, and of
    the usual ones nothing.
    """
    usual = links.usual_url(F.col(url_col))
    odd = _locate.asNondeterministic()(F.when(~usual, F.col(url_col)))
    both = links.located(df, url_col, "_usual").withColumn("_odd", odd)
    return both.withColumn("_at", F.when(usual, F.col("_usual")).otherwise(F.col("_odd"))).drop("_usual", "_odd")


def link_edges(parsed: DataFrame, url_col: str = "url") -> DataFrame:
    """Every href of every page in document order."""
    return parsed.select(F.col(url_col).alias("src_url"), F.posexplode("hrefs").alias("ord", "href"))


def resolve_links(edges: DataFrame, base_col: str = "base_url", against: str | None = None, split: bool = True) -> DataFrame:
    """Resolve each href and keep those on the host of the base; schemes may differ.

    References are resolved against the base URL of the site (``against`` names another
    column, such as the page itself). Unusable references and other hosts drop out. Usual
    references are resolved by expressions; a filter leaves the others to Python, so ``edges``
    is read twice. ``split=False`` resolves all in one Python pass: for few, distinct edges the
    larger plan costs more than it saves.
    """
    against, href = against or base_col, F.col("href")
    if not split:
        known = edges.dropna(subset=[base_col, against, "href"])
        return known.withColumn("_to", _resolve.asNondeterministic()(F.col(base_col), F.col(against), href)).filter("_to.same_site")
    usual = links.usual_reference(href) & links.usual_url(F.col(base_col)) & links.usual_url(F.col(against))
    done = links.resolved(edges.filter(usual), base_col, against, "href", "_to")
    odd = edges.filter(~usual & ~links.leads_nowhere(href)).dropna(subset=[base_col, against, "href"])
    rest = odd.withColumn("_to", _resolve.asNondeterministic()(F.col(base_col), F.col(against), href))
    return done.unionByName(rest).filter("_to.same_site")


def stamp_site_metadata(pages: DataFrame, base_meta: DataFrame) -> DataFrame:
    """Give every page of a site the title and description of its base page; a site may hold a third of the pages."""
    meta = base_meta.select("base_url", "title", "description")
    own = pages.drop("title", "description")
    return own.join(F.broadcast(meta), "base_url") if fits_broadcast(meta, meta.columns) else join_one(own, meta, "base_url")


def page_maps(pages: DataFrame) -> DataFrame:
    return pages.select("base_url", "path", "html", "markdown")
