"""Depth-limited crawl of captured pages, many sites at once, as iterated joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.operators.extract import locate, resolve_links
from lorebase.operators.ordering import join_one
from lorebase.session import ROWS_PER_TASK, broadcast_if_small, materialize

DEFAULT_DEPTH = 5
LINKS = ["key", "page_url", "hrefs", "error"]
"""What a crawl needs to know of a page."""


def page_index(parsed: DataFrame) -> DataFrame:
    """One row per fetch key (URL without fragment) with all columns of the page.

    Of several captures of one key the greatest (url, checksum of the Markdown) stays. The pages
    are written once, with their key; which of them go is found on keys and checksums, and only
    the keys that occur more than once are joined back. Contents are neither sorted nor aggregated.
    """
    shown = [F.col("url").alias("page_url"), *[F.col(c) for c in parsed.columns if c != "url"]]
    checked = F.sha2(F.coalesce("markdown", F.lit("")), 256).alias("_sha")
    located = locate(parsed).filter(F.col("_at.key").isNotNull())
    pages = materialize(located.select(F.col("_at.key").alias("key"), *shown, checked, F.monotonically_increasing_id().alias("_row")), "pages")
    versions = pages.groupBy("key").agg(F.max(F.struct("page_url", "_sha", "_row")).alias("_last"), F.count("*").alias("_n"))
    several = materialize(versions.filter("_n > 1").select("key", F.col("_last._row").alias("_kept")), "captures")
    if not several.isEmpty():
        pages = pages.join(broadcast_if_small(several), "key", "left").filter("_kept IS NULL OR _kept = _row").drop("_kept")
    return pages.drop("_sha", "_row")


def crawl(index: DataFrame, seeds: DataFrame, max_depth: int = DEFAULT_DEPTH, resolve: str = "base") -> DataFrame:
    """Pages reached from each seed: (base_url, url, key, path, depth), depth being the least number of links.

    ``index`` holds one row per page with key, page_url, hrefs and error, best written and bucketed
    by key (``materialize_by``) since every round joins it. A round takes the URLs not tried before
    on the base's host, joins them to the index, once, and writes what was found of each with its
    links: the next round follows these links, the result is read from these tables, and a lost
    executor costs one round's tasks at most. URLs differing only in query or fragment are separate
    visits. ``resolve='page'`` resolves links against the page they are on rather than the base.
    """
    if max_depth < 0:
        raise ValueError("max_depth must not be negative")
    if resolve not in ("base", "page"):
        raise ValueError("resolve must be 'base' or 'page'")
    pages = index.select(*LINKS, F.lit(True).alias("_found"))
    visit, against = ["base_url", "url"], "page_url" if resolve == "page" else "base_url"
    at = [F.col(name).alias(name.split(".")[1]) for name in ("_at.url", "_at.key", "_at.path")]
    targets = locate(seeds.select("base_url").distinct(), "base_url").filter(F.col("_at.url").isNotNull()).select("base_url", *at)
    tried, reached, size = [], [], 0
    for depth in range(max_depth + 1):
        if size > ROWS_PER_TASK:  # a key can only be frequent among many URLs
            visits = join_one(materialize(targets, "targets"), pages, "key", how="left")
        else:
            visits = targets.join(pages, "key", "left")
        visits = materialize(visits, "crawl")
        size = visits.count()  # from the Parquet footers
        if size == 0:
            break
        reached.append(visits.filter("_found").select("base_url", "url", "key", "path", F.lit(depth).alias("depth")))
        tried.append(visits.select(*visit))
        # A page whose parse failed is kept, but its links are not followed.
        origin = dict.fromkeys(["base_url", against])
        edges = visits.filter("_found AND error IS NULL").select(*origin, F.explode("hrefs").alias("href")).distinct()
        links = resolve_links(edges, "base_url", against, split=size > ROWS_PER_TASK)
        to = [F.col(f"_to.{name}").alias(name) for name in ("url", "key", "path")]
        targets = links.select("base_url", *to).dropDuplicates(visit).join(reduce(DataFrame.unionByName, tried), visit, "left_anti")
    return reduce(DataFrame.unionByName, reached) if reached else targets.limit(0).withColumn("depth", F.lit(0))


def crawl_paths(reached: DataFrame) -> DataFrame:
    """Distinct paths of each site; query and fragment do not count."""
    return reached.select("base_url", "path").distinct()


def last_page_per_path(reached: DataFrame) -> DataFrame:
    """The page that stands for a path: the deepest, then the greatest url. Keys only, contents join later."""
    pick = F.max_by(F.struct("url", "key", "depth"), F.struct("depth", "url"))
    return reached.groupBy("base_url", "path").agg(pick.alias("_p")).select("base_url", "path", "_p.*")


def crawl_report(pages: DataFrame) -> DataFrame:
    """Path and length of the HTML in bytes."""
    return pages.select("base_url", "path", F.octet_length("html").alias("html_length"))


def crawl_summary(reached: DataFrame) -> DataFrame:
    return crawl_paths(reached).groupBy("base_url").agg(F.count("*").alias("n_paths"))
