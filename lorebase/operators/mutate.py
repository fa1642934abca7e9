"""Upsert, prefix delete and clean as pure DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import like_prefix
from lorebase.operators.scan import documents
from lorebase.schema import KB_COLUMNS, conform
from lorebase.session import BROADCAST_BYTES, broadcast_if_small, fits_broadcast, materialize


def latest_by_url(incoming: DataFrame, order_col: str | None = None) -> DataFrame:
    return latest_rows(incoming, order_col)[0]


def latest_rows(incoming: DataFrame, order_col: str | None = None) -> tuple[DataFrame, bool]:
    """Last write per url, and whether they are all the rows there are, as written. A url repeated in a third of the rows is fine.

    Rows with the same order value are settled by their contents, never by arrival. Without an
    order column, a url that occurs with different contents is an error: nothing tells which of
    them is the last. The rows are written once, here; the last of each url is found on order
    values and digests, and only urls that occur more than once are joined back, so contents are
    neither sorted nor aggregated.
    """
    order = F.col(order_col) if order_col else F.lit(0)
    docs = conform(incoming, order.alias("_order"), F.monotonically_increasing_id().alias("_row"))
    docs = materialize(docs.withColumn("_mark", F.xxhash64(*KB_COLUMNS)), "incoming")
    last = F.max(F.struct("_order", "checksum", "context", "_mark", "_row")).alias("_last")
    versions = docs.groupBy("url").agg(last, F.count("*").alias("_n"), F.min("_mark").alias("_a"), F.max("_mark").alias("_b"))
    kept = F.col("_last._row")
    if not order_col:
        unclear = F.raise_error(F.concat(F.lit("order column needed: different documents for "), F.col("url")))
        kept = F.when(F.col("_a") == F.col("_b"), kept).otherwise(unclear.cast("long"))
    several = materialize(versions.filter("_n > 1").select("url", kept.alias("_kept")), "versions")
    single = several.isEmpty()
    if not single:
        docs = docs.join(broadcast_if_small(several), "url", "left").filter("_kept IS NULL OR _kept = _row")
    return docs.select(*KB_COLUMNS), single


def keep_others(kb: DataFrame, urls: DataFrame, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Rows of ``kb`` whose url is not in ``urls``, and whether that kept their partitioning.

    Document contents should not be shuffled for this. A small key set is broadcast. For a
    large one the keys that really occur are found on the url columns alone, and usually
    these few are broadcast; only when most of the table is replaced does it shuffle.
    """
    if fits_broadcast(urls, ["url"], max_bytes):
        return kb.join(F.broadcast(urls), "url", "left_anti"), True
    replaced = materialize(kb.select("url").join(urls, "url", "left_semi"), "replaced")
    if fits_broadcast(replaced, ["url"], max_bytes):
        return kb.join(F.broadcast(replaced), "url", "left_anti"), True
    return kb.join(replaced, "url", "left_anti"), False


def without_urls(kb: DataFrame, urls: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    return keep_others(kb, urls, max_bytes)[0]


def upsert(kb: DataFrame, incoming: DataFrame, order_col: str | None = None) -> DataFrame:
    """Insert or replace by url: every column is replaced, so a new context moves the document.

    ``incoming`` is read and written once.
    """
    latest = latest_by_url(incoming, order_col)
    kept = without_urls(documents(kb), latest.select("url"))
    return kept.unionByName(latest)


def delete_prefix(kb: DataFrame, prefix: str, context: str | None = None, literal: bool = False) -> DataFrame:
    """Drop documents whose url starts with ``prefix``; ``literal`` turns wildcards and case folding off."""
    return documents(kb).filter(~prefix_match(prefix, context, literal))


def prefix_match(prefix: str, context: str | None = None, literal: bool = False):
    url = F.col("url")
    hit = url.startswith(prefix) if literal else like_prefix(url, prefix)
    return hit & F.col("context").eqNullSafe(context) if context else hit


def clean(kb: DataFrame) -> DataFrame:
    return documents(kb).filter(F.lit(False))
