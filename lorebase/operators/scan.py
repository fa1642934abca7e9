"""Reads of the knowledge base: scans, filters, lists, pages, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.operators.ordering import DRIVER_ROWS, ordered_slice
from lorebase.schema import KB_COLUMNS

DEFAULT_LIMIT = 10


def documents(kb: DataFrame) -> DataFrame:
    return kb.select(*KB_COLUMNS)


def in_context(df: DataFrame, context: str | None = None) -> DataFrame:
    """Exact, case-sensitive filter; an empty context means no filter."""
    return df.filter(F.col("context") == context) if context else df


def _url_slice(kb: DataFrame, limit: int, offset: int, context: str | None) -> DataFrame:
    """Rows [offset, offset+limit) by url.

    The slice is found on the url column alone, by a job that runs here. Its two end points
    then bound the wide scan: as literals they reach the Parquet reader, which skips the row
    groups outside them (a scalar subquery would be compared row by row), so contents are
    read for the slice and not for the whole table.
    """
    scoped = in_context(kb, context)
    cut = ordered_slice(scoped.select("url"), [F.col("url")], limit, offset)
    ends = cut.agg(F.min("url").alias("first"), F.max("url").alias("last")).first()
    rows = documents(scoped.filter(F.col("url").between(ends["first"], ends["last"]))).orderBy("url")
    # A url is unique, so the range holds at most ``limit`` rows; saying so spares the range shuffle.
    return rows.limit(limit) if limit <= DRIVER_ROWS else rows


def list_documents(kb: DataFrame, limit: int = DEFAULT_LIMIT, context: str | None = None) -> DataFrame:
    return _url_slice(kb, limit if limit > 0 else DEFAULT_LIMIT, 0, context)


def page(kb: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, context: str | None = None) -> DataFrame:
    """One page in url order; an offset past the end gives an empty page."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    return _url_slice(kb, limit if limit > 0 else DEFAULT_LIMIT, offset, context)


def page_total(kb: DataFrame, context: str | None = None) -> DataFrame:
    """Row count of the whole filtered set that ``page`` cuts from."""
    return in_context(kb, context).agg(F.count("*").alias("total"))


def get_document(kb: DataFrame, url: str, context: str | None = None) -> DataFrame:
    return documents(in_context(kb.filter(F.col("url") == url), context))


def contexts(kb: DataFrame) -> DataFrame:
    return kb.filter(F.col("context").isNotNull() & (F.col("context") != "")).select("context").distinct()
