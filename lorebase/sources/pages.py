"""Captured pages: tables of (url, html) with the response's status and type when they were kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_pages(pages: DataFrame) -> DataFrame:
    """Pages answered with status 200 and an HTML content type; a column that is absent is not tested."""
    if "status" in pages.columns:
        pages = pages.filter(F.col("status") == 200)
    if "content_type" in pages.columns:
        pages = pages.filter(F.col("content_type").contains("text/html"))
    return pages
