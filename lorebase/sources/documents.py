"""Documents from crawled pages and from rows handed in by a caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import checksum


def make_documents(
    pages: DataFrame, context: str, source_type: str = "web_scrape", url_mode: str = "base"
) -> DataFrame:
    """Documents of pages(base_url, path, title, description, content[, page_url]).

    The key is the base URL with the path appended as it is; ``url_mode='page'`` keeps the
    page's own URL instead.
    """
    if url_mode not in ("base", "page"):
        raise ValueError("url_mode must be 'base' or 'page'")
    url = F.concat("base_url", "path") if url_mode == "base" else F.col("page_url")
    return pages.select(
        url.alias("url"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        "content",
        checksum(F.col("content")).alias("checksum"),
        F.lit(context).alias("context"),
        F.lit(source_type).alias("source_type"),
    )


def documents_from_rows(rows: DataFrame, context: str = "") -> DataFrame:
    """Documents from rows(url, content[, title, description, context]); url and content are required."""
    missing = {"url", "content"} - set(rows.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")

    def optional(name: str, default: str = ""):
        value = F.col(name) if name in rows.columns else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(default)).alias(name)

    return rows.select(
        "url",
        optional("title"),
        optional("description"),
        "content",
        checksum(F.col("content")).alias("checksum"),
        optional("context", context),
        F.lit("").alias("source_type"),
        F.when(F.col("url").isNull() | F.col("content").isNull(), "url and content are required").alias("error"),
    )
