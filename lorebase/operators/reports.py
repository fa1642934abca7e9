"""Projections and reports over documents and search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.vectors import vector_length
from lorebase.operators.ordering import ordered_slice
from lorebase.operators.scan import DEFAULT_LIMIT, documents, page, page_total
from lorebase.schema import KB_COLUMNS


def document_output(df: DataFrame) -> DataFrame:
    return df.select("url", "title", "description", "content", "checksum")


def list_report(kb: DataFrame, limit: int | None = None) -> DataFrame:
    """Lengths instead of payloads in the order of urls, for every document or the first ``limit``."""
    narrow = kb.select(
        "url",
        "source_type",
        "checksum",
        F.octet_length("content").alias("content_length"),
        vector_length(F.col("embeddings")).alias("embeddings_length"),
    )
    return narrow.orderBy("url") if limit is None else ordered_slice(narrow, [F.col("url")], limit)


def search_report(output: DataFrame, verbose: bool = False) -> DataFrame:
    """Rank, url and score to four decimals, as shown to a reader."""
    shown = ["rank", "url", F.printf(F.lit("%.4f"), F.col("score")).alias("score")]
    return output.select(*shown, *(["title", "description"] if verbose else []))


def to_json_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(json_row(*(columns or df.columns)).alias("json"))


def json_hits(output: DataFrame) -> DataFrame:
    """Search hits with their score, one JSON object a row, best first."""
    return to_json_rows(output.orderBy("rank"), ["url", "title", "description", "content", "checksum", "score"])


def json_documents(kb: DataFrame) -> DataFrame:
    """Whole documents with their vectors, one JSON object a row."""
    return to_json_rows(documents(kb))


def json_page(kb: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, context: str | None = None) -> DataFrame:
    """One JSON object: the documents of a page, in the order of urls, and the number of all."""
    rows = page(kb, limit, offset, context)
    shown = rows.agg(F.array_sort(F.collect_list(F.struct(*KB_COLUMNS))).alias("documents"))  # a page at most
    both = shown.crossJoin(page_total(kb, context))  # a row each
    return to_json_rows(both, ["documents", "total"])


def json_row(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
