"""Load and export of tables whose vectors are JSON text: a row per document, the vector in a binary or text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.functions.vectors import embeddings_from_json, embeddings_json_error, embeddings_to_json
from lorebase.operators.scan import documents
from lorebase.plans.ingest import Ingested
from lorebase.schema import conform
from lorebase.sources.store import KnowledgeBase


def import_table(rows: DataFrame) -> Ingested:
    """Documents of such a table, and its rows without a url or a readable vector with the reason.

    JSON null is a document without a vector; a missing vector text is unreadable. Missing strings
    become empty ones.
    """
    text = F.col("embeddings").cast("string")
    error = F.when(F.col("url").isNull(), "url is required").otherwise(embeddings_json_error(text))
    read = rows.withColumn("_error", error)
    good = read.filter("_error IS NULL").withColumn("embeddings", embeddings_from_json(text))
    return Ingested(conform(good), read.filter("_error IS NOT NULL").select("url", F.col("_error").alias("error")))


def export_table(kb: DataFrame) -> DataFrame:
    """The stored columns with each vector as JSON bytes, null where there is none."""
    return documents(kb).withColumn("embeddings", embeddings_to_json(F.col("embeddings")).cast("binary"))


def load_into(kb: KnowledgeBase, rows: DataFrame) -> DataFrame:
    """Upsert an exported table; returns its rejects."""
    done = import_table(rows)
    kb.upsert(done.documents)
    return done.rejects
