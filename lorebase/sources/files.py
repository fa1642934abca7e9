"""Files as documents: one whole file is one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.text import basename

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def plain_path(path: Column) -> Column:
    """``file:/a/b`` and ``file:///a/b`` as ``/a/b``; other file systems keep their scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def file_documents(files: DataFrame, context: str) -> DataFrame:
    """Documents from binaryFile rows, with ``error`` set for bytes that are not UTF-8."""
    local = plain_path(F.col("path"))
    readable = F.is_valid_utf8("content")
    return files.select(
        F.when(F.startswith(local, F.lit("/")), F.concat(F.lit("file://"), local)).otherwise(local).alias("url"),
        basename(local).alias("title"),
        F.lit("").alias("description"),
        F.when(readable, F.col("content").cast("string")).alias("content"),
        F.sha2("content", 256).alias("checksum"),
        F.lit(context).alias("context"),
        F.lit("file_read").alias("source_type"),
        F.when(~readable, "content is not UTF-8").alias("error"),
        F.struct("modificationTime", "path").alias("modified"),
    )


def read_files(spark: SparkSession, path: str, context: str) -> DataFrame:
    """Every file under ``path`` (a file, directory or glob). Files of length zero give no row."""
    return file_documents(spark.read.format("binaryFile").load(path), context)
