"""The one stored entity: a document keyed by URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KB_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("embeddings", T.ArrayType(T.FloatType())),
        T.StructField("context", T.StringType()),
        T.StructField("source_type", T.StringType()),
    ]
)

KB_COLUMNS = KB_SCHEMA.fieldNames()


def conform(df: DataFrame, *extra: Column) -> DataFrame:
    """Project to the stored columns: missing or null strings become '', vectors stay as they are."""
    present = set(df.columns)
    out = []
    for field in KB_SCHEMA.fields:
        if isinstance(field.dataType, T.StringType):
            value = F.coalesce(F.col(field.name), F.lit("")) if field.name in present else F.lit("")
        else:
            value = F.col(field.name) if field.name in present else F.lit(None)
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out, *extra)
