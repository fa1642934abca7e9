"""Vector expressions: cosine similarity and the JSON form of a vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Products rounded to float32, added left to right in float64."""
    products = F.zip_with(a, b, lambda x, y: (x * y).cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def magnitude(a: Column) -> Column:
    """Root of the dot product with itself, added up without an array of products."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + (x * x).cast("double")))


def cosine_from(dot_product: Column, mag_a: Column, mag_b: Column) -> Column:
    """0.0 when a magnitude is zero. Each argument appears once, so none is computed twice."""
    return F.coalesce(F.try_divide(dot_product, mag_a * mag_b), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 when a magnitude is zero, an error when the lengths differ."""
    differs = vector_length(a) != vector_length(b)
    score = cosine_from(dot(a, b), magnitude(a), magnitude(b))
    failure = F.raise_error(F.lit("vectors differ in length")).cast("double")
    return F.when(differs, failure).otherwise(score)


def vector_length(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def embeddings_to_json(a: Column) -> Column:
    """JSON array text; a missing vector is the JSON value null."""
    return F.coalesce(F.to_json(a), F.lit("null"))


def embeddings_from_json(text: Column) -> Column:
    """Vector from JSON text; JSON null and unreadable text both give NULL (see json_error)."""
    return F.from_json(text, "array<float>")


def embeddings_json_error(text: Column) -> Column:
    """NULL for readable text, else a message: JSON null is readable and means no vector."""
    parsed = embeddings_from_json(text)
    holes = F.coalesce(F.exists(parsed, lambda v: v.isNull()), F.lit(False))
    unreadable = (parsed.isNull() & (F.trim(F.coalesce(text, F.lit(""))) != "null")) | holes
    return F.when(unreadable, F.lit("failed to read vector"))
