"""One vector per whole text, computed in Arrow batches by a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.functions.embedders import HashingEmbedder
from lorebase.functions.memory import text_slices, tidy
from lorebase.session import spread_small

Embedder = Callable[[list[str]], Sequence]
EMPTY = "the embedder gave no vector"
EMBEDDED = "vector array<float>, error string"
TEXT_BYTES, TEXT_ROWS = 4 << 20, 1000
"""Texts that the embedder gets at a time; a longer one comes alone."""


def _vectors(embedder: Embedder, texts: list[str]) -> list[tuple]:
    """(vector, error) per text. A batch that fails is retried text by text, so one bad text costs only itself."""
    try:
        vectors = list(embedder(texts))
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
    except Exception as e:
        if len(texts) == 1:
            return [(None, f"the embedder failed: {e}")]
        return [pair for t in texts for pair in _vectors(embedder, [t])]
    return [(np.asarray(v, np.float32), None) if v is not None and len(v) else (None, EMPTY) for v in vectors]


def embed(
    df: DataFrame, text_col: str = "content", out_col: str = "embeddings", embedder: Embedder | None = None
) -> DataFrame:
    """Add ``out_col`` and fill ``error`` where a text has no vector.

    Rows that already carry an error keep it and are not sent to the embedder. Only the text
    column travels to Python; the call is nondeterministic so that it is never made twice.
    """
    embedder = embedder or HashingEmbedder()

    @F.arrow_udf(EMBEDDED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidy(embedded)(batches)

    def embedded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for lo, hi in text_slices(batch, TEXT_BYTES, TEXT_ROWS):
                texts = batch.slice(lo, hi - lo).to_pylist()
                known = [i for i, text in enumerate(texts) if text is not None]
                out: list[tuple] = [(None, "no text")] * len(texts)
                if known:
                    for i, pair in zip(known, _vectors(embedder, [texts[i] for i in known])):
                        out[i] = pair
                vectors, errors = pa.array([v for v, _ in out], pa.list_(pa.float32())), pa.array([e for _, e in out], pa.string())
                yield pa.StructArray.from_arrays([vectors, errors], ["vector", "error"])

    earlier = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    text = F.when(earlier.isNull(), F.col(text_col))
    called = spread_small(df).withColumn("_e", run.asNondeterministic()(text))
    return (
        called.withColumn(out_col, F.col("_e.vector"))
        .withColumn("error", F.coalesce(earlier, F.col("_e.error")))
        .drop("_e")
    )


def embed_query(text: str, embedder: Embedder | None = None) -> list[float]:
    """The vector of one query text, for ``search``. Tables of queries go through ``embed``."""
    vector, error = _vectors(embedder or HashingEmbedder(), [text])[0]
    if error:
        raise ValueError(error)
    return [float(x) for x in vector]


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the error column, rejected rows with it)."""
    return df.filter(F.col("error").isNull()).drop("error"), df.filter(F.col("error").isNotNull())
