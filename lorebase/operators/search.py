"""Exact cosine search: one query, or a table of queries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions.memory import tidy
from lorebase.functions.topk import BINS, Histogram, QuerySlice, TopK
from lorebase.functions.vectors import cosine_from, dot, magnitude, vector_length
from lorebase.operators.ordering import DRIVER_ROWS, best_within, index_within, ordered_slice
from lorebase.operators.scan import in_context
from lorebase.session import broadcast_if_small, materialize

DEFAULT_RESULTS = 3
SLICE_BYTES = 8 << 20
"""Query vectors held by one task at a time."""
SLICE_HITS = 4_000_000
"""Partial results (queries x k) held by one task at a time."""
MERGE_PARTS = 64
"""Parts of the tasks whose hits are merged first, each by itself (see ``_merged``)."""
FLOORED_K = 100
"""From this k on a first scan finds a score that each query's k best reach, so that tasks need not emit k hits each."""
FLOORED_QUERIES = 2_000
"""Queries of a slice of such a search; a task counts ``2 * BINS`` levels of each."""
HITS_PER_BATCH, QUERIES_PER_BATCH = 65_536, 256
LIMITED_K = 1000
"""Up to this k the engine itself keeps no more than k rows of a ranked window before its shuffle."""


def _query_column(query: Sequence[float] | DataFrame) -> Column:
    """The query as a struct (v, magnitude), computed once and not per document."""
    if isinstance(query, DataFrame):
        v = F.col(query.columns[0])
        return query.select(F.struct(v.alias("v"), magnitude(v).alias("magnitude"))).scalar()
    v = F.lit([float(x) for x in query]).cast("array<float>")
    return F.struct(v.alias("v"), magnitude(v).alias("magnitude"))


def _scored(kb: DataFrame, query: Sequence[float] | DataFrame, context: str | None) -> DataFrame:
    """url and score of every comparable document; contents stay out of the scan.

    A stored magnitude is used as it is; it has the same bits as one computed here.
    A score that is not a number becomes NULL, to be sorted last and dropped after the cut: a
    filter here would be pushed below the projection and compute every score twice.
    """
    stored = ["magnitude"] if "magnitude" in kb.columns else []
    vectors = in_context(kb, context).select("url", "embeddings", *stored)
    vectors = vectors.withColumn("_q", _query_column(query)).filter(
        (vector_length(F.col("embeddings")) > 0) & (F.size("embeddings") == F.size("_q.v"))
    )
    doc, q = F.col("embeddings"), F.col("_q.v")
    score = cosine_from(dot(q, doc), F.col("_q.magnitude"), F.col("magnitude") if stored else magnitude(doc))
    return vectors.select("url", F.nanvl(score, F.lit(None).cast("double")).alias("score"))


def search(
    kb: DataFrame, query: Sequence[float] | DataFrame, n: int = DEFAULT_RESULTS, context: str | None = None
) -> DataFrame:
    """The ``n`` nearest documents as (url, score, rank); equal scores are ordered by url.

    ``query`` is a vector, or a one-row DataFrame whose first column is the vector. Documents
    without a vector or with one of another length are left out (see ``search_skipped``).
    """
    if n < 0:
        raise ValueError("n must not be negative")
    best = [F.col("score").desc_nulls_last(), F.col("url").asc()]
    scored = _scored(kb, query, context)
    if n > DRIVER_ROWS:
        top = index_within(scored, [], best, "_i").filter(F.col("_i") < n).withColumn("rank", F.col("_i") + 1)
    else:
        # The window sees at most n rows: the top-n plan runs below it.
        top = ordered_slice(scored, best, n).withColumn("rank", F.row_number().over(Window.orderBy(*best)).cast("long"))
    return top.filter(F.col("score").isNotNull()).select("url", "score", "rank")


def search_skipped(kb: DataFrame, query: Sequence[float] | DataFrame, context: str | None = None) -> DataFrame:
    """How many documents ``search`` leaves out, by reason."""
    size = vector_length(F.col("embeddings"))
    reason = F.when(size == 0, "empty").when(size != F.size("_q.v"), "length").otherwise("scored")
    return (
        in_context(kb, context)
        .select("embeddings", _query_column(query).alias("_q"))
        .groupBy(reason.alias("reason"))
        .agg(F.count("*").alias("n_docs"))
    )


def search_output(kb: DataFrame, hits: DataFrame) -> DataFrame:
    """Document fields of the hits, which are written once, measured, and broadcast only if small."""
    hits = broadcast_if_small(materialize(hits.select("url", "score", "rank"), "hits"))
    fields = kb.select("url", "title", "description", "content", "checksum")
    return fields.join(hits, "url").select(*fields.columns, "score", "rank")


def measure(rows: DataFrame, id_col: str, vector_col: str) -> Row:
    """Number of rows and their size in memory."""
    width = 4 * F.size(vector_col) + F.octet_length(F.col(id_col).cast("string")) + 64
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")).first()


def _sink(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", id_type),
            T.StructField("url", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _stream_topk(load: Callable[[], QuerySlice], k: int, threshold: float, floor: np.ndarray | None = None):
    """Keep k hits per query over all batches of a task, and emit them once at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = TopK(load(), k, threshold, floor)
        for batch in batches:
            best.add(batch.column(0), batch.column(1))
        yield from best.result().to_batches(HITS_PER_BATCH)

    return tidy(run)


def _count_levels(load: Callable[[], QuerySlice], k: int):
    """(row of the query, level, number of scores) over all batches of a task, down to the level that its own k best reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Histogram(load())
        for batch in batches:
            seen.add(batch.column(1))
        for start in range(0, len(seen.counts), QUERIES_PER_BATCH):
            q, level, n = seen.best(k, slice(start, start + QUERIES_PER_BATCH))
            yield pa.record_batch({"q": pa.array(q, pa.int32()), "level": pa.array(level, pa.int32()), "n": pa.array(n, pa.int64())})

    return tidy(run)


def _floors(docs: DataFrame, load: Callable[[], QuerySlice], n_queries: int, k: int) -> np.ndarray:
    """For each query of a slice a score that at least k documents reach; -inf if there are not as many.

    The levels of all tasks are summed by query, and from the highest level on; a number a query returns.
    """
    levels = docs.mapInArrow(_count_levels(load, k), "q int, level int, n long").groupBy("q", "level").agg(F.sum("n").alias("n"))
    higher = Window.partitionBy("q").orderBy(F.col("level").desc())
    reached = levels.withColumn("n", F.sum("n").over(higher)).filter(F.col("n") >= k).groupBy("q").agg(F.max("level").alias("level")).toArrow()
    floor = np.full(n_queries, -np.inf)
    floor[reached.column("q").to_numpy()] = reached.column("level").to_numpy() / BINS - 1
    return floor


def _merged(part: DataFrame, top_k: int) -> DataFrame:
    """The k best of the tasks' partial hits: by (query, part of the tasks), then by query.

    No task sees a query's hits from all tasks at once. Above ``LIMITED_K`` the tasks are dealt to
    more parts, and these are merged ``MERGE_PARTS`` at a time, because the engine no longer cuts
    a window's input there.
    """
    parts = MERGE_PARTS if top_k <= LIMITED_K else MERGE_PARTS**2
    best = [F.col("score").desc(), F.col("url")]
    top = best_within(part, ["query_id"], best, top_k, F.xxhash64(F.spark_partition_id()), parts, MERGE_PARTS)
    return top.withColumn("rank", F.col("rank").cast("long"))


def search_batch(
    kb: DataFrame,
    queries: DataFrame,
    top_k: int,
    threshold: float = 0.0,
    context: str | None = None,
    slice_bytes: int = SLICE_BYTES,
    slice_hits: int = SLICE_HITS,
) -> DataFrame:
    """Exact top-k for every row of ``queries(query_id, embedding)`` with score >= threshold.

    Pairs are scored block against block inside tasks and never become rows: each task emits
    at most k rows per query, and the merge takes them in two levels. From ``FLOORED_K`` on a scan
    that only counts finds, for each query, a score that k documents reach, so that all tasks
    together emit little more than k rows a query.

    The query side is measured first. If it fits one slice it is shipped to the tasks and the
    documents are streamed past it without a shuffle. Otherwise the queries are dealt into slices,
    and the vectors, written once, are scanned for one slice after the other: the driver holds one
    slice at a time, and documents are neither copied nor shuffled. Both ways are exact.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    docs = in_context(kb, context).select("url", "embeddings").filter(vector_length(F.col("embeddings")) > 0)
    asked = queries.select("query_id", "embedding").filter(vector_length(F.col("embedding")) > 0)
    size = measure(asked, "query_id", "embedding")
    sink = _sink(queries.schema["query_id"].dataType)
    slices = max(1, math.ceil(size["bytes"] / slice_bytes), math.ceil(size["n"] * top_k / slice_hits))
    floored = top_k >= FLOORED_K
    if floored:
        slices = max(slices, math.ceil(size["n"] / FLOORED_QUERIES))

    def scan(of: DataFrame) -> DataFrame:
        table = of.toArrow()
        packed = of.sparkSession.sparkContext.broadcast(table)

        def load() -> QuerySlice:
            return QuerySlice.from_table(packed.value)

        floor = _floors(docs, load, table.num_rows, top_k) if floored else None
        return _merged(docs.mapInArrow(_stream_topk(load, top_k, threshold, floor), sink), top_k)

    if floored or slices > 1:
        docs = materialize(docs, "vectors")
    if slices == 1:
        return scan(asked)
    # Dealt by row and not by id, so that a slice keeps its size whatever ids repeat.
    asked = materialize(asked.withColumn("_row", F.monotonically_increasing_id()), "queries")
    of_slice = F.pmod(F.xxhash64("_row"), F.lit(slices))
    done = [materialize(scan(asked.filter(of_slice == s).drop("_row")), "hits").drop("rank") for s in range(slices)]
    # Only an id that several slices hold has more than k hits here.
    best = [F.col("score").desc(), F.col("url")]
    top = best_within(reduce(DataFrame.unionByName, done), ["query_id"], best, top_k, F.xxhash64("url"), MERGE_PARTS, MERGE_PARTS)
    return top.withColumn("rank", F.col("rank").cast("long"))
