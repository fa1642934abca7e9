"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors of floats become integers, floor(1024 * x). A block of up to ``BLOCK_ROWS`` of them is one
row of the index: for each dimension, posting segments of the vectors whose component falls in one
quantised level, from the least level to the greatest. A query's impacts are the components' worths
above the least a dimension can add, so none is negative; segments are processed by descending
quantised impact, all dimensions together, and each adds its impact to its vectors.

After each step the score of any vector is known to within bounds: what it has gathered, plus in
each dimension the impact of the next segment (not seen yet) or the width of a level (seen). The
k-th largest lower bound is what a member must reach, and so is the k-th exact score of the task's
earlier blocks. Processing stops once the vectors that can still reach it are few enough to be
scored exactly, which proves the result: no vector outside them can belong to it. Nothing is
approximated, and ties are settled by id.

Vectors that are null or hold a null, NaN or infinite component take no part. Vectors of different
lengths are never compared. Repeated ids are rows like any other: a query takes every row whose id
differs from its own, and an id with several query rows is asked once for each of them. Rows without
an id are not candidates. Scores beyond the range of a long count as its nearest end. Columns other
than the two named ones are not read. No queries or no vectors give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.session import materialize, spread_small

SCALE = 1024
K = 10
BLOCK_ROWS = 1 << 14
"""Vectors in a block, one row of the index; fewer if they are long (``BLOCK_CELLS``). At most 1 << 16."""
BLOCK_CELLS = 1 << 20
"""Components in a block."""
LEVELS = 64
"""Levels of a dimension, at most."""
STEP = 0.75
"""Each round processes the segments down to this share of the last round's least impact."""
FEW = 64
"""So many possible members, or one in ``1 << SHARE`` of a block, are scored exactly rather than told apart further."""
SHARE = 5
SLICE_BYTES = 32 << 20
"""Queries in a slice, which is shipped to the tasks; there are as many slices as it takes."""
SAFE = 1 << 62
"""Sums that may pass this are added as Python integers."""

INDEX = "dims int, ids binary, vectors binary, least binary, width binary, postings binary, ends binary"
HIT = "query_row long, query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd


def _matrix(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integers) for each length of vector that occurs; integers beyond 64 bits come as objects."""
    length = vectors.value_lengths().to_numpy()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(length)
    for dims in np.unique(length):
        rows = np.flatnonzero(length == dims)
        cells = flat[(ends[rows] - dims)[:, None] + np.arange(dims)]
        with np.errstate(over="ignore"):
            whole = np.floor(cells * SCALE)
        small = np.abs(whole).max(axis=1, initial=0) < 2**31
        if small.any():
            yield rows[small], whole[small].astype(np.int64)
        if not small.all():  # exact: a float times a power of two, as an integer
            yield rows[~small], np.array([[math.floor(int(SCALE) * x) if abs(x) < 2**900 else int(x) * SCALE for x in row] for row in cells[~small].tolist()], object)


class Block:
    """The posting segments of a block of vectors, and the vectors for exact scores."""

    def __init__(self, ids, vectors, least, width, postings, ends):
        self.ids, self.vectors, self.least, self.width, self.postings, self.ends = ids, vectors, least, width, postings, ends

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS) -> Block:
        """``postings[d]`` has the vectors by the level of component d, and ``ends[d]`` where each level ends."""
        n, dims = vectors.shape
        least = vectors.min(axis=0) if dims else np.zeros(0, np.int64)
        width = (vectors.max(axis=0) - least) // levels + 1 if dims else least
        level = ((vectors - least) // width).astype(np.int16).T
        postings = np.argsort(level, axis=1, kind="stable").astype(np.uint16).reshape(dims, n)
        counts = np.zeros((dims, levels), np.int64)
        for d in range(dims):
            counts[d] = np.bincount(level[d], minlength=levels)
        return cls(ids, vectors, least, width, postings, np.cumsum(counts, axis=1))

    def row(self) -> tuple:
        arrays = (self.ids, self.vectors.astype(np.int32), self.least, self.width, self.postings, self.ends)
        return (self.vectors.shape[1], *(np.ascontiguousarray(a).tobytes() for a in arrays))

    @classmethod
    def read(cls, dims: int, ids: bytes, vectors: bytes, least: bytes, width: bytes, postings: bytes, ends: bytes) -> Block:
        i = np.frombuffer(ids, np.int64)
        whole = np.frombuffer(vectors, np.int32).astype(np.int64).reshape(len(i), dims)
        order = np.frombuffer(postings, np.uint16).reshape(dims, len(i))
        stops = np.frombuffer(ends, np.int64).reshape(dims, -1 if dims else 0)
        return cls(i, whole, np.frombuffer(least, np.int64), np.frombuffer(width, np.int64), order, stops)

    def best(self, query: np.ndarray, own: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of every vector that can be among the k best with at least ``floor``, ``own`` id left out."""
        n, dims = self.vectors.shape
        weight = np.abs(query)
        rising = query >= 0
        top = self.least + self.width * self.ends.shape[1] - 1
        base = int((np.where(rising, self.least, top) * query).sum())  # the least score there can be
        at = np.zeros(dims, np.int64)  # levels processed of each dimension, from its greatest impact down
        levels = self.ends.shape[1] if dims else 0
        gain = weight * self.width  # of one level over the next
        alive = np.flatnonzero(self.ids != own)
        sums = np.zeros(n, np.int64)

        def ahead() -> int:
            """What any vector can have beyond its sum: in each dimension the next impact, or less than a level's width."""
            return int((np.maximum(levels - at, 1) * gain).sum()) if dims else 0

        def possible(rows: np.ndarray) -> np.ndarray:
            least = floor
            if len(rows) > k:
                least = max(least, base + int(np.partition(sums[rows], -k)[-k]))
            return rows[base + sums[rows] + ahead() >= least]

        alive = possible(alive)
        impact = int(gain.max(initial=0)) * levels
        while len(alive) > max(FEW, k, n >> SHARE) and (at < levels).any():
            impact = int(impact * STEP)
            # Level j from the top has a quantised impact of (levels - 1 - j) * gain.
            until = np.where(gain > 0, np.clip(levels - -(-impact // np.maximum(gain, 1)), at, levels), levels)
            for d in np.flatnonzero((until > at) & (gain > 0)):
                self._add(sums, d, int(at[d]), int(until[d]), bool(rising[d]), int(gain[d]), levels)
            at = until
            alive = possible(alive)
        exact = self.vectors[alive] @ query
        return alive, exact

    def _add(self, sums: np.ndarray, d: int, first: int, until: int, rising: bool, gain: int, levels: int) -> None:
        """Segments ``first`` to ``until`` of dimension ``d``, counted from its greatest impact, each add theirs."""
        ends = self.ends[d]
        starts = np.concatenate([[0], ends[:-1]])
        chosen = slice(levels - until, levels - first) if rising else slice(first, until)
        lo, hi = starts[chosen], ends[chosen]
        worth = (np.arange(levels) if rising else np.arange(levels)[::-1])[chosen] * gain
        sums[self.postings[d, lo[0] : hi[-1]]] += np.repeat(worth, hi - lo)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", levels: int = LEVELS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index of all usable vectors, a row per block, written to the shared folder. Nothing is shuffled.

    Vectors with a component beyond 31 bits are put in rows without postings and are scored exactly.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = spread_small(rows.filter(F.col("id").isNotNull() & usable(F.col("v"))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def out(parts: list) -> pa.RecordBatch:
            block = Block.build(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), levels)
            return pa.record_batch([[x] for x in block.row()], schema=schema)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, whole in _matrix(batch.column(1)):
                dims = whole.shape[1]
                if whole.dtype == object:
                    for k, row in zip(at, whole, strict=True):
                        said = ",".join(map(str, row)).encode()
                        yield pa.record_batch([[x] for x in (-dims - 1, ids[k : k + 1].tobytes(), said, b"", b"", b"", b"")], schema=schema)
                    continue
                limit = max(1, min(block_rows, BLOCK_CELLS // max(1, dims)))
                for lo in range(0, len(at), limit):
                    parts = waiting.setdefault(dims, [])
                    parts.append((ids[at[lo : lo + limit]], whole[lo : lo + limit]))
                    if sum(len(p[0]) for p in parts) >= limit:
                        yield out(waiting.pop(dims))
        for parts in waiting.values():
            yield out(parts)

    kinds = {"int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in INDEX.split(", "))])
    return materialize(rows.mapInArrow(run, INDEX), "impact-index")


class Best:
    """The k best hits so far of each query of a slice, over the blocks of one task."""

    def __init__(self, asked: pa.Table, k: int):
        self.k = k
        self.rows, self.ids = asked.column(0).to_numpy(), asked.column(1).to_numpy()
        vectors = asked.column(2).combine_chunks()
        self.queries = [None] * asked.num_rows
        for at, whole in _matrix(vectors):
            for q, v in zip(at, whole, strict=True):
                self.queries[q] = v
        none = np.zeros(0, np.int64)
        self.score, self.hit = [none] * asked.num_rows, [none] * asked.num_rows

    def add(self, block: Block) -> None:
        limit = int(np.abs(block.vectors).max(initial=0)) if block.vectors.dtype != object else None
        for q, query in enumerate(self.queries):
            if len(query) != block.vectors.shape[1]:
                continue
            wide = limit is None or query.dtype == object or 4 * (limit + LEVELS) * int(np.abs(query).sum()) >= SAFE
            if wide:
                at = np.flatnonzero(block.ids != self.ids[q])
                score = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in block.vectors[at].astype(object) @ query.astype(object)], object)
            else:
                full = len(self.score[q]) == self.k
                at, score = block.best(query, self.ids[q], self.k, int(self.score[q][-1]) if full else -SAFE)
            self._merge(q, block.ids[at], score)

    def _merge(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        ids, score = np.concatenate([self.hit[q], ids]), np.concatenate([self.score[q], score])
        if len(ids) > 4 * self.k and score.dtype != object:
            least = np.partition(score, -self.k)[-self.k]
            ids, score = ids[score >= least], score[score >= least]
        order = np.lexsort((ids, -score))[: self.k] if score.dtype != object else sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[: self.k]
        self.hit[q], self.score[q] = ids[order], score[order]

    def result(self) -> pa.RecordBatch:
        n = [len(h) for h in self.hit]
        score = [int(s) for part in self.score for s in part]
        columns = np.repeat(self.rows, n), np.repeat(self.ids, n), np.concatenate([*self.hit, np.zeros(0, np.int64)])
        return pa.record_batch([*map(pa.array, columns), pa.array(score, pa.int64())], names=["query_row", "query_id", "vec_id", "score"])


def _search(load: Callable[[], pa.Table], k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(load(), k)
        for batch in batches:
            for row in zip(*batch.to_pydict().values(), strict=True):
                dims = row[0]
                if dims < 0:  # a vector with wide components
                    whole = np.array([[int(x) for x in row[2].split(b",") if x]], object).reshape(1, -dims - 1)
                    best.add(Block(np.frombuffer(row[1], np.int64), whole, *[None] * 4))
                else:
                    best.add(Block.read(*row))
        yield best.result()

    return run


def top_k(index: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row of ``queries``, its own id left out.

    The queries are written and measured. A slice of at most about ``slice_bytes`` of them is
    shipped at a time and the index is scanned once a slice; a task gives k rows a query, which are
    merged by (query, part of the tasks) and then by query.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    v = F.col(vector_col).cast("array<double>")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    asked = materialize(asked.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "asked")
    # A hit is held as two arrays' items, a query as its components.
    width = 8 * F.size("v") + 32 * k + 256
    size = asked.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, -(-size // slice_bytes))
    hits = None
    for s in range(slices):
        packed = asked.sparkSession.sparkContext.broadcast(asked.filter(F.pmod(F.xxhash64("row"), F.lit(slices)) == s).toArrow())
        part = spread_small(index).mapInArrow(_search(lambda packed=packed: packed.value, k), HIT).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
        hits = part if hits is None else hits.unionByName(part)
    best = [F.col("score").desc(), F.col("vec_id").asc()]
    for keys in (["query_row", "_part"], ["query_row"]):
        spec = Window.partitionBy(*keys).orderBy(*best)
        hits = hits.withColumn("rank", F.row_number().over(spec)).filter(F.col("rank") <= k)
    return hits.select("query_id", "rank", "vec_id", "score")
