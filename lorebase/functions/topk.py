"""Per-task kernel of batch search: exact top-k of a stream of vectors against a slice of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PAIRS_PER_STEP = 1_000_000
EXACT_PER_STEP = 65_536
"""Pairs whose vectors are gathered at once to be scored exactly."""
BINS = 256
"""Bins of a histogram of scores for each unit of score, of which there are two."""


def by_length(vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Group a list<float> Arrow column by vector length: length -> (row numbers, matrix)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    flat = np.asarray(vectors.flatten().cast(pa.float32()).fill_null(np.nan), dtype=np.float32)
    ends = np.cumsum(lengths)
    groups = {}
    for size in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == size)
        if len(rows) == len(lengths):
            matrix = flat.reshape(-1, size)
        else:
            matrix = flat[(ends[rows] - size)[:, None] + np.arange(size)]
        groups[int(size)] = (rows, matrix)
    return groups


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot product: float32 products added left to right in float64."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        for j in range(a.shape[1]):
            total += a[:, j] * b[:, j]
    return total


class Vectors:
    """A matrix with its exact magnitudes and a normalised copy for the estimate."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        squares = exact_dot(matrix, matrix)
        self.magnitude = np.sqrt(squares)
        # Outside this range float32 products over- or underflow and the error bound of the
        # estimate does not hold; such rows are always scored exactly. Zero rows are safe.
        self.estimable = (squares == 0) | ((squares > 1e-24) & (squares < 1e30))
        safe = np.where(self.estimable & (squares > 0), self.magnitude, 1.0)
        self.unit = np.zeros(matrix.shape, np.float32)
        for start in range(0, len(matrix), EXACT_PER_STEP):
            part = slice(start, start + EXACT_PER_STEP)
            self.unit[part] = matrix[part].astype(np.float64) / safe[part, None]
        self.unit[~self.estimable] = 0.0


def slack(size: int) -> float:
    """More than an estimate of vectors of ``size`` components can be off."""
    return (size + 16) * 2.0**-22


class QuerySlice:
    def __init__(self, ids, vectors):
        self.ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        self.groups = {size: (rows, Vectors(matrix)) for size, (rows, matrix) in by_length(vectors).items()}

    @classmethod
    def from_table(cls, table: pa.Table) -> QuerySlice:
        return cls(table.column("query_id"), table.column("embedding"))

    def blocks(self, vectors):
        """(rows of the column, their vectors, query rows, query vectors, length) of comparable pairs, about a step's at a time."""
        for size, (rows, matrix) in by_length(vectors).items():
            if size in self.groups:
                q_rows, q_vectors = self.groups[size]
                step = max(1, PAIRS_PER_STEP // max(1, len(q_rows)))
                for start in range(0, len(rows), step):
                    block = slice(start, start + step)
                    yield rows[block], Vectors(matrix[block]), q_rows, q_vectors, size


class Histogram:
    """How many scores of each query surely reach each of ``2 * BINS`` levels from -1 to 1, by estimates less their error."""

    def __init__(self, queries: QuerySlice):
        self.queries = queries
        self.counts = np.zeros((len(queries.ids), 2 * BINS), np.int32)

    def add(self, vectors) -> None:
        for _, docs, q_rows, queries, size in self.queries.blocks(vectors):
            usable = queries.estimable[:, None] & docs.estimable
            sure = (queries.unit @ docs.unit.T).astype(np.float64) - slack(size)
            level = np.minimum(np.floor((sure + 1) * BINS), 2 * BINS - 1).astype(np.int64)
            usable &= level >= 0
            place = (np.arange(len(q_rows))[:, None] * (2 * BINS) + level)[usable]
            self.counts[q_rows] += np.bincount(place, minlength=len(q_rows) * 2 * BINS).reshape(len(q_rows), -1).astype(np.int32)

    def best(self, k: int, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, level, number of scores) from each query's highest level down to the one where there are k."""
        part = self.counts[rows]
        above = np.cumsum(part[:, ::-1], axis=1)[:, ::-1] - part
        q, level = np.nonzero((part > 0) & (above < k))
        return q + rows.start, level, part[q, level]


class TopK:
    """Running best k (score descending, url ascending) of each query.

    A float32 matrix product estimates every pair. An estimate is off by less than
    ``slack``, so a pair whose estimate is more than that below the k-th best score of its
    query cannot be a hit; the others are scored exactly. The estimate only saves work.
    ``floor`` holds a score for each query that k documents, of whatever task, are known to reach.
    """

    def __init__(self, queries: QuerySlice, k: int, threshold: float, floor: np.ndarray | None = None):
        self.queries, self.k, self.threshold = queries, k, threshold
        self.floor = np.full(len(queries.ids), -np.inf) if floor is None else floor.copy()
        self.q, self.score, self.url = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.pending: list[tuple] = []
        self.waiting = 0

    def add(self, urls, vectors) -> None:
        names = urls.to_numpy(zero_copy_only=False)
        for rows, *block in self.queries.blocks(vectors):
            self._add_block(names[rows], *block)

    def _add_block(self, names, docs: Vectors, q_rows, queries: Vectors, size: int) -> None:
        off = slack(size)
        estimate = queries.unit @ docs.unit.T
        # Pairs that cannot be estimated are candidates whatever the bound.
        estimate[~queries.estimable] = np.inf
        estimate[:, ~docs.estimable] = np.inf
        need = np.maximum(self.floor[q_rows], self.threshold)
        opening = np.flatnonzero(np.isneginf(self.floor[q_rows]))
        if len(opening) and len(names) > self.k:
            # Queries without k hits yet: k pairs of this block reach their k-th estimate less slack.
            known = estimate[opening]
            known[np.isposinf(known)] = -np.inf
            kth = np.partition(known, -self.k, axis=1)[:, -self.k]
            need[opening] = np.maximum(need[opening], kth - off)
        bound = np.nextafter((need - off).astype(np.float32), np.float32(-np.inf))
        pairs = np.flatnonzero(estimate >= bound[:, None])
        if not len(pairs):
            return
        qi, di = np.divmod(pairs, len(names))
        score = self._exact(docs, di, queries, qi)
        keep = (score >= self.threshold) & (score >= self.floor[q_rows[qi]])
        if keep.any():
            self.pending.append((q_rows[qi[keep]], score[keep], names[di[keep]]))
            self.waiting += len(self.pending[-1][0])
            # Large results are not sorted anew for every block; small ones are, for the sake of the floor.
            if self.waiting >= len(self.q) // 4:
                self._settle()

    def _settle(self) -> None:
        if self.pending:
            q, score, url = (np.concatenate(parts) for parts in zip(*self.pending))
            self.pending, self.waiting = [], 0
            self._merge(q, score, url)

    @staticmethod
    def _exact(docs: Vectors, di, queries: Vectors, qi) -> np.ndarray:
        score = np.empty(len(qi))
        for start in range(0, len(qi), EXACT_PER_STEP):
            part = slice(start, start + EXACT_PER_STEP)
            d, q = di[part], qi[part]
            product = exact_dot(queries.matrix[q], docs.matrix[d])
            zero = (queries.magnitude[q] == 0) | (docs.magnitude[d] == 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                score[part] = np.where(zero, 0.0, product / (queries.magnitude[q] * docs.magnitude[d]))
        return score

    def _merge(self, q, score, url) -> None:
        touched = np.zeros(len(self.floor), bool)
        touched[q] = True
        old = touched[self.q]
        q = np.concatenate([self.q[old], q])
        score = np.concatenate([self.score[old], score])
        url = np.concatenate([self.url[old], url])
        order = np.lexsort((-score, q))
        tied = (np.diff(q[order]) == 0) & (np.diff(score[order]) == 0)
        if tied.any():
            named = np.array([u is not None for u in url])  # a null comes first, as in the merge
            named_at = np.flatnonzero(named)
            by_url = np.concatenate([np.flatnonzero(~named), named_at[np.argsort(url[named_at], kind="stable")]])
            order = by_url[np.lexsort((-score[by_url], q[by_url]))]
        q, score, url = q[order], score[order], url[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        full = place == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], score[full])
        best = place < self.k
        self.q = np.concatenate([self.q[~old], q[best]])
        self.score = np.concatenate([self.score[~old], score[best]])
        self.url = np.concatenate([self.url[~old], url[best]])

    def result(self) -> pa.Table:
        self._settle()
        return pa.table(
            {
                "query_id": self.queries.ids.take(pa.array(self.q)),
                "url": pa.array(self.url.tolist(), pa.string()),
                "score": pa.array(self.score),
            }
        )
