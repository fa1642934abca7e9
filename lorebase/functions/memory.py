"""Memory of Python workers, which live on from task to task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def tidy(run: Callable[[Iterable], Iterator]):
    """``run`` for ``mapInArrow`` or a function of batches, giving freed memory back to the system when a task ends.

    Python workers live on from stage to stage, and what their allocators keep of one would add to
    the next.
    """

    def tidied(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def text_slices(texts: pa.Array, max_bytes: int, max_rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of a string column with about ``max_bytes`` and at most ``max_rows`` texts each; a longer text is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = int(np.searchsorted(ends, before + max_bytes, "right"))
        hi = min(max(hi, lo + 1), lo + max_rows, len(texts))
        yield lo, hi
        lo = hi


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
