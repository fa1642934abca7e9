"""Fill-in-middle: texts cut into prefix, middle and suffix at token boundaries, and put in another order.

A text is cut into tokens ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``. Where its
tokens end is kept in a learned rank index: straight segments that predict the place of the r-th
boundary to within ``ERROR`` bytes, and for each boundary the residual, one signed byte. A cut at a
rank is predicted from its segment and corrected exactly by its residual.

Each row is handled by itself, so nothing is shuffled and equal or repeated rows give equal results.
A null or empty text has no tokens and stays plain; a null doc_id counts as an empty one in the
seed. Columns other than doc_id and text are not read, whatever their names. An empty table gives
an empty one. Tasks hold about a megabyte of text at a time, or one whole text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.llm.words import SPACE, as_bytes, pieces

ERROR = 127
"""Largest residual of a boundary, in bytes: what a signed byte holds."""

SEED, FORM_PERCENT, SPM_PERCENT = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
"""Fixed values of the output format."""


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of every boundary, index of each text's first one, and at the end their number).

    The boundaries of a text are its start and the end of each of its tokens, as places in ``data``.
    """
    size = len(data)
    inside = ~SPACE[data]
    last = np.zeros(size, bool)
    last[:-1] = ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    last[offsets[1:][full] - 1] = True
    word_ends = np.flatnonzero(inside & last) + 1
    closing = offsets[1:][full & ~inside[offsets[1:] - 1]] if size else np.zeros(0, np.int64)
    ends = np.sort(np.concatenate([word_ends, closing]))  # a text's trailing blanks are a token too
    counts = np.searchsorted(ends, offsets[1:], "right") - np.searchsorted(ends, offsets[:-1], "right")
    first = np.concatenate([[0], np.cumsum(counts + 1)])
    place = np.empty(first[-1], np.int64)
    starts = np.zeros(len(place), bool)
    starts[first[:-1]] = True
    place[starts] = offsets[:-1]
    place[~starts] = ends
    return place, first


class RankIndex(NamedTuple):
    """Segments in rank order: boundaries from ``rank`` on lie at ``place + run * (r - rank) // steps``, plus their residual."""

    rank: np.ndarray
    place: np.ndarray
    run: np.ndarray
    steps: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, place: np.ndarray, first: np.ndarray, error: int = ERROR) -> RankIndex:
        """Segments within ``error`` of every boundary; none spans two texts.

        A segment is the line between its end points. One that misses a boundary by more is halved;
        one of a single step misses nothing, so this ends after at most log2 of the ranks rounds.
        """
        lo, hi = first[:-1], first[1:] - 1
        residual, done = np.zeros(len(place), np.int64), []
        while len(lo):
            count = hi - lo + 1
            begin = np.cumsum(count) - count
            step = np.arange(count.sum()) - np.repeat(begin, count)
            run, steps = place[hi] - place[lo], np.maximum(hi - lo, 1)
            off = place[np.repeat(lo, count) + step] - np.repeat(place[lo], count) - np.repeat(run, count) * step // np.repeat(steps, count)
            fits = np.maximum.reduceat(np.abs(off), begin) <= error
            kept = np.repeat(fits, count)
            residual[(np.repeat(lo, count) + step)[kept]] = off[kept]
            done.append(np.stack([lo[fits], place[lo[fits]], run[fits], steps[fits]]))
            lo, hi = lo[~fits], hi[~fits]
            middle = (lo + hi) // 2
            lo, hi = np.concatenate([lo, middle]), np.concatenate([middle, hi])
        found = np.concatenate(done, axis=1) if done else np.zeros((4, 0), np.int64)
        found = found[:, np.argsort(found[0], kind="stable")]
        return cls(*found, residual.astype(np.min_scalar_type(-error - 1)))

    def segment(self, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rank, rank, "right") - 1

    def predict(self, rank: np.ndarray) -> np.ndarray:
        """Places off by at most the error the index was fitted with."""
        s = self.segment(rank)
        return self.place[s] + self.run[s] * (rank - self.rank[s]) // self.steps[s]

    def locate(self, rank: np.ndarray) -> np.ndarray:
        """Exact places."""
        return self.predict(rank) + self.residual[rank]


def seeds(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four groups of eight hex digits of sha256 of ``seed:doc_id``, as longs."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _forms(column: pa.Array, picks: np.ndarray, form_percent: int, spm_percent: int) -> list[str]:
    text = column.fill_null("").to_pylist()
    out = []
    for t, (_, _, chance, order) in zip(text, picks, strict=True):
        marked = not t or PREFIX in t or SUFFIX in t or MIDDLE in t
        out.append("plain" if marked or chance % 100 >= form_percent else "spm" if order % 100 < spm_percent else "psm")
    return out


def _chars(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    data, offsets = as_bytes(batch.column(1))
    for lo, hi in pieces(offsets):
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def transform(
    docs: DataFrame, seed: int = SEED, form_percent: int = FORM_PERCENT, spm_percent: int = SPM_PERCENT, error: int = ERROR
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, n_segments), a row for every row.

    ``n`` counts tokens, form is plain, psm or spm, and ``output`` is the text in that order behind
    its markers; ``n_segments`` says how many segments index the text's boundaries.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[s.alias(f"h{k}") for k, s in enumerate(seeds(F.col("doc_id"), seed), 1)])
    out = (
        T.StructType([docs.schema["doc_id"]]).add("n", "long").add("form", "string").add("prefix_chars", "long")
        .add("middle_chars", "long").add("output", "string").add("n_segments", "long")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _texts(batch):
                place, first = boundaries(data, offsets)
                index = RankIndex.fit(place, first, error)
                n = np.diff(first) - 1
                picks = np.stack([part.column(k).to_numpy() for k in range(2, 6)], axis=1)
                cuts = np.sort(picks[:, :2] % (n + 1)[:, None], axis=1) + first[:-1, None]
                a, b = index.locate(cuts[:, 0]), index.locate(cuts[:, 1])
                chars, raw = _chars(data), data.tobytes()
                forms, texts = _forms(part.column(1), picks, form_percent, spm_percent), []
                for form, lo, x, y, hi in zip(forms, offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), strict=True):
                    if form == "plain":
                        texts.append(raw[lo:hi])
                    elif form == "psm":
                        texts.append(b"<P>" + raw[lo:x] + b"<S>" + raw[y:hi] + b"<M>" + raw[x:y])
                    else:
                        texts.append(b"<S>" + raw[y:hi] + b"<P>" + raw[lo:x] + b"<M>" + raw[x:y])
                plain = np.array([f == "plain" for f in forms])
                segments = np.searchsorted(index.rank, first[1:]) - np.searchsorted(index.rank, first[:-1])
                yield pa.record_batch([
                    part.column(0), pa.array(n), pa.array(forms, pa.string()), pa.array(chars[a] - chars[offsets[:-1]], mask=plain),
                    pa.array(chars[b] - chars[a], mask=plain), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(segments),
                ], names=out.names)

    return rows.mapInArrow(run, out)


def rank_index(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """The index itself, to be stored beside the texts: (doc_id, n, segments, residuals).

    ``segments`` are structs of rank, place, run and steps, places counting bytes from the text's
    start; ``residuals`` holds a signed byte for every boundary from rank 0 to n (little-endian
    16-bit or wider numbers if ``error`` is more than 127).
    """
    segment = T.StructType([T.StructField(name, T.LongType()) for name in ("rank", "place", "run", "steps")])
    out = T.StructType([docs.schema["doc_id"]]).add("n", "long").add("segments", T.ArrayType(segment)).add("residuals", "binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in _texts(batch):
                place, first = boundaries(data, offsets)
                index = RankIndex.fit(place, first, error)
                at = np.searchsorted(index.rank, first)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(at))
                parts = [pa.array(x) for x in (index.rank - first[owner], index.place - offsets[owner], index.run, index.steps)]
                segments = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(parts, ["rank", "place", "run", "steps"]))
                stored = [index.residual[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.record_batch([part.column(0), pa.array(np.diff(first) - 1), segments, pa.array(stored, pa.binary())], names=out.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form. Markers occur once each: marked texts stay plain."""

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
