"""Benchmark decontamination by greedy string tiling.

A benchmark item leaks into a document when tiles cover at least ``coverage`` of the item's
words. A tile is a run of at least ``min_match`` equal words at one place of the item and one of
the document; no word of either is in two tiles. The longest match is marked first (ties: the
earliest in the item, then in the document), whatever it overlaps is cut down, and this repeats
until nothing of ``min_match`` words is left. As tiles may come in any order, a passage whose
sentences were moved about is found like the original.

Seeds are the Karp-Rabin hashes of all runs of ``min_match`` words. The benchmark's seeds are an
index that every task gets; a document's seeds run past it, those that hit are joined with the
item places that hold them, and neighbouring hits on one diagonal are one match. Matches grow word
by word of the item, so a seed that repeats in both is never expanded to all pairs of its places.
Pairs whose hits cannot cover enough of the item are left out before tiling. A benchmark of at
most ``BLOCK_BYTES`` of text is such an index. The seeds of a larger one are joined with those of
the documents by a shuffle, which leaves the pairs of a document and an item that share enough of
them, and only those are tiled; nothing of it passes through the driver.

Words are runs of letters and digits, A-Z lower-cased, so punctuation does not hide a leak.

Defined results: null or empty texts leak nothing. An item of fewer than ``min_match`` words
cannot be found. Rows that repeat are reported each. An empty benchmark leaks nowhere. Other
columns are not read by ``leaks``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.frames import free_name, renamed, tidy
from lorebase.llm.words import NOT_ALNUM, Words, as_bytes, pieces
from lorebase.session import materialize

MIN_MATCH = 5
COVERAGE = 0.8
BLOCK_BYTES = 8 << 20
SIEVE_BITS = 22


class SeedIndex:
    """The seeds of one block of benchmark items and the places that hold them."""

    def __init__(self, ids: list, texts: pa.Array, min_match: int):
        data, offsets = as_bytes(texts)
        words = Words(data, offsets, NOT_ALNUM)
        seed, at = words.grams(min_match)
        order = np.argsort(seed, kind="stable")
        self.ids, self.length, self.min_match = ids, words.count, min_match
        self.seed, first = np.unique(seed[order], return_index=True)
        self.first = np.append(first, len(seed))
        self.item, self.place = words.doc[at][order], (at - words.first[words.doc[at]])[order]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(self.seed >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word of the text, seed) of every seed found."""
        seed, at = words.grams(self.min_match)
        maybe = np.flatnonzero(self.sieve[(seed >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        if not len(maybe) or not len(self.seed):
            return (np.zeros(0, np.int64),) * 3
        seed, at = seed[maybe], at[maybe]
        where = np.minimum(np.searchsorted(self.seed, seed), len(self.seed) - 1)
        real = self.seed[where] == seed
        at, where = at[real], where[real]
        return words.doc[at], at - words.first[words.doc[at]], where

    def pairs(self, word: np.ndarray, seed: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """(item, its places with a seed of the text, the text's places of each) by item."""
        order = np.argsort(seed, kind="stable")
        seeds, first = np.unique(seed[order], return_index=True)
        held = np.split(word[order], first[1:])
        count = self.first[seeds + 1] - self.first[seeds]
        flat = np.repeat(self.first[seeds] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item, place, which = self.item[flat], self.place[flat], np.repeat(np.arange(len(seeds)), count)
        order = np.lexsort((place, item))
        cut = np.flatnonzero(np.diff(item[order], prepend=-1))
        for part in np.split(order, cut[1:]):
            yield int(item[part[0]]), place[part], [held[k] for k in which[part]]

    def leaks(self, texts: pa.Array, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(text, item, tiles) for every leak."""
        data, offsets = as_bytes(texts)
        for lo, hi in pieces(offsets):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], NOT_ALNUM)
            text, word, seed = self.hits(words)
            if not len(text):
                continue
            cut = np.flatnonzero(np.diff(text, prepend=-1))
            for part in np.split(np.arange(len(text)), cut[1:]):
                for item, place, at in self.pairs(word[part], seed[part]):
                    needed = coverage * int(self.length[item])
                    if covered(place, self.min_match) < needed:
                        continue
                    tiles = tile(place, at, self.min_match)
                    if sum(n for _, _, n in tiles) >= needed:
                        yield lo + int(text[part[0]]), item, tiles


def covered(places: np.ndarray, length: int) -> int:
    """Words in the union of runs of ``length`` from each of the sorted ``places``."""
    return int(np.minimum(np.diff(places, append=places[-1] + length), length).sum())


def matches(place: np.ndarray, at: list[np.ndarray], min_match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, place in the item, place in the text) of the longest equal runs from each start.

    ``at`` has the sorted places of the text where the run of ``min_match`` words from each of the
    sorted ``place`` is found. Only the runs that reach the last place are held.
    """
    found, before, ends, starts = [], -2, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def closed(which: np.ndarray) -> None:
        length = before - starts[which]
        found.append(np.stack([length + min_match, starts[which], ends[which] - length]))

    for p, here in zip(place, at):
        if p != before + 1:
            closed(np.arange(len(ends)))
            ends, starts = ends[:0], starts[:0]
        where = np.minimum(np.searchsorted(ends, here - 1), max(len(ends) - 1, 0))
        goes_on = ends[where] == here - 1 if len(ends) else np.zeros(len(here), bool)
        stops = np.ones(len(ends), bool)
        stops[where[goes_on]] = False
        closed(np.flatnonzero(stops))
        begun = np.full(len(here), p, np.int64)
        begun[goes_on] = starts[where[goes_on]]
        before, ends, starts = int(p), here, begun
    closed(np.arange(len(ends)))
    return tuple(np.concatenate(found, axis=1))


def tile(place: np.ndarray, at: list[np.ndarray], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the text, words) from equal runs of ``min_match`` words."""
    runs = matches(place, at, min_match)
    order = np.lexsort((runs[2], runs[1], -runs[0]))
    longest = zip(*(r[order].tolist() for r in runs))
    used_item = np.zeros(int(place.max()) + min_match, bool)
    base = min(int(x[0]) for x in at)
    used_text = np.zeros(max(int(x[-1]) for x in at) - base + min_match, bool)
    tiles, heap, room = [], [], len(used_item)
    run = next(longest, None)
    while (run or heap) and room >= min_match:
        # Whole matches come sorted; what is left of those cut down waits in the heap.
        if heap and (run is None or heap[0] < (-run[0], run[1], run[2])):
            n, p, a = heapq.heappop(heap)
            n = -n
        else:
            (n, p, a), run = run, next(longest, None)
        taken = used_item[p : p + n] | used_text[a - base : a - base + n]
        if not taken.any():
            used_item[p : p + n] = used_text[a - base : a - base + n] = True
            room -= n
            tiles.append((p, a, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if hi - lo >= min_match:
                heapq.heappush(heap, (lo - hi, p + lo, a + lo))
    return tiles


LEAK = "item_id long, n_words long, n_covered long, tiles array<struct<item_word: int, doc_word: int, n_words: int>>"
TILES = pa.list_(pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))


def _items(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return renamed(bench, item_id=id_col, text=text_col).filter("text IS NOT NULL").withColumn("item_id", F.col("item_id").cast("long"))


def small_index(items: DataFrame, min_match: int, most: int = BLOCK_BYTES) -> SeedIndex | None:
    """The index of a benchmark that is measured to be small, with its rows: a row counts 64 bytes more than its text."""
    size = items.select(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    if size > most:
        return None
    rows = items.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
    return SeedIndex(rows.column("item_id").to_pylist(), rows.column("text").combine_chunks().cast(pa.string()), min_match)


def _found(ids: pa.Array, index: SeedIndex, found: list) -> list[pa.Array]:
    """The columns of ``LEAK`` behind the texts' ids."""
    return [
        ids.take(pa.array([d for d, _, _ in found], pa.int64())),
        pa.array([index.ids[i] for _, i, _ in found], pa.int64()),
        pa.array([int(index.length[i]) for _, i, _ in found], pa.int64()),
        pa.array([sum(n for _, _, n in t) for _, _, t in found], pa.int64()),
        pa.array([[{"item_word": p, "doc_word": a, "n_words": n} for p, a, n in sorted(t)] for _, _, t in found], TILES),
    ]


def _seeds(texts: DataFrame, key: str, min_match: int) -> DataFrame:
    """(key, seed, n, length): the seeds of each text once, how often it has them, and its words."""

    def run(batches):
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for lo, hi in pieces(offsets):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], NOT_ALNUM)
                seed, at = words.grams(min_match)
                order = np.lexsort((seed, words.doc[at]))
                seed, doc = seed[order], words.doc[at][order]
                first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(seed, prepend=seed[:1] + np.uint64(1)) != 0))
                columns = batch.column(key).take(pa.array(lo + doc[first])), pa.array(seed[first].view(np.int64))
                n = np.diff(np.append(first, len(seed)))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(words.count[doc[first]])], names=[key, "seed", "n", "length"])

    return texts.select(key, "text").mapInArrow(tidy(run), f"{key} long, seed long, n long, length long")


def leaks_by_shuffle(rows: DataFrame, items: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """(row, LEAK) for ``rows(row, text)`` and ``items(item_id, text)`` of any number. Both are written tables.

    A seed found covers at most ``min_match`` words of an item at each of its places there, so a
    pair with too few of them cannot reach the coverage.
    """
    numbered = materialize(items.withColumn("item", F.monotonically_increasing_id()), "bench-items")
    have = _seeds(rows, "row", min_match).select("row", "seed")
    hits = have.join(_seeds(numbered, "item", min_match), "seed").groupBy("row", "item")
    hits = hits.agg((F.sum("n") * min_match).alias("most"), F.max("length").alias("length"))
    pairs = materialize(hits.filter(F.col("most") >= F.lit(coverage) * F.col("length")).select("row", "item"), "bench-pairs")
    texts = pairs.join(rows, "row").join(numbered.select("item", "item_id", F.col("text").alias("said")), "item")

    def run(batches):
        for batch in batches:
            parts = []
            for k in range(batch.num_rows):
                index = SeedIndex(batch.column("item_id").slice(k, 1).to_pylist(), batch.column("said").slice(k, 1), min_match)
                found = list(index.leaks(batch.column("text").slice(k, 1), coverage))
                parts.append(pa.record_batch(_found(batch.column("row").slice(k, 1), index, found), names=["row", "item_id", "n_words", "n_covered", "tiles"]))
            yield from parts

    return texts.select("row", "text", "item_id", "said").mapInArrow(tidy(run), f"row long, {LEAK}")


def leaks(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, n_words of the item, n_covered, tiles) for every item that leaks into a document."""
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    items = _items(bench, item_col, item_text_col)
    index = small_index(items, min_match, block_bytes)
    if index is None:
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "bench-rows")
        return leaks_by_shuffle(rows, items, min_match, coverage).join(rows.select("row", "doc_id"), "row").select("doc_id", "item_id", "n_words", "n_covered", "tiles")

    def run(batches):
        for batch in batches:
            found = list(index.leaks(batch.column("text"), coverage))
            yield pa.RecordBatch.from_arrays(_found(batch.column("doc_id"), index, found), names=["doc_id", "item_id", "n_words", "n_covered", "tiles"])

    return rows.mapInArrow(tidy(run), f"doc_id long, {LEAK}")


def is_clean(index: SeedIndex, text: Column, coverage: float = COVERAGE) -> Column:
    """Whether no item of ``index`` leaks into ``text``, as a column for any frame."""

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        out[[d for d, _, _ in index.leaks(texts, coverage)]] = False
        return pa.array(out)

    return clean(text)


def without_leaks(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, whatever their other columns are called."""
    items = _items(bench, item_col, item_text_col)
    index = small_index(items, min_match, block_bytes)
    if index is not None:
        return docs.filter(is_clean(index, docs[f"`{text_col}`"], coverage))
    row = free_name(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "bench-rows")
    found = leaks_by_shuffle(renamed(numbered, row=row, text=text_col), items, min_match, coverage)
    gone = found.select(F.col("row").alias(row)).distinct()
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
