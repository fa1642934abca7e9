"""Removal of byte strings that occur twice, by prefix-free parsing of the whole corpus.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes, judged on
the input. What a suffix array of the corpus would show as neighbours with a common prefix of
``length`` bytes is found without ever sorting the corpus:

1. **Triggers.** A rolling hash runs over every text. The trigger of a string of ``length``
   bytes is the place of its least hash of ``GRAM`` bytes (ties: the first). It depends on the
   string alone, so two equal strings have it at the same offset.
2. **Phrases.** Neighbouring starts whose strings have the same trigger at an offset in the same
   range of ``RANGE`` make a phrase: all the bytes of these strings. The part that they all
   share, of length-RANGE+1 bytes, is the phrase's core. Equal strings have equal cores, so a
   core met once settles its up to ``RANGE`` starts at one stroke.
3. **Dictionary.** Phrases whose core occurs again are grouped by (core, phrase). A phrase that
   occurs twice makes all of its strings repeats: this settles the inside of every long copy.
   Only entries that share a core with other entries stay open, at the edges of copies.
4. **Order.** The strings of the open dictionary entries, one occurrence each, are brought
   together by (core, hash of the string), as neighbours in the order of suffixes would be, and
   those of two entries are repeats.
5. **Parse.** The marks go back to the phrases of each document and its bytes are cut.

Strings are compared by a core and a string hash of 64 bits each. All groups are counted with
map-side sums and joined back; no key, however frequent, is gathered anywhere. A text is read in
windows of a megabyte, so its length is no bound on memory for the search.

Matches do not cross documents. Defined results: a null or empty text has no bytes; a text
shorter than ``length`` loses nothing. Repeated rows, with or without doc_id, are documents of
their own and so copies of each other. Other columns are not read. What is left need not be valid
UTF-8, so it is returned as binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.words import LETTER_CODE, as_bytes, mix
from lorebase.session import broadcast_if_small, materialize

LENGTH = 400
GRAM = 16
RANGE = 64
WINDOW = 1 << 20
PLACE_BITS = 22

_BASE = np.uint64(0x2545F4914F6CDD1D)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Rolling:
    """Hashes of any stretch of some bytes, from sums of powers modulo 2**64."""

    powers = back = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Rolling.powers) < n:
            for name, base in (("powers", _BASE), ("back", _BACK)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(steps))
        self.sum = np.zeros(n, np.uint64)
        np.cumsum(LETTER_CODE[data] * Rolling.powers[: n - 1], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * Rolling.back[start] + (end - start).astype(np.uint64))


def windows(offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of texts (text, begin, end) to read together, cut so that each start is in one of them."""
    text, begin, end, size = [], [], [], 0
    for k in range(len(offsets) - 1):
        n = int(offsets[k + 1] - offsets[k])
        for at in range(0, max(n - length + 1, 0), WINDOW):
            stop = min(at + WINDOW + length - 1, n)
            if size and size + stop - at > WINDOW + length:
                yield np.array(text), np.array(begin), np.array(end)
                text, begin, end, size = [], [], [], 0
            text.append(k)
            begin.append(at)
            end.append(stop)
            size += stop - at
    if text:
        yield np.array(text), np.array(begin), np.array(end)


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def phrases(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first start, number of starts, core, phrase) of all phrases."""
    data, offsets = as_bytes(texts)
    width = length - GRAM + 1
    for text, begin, end in windows(offsets, length):
        size = end - begin
        first = np.cumsum(size) - size
        raw = np.concatenate([data[offsets[t] + b : offsets[t] + e] for t, b, e in zip(text, begin, end)])
        rolling = Rolling(raw)
        at = np.arange(len(raw) - GRAM + 1)
        place = np.uint64((1 << PLACE_BITS) - 1)
        gram = (rolling.of(at, at + GRAM) & ~place) | at.astype(np.uint64)
        trigger = (sliding_least(gram, width) & place).astype(np.int64)
        piece = np.repeat(np.arange(len(size)), size)
        start = np.flatnonzero(piece[: len(trigger)] == piece[length - 1 :])
        trigger = trigger[start]
        part = (trigger - start) // RANGE
        fresh = (np.diff(start, prepend=-2) != 1) | (np.diff(trigger, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0)
        fresh |= np.diff(piece[start], prepend=-1) != 0
        head = np.flatnonzero(fresh)
        count = np.diff(head, append=len(start))
        lo, anchor, part = start[head], trigger[head], part[head]
        core_at = anchor - part * RANGE
        core = rolling.of(core_at, core_at + length - RANGE + 1)
        whole = rolling.of(lo, lo + count - 1 + length) + (anchor - lo).astype(np.uint64)
        own = piece[lo]
        yield text[own], lo - first[own] + begin[own], count, mix(core + part.astype(np.uint64)), mix(whole)


def string_hashes(raw: np.ndarray, start: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the strings of some phrases of one text."""
    every = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    out = np.zeros(len(every), np.uint64)
    for lo in range(0, len(raw), WINDOW):
        here = np.flatnonzero((every >= lo) & (every < lo + WINDOW))
        if len(here):
            at = every[here] - lo
            out[here] = Rolling(raw[lo : lo + WINDOW + length]).of(at, at + length)
    return every, out


def phrase_table(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, mark, first, n, core, phrase): all phrases of ``docs`` (doc_id, mark, text)."""

    def run(batches):
        for batch in batches:
            for text, first, count, core, phrase in phrases(batch.column("text"), length):
                take = pa.array(text)
                columns = [batch.column("doc_id").take(take), batch.column("mark").take(take), pa.array(first.astype(np.int32))]
                columns += [pa.array(count.astype(np.int16)), pa.array(core.view(np.int64)), pa.array(phrase.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "first", "n", "core", "phrase"])

    return docs.mapInArrow(run, "doc_id long, mark long, first int, n short, core long, phrase long")


def _on(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, mark); a missing doc_id equals a missing doc_id."""
    right = right.withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"})
    return left.join(right, (left["mark"] == right["_mark"]) & left["doc_id"].eqNullSafe(right["_doc"]), how).drop("_doc", "_mark")


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, mark, first, n): runs of starts whose strings occur elsewhere, too."""
    all_phrases = phrase_table(docs, length)
    # Written, so that the join below has two plain shuffles, of which the engine can split a frequent core.
    cores = materialize(all_phrases.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1").select("core"), "cores")
    open_ = materialize(all_phrases.join(cores, "core"), "phrases")
    dictionary = open_.groupBy("core", "phrase").agg(F.count("*").alias("uses"), F.min(F.struct("doc_id", "mark", "first", "n")).alias("at"))
    dictionary = materialize(dictionary, "dictionary")
    often = dictionary.filter("uses > 1").select("core", "phrase")
    settled = open_.join(often, ["core", "phrase"]).select("doc_id", "mark", "first", "n")

    several = dictionary.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1").select("core")
    entries = dictionary.join(several, "core").select("at.*", "core", (F.col("uses") == 1).alias("single"))
    wanted = entries.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "n", "core", "single")).alias("entries"))
    wanted = materialize(wanted, "dictionary-texts")

    def strings(batches):
        for batch in batches:
            entries = batch.column("entries")
            texts = batch.column("text").cast(pa.binary())
            for k in range(batch.num_rows):
                fields = entries[k].values
                first, n, core, single = (fields.field(c).to_numpy(zero_copy_only=False) for c in ("first", "n", "core", "single"))
                n = n.astype(np.int64)
                start, value = string_hashes(np.frombuffer(texts[k].as_py(), np.uint8), first.astype(np.int64), n, length)
                columns = [batch.column("doc_id").take(pa.array(np.full(len(start), k))), batch.column("mark").take(pa.array(np.full(len(start), k)))]
                columns += [pa.array(start.astype(np.int32)), pa.array(np.repeat(core, n)), pa.array(value.view(np.int64)), pa.array(np.repeat(single, n))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "first", "core", "string", "single"])

    texts = _on(docs, broadcast_if_small(wanted), "inner").select("doc_id", "mark", "text", "entries")
    found = texts.mapInArrow(strings, "doc_id long, mark long, first int, core long, string long, single boolean")
    found = materialize(found, "strings")
    twice = found.groupBy("core", "string").agg(F.count("*").alias("k")).filter("k > 1").select("core", "string")
    edges = found.filter("single").join(twice, ["core", "string"]).select("doc_id", "mark", "first", F.lit(1).cast("short").alias("n"))
    return settled.unionByName(edges)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept), a row for every row of ``docs``.

    ``spans`` holds the removed runs as (start, end) in bytes, ``kept`` the other bytes.
    """
    if length < GRAM + RANGE:
        raise ValueError(f"length must be at least {GRAM + RANGE}")
    docs = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("doc_id", "text"))
    marks = repeated_starts(docs, length).distinct().groupBy("doc_id", "mark")
    marks = materialize(marks.agg(F.collect_list(F.struct("first", "n")).alias("runs")), "repeats")

    def cut(batches):
        for batch in batches:
            texts, runs = batch.column("text").cast(pa.binary()), batch.column("runs")
            sizes, removed, spans, kept = [], [], [], []
            for k in range(batch.num_rows):
                raw = texts[k].as_py() or b""
                sizes.append(len(raw))
                if not runs[k].is_valid:
                    removed.append(0)
                    spans.append([])
                    kept.append(raw)
                    continue
                fields = runs[k].values
                first = fields.field("first").to_numpy(zero_copy_only=False).astype(np.int64)
                step = np.zeros(len(raw) + 1, np.int32)
                np.add.at(step, first, 1)
                np.add.at(step, first + fields.field("n").to_numpy(zero_copy_only=False) - 1 + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                removed.append(int(gone.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(list(map(len, spans)), pa.int64())]
            columns += [pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary"
    return _on(docs, marks, "left").select("doc_id", "text", "runs").mapInArrow(cut, schema)
