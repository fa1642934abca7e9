"""Phrase collocations by dynamic itemset counting.

The texts are written once in ``SHARDS`` shards, which are scanned in turn, again and again. A scan
counts phrases of all lengths at once: a single word from the first scan on, a longer phrase from
the scan after both of its subphrases (all but its last word, all but its first) have reached the
threshold, each until it reaches the threshold too, for one full cycle at most. Scanning ends when
every phrase that became active has completed its cycle or reached the threshold. So a phrase that
is frequent in every shard is found along with its subphrases, not a whole pass later.

The scans count hashes of phrases, not phrases: phrases that share one only reach the threshold too
early. A last pass over all shards then counts the phrases themselves, all occurrences of those that
reached it, which are few and exact; the others cannot be frequent. Every task of that pass gives a
row for each frequent phrase that it meets, so there are as many tasks as the cluster keeps busy,
however large the input: more would repeat the same phrases.

What has reached the threshold is told to the tasks by a table of one byte for each of
``1 << BITS`` hash buckets: the first scan after which a phrase of that bucket had reached it. Its
size does not grow with the data. A phrase has two buckets, and counts as reached when both are.
Phrases that share both with others may become active without need, but never too late or for too
short: the table only saves work. The last pass groups occurrences by a 64-bit hash of their words
and compares a second one, in buffers of at most ``HELD`` phrases; from there on the phrases
themselves are the keys.

Languages are kept apart; a null language counts as ``und``. A null or empty text has no words, a
repeated row counts as often as it occurs, and only text and lang are read, whatever other columns
there are. No texts give no rows. A long text is cut at the end of a piece, which no phrase crosses.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.words import LOWER, PIECE_BYTES, Words, as_bytes, mix, pieces
from lorebase.operators.ordering import best_within
from lorebase.session import broadcast_if_small, materialize, new_work_path

THRESHOLD, LONGEST, TOP = 100, 5, 2000
SHARDS = 3
BITS = 24
HELD = 1 << 19
TALLY = 1 << 22
"""Occurrences that a task of a scan holds before it counts them."""
NEVER = 255
TASKS_PER_CORE = 2
"""Tasks of the last pass."""
ROWS_PER_PART = 100_000

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
"""Ends of pieces: ``[.,;:!?\\x0A-\\x0D]``."""
SEPARATOR = BREAK.copy()
SEPARATOR[[0x20, 0x09]] = True

COUNTED = "lang string, words int, hash long, since int, phrase string, n long"
TALLIED = "key long, n long"
"""A key is the first 48 bits of a phrase's hash, then its number of words and the scan it waited for, a byte each."""


def _runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the texts, their bounds) of about a megabyte each; a longer text is cut behind ends of pieces."""
    for lo, hi in pieces(offsets):
        bounds = offsets[lo : hi + 1]
        if bounds[-1] - bounds[0] > 2 * PIECE_BYTES:
            ends = np.flatnonzero(BREAK[data[bounds[0] : bounds[-1]]]) + 1 + bounds[0]
            cut = int(bounds[0])
            while cut < bounds[-1]:
                at = np.searchsorted(ends, cut + PIECE_BYTES)
                after = int(ends[at]) if at < len(ends) else int(bounds[-1])
                yield np.array([lo]), np.array([cut, after])
                cut = after
        else:
            yield np.arange(lo, hi), bounds


def _reached(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The scan after which both buckets of each key had reached the threshold, or ``NEVER``."""
    bits = len(table).bit_length() - 1
    scan = table[key >> np.uint64(64 - bits)]
    at = np.flatnonzero(scan != NEVER)
    scan[at] = np.maximum(scan[at], table[key[at] >> np.uint64(16) & np.uint64(len(table) - 1)])
    return scan


class Occurrences:
    """The phrases of a run of texts that are active in a scan.

    With ``told`` only those whose own buckets have reached the threshold (True) or have not (False).
    """

    def __init__(self, words: Words, code: np.ndarray, reached: np.ndarray, scan: int, shards: int, longest: int, told: bool | None = None):
        self.words = words
        n = len(words.hash)
        breaks = np.cumsum(BREAK[words.data], dtype=np.int32)[words.start] if n else np.zeros(0, np.int32)
        joined = (words.doc[1:] == words.doc[:-1]) & (breaks[1:] == breaks[:-1])
        key = mix(words.hash ^ code[words.doc])
        check = words.hash * np.uint64(0xD6E8FEB86659FD93) + (words.end - words.start).astype(np.uint64)
        since = _reached(reached, key).astype(np.int64)
        now = np.arange(n) if told is None else np.flatnonzero((since != NEVER) == told)
        found = [(now, 1, key[now], check[now], np.zeros(len(now), np.int64))] if scan <= shards else []
        held, held_check = key.copy(), check.copy()
        for k in range(2, longest + 1):
            if len(since) < 2:
                break
            # Position i stands for the phrase of k words from word i on; its subphrases are those of k - 1 words at i and i + 1.
            since = np.maximum(since[:-1], since[1:])
            if k == 2:
                since[~joined] = NEVER
            at = np.flatnonzero(since != NEVER)
            held[at] = mix(held[at] * np.uint64(0x9FB21C651E98DF25) + words.hash[at + k - 1])
            held_check[at] = held_check[at] * np.uint64(0xA24BAED4963EE407) + (words.hash[at + k - 1] ^ np.uint64(k))
            own = _reached(reached, held[at])
            active = scan <= since[at] + shards
            now = at[active if told is None else active & ((own != NEVER) == told)]
            found.append((now, k, held[now], held_check[now], since[now]))
            if k < longest:
                reach = np.full(len(since), NEVER, np.int64)
                # Not before it is counted itself: the buckets may have been other phrases' earlier, and the cycle of
                # a phrase one word longer, which begins when this one is seen, would then end too soon.
                reach[at] = np.maximum(own, since[at])
                since = reach
        self.first = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
        self.size = np.concatenate([np.full(len(f[0]), f[1]) for f in found] or [np.zeros(0, np.int64)])
        self.key = np.concatenate([f[2] for f in found] or [np.zeros(0, np.uint64)])
        self.check = np.concatenate([f[3] for f in found] or [np.zeros(0, np.uint64)])
        self.since = np.concatenate([f[4] for f in found] or [np.zeros(0, np.int64)])

    def keys(self) -> np.ndarray:
        return self.key & ~np.uint64(0xFFFF) | (self.size << 8 | self.since).astype(np.uint64)

    def grouped(self) -> tuple[np.ndarray, np.ndarray]:
        """(one occurrence of each phrase, ordered by key; its number of occurrences)."""
        order = np.argsort(self.key)
        key, check = self.key[order], self.check[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = key[1:] != key[:-1]
        if (~fresh[1:] & (check[1:] != check[:-1])).any():
            order = np.lexsort((self.check, self.key))
            key, check = self.key[order], self.check[order]
            fresh[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        at = np.flatnonzero(fresh)
        return order[at], np.diff(np.append(at, len(order)))

    def phrases(self, which: np.ndarray) -> pa.Array:
        """Their words in lower case, joined by one blank."""
        size = self.size[which]
        begin = np.cumsum(size) - size
        word = np.repeat(self.first[which], size) + np.arange(size.sum()) - np.repeat(begin, size)
        length = self.words.end[word] - self.words.start[word] + 1  # and a blank
        ends = np.cumsum(length)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(self.words.start[word], length)
        letters = LOWER[self.words.data[np.minimum(place, len(self.words.data) - 1)]]
        letters[ends - 1] = 0x20
        stops = ends[begin + size - 1]
        letters = np.delete(letters, stops - 1)  # no blank behind the last word
        offsets = np.concatenate([[0], stops - np.arange(1, len(stops) + 1)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(letters.tobytes()))


class Buffer:
    """Phrases of a task with their counts so far."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.langs = schema, {}
        self._clear()

    def _clear(self) -> None:
        self.key, self.check, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.n, self.chunks = np.zeros(0, np.int64), []

    def add(self, found: Occurrences, langs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count the occurrences; ``langs`` has the language of each text. Yields what must leave the buffer."""
        one, n = found.grouped()
        key, check = found.key[one], found.check[one]
        at = np.searchsorted(self.key, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == key[inside]
        same = known.copy()
        same[known] = self.check[at[known]] == check[known]
        self.n[self.slot[at[same]]] += n[same]
        # Phrases whose key is another's leave at once: the buffer holds one of a key.
        twice = np.zeros(len(key), bool)
        twice[1:] = key[1:] == key[:-1]
        apart = (known & ~same) | (~known & twice)
        new = ~known & ~twice
        if apart.any():
            yield self._batch([self._rows(found, one[apart], langs)], n[apart])
        if new.any():
            self.chunks.append(self._rows(found, one[new], langs))
            slots = np.arange(len(self.n), len(self.n) + new.sum())
            self.key, self.check = np.insert(self.key, at[new], key[new]), np.insert(self.check, at[new], check[new])
            self.slot, self.n = np.insert(self.slot, at[new], slots), np.concatenate([self.n, n[new]])
        if len(self.n) > HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if len(self.n):
            yield self._batch(self.chunks, self.n)
        self._clear()

    def _rows(self, found: Occurrences, which: np.ndarray, langs: np.ndarray) -> tuple:
        return langs[found.words.doc[found.first[which]]], found.size[which], found.key[which], found.since[which], found.phrases(which)

    def _batch(self, chunks: list[tuple], n: np.ndarray) -> pa.RecordBatch:
        lang, size, key, since = (np.concatenate([c[k] for c in chunks]) for k in range(4))
        columns = pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(key.view(np.int64)), pa.array(since, pa.int32())
        return pa.record_batch([*columns, pa.concat_arrays([c[4] for c in chunks]), pa.array(n)], schema=self.schema)


def _found(load: Callable[[], np.ndarray], batches: Iterable[pa.RecordBatch], *how, **told) -> Iterator[tuple[Occurrences, np.ndarray]]:
    """(phrases, language of each text) of runs of texts."""
    reached = load()
    for batch in batches:
        langs = batch.column(0).to_numpy(zero_copy_only=False)
        codes = batch.column(1).to_numpy().view(np.uint64)
        data, offsets = as_bytes(batch.column(2))
        for texts, bounds in _runs(data, offsets):
            words = Words(data[bounds[0] : bounds[-1]], bounds - bounds[0], SEPARATOR)
            yield Occurrences(words, codes[texts], reached, *how, **told), langs[texts]


def _tally(load: Callable[[], np.ndarray], scan: int, shards: int, longest: int):
    """Keys of the active phrases that have not reached the threshold, with their numbers of occurrences."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found, _ in _found(load, batches, scan, shards, longest, told=False):
            held.append(found.keys())
            size += len(held[-1])
            if size >= TALLY:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    return run


def _count(load: Callable[[], np.ndarray], longest: int):
    """All occurrences of the phrases whose buckets have reached the threshold; words are 0 where n has all words of a language."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in COUNTED.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, all_words = Buffer(schema), Counter()
        for found, langs in _found(load, batches, 1, 1, longest, told=True):
            yield from held.add(found, langs)
            for lang, n in zip(langs, found.words.count.tolist()):
                all_words[lang] += n
        yield from held.flush()
        totals = [{"lang": lang, "words": 0, "hash": 0, "since": 0, "phrase": "", "n": n} for lang, n in all_words.items() if n]
        yield pa.RecordBatch.from_pylist(totals, schema)

    return run


def reachable(shard_of: DataFrame, threshold: int, longest: int, shards: int, bits: int) -> np.ndarray:
    """The table of buckets after scans of all shards in turn: below ``NEVER`` where a phrase may have reached the threshold."""
    spark = shard_of.sparkSession
    reached = np.full(1 << bits, NEVER, np.uint8)
    counts, scan, last = None, 0, 0
    words, since = F.shiftright("key", 8).bitwiseAND(F.lit(0xFF)), F.col("key").bitwiseAND(F.lit(0xFF))
    while scan < shards or scan < last + shards:
        scan += 1
        told = spark.sparkContext.broadcast(zlib.compress(reached, 1))
        shard = shard_of.filter(F.col("shard") == (scan - 1) % shards).select("lang", "code", "text")
        seen = shard.mapInArrow(_tally(lambda told=told: np.frombuffer(zlib.decompress(told.value), np.uint8), scan, shards, longest), TALLIED)
        rows = seen if counts is None else seen.unionByName(counts)
        summed = rows.groupBy("key").agg(F.sum("n").alias("n"))
        often = F.col("n") >= threshold
        summed = materialize(summed.filter(often | (since + shards > scan)), "phrases")
        told.destroy()
        counts = summed.filter(~often)
        both = F.array(F.shiftrightunsigned("key", 64 - bits), F.shiftrightunsigned("key", 16).bitwiseAND(F.lit((1 << bits) - 1)))
        buckets = summed.filter(often).select(F.explode(both.cast("array<int>")).alias("bucket"), (words < longest).alias("grows")).distinct().toArrow()  # at most two for each byte of the table
        new, grows = buckets.column(0).to_numpy(), buckets.column(1).to_numpy()
        if grows.any():
            last = scan
        reached[new] = np.minimum(reached[new], scan)
    return reached


def frequent_phrases(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, bits: int = BITS
) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of all phrases found ``threshold`` times or more, (lang, n) with all words' number)."""
    if not 1 <= shards * longest < NEVER or threshold < 1:
        raise ValueError("shards x longest must stay below 255, and the threshold be positive")
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    texts = texts.select("lang", F.xxhash64("lang").alias("code"), "text", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
    path = new_work_path(spark, "shards")
    texts.write.partitionBy("shard").parquet(path)
    shard_of = spark.read.schema(texts.schema).parquet(path)

    reached = reachable(shard_of, threshold, longest, shards, bits)
    told = spark.sparkContext.broadcast(zlib.compress(np.where(reached == NEVER, NEVER, 0).astype(np.uint8), 1))
    every = shard_of.select("lang", "code", "text").coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    counted = every.mapInArrow(_count(lambda: np.frombuffer(zlib.decompress(told.value), np.uint8), longest), COUNTED)
    summed = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    summed = materialize(summed.filter((F.col("words") == 0) | (F.col("n") >= threshold)), "phrases")
    told.destroy()
    frequent = summed.filter("words > 0").select("lang", "words", "phrase", F.col("n").alias("f"))
    return frequent, summed.filter("words = 0").select("lang", "n")


def _joined(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of two words or more, by its lowest-scoring cut."""
    known = materialize(frequent.join(broadcast_if_small(materialize(totals, "totals")), "lang"), "frequent")
    words, cut = F.split("phrase", " "), F.col("cut")
    cuts = known.filter("words >= 2").select("lang", "phrase", F.col("f").alias("a"), "n", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "n", "cut", _joined(F.col("w"), F.lit(1), cut).alias("first"), _joined(F.col("w"), cut + 1, F.size("w") - cut).alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    a, n, l, r = (F.col(c).cast("decimal(19,0)") for c in "anlr")
    both = both.withColumn("above", F.lit(1000).cast("decimal(4,0)") * a * n).withColumn("below", l * r)
    both = both.withColumn("score", F.expr("above div below"))
    worst = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_c"))
    return worst.select("lang", "phrase", "a", "_c.l", "_c.r", "n", "_c.score")


def absorbed(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a) of the phrases that never occur outside of one longer phrase.

    It is enough to look one word further: what lies inside a longer phrase as often as anywhere
    also lies as often inside that phrase's part of one word more.
    """
    words = F.split("phrase", " ")
    longer = frequent.filter("words >= 3").select("lang", F.col("f").alias("a"), "words", words.alias("w"))
    less = F.col("words") - 1
    parts = F.array(_joined(F.col("w"), F.lit(1), less), _joined(F.col("w"), F.lit(2), less))
    return longer.select("lang", F.explode(parts).alias("phrase"), "a").distinct()


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, bits: int = BITS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, then count, then bytes."""
    frequent, totals = frequent_phrases(docs, threshold, longest, shards, bits)
    kept = materialize(scored(frequent, totals).join(absorbed(frequent), ["lang", "phrase", "a"], "left_anti"), "scored")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    best = best_within(kept, ["lang"], order, top, F.xxhash64("phrase"), max(16, -(-kept.count() // ROWS_PER_PART)))
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
