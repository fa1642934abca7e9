"""Byte-level BPE encoding and decoding by recursive queries inside each partition.

Encoding
    A text is cut by the tokenizer's pattern into pre-tokens. Within a task, the pre-tokens not
    met before become rows (word, position, token), a byte each, and one recursive query joins
    them with the merge table, contracts each word's leftmost pair of least rank, and repeats
    until no pair of the word merges. The merge table holds every split of every vocabulary
    entry into two entries, so ranks alone decide, as in the usual library. Each worker remembers
    the words it has encoded, up to ``REMEMBERED`` of them.

    A pre-token of more than ``ROW_BYTES`` bytes (prose has none) would need as many rounds over
    all of its rows as it has merges, which is quadratic. Its pairs are contracted in the same
    order from a heap instead; see ``long_word``.

Decoding
    Token rows join the vocabulary and an ordered aggregation puts their bytes together.

The vocabulary file has lines of base64 bytes and a rank. It must be readable under the same path
by every executor, as an installed package is. Special tokens are ordinary text.

Defined results: a null or empty text has no tokens and decodes to no bytes. Ids that are not in
the vocabulary make decoding fail. Repeated rows are encoded alike. Other columns pass through;
where they clash with the new ones these are called ``ids_2`` and so on.
"""

from __future__ import annotations

import base64
from functools import lru_cache
import tempfile
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from lorebase.llm.frames import free_name, tidy
from lorebase.llm.words import as_bytes, pieces

REMEMBERED = 600_000
ROW_BYTES = 256
WORDS_A_QUERY = 20_000
TOKENS_A_QUERY = 400_000
BYTES_A_PREPARATION = 2 << 20

ENCODE = """
WITH RECURSIVE step(w, round, pos, tok, beside, after) AS (
  SELECT w, 0::SMALLINT, pos, tok, lead(tok) OVER words, lead(pos) OVER words
  FROM letters WINDOW words AS (PARTITION BY w ORDER BY pos)
  UNION ALL
  (WITH best AS (
     SELECT w, min(rank * 65536 + pos) AS least FROM step JOIN merges ON a = tok AND b = beside GROUP BY w),
   pair AS (
     SELECT best.w, (least // 65536)::INTEGER AS made, least % 65536 AS spot, y.beside AS then_tok, y.after AS then_pos
     FROM best JOIN step x ON x.w = best.w AND x.pos = least % 65536 JOIN step y ON y.w = x.w AND y.pos = x.after)
   SELECT step.w, round + 1, pos,
          CASE WHEN pos = spot THEN made ELSE tok END,
          CASE WHEN pos = spot THEN then_tok WHEN after = spot THEN made ELSE beside END,
          CASE WHEN pos = spot THEN then_pos ELSE after END
   FROM step JOIN pair ON step.w = pair.w AND (pos <= spot OR pos >= coalesce(then_pos, 65536)))
)
SELECT w, list(tok ORDER BY pos) AS ids
FROM step JOIN (SELECT w, max(round) AS round FROM step GROUP BY w) USING (w, round) GROUP BY w ORDER BY w
"""
"""Rows carry the token and the place beside them, so that a round needs no ordering."""

DECODE = """
SELECT d, string_agg(letters, '') AS letters
FROM (SELECT d, letters FROM tokens JOIN vocabulary USING (tok) ORDER BY pos) GROUP BY d ORDER BY d
"""
"""One thread reads the ordered rows, so each document's letters are put together in order."""


class Tokenizer:
    """One worker's vocabulary, its query engine and the words it remembers."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        self.forget()
        splits = [
            (a, b, rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None
        ]
        a, b, rank = np.array(splits, np.int64).reshape(-1, 3).T
        self.merges = {(x, y): r for x, y, r in splits}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": tempfile.gettempdir()})
        self._table("merges", {"a": a.astype(np.int32), "b": b.astype(np.int32), "rank": rank})
        # A character for each byte, so that the engine's strings can carry any bytes.
        letters = [t.decode("latin-1") for t in self.ranks]
        self._table("vocabulary", {"tok": np.fromiter(self.ranks.values(), np.int32), "letters": letters})
        self.top = max(self.ranks.values(), default=-1)

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def forget(self) -> None:
        """``known`` numbers the words; word k has the ids flat[ends[k]:ends[k+1]]."""
        self.known: dict[str, int] = {}
        self.ends, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def remember(self, words: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        self.flat = np.concatenate([self.flat, ids])

    def learn(self, words: list[str]) -> None:
        """Encode new words and remember them."""
        short = []
        for word in words:
            raw = word.encode()
            if len(raw) > ROW_BYTES:
                ids = self.long_word(raw)
                self.remember([word], np.array([len(ids)]), ids)
            else:
                short.append((word, raw))
        for at in range(0, len(short), WORDS_A_QUERY):
            part = short[at : at + WORDS_A_QUERY]
            size = np.array([len(raw) for _, raw in part])
            first = np.cumsum(size) - size
            letters = {
                "w": np.repeat(np.arange(len(part), dtype=np.int32), size),
                "pos": (np.arange(size.sum()) - np.repeat(first, size)).astype(np.int32),
                "tok": self.byte[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)],
            }
            self.con.register("letters", pa.table(letters))
            found = self.con.sql(ENCODE).to_arrow_table().column("ids").combine_chunks()
            self.con.unregister("letters")
            self.remember([word for word, _ in part], np.diff(found.offsets.to_numpy()), found.flatten().to_numpy().astype(np.int32))

    def long_word(self, raw: bytes) -> np.ndarray:
        """The same contraction, leftmost least pair first, from a heap of pairs."""
        tok = self.byte[np.frombuffer(raw, np.uint8)].tolist()
        after, before = [*range(1, len(tok)), -1], [-1, *range(len(tok) - 1)]
        heap = [(r, k) for k in range(len(tok) - 1) if (r := self.merges.get((tok[k], tok[k + 1]))) is not None]
        heapify(heap)
        while heap:
            rank, k = heappop(heap)
            n = after[k]
            if tok[k] < 0 or n < 0 or self.merges.get((tok[k], tok[n])) != rank:
                continue  # one of the two has been contracted since
            tok[k], tok[n], after[k] = rank, -1, after[n]
            if after[n] >= 0:
                before[after[n]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := self.merges.get((tok[x], tok[y]))) is not None:
                    heappush(heap, (r, x))
        return np.array([t for t in tok if t >= 0], np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): text k has ids[ends[k]:ends[k+1]]; the new words of all texts are learnt at once."""
        cut = [self.find(text) if text else [] for text in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = set().union(*cut)
        self.learn(list(new))
        size = np.array([len(words) for words in cut], np.int64)
        word = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, size.sum())
        begin, count = self.ends[word], self.ends[word + 1] - self.ends[word]
        done = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(begin - done[:-1], count) + np.arange(done[-1])]
        return done[np.concatenate([[0], np.cumsum(size)])], ids

    def decode(self, ends: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of ids[ends[k]:ends[k+1]] for every k."""
        if len(ids) and (ids.min() < 0 or ids.max() > self.top):
            raise ValueError("an id is not in the vocabulary")
        size = np.diff(ends)
        tokens = {"d": np.repeat(np.arange(len(size), dtype=np.int32), size), "pos": np.arange(len(ids), dtype=np.int64), "tok": ids}
        self.con.register("tokens", pa.table(tokens))
        found = self.con.execute(DECODE).fetchall()
        self.con.unregister("tokens")
        out = [b""] * len(size)
        for d, letters in found:
            out[d] = letters.encode("latin-1")
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """A worker builds its vocabulary once and keeps it from task to task."""
    return Tokenizer(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", and_decode: bool = False) -> DataFrame:
    """``docs`` plus ids (array of int), and with ``and_decode`` also decoded (the bytes of these ids).

    Both in one step spare a second Python worker a task.
    """
    added = {free_name(docs, "ids"): ArrayType(IntegerType())} | ({free_name(docs, "decoded"): BinaryType()} if and_decode else {})

    def run(batches):
        tok = tokenizer(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo, hi in pieces(as_bytes(batch.column(at))[1], BYTES_A_PREPARATION):
                part = batch.slice(lo, hi - lo)
                ends, ids = tok.encode(part.column(at).to_pylist())
                new = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
                if and_decode:
                    new.append(_decoded(tok, ends, ids))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *added])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, *(StructField(n, t) for n, t in added.items())]))


def _decoded(tok: Tokenizer, ends: np.ndarray, ids: np.ndarray) -> pa.Array:
    out = []
    for lo, hi in pieces(ends, TOKENS_A_QUERY):
        out += tok.decode(ends[lo : hi + 1] - ends[lo], ids[ends[lo] : ends[hi]])
    return pa.array(out, pa.binary())


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` plus decoded (the bytes of its ids)."""
    name = free_name(tokens, "decoded")

    def run(batches):
        tok = tokenizer(path, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(tok, ends, ids)], names=[*batch.schema.names, name])

    return tokens.mapInArrow(tidy(run), StructType([*tokens.schema.fields, StructField(name, BinaryType())]))


def digests(ids_col: str = "ids", bytes_col: str = "decoded") -> list:
    """Columns n_tokens, ids_sha256 and decoded_sha256."""
    ids = F.concat_ws(" ", F.col(ids_col).cast("array<string>"))
    return [F.size(ids_col).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col(bytes_col), 256).alias("decoded_sha256")]
