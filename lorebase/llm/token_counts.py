"""Token counts that follow edits without reading whole texts again.

A text is cut by the tokenizer's pattern into pre-tokens, which are encoded independently. A
document's state is a segment tree over blocks of ``BLOCK`` pre-tokens: each leaf has its block's
characters and tokens, each inner node the sums below it. The root is the document's count.

An edit replaces characters [start, end). Reading starts at the last block edge at least
``CONTEXT`` characters before it, as a pre-token is settled by the two characters behind it, and
ends where a new pre-token ends on an old block edge behind the edit: from there on the text and
hence the pre-tokens are the old ones. Only the pre-tokens read are encoded; the touched leaves
and the sums above them are updated.

Defined results: a null or empty text has no tokens. Edits of one document apply in the order of
their seq (ties: start, end, replacement); start and end are clamped to the text as it is then, a
null replacement is empty, a null start is 0, and a null end is the start, so nothing is deleted. Edits of unknown documents do nothing. Rows that repeat a doc_id all
get its edits; a row without doc_id gets none. Other columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.session import broadcast_if_small, materialize

BLOCK = 64
CONTEXT = 2
REMEMBERED = 400_000


class Counter:
    """Pre-tokens and their numbers of tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern, self.known = regex.compile(pattern), {}

    def tokens(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = len(self.encode(w))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def leaves(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of every block."""
        words = self.pattern.findall(text)
        at = np.arange(0, len(words), BLOCK)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        return np.add.reduceat(size, at), np.add.reduceat(self.tokens(words), at)


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class SegmentTree:
    """Sums of (characters, tokens) over a power of two of leaves; node k has children 2k and 2k+1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.width = 1 << max(0, int(len(chars) - 1).bit_length())
        self.sum = np.zeros((2 * self.width, 2), np.int64)
        self.sum[self.width : self.width + len(chars)] = np.stack([chars, tokens], axis=1)
        level = self.width
        while level > 1:
            pairs = self.sum[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            self.sum[level // 2 : level] = pairs
            level //= 2

    @property
    def chars(self) -> int:
        return int(self.sum[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sum[1, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the last leaf that begins at or before ``place``, empty ones aside."""
        node, begin = 1, 0
        while node < self.width:
            left = int(self.sum[2 * node, 0])
            if place >= begin + left and self.sum[2 * node + 1, 0]:
                node, begin = 2 * node + 1, begin + left
            else:
                node = 2 * node
        return node - self.width, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        change = np.array([chars, tokens]) - self.sum[node]
        while node:
            self.sum[node] += change
            node //= 2

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.sum[self.width :]
        used = used[used[:, 0] > 0]
        return used[:, 0], used[:, 1]


def edit(text: str, tree: SegmentTree, start: int, end: int, replacement: str, count: Counter) -> tuple[str, SegmentTree, int]:
    """(new text, tree, characters read) after one edit."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    new = text[:start] + replacement + text[end:]
    shift = len(new) - len(text)
    first, begin = tree.leaf_at(max(start - CONTEXT, 0))
    edge, last = begin + int(tree.sum[tree.width + first, 0]), first  # old edge behind leaf ``last``
    words, at = [], begin
    for match in count.pattern.finditer(new, begin):
        words.append(match.group())
        at = match.end()
        while last < tree.width - 1 and (edge < end or edge + shift < at):
            last += 1
            edge += int(tree.sum[tree.width + last, 0])
        if edge >= end and edge + shift == at:
            break
    else:
        last = tree.width - 1
    read = at - begin
    sizes, tokens = [len(w) for w in words], count.tokens(words) if words else np.zeros(0, np.int64)
    slots = last - first + 1
    if len(words) > 4 * BLOCK * slots:  # the leaves would get too long: a new tree from all leaves
        before, after = tree.sum[tree.width : tree.width + first], tree.sum[tree.width + last + 1 :]
        cut = np.arange(0, len(words), BLOCK)
        middle = np.stack([np.add.reduceat(np.array(sizes), cut), np.add.reduceat(tokens, cut)], axis=1)
        every = np.concatenate([before, middle, after])
        every = every[every[:, 0] > 0]
        return new, SegmentTree(every[:, 0], every[:, 1]), read
    cut = np.linspace(0, len(words), slots + 1).astype(int)
    for k in range(slots):
        part = slice(cut[k], cut[k + 1])
        tree.put(first + k, sum(sizes[part]), int(tokens[part].sum()))
    return new, tree, read


# -- the operator --------------------------------------------------------------------------


def count_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(mark, n_tokens, leaf_chars, leaf_tokens), a row for each different text; mark is its digest."""
    texts = docs.select(F.md5(F.coalesce(docs[f"`{text_col}`"], F.lit(""))).alias("mark"), docs[f"`{text_col}`"].alias("text"))

    def run(batches):
        count = counter(path, pattern)
        for batch in batches:
            found = [count.leaves(text or "") for text in batch.column("text").to_pylist()]
            total = pa.array([int(t.sum()) for _, t in found], pa.int64())
            columns = [batch.column("mark"), total, pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([t for _, t in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["mark", "n_tokens", "leaf_chars", "leaf_tokens"])

    leaves = texts.mapInArrow(run, "mark string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>")
    return leaves.groupBy("mark").agg(*[F.first(c).alias(c) for c in ("n_tokens", "leaf_chars", "leaf_tokens")])


def recount(docs: DataFrame, state: DataFrame, edits: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_before, n_tokens, n_read, leaf_chars, leaf_tokens) with edits (doc_id, seq, start, end, replacement) applied.

    ``state`` is a written table from ``count_tokens``; texts it lacks are encoded as a whole. n_read is the number of characters read again.
    """
    docs = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    start = F.coalesce("start", F.lit(0))
    place = start.alias("start"), F.coalesce("end", start).alias("end")
    steps = F.array_sort(F.collect_list(F.struct("seq", *place, F.coalesce("replacement", F.lit("")).alias("replacement"))))
    steps = materialize(edits.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(steps.alias("steps")), "token-edits")
    rows = docs.withColumn("mark", F.md5("text")).join(broadcast_if_small(state), "mark", "left").join(broadcast_if_small(steps), "doc_id", "left")

    def run(batches):
        count = counter(path, pattern)
        for batch in batches:
            out = []
            for text, chars, tokens, steps in zip(*(batch.column(c) for c in ("text", "leaf_chars", "leaf_tokens", "steps"))):
                text, read = text.as_py(), 0
                # A text that the state does not know is encoded here.
                leaves = (chars.values.to_numpy(), tokens.values.to_numpy()) if chars.is_valid else count.leaves(text)
                tree = SegmentTree(*leaves)
                before = tree.tokens
                for s in steps.as_py() or ():
                    text, tree, more = edit(text, tree, s["start"], s["end"], s["replacement"], count)
                    read += more
                out.append((text, before, tree.tokens, read, *tree.leaves()))
            text, before, after, read, chars, tokens = zip(*out) if out else ((),) * 6
            leaf = pa.list_(pa.int32())
            columns = [batch.column("doc_id"), pa.array(text, pa.string()), *(pa.array(x, pa.int64()) for x in (before, after, read)), pa.array(chars, leaf), pa.array(tokens, leaf)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_before", "n_tokens", "n_read", "leaf_chars", "leaf_tokens"])

    schema = "doc_id long, text string, n_before long, n_tokens long, n_read long, leaf_chars array<int>, leaf_tokens array<int>"
    return rows.select("doc_id", "text", "leaf_chars", "leaf_tokens", "steps").mapInArrow(run, schema)
