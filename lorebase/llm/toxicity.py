"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Fit
    Training rows are documents with a label. At most ``max_rows`` of them are used, those with
    the smallest hash of their id (and, where ids repeat, of their id and features). Each becomes the set of its hashed features: words, pairs of
    neighbours, and pairs with one word between. FTRL-proximal reads them one by one in a hashed
    order, ``epochs`` times, with a learning rate of its own for every coordinate and an L1 term
    that leaves rare features at exactly zero. It is an online method: the one task that runs it
    holds the coordinates (``2**bits`` of them) and a batch of rows, whatever the texts' lengths.
    A row counts by the inverse of its class's frequency, to the power ``balance``, so that by
    default neither class outweighs the other.

Score
    The weights that are not zero, bounded by ``2**bits``, are broadcast. A text's score is the
    logistic of the bias plus the weights of its distinct features; all of the text counts.

Defined results: a null or empty text scores as the bias alone. Labels that are null are not
used; of several labels of one id the largest counts. Without any label of both classes the
score is 0.5. Repeated rows score alike. Other columns pass through and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.frames import renamed, tidy
from lorebase.llm.words import NOT_ALNUM, Words, as_bytes, pieces
from lorebase.session import materialize

MAX_ROWS = 20_000
BITS = 20
THRESHOLD = 0.7


@dataclass(frozen=True)
class FTRL:
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 1.0
    epochs: int = 8
    balance: float = 1.0


def features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every n-gram and skip-gram, repeats included."""
    found = [words.grams(1), words.grams(2), words.grams(2, skip=1)]
    at = np.concatenate([a for _, a in found])
    return words.doc[at], (np.concatenate([h for h, _ in found]) >> np.uint64(64 - bits)).astype(np.int64)


def distinct_features(texts: pa.Array, bits: int, keep: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text of the piece, text, feature) with each feature once a text; of ``keep`` only."""
    data, offsets = as_bytes(texts)
    for lo, hi in pieces(offsets):
        doc, feature = features(Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], NOT_ALNUM), bits)
        if keep is not None:
            some = keep[feature]
            doc, feature = doc[some], feature[some]
        pair = np.unique((doc << bits) | feature)
        yield lo, pair >> bits, pair & ((1 << bits) - 1)


class Learner:
    """FTRL-proximal state; the bias is one more coordinate, without L1."""

    def __init__(self, bits: int, how: FTRL):
        self.z, self.n, self.how = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1), how

    def weights(self, at: np.ndarray) -> np.ndarray:
        h, z = self.how, self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, h.l1)
        w = -(z - np.sign(z) * l1) / ((h.beta + np.sqrt(self.n[at])) / h.alpha + h.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, feature: np.ndarray, label: int, importance: float) -> None:
        at = np.append(feature, len(self.z) - 1)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * importance
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.how.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int

    def scorer(self):
        """A function from a string column to scores."""
        dense, keep = np.zeros(1 << self.bits), np.zeros(1 << self.bits, bool)
        dense[self.index], keep[self.index] = self.weight, True

        def score(texts: pa.Array) -> np.ndarray:
            margin = np.full(len(texts), self.bias)
            for lo, doc, feature in distinct_features(texts, self.bits, keep):
                if len(doc):
                    part = np.bincount(doc, dense[feature])
                    margin[lo : lo + len(part)] += part
            return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))

        return score


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = MAX_ROWS, bits: int = BITS, how: FTRL = FTRL(),
) -> Model:
    """``labels`` holds the rows that may be learnt from."""
    named = renamed(labels, doc_id=id_col, label=label).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    named = named.groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    chosen = materialize(named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "toxicity-labels")
    sizes = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, bits)
    total = sum(sizes.values())
    importance = {k: (total / (2 * n)) ** how.balance for k, n in sizes.items()}

    def extract(batches):
        for batch in batches:
            held = [b""] * batch.num_rows
            for lo, doc, feature in distinct_features(batch.column("text"), bits):
                cut = np.flatnonzero(np.diff(doc, prepend=-1, append=-1)) if len(doc) else []
                for a, b in zip(cut[:-1], cut[1:]):
                    held[lo + doc[a]] = feature[a:b].astype(np.int32).tobytes()
            columns = [batch.column("doc_id"), batch.column("label"), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "features"])

    rows = renamed(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = materialize(rows.mapInArrow(tidy(extract), "doc_id long, label int, features binary"), "toxicity-rows")
    if rows.count() > max_rows:  # a corpus may repeat a labelled id in any number of rows
        rows = materialize(rows.orderBy(F.xxhash64("doc_id", "features"), "doc_id", "label", "features").limit(max_rows), "toxicity-rows")

    def learn(batches):
        learner = Learner(bits, how)
        for batch in batches:
            for y, x in zip(batch.column("label").to_pylist(), batch.column("features").to_pylist()):
                learner.learn(np.frombuffer(x, np.int32), y, importance[y])
        w = learner.weights(np.arange(len(learner.z)))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["index", "weight"])

    # One task reads the bounded sample again and again, each time in another order; nothing is shuffled.
    rounds = [
        rows.coalesce(1).sortWithinPartitions(F.xxhash64(F.lit(k), "doc_id"), "doc_id", "label", "features").select("label", "features")
        for k in range(how.epochs)
    ]
    stream = reduce(DataFrame.union, rounds).coalesce(1)
    found = stream.mapInArrow(tidy(learn), "index long, weight double").toPandas().sort_values("index")
    index, weight = found["index"].to_numpy(), found["weight"].to_numpy()
    bias = index == 1 << bits
    return Model(index[~bias], weight[~bias], float(weight[bias].sum()), bits)


def score_column(model: Model, text: Column) -> Column:
    """The score of ``text`` as a column, for any frame."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = model.scorer()
        for texts in batches:
            yield pa.array(scorer(texts))

    return score(text)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1
