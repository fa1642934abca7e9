"""Quality rules: statistics of each text, an isolation forest over them, a calibrated verdict.

Statistics
    Counts over the whole text: words, their characters, marks, repeated lines, words in repeated
    windows of eight, capitals. The forest's inputs are rates of them: mean word length, marks
    per word, share of words in repeated windows, share of capitals among the characters. (Good
    texts, too, repeat lines, have digits and any length; with these as inputs the forest told
    labelled rows apart less well.)

Forest
    ``trees`` trees, each of ``sample`` rows drawn with a fixed seed from at most ``max_rows``
    labelled rows (those with the least hash of their id). A node splits a random input at a
    random place between its least and greatest value, down to a depth of log2(sample). Odd rows
    end on short paths. The score of a row is 2 to the power of minus its mean path length over
    the usual one: 0 to 1, higher for odder rows. The model is a few hundred kilobytes whatever
    the corpus.

Verdict
    The threshold is the score that separates the labelled good rows from the bad best, among
    those that lose at most ``max_loss`` of the good rows. A text that breaks a hard rule is not
    kept either: fewer than 20 words, or more than 30 % of its words in repeated windows.

Windows are compared by 64-bit hashes inside one text. Defined results: a null or empty text has
no words and is not kept. Without labels of both kinds only the hard rules decide. Repeated rows
get one verdict. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.frames import renamed
from lorebase.llm.words import SPACE, Words, as_bytes, pieces
from lorebase.session import materialize

MAX_ROWS = 20_000
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
INPUTS = ["mean_length", "marks", "repeats", "capitals"]
MARK = np.zeros(256, bool)
MARK[list(b"#*$%&|<>")] = True


def repeated_words(words: Words) -> np.ndarray:
    """For each text the number of words in windows of eight that occur twice or more in it."""
    gram, at = words.grams(WINDOW)
    n = len(words.count)
    if not len(gram):
        return np.zeros(n, np.int64)
    doc = words.doc[at]
    order = np.lexsort((gram, doc))
    same = (np.diff(gram[order]) == 0) & (np.diff(doc[order]) == 0)
    twice = np.zeros(len(gram), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return inside[words.first[1:]] - inside[words.first[:-1]]


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier one."""
    lines = [x for x in raw.split(b"\n") if x and x.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (integers) and INPUTS (floats) of every text, a row each."""
    data, offsets = as_bytes(texts)
    counts, inputs = np.zeros((len(texts), len(COUNTS)), np.int64), np.zeros((len(texts), len(INPUTS)))
    for lo, hi in pieces(offsets):
        raw, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]

        def per_text(flag):
            total = np.concatenate([[0], np.cumsum(flag)])
            return total[at[1:]] - total[at[:-1]]

        words = Words(raw, at, SPACE, lower=False)
        letter = (raw & 0xC0) != 0x80  # first bytes of characters
        chars, marks = per_text(letter & ~SPACE[raw]), per_text(MARK[raw])
        lines = np.array([repeated_lines(raw[at[k] : at[k + 1]].tobytes()) for k in range(hi - lo)], np.int64)
        repeats, n = repeated_words(words), words.count
        counts[lo:hi] = np.stack([n, chars, marks, lines, repeats], axis=1)
        capitals = per_text((raw >= 0x41) & (raw <= 0x5A))
        some = np.maximum(n, 1)
        inputs[lo:hi] = np.stack([chars / some, marks / some, repeats / some, capitals / np.maximum(chars, 1)], axis=1)
    return counts, inputs


# -- isolation forest ----------------------------------------------------------------------


def usual_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees: input to split on (-1: leaf), place of the split, children, depth at a leaf."""

    split: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    sample: int

    @classmethod
    def grow(cls, rows: np.ndarray, trees: int = 128, sample: int = 256, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        split, value, left, right, path, roots = [], [], [], [], [], []
        sample = min(sample, len(rows))
        limit = int(np.ceil(np.log2(max(sample, 2))))

        def node(part: np.ndarray, depth: int) -> int:
            me = len(split)
            for field in (split, value, left, right, path):
                field.append(-1)
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth >= limit or len(part) < 2 or not len(open_):
                path[me] = depth + float(usual_path(len(part)))
                return me
            split[me] = int(rng.choice(open_))
            value[me] = float(rng.uniform(low[split[me]], high[split[me]]))
            below = part[:, split[me]] <= value[me]
            left[me], right[me] = node(part[below], depth + 1), node(part[~below], depth + 1)
            return me

        for _ in range(trees):
            roots.append(node(rows[rng.choice(len(rows), sample, replace=False)], 0))
        return cls(*(np.array(x) for x in (split, value, left, right)), np.array(path, float), np.array(roots), sample)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while True:
                on = self.split[at]
                going = every[on >= 0]
                if not len(going):
                    break
                here = at[going]
                below = rows[going, on[going]] <= self.value[here]
                at[going] = np.where(below, self.left[here], self.right[here])
            total += self.path[at]
        return 2.0 ** (-total / len(self.roots) / max(float(usual_path(self.sample)), 1e-9))


@dataclass(frozen=True)
class Model:
    forest: Forest | None
    threshold: float


def calibrate(score: np.ndarray, good: np.ndarray, max_loss: float) -> float:
    """The threshold (rows above it are dropped) of the best balanced accuracy within ``max_loss``."""
    places = np.unique(score)
    lost = 1 - np.searchsorted(np.sort(score[good]), places, "right") / good.sum()
    caught = 1 - np.searchsorted(np.sort(score[~good]), places, "right") / (~good).sum()
    gain = np.where(lost <= max_loss, caught - lost, -1)
    return float(places[np.argmax(gain)])


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = MAX_ROWS, trees: int = 128, sample: int = 256, max_loss: float = 0.01,
) -> Model:
    named = renamed(labels, doc_id=id_col, label=label).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    named = named.groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    chosen = materialize(named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "quality-labels")
    rows = renamed(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def measure(batches):
        for batch in batches:
            _, inputs = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *map(pa.array, inputs.T)], names=["doc_id", "label", *INPUTS])

    schema = ", ".join(["doc_id long, label int", *(f"{c} double" for c in INPUTS)])
    # A corpus may repeat a labelled id in any number of rows, so the bound is taken on rows too.
    measured = rows.mapInArrow(measure, schema).orderBy(F.xxhash64("doc_id", *INPUTS), "doc_id", "label", *INPUTS).limit(max_rows)
    found = measured.toPandas().sort_values(["doc_id", "label", *INPUTS])
    good, inputs = found["label"].to_numpy() > 0, found[INPUTS].to_numpy()
    if good.all() or not good.any():
        return Model(None, 1.0)
    forest = Forest.grow(inputs, trees, sample)
    return Model(forest, calibrate(forest.score(inputs), good, max_loss))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept, score) for every row."""
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))

    def run(batches):
        for batch in batches:
            counts, inputs = statistics(batch.column("text"))
            n, repeats = counts[:, 0], counts[:, 4]
            failed = (n < 20) | (100 * repeats > 30 * n)
            score = model.forest.score(inputs) if model.forest else np.zeros(len(n))
            columns = [batch.column("doc_id"), *map(pa.array, counts.T), pa.array(failed), pa.array(~failed & (score <= model.threshold)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "kept", "score"])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean, kept boolean, score double"])
    return rows.mapInArrow(run, schema)
