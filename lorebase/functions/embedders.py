"""Embedders turn a list of texts into one vector per text. Any picklable callable will do."""

from __future__ import annotations

import numpy as np

# Fixed values of the hash: weights of the three characters of a window.
WEIGHTS = (7, 31, 131)
WINDOWS_AT_ONCE = 1 << 16


class HashingEmbedder:
    """Signed counts of hashed character trigrams, scaled to length 1. Same text, same vector.

    A text is padded with a blank on both sides. Window h counts into component h mod
    ``dimension``, negatively when h div ``dimension`` is odd. An empty text has no vector.
    """

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [self.embed(t) for t in texts]

    def embed(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.float32)
        counts, padded = np.zeros(2 * self.dimension, np.int64), len(text) + 2
        for at in range(0, padded - 2, WINDOWS_AT_ONCE):
            # Characters at..stop+2 of the padded text, which is never built as a whole.
            stop = min(at + WINDOWS_AT_ONCE, padded - 2)
            part = text[max(at - 1, 0) : stop + 1]
            part = (" " if at == 0 else "") + part + (" " if stop + 2 == padded else "")
            c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            h = c[:-2] * WEIGHTS[0] + c[1:-1] * WEIGHTS[1] + c[2:] * WEIGHTS[2]
            counts += np.bincount(h % (2 * self.dimension), minlength=2 * self.dimension)
        signed = counts[: self.dimension] - counts[self.dimension :]
        if not signed.any():
            signed = counts[: self.dimension]
        return (signed / np.sqrt(np.sum(signed * signed))).astype(np.float32)
