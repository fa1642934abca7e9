import random

import numpy as np
import pytest

from lorebase.llm import substring_dedup
from lorebase.llm.substring_dedup import remove_repeats, sliding_least


def brute(rows, length):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for k, (_, b) in enumerate(raw):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((k, p))
    gone = [np.zeros(len(b), bool) for _, b in raw]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p : p + length] = True
    out = []
    for (d, b), g in zip(raw, gone):
        spans = int((np.diff(g.astype(int), prepend=0) == 1).sum())
        out.append((d, len(b), int(g.sum()), spans, np.frombuffer(b, np.uint8)[~g].tobytes()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()), key=repr)


def texts(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, rows = [word(n) for n in (90, 150, 399, 400, 401, 700)], []
    for k in range(40):
        parts = [word(rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 60)
            parts += [s[a : len(s) - rng.randrange(0, 60)], word(rng.randrange(0, 200))]
        rows.append((k, "".join(parts)))
    return rows + [(50, "ab" * 600), (51, "z" * 900), (52, "z" * 399), (53, None), (54, ""), (None, shared[5]), (55, shared[5]), (55, shared[5])]


@pytest.mark.parametrize("length", [100, 400])
def test_equals_all_strings(frame, length):
    rows = texts(length)
    assert result(remove_repeats(frame(rows), length=length)) == brute(rows, length)


def test_windows_of_long_texts(frame, monkeypatch):
    monkeypatch.setattr(substring_dedup, "WINDOW", 256)
    rows = [(d, t) for d, t in texts(9)][:20]
    data = [t or "" for _, t in rows]
    import pyarrow as pa

    starts = [set() for _ in data]
    for text, first, n, *_ in substring_dedup.phrases(pa.array(data), 100):
        for t, f, c in zip(text, first, n):
            assert not starts[t] & set(range(f, f + c))
            starts[t] |= set(range(f, f + c))
    assert [len(s) for s in starts] == [max(0, len(t.encode()) - 99) for t in data]


def test_odd_rows(odd, frame):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["text"] is None or len(r["text"]) < 10_000]
    assert result(remove_repeats(frame(rows), length=100)) == brute(rows, 100)
    assert remove_repeats(odd).count() == odd.count()
    assert remove_repeats(frame([])).count() == 0


def test_sliding_least():
    v = np.random.default_rng(0).integers(0, 1000, 300).astype(np.uint64)
    for width in (1, 7, 299, 300):
        assert sliding_least(v, width).tolist() == [v[k : k + width].min() for k in range(len(v) - width + 1)]
