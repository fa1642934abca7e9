import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lorebase.llm import phrases as ph
from lorebase.llm.registry import QUERIES
from lorebase.llm.words import Words, as_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest=5):
    counts = {}
    for lang, text in rows:
        c = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return counts


def plain_way(rows, threshold, longest=5, top=2000):
    out = []
    for lang, f in counted(rows, longest).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        gone = {q[i : i + k] for q, b in candidates.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 100 * candidates[q[i : i + k]]}
        found = []
        for p, a in candidates.items():
            cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if p not in gone:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "a", "É", "日本", "of", "x1", "\x1c", " ", "fox", "dog", "runs", "over"]
    fixed = ["quick brown fox jumps over the dog", "New  York\tcity of dreams", "at the end of the day"]
    rows = []
    for i in range(n):
        bits = [rng.choice(fixed) if rng.random() < 0.15 else rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 20, 90]))]
        rows.append((rng.choice(["en", "de", None, "und", ""]) if i % 3 else "en", "".join(b + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for b in bits)))
    return rows


def frame(spark, rows):
    shape = "lang string, text string, phrase string, words int, hash string, shard string, n string"
    return spark.createDataFrame([(a, b, "p", 1, "h", "s", "n") for a, b in rows], shape).repartition(5)


@pytest.mark.parametrize("how", [{}, {"shards": 1}, {"shards": 7}, {"bits": 3}, {"longest": 2}, {"top": 5}])
def test_equals_brute_force(spark, how):
    rows = texts(3, 220)
    want = plain_way(rows, 12, how.get("longest", 5), how.get("top", 2000))
    got = ph.collocations(frame(spark, rows), threshold=12, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 4


def test_counts_are_exact_whatever_the_order(spark):
    rows = texts(8, 150)
    want = {(lang, " ".join(p)): c for lang, f in counted(rows).items() for p, c in f.items() if c >= 9}
    frequent, totals = ph.frequent_phrases(frame(spark, rows), threshold=9, shards=3)
    assert {(r["lang"], r["phrase"]): r["f"] for r in frequent.collect()} == want
    assert {r["lang"]: r["n"] for r in totals.collect()} == {lang: sum(c for p, c in f.items() if len(p) == 1) for lang, f in counted(rows).items() if f}


def test_longer_phrases_wait_for_both_subphrases():
    data, offsets = as_bytes(pa.array(["a b c. c d"]))
    words = Words(data, offsets, ph.SEPARATOR)
    never = np.full(1 << 10, ph.NEVER, np.uint8)
    code = np.zeros(1, np.uint64)
    assert ph.Occurrences(words, code, never, 1, 4, 5).size.tolist() == [1] * 5
    assert not len(ph.Occurrences(words, code, never, 5, 4, 5).size)
    told = np.full(1 << 10, 2, np.uint8)  # everything reached the threshold after scan 2
    assert sorted(ph.Occurrences(words, code, told, 3, 4, 5).size.tolist()) == [1] * 5 + [2, 2, 2, 3]
    assert sorted(ph.Occurrences(words, code, told, 6, 4, 5).size.tolist()) == [2, 2, 2, 3]
    assert not len(ph.Occurrences(words, code, told, 7, 4, 5).size)


def test_odd_rows(spark, odd):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in ph.collocations(odd, threshold=3).collect()) == plain_way(rows, 3)
    assert ph.collocations(frame(spark, [])).collect() == []
    assert ph.collocations(frame(spark, [("en", None), (None, ""), ("de", " ,.")])).collect() == []
    with pytest.raises(ValueError, match="shards"):
        ph.collocations(odd, shards=100)


def test_long_texts_are_cut_between_pieces():
    text = ("one two three four, " * 200 + "x" * 9000 + " tail; ") * 3
    data, offsets = as_bytes(pa.array(["a b", text, "c"]))
    size, ph.PIECE_BYTES = ph.PIECE_BYTES, 1000
    try:
        parts = [(int(d), bytes(data[a:b])) for docs, bounds in ph._runs(data, offsets) for d, a, b in zip(docs, bounds, bounds[1:])]
    finally:
        ph.PIECE_BYTES = size
    assert b"".join(p for _, p in parts) == data.tobytes() and len(parts) > 5
    assert all(p.endswith((b",", b";")) for d, p in parts[1:-2] if d == 1)


def test_colliding_keys_stay_apart():
    data, offsets = as_bytes(pa.array(["a b a c"]))
    found = ph.Occurrences(Words(data, offsets, ph.SEPARATOR), np.zeros(1, np.uint64), np.full(2, ph.NEVER, np.uint8), 1, 4, 2)
    found.key = np.zeros(4, np.uint64)
    buffer = ph.Buffer(pa.schema([("lang", pa.string()), ("words", pa.int32()), ("hash", pa.int64()), ("since", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())]))
    out = [*buffer.add(found, np.array(["en"], object)), *buffer.add(found, np.array(["en"], object)), *buffer.flush()]
    total = Counter()
    for batch in out:
        total.update(dict(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())))
    assert total == {"a": 4, "b": 2, "c": 2}


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op11_phrase_collocations"](spark, sf_dir).collect()) == plain_way(rows, 100)


@pytest.mark.parametrize("bits", [9, 11])
def test_shared_buckets_lose_no_count(spark, bits):
    """Phrases of words that reach the threshold in different scans, in buckets that others have reached before."""
    rng = random.Random(0)
    fixed = [" ".join(f"r{j}x{i}" for i in range(rng.randint(2, 7))) for j in range(60)]
    rows = [("en", " ".join(rng.choice(fixed) if rng.random() < 0.35 else f"v{rng.randrange(40)}" for _ in range(20))) for _ in range(400)]
    want = plain_way(rows, 30)
    assert sorted(tuple(r) for r in ph.collocations(frame(spark, rows), threshold=30, bits=bits).collect()) == want and len(want) > 40


def test_scans_leave_out_what_has_reached_the_threshold():
    data, offsets = as_bytes(pa.array(["a b c. c d"]))
    words, code = Words(data, offsets, ph.SEPARATOR), np.zeros(1, np.uint64)
    reached = np.full(1 << 10, 2, np.uint8)
    assert not len(ph.Occurrences(words, code, reached, 3, 4, 5, told=False).size)
    assert sorted(ph.Occurrences(words, code, reached, 3, 4, 5, told=True).size.tolist()) == [1] * 5 + [2, 2, 2, 3]
    reached[:] = ph.NEVER
    assert not len(ph.Occurrences(words, code, reached, 1, 4, 5, told=True).size)
    found = ph.Occurrences(words, code, reached, 1, 4, 5, told=False)
    assert found.size.tolist() == [1] * 5 and len(set(found.keys().tolist())) == 4  # c twice
    assert ((found.keys() >> np.uint64(54)) == (found.key >> np.uint64(54))).all() and (found.keys() & np.uint64(0xFFFF) == 1 << 8).all()


def test_a_phrase_is_told_only_when_both_its_buckets_are():
    """A bucket that other phrases share is not enough: what the last pass counts in vain would grow with the square of the texts."""
    data, offsets = as_bytes(pa.array(["a"]))
    words, code = Words(data, offsets, ph.SEPARATOR), np.zeros(1, np.uint64)
    never = np.full(1 << 12, ph.NEVER, np.uint8)
    key = int(ph.Occurrences(words, code, never, 1, 1, 5).key[0])
    told = lambda *buckets: len(ph.Occurrences(words, code, np.where(np.isin(np.arange(1 << 12), buckets), 3, never), 1, 1, 5, told=True).size)
    first, second = key >> 52, key >> 16 & 0xFFF
    assert first != second and (told(first), told(second), told(first, second)) == (0, 0, 1)


def test_the_last_pass_repeats_no_phrase_for_each_piece_of_the_input(spark, monkeypatch):
    """The same words everywhere: ten times the texts in as many more files give few more rows."""
    made, real = [spark.sparkContext.accumulator(0)], ph._count

    def noted(load, longest):
        run, rows = real(load, longest), made[-1]

        def counting(batches):
            for batch in run(batches):
                rows.add(batch.num_rows)
                yield batch

        return counting

    monkeypatch.setattr(ph, "_count", noted)
    small = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "2k"}
    was = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        one = [("en", " ".join(f"w{(i * j) % 50}" for j in range(60))) for i in range(40)]
        for times in (1, 10):
            made.append(spark.sparkContext.accumulator(0))
            got, _ = ph.frequent_phrases(frame(spark, one * times).repartition(4 * times), threshold=5, longest=1)
            assert got.count() == 50
        assert 0 < made[1].value and made[2].value <= 2 * spark.sparkContext.defaultParallelism * 51
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
