import random
import time

import numpy as np
import pytest

from lorebase.llm import ngram_join
from lorebase.llm.components import components
from lorebase.llm.ngram_join import Dealer, Trie, linked_components


def grams(text, n):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    """Components by id; rows without one take no part."""
    sets = [(d, grams(t, n)) for d, t in rows]
    label = {d: d for d, _ in rows if d is not None}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sorted(((d, len(s), label.get(d)) for d, s in sets), key=repr)


def near_copies(seed, groups=12, size=6):
    rng, rows, k = random.Random(seed), [], 0
    for _ in range(groups):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 12, 25, 60, 200]))]
        for _ in range(rng.randrange(1, size)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((k, " ".join(copy)))
            k += 1
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("n", "num", "how"), [(3, 90, {}), (5, 80, {}), (3, 90, {"cell": 200}), (5, 80, {"many": 1, "cell": 900})])
def test_equals_all_pairs(frame, n, num, how):
    rows = near_copies(n * num)
    assert result(linked_components(frame(rows), n=n, num=num, **how)) == brute(rows, n, num, 100)


def test_shared_passages_tie_no_unlike_texts(frame):
    """A passage of a third of each text gives common keys; the profiles tell the texts apart."""
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(60)]
    rows = [(d, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(120)])) for d in range(60)]
    rows += [(100, rows[0][1] + " more"), (101, rows[1][1])]
    docs = frame(rows)
    sets = ngram_join.set_table(docs, 5, 80, 100).dropDuplicates(["digest"]).withColumnRenamed("doc_id", "rep")
    shared = ngram_join.shared_keys(docs, 5, 80, 100)
    marks = {r["mark"] for r in shared.collect()}
    assert len(marks) > 40
    ties = ngram_join.neighbours(shared, sets, 80, 100).collect()
    assert len(ties) == 1  # the near copy; the exact one is the same set
    assert result(linked_components(docs, n=5, num=80)) == brute(rows, 5, 80, 100)


@pytest.mark.parametrize("cell", [1 << 18, 2000])
def test_repeated_ids_in_large_groups(frame, cell):
    """Document 5 has a near copy of the others' text and a much longer one: its links are those of both."""
    rng = random.Random(8)
    a = [f"a{k}" for k in range(100)]
    rows = [(d, " ".join([*a[:-1], f"n{d}"])) for d in range(10, 40)]
    rows += [(5, " ".join([*a[:-1], "five"])), (5, " ".join(f"b{rng.randrange(10**6)}" for _ in range(1500)))]
    got = result(linked_components(frame(rows), cell=cell))
    assert {r[2] for r in got} == {5} and got == brute(rows, 3, 90, 100)


def test_profiles_bound_the_overlap():
    rng = np.random.default_rng(6)
    for _ in range(200):
        size = int(rng.integers(5, 3000))
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        keep = int(rng.integers(0, len(x) + 1))
        y = np.unique(np.concatenate([x[:keep], rng.integers(0, 2**63, int(rng.integers(1, size + 1))).astype(np.uint64)]))
        same = len(np.intersect1d(x, y))
        root = ngram_join.tied_by_profile(np.array([len(x), len(y)]), [ngram_join.profile(x), ngram_join.profile(y)], 80, 100)
        assert root[0] == root[1] or 100 * same < 80 * (len(x) + len(y) - same)
    crowd = ngram_join.profile(np.repeat(np.uint64(3), 300))  # more than a byte in one class
    assert crowd == b"" and len(set(ngram_join.tied_by_profile(np.array([300, 300]), [crowd, crowd], 80, 100))) == 1


def test_many_unlike_short_sets_take_linear_time():
    rng = np.random.default_rng(7)

    def seconds(n):
        sets = [np.unique(rng.integers(0, 10**9, 12)).astype(np.uint64) for _ in range(n)]
        trie, start = Trie(sets), time.process_time()
        for k in range(n):
            assert trie.similar(k, 90, 100).tolist() == [k]
        return time.process_time() - start

    assert seconds(8000) < 8 * seconds(2000)


def test_odd_rows(odd, frame):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(linked_components(odd)) == brute(rows, 3, 90, 100)
    assert linked_components(frame([])).count() == 0


def test_repeated_ids_tie_their_texts(frame):
    a, b = " ".join(f"a{k}" for k in range(100)), " ".join(f"b{k}" for k in range(100))
    got = result(linked_components(frame([(5, a), (5, b), (3, b), (9, f"{a[:-3]}new"), (7, f"x {b}"), (11, "c d e f g")])))
    assert {r[0]: r[2] for r in got} == {3: 3, 5: 3, 7: 3, 9: 3, 11: 11}


def test_keys_meet_for_every_linked_pair():
    rng, dealer = np.random.default_rng(1), Dealer(90, 100)
    for _ in range(300):
        size = int(rng.integers(10, 400))
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        change = int(rng.integers(0, max(1, len(x) // 10)))
        y = np.unique(np.concatenate([x[change:], rng.integers(0, 2**63, int(rng.integers(0, change + 1))).astype(np.uint64)]))
        inter = len(np.intersect1d(x, y))
        if 100 * inter >= 90 * (len(x) + len(y) - inter) and len(np.setxor1d(x, y)):
            assert np.intersect1d(dealer.keys(x), dealer.keys(y)).size


@pytest.mark.parametrize(("large", "link"), [(1 << 15, 64), (0, 64), (0, 3), (0, 1)])
def test_trie_finds_all(monkeypatch, large, link):
    monkeypatch.setattr(ngram_join, "LARGE_TRIE", large)
    monkeypatch.setattr(ngram_join, "LINK", link)
    rng = random.Random(4)
    base = list(range(40))
    sets = [np.array(sorted(set(rng.sample(base, rng.randrange(25, 41)) + [100 + rng.randrange(50)])), np.uint64) for _ in range(60)]
    sets += [sets[0].copy(), sets[1][:20]]
    trie = Trie(sets)
    for k, s in enumerate(sets):
        want = [j for j, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 80 * len(np.union1d(s, o))]
        assert trie.similar(k, 80, 100).tolist() == want


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7)]
    label = {v: v for p in pairs for v in p}
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["hi"]: r["lo"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: m for v, m in label.items() if v != m}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
