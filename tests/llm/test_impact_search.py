import math

import numpy as np
import pyarrow as pa
import pytest

from lorebase.llm import impact_search as sas
from lorebase.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, rank string, score string, v int"


def brute(rows, queries, k=10):
    """{query_id: [(vec_id, score)]} with Python integers."""
    whole = {}
    for i, (d, v) in enumerate(rows):
        if d is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = d, [math.floor(1024 * float(np.float32(x))) for x in v]
    out = []
    for i in queries:
        if i in whole:
            d, q = whole[i]
            hits = [(-min(max(sum(a * b for a, b in zip(q, v)), -(2**63)), 2**63 - 1), c) for c, v in whole.values() if c != d and len(v) == len(q)]
            out += [(d, r, c, -s) for r, (s, c) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out)


def ask(spark, rows, queries, k=10, **more):
    docs = spark.createDataFrame([(d, v, "r", "s", 1) for d, v in rows], SCHEMA)
    asked = spark.createDataFrame([(rows[i][0], rows[i][1], "r", "s", 1) for i in queries], SCHEMA)
    index = sas.build_index(docs, **{n: more.pop(n) for n in ("levels", "block_rows") if n in more})
    got = sas.top_k(index, asked, k, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    return [(i, (centres[rng.integers(7)] + 0.3 * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def test_bounds_hold_and_work_is_saved(monkeypatch):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(0, 300, (3000, 24)), rng.normal(800, 100, (60, 24))]).astype(np.int64)
    vectors[:, 3] = 7  # one value only
    block = sas.Block.build(np.arange(len(vectors)), vectors)
    scored = []
    for q in [*vectors[::400], vectors[-1], np.zeros(24, np.int64), -vectors[-1]]:
        rows, score = block.best(q, -1, 10, -sas.SAFE)
        want = vectors @ q
        assert np.array_equal(score, want[rows])
        assert set(np.flatnonzero(want >= np.sort(want)[-10])) <= set(rows.tolist())
        scored.append(len(rows))
        floor = int(np.sort(want)[-3])
        assert set(np.flatnonzero(want >= floor)) <= set(block.best(q, -1, 10, floor)[0].tolist())
        assert not len(block.best(q, -1, 10, int(want.max()) * 3 + 10**9)[0])
    assert np.median(scored) < 200  # of 3,060
    again = sas.Block.read(*block.row())
    assert np.array_equal(again.best(vectors[0], 0, 5, -sas.SAFE)[0], block.best(vectors[0], 0, 5, -sas.SAFE)[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = clustered(900, 12, seed) + clustered(200, 5, seed + 9)
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)]  # ties
    queries = [*range(0, 900, 90), 905, 1105, 1200]
    want = brute(rows, queries)
    assert ask(spark, rows, queries, block_rows=128) == want
    assert ask(spark, rows, queries, levels=3, slice_bytes=2000) == want
    assert ask(spark, rows, queries, k=3) == brute(rows, queries, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [-inf, 1.0]), (6, []), (7, []), (100, []),
        (8, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [1.0, 2.0]), (9, [1e30, -1.0]), (10, [-3.0e6, 0.0]), (11, [0.0, -0.0]), (200, [0.0, 0.0]),
        (12, [1e-30, -1e-30]), (13, [1.0, 2.0, 3.0]), (300, [5.0, 6.0, 7.0]), (400, [1.0] * 4),
    ]
    queries = [0, 8, 14, 15, 18, 19, 1, 3]
    assert ask(spark, rows, queries) == brute(rows, queries)
    assert ask(spark, rows, [13]) == brute(rows, [13])  # 3e6 squared still fits a long
    assert ask(spark, [], []) == [] and ask(spark, rows, []) == []
    docs = spark.createDataFrame([], SCHEMA)
    assert sas.top_k(sas.build_index(docs), docs).collect() == []
    with pytest.raises(ValueError, match="positive"):
        sas.top_k(docs, docs, 0)


def test_integers_of_wide_floats():
    rows = [[1e30, 2.5], [2.0**-1000, -(2.0**-1000)], [1.7e308, -1.7e308], [-0.001, 0.9999]]
    got = {}
    for at, whole in sas._matrix(pa.array(rows, pa.list_(pa.float64()))):
        got |= {int(i): [int(x) for x in v] for i, v in zip(at, whole)}
    assert got == {0: [int(1e30) * 1024, 2560], 1: [0, -1], 2: [int(1.7e308) * 1024, -int(1.7e308) * 1024], 3: [-2, 1023]}


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    queries = [i for i, (d, _) in enumerate(rows) if d % 100 == 0]
    assert sorted(tuple(r) for r in QUERIES["op13_exact_top_k"](spark, sf_dir).collect()) == brute(rows, queries)
