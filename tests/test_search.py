import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorebase.functions import vectors
from lorebase.functions.topk import QuerySlice, TopK
from lorebase.operators import search

DOCS = "url string, embeddings array<float>, context string"


def exact(a, b):
    a, b = np.asarray(a, np.float32), np.asarray(b, np.float32)
    dot = na = nb = 0.0
    with np.errstate(all="ignore"):
        for x, y in zip(a, b):
            dot, na, nb = dot + float(x * y), na + float(x * x), nb + float(y * y)
    if na == 0 or nb == 0:
        return 0.0
    with np.errstate(all="ignore"):
        return float(np.float64(dot) / (math.sqrt(na) * math.sqrt(nb)))


def brute(docs, queries, k, threshold):
    out = set()
    for q, qv in queries:
        hits = [(-exact(qv, v), u) for u, v in docs if v is not None and len(v) == len(qv) and len(v)]
        hits = sorted((s, u) for s, u in hits if not math.isnan(s) and -s >= threshold)[:k]
        out |= {(q, u, -s) for s, u in hits}
    return out


def kernel(docs, queries, k, threshold, batch=7):
    best = TopK(QuerySlice(pa.array([q for q, _ in queries]), pa.array([v for _, v in queries], pa.list_(pa.float32()))), k, threshold)
    for i in range(0, len(docs), batch):
        part = docs[i : i + batch]
        best.add(pa.array([u for u, _ in part]), pa.array([v for _, v in part], pa.list_(pa.float32())))
    return {(r["query_id"], r["url"], r["score"]) for r in best.result().to_pylist()}


number = st.sampled_from([0.0, 1.0, -1.0, 0.5, 1e-30, -1e-25, 1e19, 3e38, 0.1, 0.3])
vector = st.one_of(st.none(), st.lists(number, min_size=0, max_size=3), st.lists(number, min_size=3, max_size=3))


@settings(max_examples=200, deadline=None)
@given(
    st.lists(vector, max_size=30),
    st.lists(st.lists(number, min_size=1, max_size=3), min_size=1, max_size=5),
    st.integers(1, 6),
    st.sampled_from([-1.0, 0.0, 0.5]),
)
def test_kernel_equals_brute_force(doc_vectors, query_vectors, k, threshold):
    docs = [(f"u{i % 11}-{i}", v) for i, v in enumerate(doc_vectors)]
    queries = list(enumerate(query_vectors))
    assert kernel(docs, queries, k, threshold) == brute(docs, queries, k, threshold)


def test_kernel_on_random_vectors_with_copies():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 16)).astype(np.float32)
    base[100:230] = base[7]  # a third are copies of one vector
    docs = [(f"u{i:04d}", v.tolist()) for i, v in enumerate(base)]
    queries = [(i, v.tolist()) for i, v in enumerate(np.vstack([rng.normal(size=(10, 16)), base[7:9]]))]
    for k in (1, 5, 150):
        assert kernel(docs, queries, k, -1.0, 64) == brute(docs, queries, k, -1.0)


@pytest.fixture(scope="module")
def kb(spark):
    rows = [
        ("same", [1.0, 2.0], "a"),
        ("opposite", [-1.0, -2.0], "a"),
        ("tie2", [2.0, 0.0], "a"),
        ("tie1", [4.0, 0.0], "b"),
        ("zero", [0.0, 0.0], "a"),
        ("none", None, "a"),
        ("empty", [], "a"),
        ("long", [1.0, 2.0, 3.0], "a"),
        ("overflow", [3e38, 3e38], "a"),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_search_order_and_skips(kb):
    rows = [(r.url, r["rank"]) for r in search.search(kb, [1.0, 2.0], 10).orderBy("rank").collect()]
    assert [u for u, _ in rows] == ["same", "tie1", "tie2", "zero", "opposite"]
    assert [n for _, n in rows] == [1, 2, 3, 4, 5]
    skipped = {r.reason: r.n_docs for r in search.search_skipped(kb, [1.0, 2.0]).collect()}
    assert skipped == {"empty": 2, "length": 1, "scored": 6}


def test_search_limits(kb):
    assert search.search(kb, [1.0, 2.0], 0).count() == 0
    assert search.search(kb, [1.0, 2.0]).count() == search.DEFAULT_RESULTS
    assert search.search(kb, [1.0, 2.0], 5, "nowhere").count() == 0
    assert [r.url for r in search.search(kb, [1.0, 2.0], 5, "b").collect()] == ["tie1"]
    with pytest.raises(ValueError):
        search.search(kb, [1.0], -1)


def test_search_beyond_the_top_n_plan(kb, monkeypatch):
    want = search.search(kb, [1.0, 2.0], 3).orderBy("rank").collect()
    monkeypatch.setattr(search, "DRIVER_ROWS", 2)
    assert search.search(kb, [1.0, 2.0], 3).orderBy("rank").collect() == want


@pytest.mark.parametrize("layout", [{}, {"slice_bytes": 100}, {"slice_hits": 4}])
def test_search_batch_layouts(spark, kb, layout):
    asked = [("q1", [1.0, 2.0]), ("q2", [0.0, 1.0]), ("q3", [1.0, 1.0, 1.0]), ("q4", [0.0, 0.0]), ("q5", None)]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<float>")
    docs = [(r.url, r.embeddings) for r in kb.collect()]
    got = search.search_batch(kb, queries, 3, -1.0, **layout).collect()
    assert {(r.query_id, r.url, r.score) for r in got} == brute(docs, [a for a in asked if a[1]], 3, -1.0)
    ranks = sorted(r["rank"] for r in got if r.query_id == "q1")
    assert ranks == [1, 2, 3]


def test_cosine_expression(spark):
    pair = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>")
    scores = [r.s for r in pair.select(vectors.cosine(F.col("a"), F.col("b")).alias("s")).collect()]
    assert scores == [exact([1, 2], [2, 4]), 0.0]
    uneven = spark.createDataFrame([([1.0, 2.0], [2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="differ in length"):
        uneven.select(vectors.cosine(F.col("a"), F.col("b"))).collect()


def test_vector_json(spark):
    texts = spark.createDataFrame([("[1.5,2]",), ("null",), ("[]",), ("[1,",), ("x",), (None,)], "t string")
    rows = texts.select(
        vectors.embeddings_from_json(F.col("t")).alias("v"), vectors.embeddings_json_error(F.col("t")).alias("e")
    ).collect()
    assert [r.v for r in rows][:3] == [[1.5, 2.0], None, []]
    assert [r.e is None for r in rows] == [True, True, True, False, False, False]
    back = spark.createDataFrame([([1.5, 2.0],), (None,)], "v array<float>").select(vectors.embeddings_to_json(F.col("v")))
    assert [r[0] for r in back.collect()] == ["[1.5,2.0]", "null"]


def test_wide_search_tasks_emit_little_more_than_k_rows_together(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(4000, 8)).astype(np.float32)
    vectors[:300] = vectors[0]  # a group of copies
    docs = spark.createDataFrame([(f"u{i:05}", [float(x) for x in v]) for i, v in enumerate(vectors)], "url string, embeddings array<float>").repartition(8)
    docs = docs.withColumn("context", F.lit(""))
    asked = spark.createDataFrame([(i, [float(x) for x in vectors[i * 7]]) for i in range(30)], "query_id long, embedding array<float>")
    emitted = []
    monkeypatch.setattr(search, "_merged", lambda part, k, real=search._merged: emitted.append(part.count()) or real(part, k))
    hits = {tuple(r) for r in search.search_batch(docs, asked, 200, -1.0).select("query_id", "url", "score", "rank").collect()}
    monkeypatch.setattr(search, "FLOORED_K", 1 << 30)
    plain = {tuple(r) for r in search.search_batch(docs, asked, 200, -1.0).select("query_id", "url", "score", "rank").collect()}
    assert hits == plain and len(hits) == 30 * 200
    assert emitted[0] < 30 * 200 * 3 < 30 * 200 * 8 * 0.9 < emitted[1]


def test_equal_scores_of_documents_without_url_come_first():
    docs = [("b", [1.0]), (None, [2.0]), ("a", [3.0]), (None, [4.0])]
    assert kernel(docs, [(0, [1.0])], 2, -1.0) == {(0, None, 1.0)}
    assert kernel(docs, [(0, [1.0])], 3, -1.0) == {(0, None, 1.0), (0, "a", 1.0)}
