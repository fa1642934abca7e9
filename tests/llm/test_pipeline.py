import random
import resource

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from compare import difference, duck
from lorebase.llm.decontaminate import SeedIndex, leaks, tile, without_leaks
from lorebase.llm.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck(SF_DIR), ORACLES[name]) is None


def test_everything_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert set(ORACLES) <= set(entry.oracle_sql())


# -- decontamination -----------------------------------------------------------------------


def words_of(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def brute_tiles(a, b, least):
    """Greedy string tiling by trying all matches."""
    used_a, used_b, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return sorted(tiles)
        tiles.append(best)
        used_a |= set(range(best[0], best[0] + best[2]))
        used_b |= set(range(best[1], best[1] + best[2]))


def test_tiles_equal_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        a = [rng.choice("abc") for _ in range(rng.randrange(8, 30))]
        b = [rng.choice("abc") for _ in range(10)] + a[5:] + a[:7]
        seeds = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3]]
        if seeds:
            place = np.unique([i for i, _ in seeds])
            at = [np.array([j for i, j in seeds if i == p]) for p in place]
            assert sorted(tile(place, at, 3)) == brute_tiles(a, b, 3)


def test_very_repetitive_texts():
    """Every place of one meets every place of the other; the pairs are never held."""
    index = SeedIndex([1, 2], pa.array(["word " * 4000, "one two " * 500]), 5)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = list(index.leaks(pa.array(["word " * 50_000, "one two " * 9000, "two one " * 300]), 0.5))
    assert [(d, i, t) for d, i, t in found] == [(0, 0, [(0, 0, 4000)]), (1, 1, [(0, 0, 1000)]), (2, 1, [(1, 0, 600)])]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB


def test_a_large_benchmark_is_joined_by_its_seeds(spark, frame, odd):
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    repeated = bench.unionByName(bench.limit(3)).unionByName(spark.createDataFrame([(None, "a b c d e f"), (9, None), (8, "")], bench.schema))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").unionByName(odd.select(*COLUMNS)).unionByName(frame([(4, "x a b c d e f y")]).select(*COLUMNS))
    shown = [sorted(map(str, leaks(docs, repeated, block_bytes=n).collect())) for n in (1 << 30, 0)]
    assert shown[0] == shown[1] and len(shown[0]) >= 4
    kept = [sorted(map(str, without_leaks(docs, repeated, block_bytes=n).collect())) for n in (1 << 30, 0)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()
    assert leaks(docs, repeated.limit(0), block_bytes=-1).count() == 0 and without_leaks(odd.limit(0), bench, block_bytes=0).count() == 0


def test_leaks_in_any_order(spark, frame, odd):
    rng = random.Random(1)
    item = [f"w{k}" for k in range(40)]
    other = [f"v{k}" for k in range(12)]
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    bench = [(1, " ".join(item)), (2, ", ".join(other).upper()), (3, "too short"), (4, None), (5, "")]
    rows = [
        (1, noise(50) + item + noise(9)), (2, item[25:] + noise(20) + item[:25]), (3, noise(5) + item[:31]), (4, item[:32] + noise(3)), (5, other + noise(2000) + item),
        (6, [w for k in range(0, 40, 4) for w in item[k : k + 4] + noise(1)]), (7, noise(100)), (8, ["too", "short"]),
    ]
    docs = frame([(d, " ".join(w)) for d, w in rows])
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_covered"], r["n_words"], len(r["tiles"])) for r in leaks(docs, items).collect()}
    assert got == {(1, 1): (40, 40, 1), (2, 1): (40, 40, 2), (4, 1): (32, 40, 1), (5, 1): (40, 40, 1), (5, 2): (12, 12, 1)}
    assert sorted(r["doc_id"] for r in without_leaks(docs, items).collect()) == [3, 6, 7, 8]
    assert leaks(odd, items).count() == 0 and leaks(docs, items.limit(0)).count() == 0 and leaks(frame([]), items).count() == 0
    assert {r["item_id"] for r in leaks(odd, spark.createDataFrame([(1, "word " * 50)], "item_id long, text string")).collect()} == {1}


def test_decontamination_query(spark):
    docs = [(r["doc_id"], words_of(r["text"])) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    items = [(r["item_id"], words_of(r["text"])) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    want = set()
    for d, w in docs:
        runs = {tuple(w[k : k + 5]) for k in range(len(w))}
        for i, v in items:
            hit = set()
            for k in range(len(v) - 4):
                if tuple(v[k : k + 5]) in runs:
                    hit |= set(range(k, k + 5))
            if len(hit) >= 0.8 * len(v) and sum(n for _, _, n in brute_tiles(v, w, 5)) >= 0.8 * len(v):
                want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op10_benchmark_decontamination"](spark, SF_DIR).collect()} == want and want


# -- pipeline ------------------------------------------------------------------------------


def test_stages(spark):
    docs, rows = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, SF_DIR), "test")
        rows[name] = docs.count()
        if name != "byte-level BPE":
            assert docs.columns == COLUMNS
        assert 0 < rows[name] <= before.count()
    assert rows["toxicity"] > 150 and rows["byte-level BPE"] == rows["benchmark decontamination"] < rows["line dedup"] == rows["toxicity"]
    again = corpus_pipeline.run(spark, SF_DIR).select("doc_id", "ids_sha256").collect()
    assert {tuple(r) for r in docs.select("doc_id", "ids_sha256").collect()} == {tuple(r) for r in again}


def test_stages_take_odd_rows(spark, odd, frame):
    for docs in (odd, frame([])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            assert out.count() <= docs.count()
            assert out.columns == COLUMNS or name == "byte-level BPE"


def test_decisions_take_effect(spark, frame):
    same = [f"t{k}" for k in range(60)]
    rows = [(3, " ".join(same)), (7, " ".join(same)), (2, " ".join([*same[:58], "x", "y"])), (9, "on its own"), (None, " ".join(same)), (11, None)]
    kept = corpus_pipeline.near_duplicates(spark, frame(rows), SF_DIR).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["11", "2", "9", "None"]
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first()["text"]
    kept = corpus_pipeline.benchmark_leaks(spark, frame([(1, f"before {item} after"), (2, "clean"), (None, None)]), SF_DIR).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["2", "None"]
    line = "a line that is found in three documents"
    kept = corpus_pipeline.line_dedup(spark, frame([(k, f"{line}\nown {k}") for k in (1, 2, 3)]), SF_DIR).collect()
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in kept) == [(1, "own 1", 5), (2, "own 2", 5), (3, f"{line}\nown 3", len(line) + 6)]
