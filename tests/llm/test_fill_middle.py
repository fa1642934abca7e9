import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from lorebase.llm import fill_middle as fim
from lorebase.llm.registry import QUERIES
from lorebase.llm.words import as_bytes

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_way(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fuzz(seed, n):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "a", "word", "é", "日本", "\U0001f600", "\x0b", "\x1c", " ", "<P", "<S>", "x" * 300, " " * 400, "<", ">"]
    return ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 9, 80, 900]))) for _ in range(n)]


def test_index_is_within_its_error_and_exact():
    texts = fuzz(1, 200) + ["a b " * 5000 + "y" * 3000 + " c" * 5000]
    data, offsets = as_bytes(pa.array([None, *texts]))
    place, first = fim.boundaries(data, offsets)
    for k, text in enumerate(texts, 1):
        ends = np.cumsum([0, *(len(t.encode()) for t in TOKEN.findall(text))])
        assert (place[first[k] : first[k + 1]] - offsets[k]).tolist() == ends.tolist()
    everything = np.arange(len(place))
    for error in (0, 3, fim.ERROR):
        index = fim.RankIndex.fit(place, first, error)
        assert np.array_equal(index.locate(everything), place)
        assert np.abs(index.predict(everything) - place).max() <= error
        assert np.isin(first[:-1], index.rank).all()
    assert index.residual.dtype == np.int8
    own = (index.rank >= first[-2]).sum()  # of the last text: even steps but for one jump
    assert own < 40 and first[-1] - first[-2] > 10_000


def test_odd_rows(odd, frame):
    marked = frame([(20, "a <P> b"), (21, "a <M b> c"), (22, "<S>"), *[(k, f"one two\tthree\n{k}  ") for k in range(30, 90)]])
    for docs in (odd, marked):
        done = fim.transform(docs)
        got = done.withColumn("back", fim.restored(done["output"], done["form"])).collect()
        asked = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = [(d, *plain_way(d, t), t or "") for d, t in asked]
        have = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got]
        assert sorted(have, key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fim.transform(frame([])).count() == 0 and fim.rank_index(frame([])).count() == 0


def test_stored_index(odd):
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] != 7}
    for r in fim.rank_index(odd).collect():
        if r["doc_id"] == 7:
            continue
        ends = np.cumsum([0, *(len(t.encode()) for t in TOKEN.findall(texts[r["doc_id"]]))])
        off, segments = np.frombuffer(r["residuals"], np.int8), r["segments"]
        assert r["n"] == len(ends) - 1 == len(off) - 1 and segments[0]["rank"] == 0
        for rank in {0, r["n"], r["n"] // 2, r["n"] // 3}:
            s = [s for s in segments if s["rank"] <= rank][-1]
            assert s["place"] + s["run"] * (rank - s["rank"]) // s["steps"] + int(off[rank]) == ends[rank]


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op12_fill_in_middle"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, p, m, output = plain_way(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
