import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lorebase.llm import bpe, token_counts
from lorebase.llm.registry import QUERIES

PATH = P.path("byte_bpe_50k.tiktoken")
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(seed, n):
    rng = random.Random(seed)
    bits = ["ab", "  ", " ", "\n", "'s", "'ll", "12", "é", ".", "!x", "日", "the ", "\t", "'r", "e", "\U0001f600", "　", "\x1c"]
    return ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(n)]


def test_encoding_equals_the_library(library):
    rng = random.Random(1)
    texts = fuzz(3, 150) + ["a" * 3000, "thethethe" * 200, "<|endoftext|>", "".join(rng.choice("etaoinshrdlu") for _ in range(3000))]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(200, 300))) for _ in range(10)]
    tok = bpe.Tokenizer(PATH, P.PATTERN)
    ends, ids = tok.encode([None, *texts])
    assert ends[1] == 0
    assert [ids[a:b].tolist() for a, b in zip(ends[1:], ends[2:])] == [library.encode_ordinary(t) for t in texts]
    assert tok.decode(ends, ids) == [b"", *(t.encode() for t in texts)]
    with pytest.raises(ValueError, match="vocabulary"):
        tok.decode(np.array([0, 1]), np.array([10**6], np.int32))


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    tok = bpe.Tokenizer(PATH, P.PATTERN)
    for text in ("one two three four", "five six seven eight nine ten", "one five"):
        assert tok.encode([text])[1].tolist() == library.encode_ordinary(text)


def test_odd_rows(odd, frame, library):
    got = bpe.encode(odd, PATH, P.PATTERN, and_decode=True)
    for r in got.collect():
        text = r["text"] or ""
        assert r["ids_2"] == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    again = bpe.decode(got, PATH, P.PATTERN, "ids_2")
    assert all(r["decoded"] == r["decoded_2"] for r in again.collect())
    assert bpe.encode(frame([]), PATH, P.PATTERN).count() == 0


def test_bpe_query(spark, library):
    got = {r["doc_id"]: r for r in QUERIES["op8_byte_bpe"](spark, SF_DIR).collect()}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        ids, g = library.encode_ordinary(r["text"]), got[r["doc_id"]]
        said = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), said, hashlib.sha256(r["text"].encode()).hexdigest())


def test_edits(library):
    count, rng, read, whole = token_counts.Counter(PATH, P.PATTERN), random.Random(5), 0, 0
    for text in fuzz(7, 200) + [" ".join(fuzz(8, 40))] * 20:
        tree = token_counts.SegmentTree(*count.leaves(text))
        for new in fuzz(rng.random(), 3):
            a = rng.randint(-2, len(text) + 2)
            text, tree, n = token_counts.edit(text, tree, a, a + rng.choice([0, 0, 1, 3, 50]), new, count)
            read, whole = read + n, whole + len(text)
            assert (tree.tokens, tree.chars) == (len(library.encode_ordinary(text)), len(text))
    assert read < whole


def test_recount_of_odd_rows(spark, odd, frame, library):
    state = token_counts.count_tokens(odd, PATH, P.PATTERN)
    edits = [(1, 1, 0, 5, "new text"), (6, 2, 0, 3, None), (6, 1, 3, 10**6, "x  "), (7, 1, -5, -1, "'"), (9, 1, 100_000, 100_001, " w"), (77, 1, 0, 0, "no"), (None, 1, 0, 9, "no")]
    edits = spark.createDataFrame(edits, "doc_id long, seq int, start int, end int, replacement string")
    got = token_counts.recount(odd, state, edits, PATH, P.PATTERN).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r["n_tokens"] == len(library.encode_ordinary(r["text"])) == sum(r["leaf_tokens"])
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["text"] == "new text" and by_id[6]["text"] == "x  "  # seq 1 leaves "a lx  ", seq 2 deletes "a l"
    assert by_id[9]["n_read"] < 3000
    assert token_counts.recount(frame([]), state, edits, PATH, P.PATTERN).count() == 0


def test_count_query(spark, library):
    got = {r["doc_id"]: r for r in QUERIES["op7_token_counts"](spark, SF_DIR).collect()}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        x = r["text"]
        n, y = len(x), f"{r['source']}: {x}"
        a, b = n // 2, min(int(n / 2 + 20), len(y))
        y = y[:a] + r["lang"] + y[max(a, b) :]
        a = min(max(n - 10, 0), len(y))
        y = y[:a] + y[min(max(n, a), len(y)) :]
        assert (got[r["doc_id"]]["n_before"], got[r["doc_id"]]["n_tokens"]) == (len(library.encode_ordinary(x)), len(library.encode_ordinary(y)))


def test_null_places(spark, frame, library):
    docs = frame([(1, None), (2, "one two three"), (3, "one two three"), (4, "one two three")])
    edits = [(1, 1, None, None, "new"), (2, 1, None, 4, "x "), (3, 1, 4, None, "and "), (4, None, None, None, None)]
    edits = spark.createDataFrame(edits, "doc_id long, seq int, start int, end int, replacement string")
    got = token_counts.recount(docs, token_counts.count_tokens(docs, PATH, P.PATTERN), edits, PATH, P.PATTERN).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: "new", 2: "x two three", 3: "one and two three", 4: "one two three"}
    assert all(r["n_tokens"] == len(library.encode_ordinary(r["text"])) for r in got)


def test_count_query_over_odd_rows(odd, library, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for r in odd.collect():
        x = r["text"] or ""
        n, y = len(x), f"{r['source']}: {x}"
        for a, b, said in ((n / 2, n / 2 + 20, r["lang"] or ""), (n - 10, n, "")):
            a = min(max(int(a), 0), len(y))
            y = y[:a] + said + y[min(max(int(b), a), len(y)) :]
        want.append((r["doc_id"], len(library.encode_ordinary(x)), len(library.encode_ordinary(y)) if r["doc_id"] is not None else len(library.encode_ordinary(x))))
    got = QUERIES["op7_token_counts"](odd.sparkSession, str(tmp_path)).collect()
    assert sorted(want, key=repr) == sorted(((r["doc_id"], r["n_before"], r["n_tokens"]) for r in got), key=repr)


def test_texts_that_the_state_lacks_are_encoded(frame, library):
    docs = frame([(1, "one two three"), (2, "not in the state"), (2, "nor this"), (3, None)])
    state = token_counts.count_tokens(frame([(9, "one two three")]), PATH, P.PATTERN)
    edits = frame([]).sparkSession.createDataFrame([(2, 1, 0, 3, "was")], "doc_id long, seq int, start int, end int, replacement string")
    got = token_counts.recount(docs, state, edits, PATH, P.PATTERN).collect()
    count = lambda t: len(library.encode_ordinary(t))
    want = [(1, "one two three", "one two three"), (2, "not in the state", "was in the state"), (2, "nor this", "was this"), (3, "", "")]
    assert sorted((r["doc_id"], r["n_before"], r["text"], r["n_tokens"]) for r in got) == sorted((d, count(a), b, count(b)) for d, a, b in want)
