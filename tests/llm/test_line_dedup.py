from pathlib import Path

import numpy as np
import pytest

from lorebase.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines

WS, UP, LOW = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows):
    key = lambda line: line.strip(WS).translate(str.maketrans(UP, LOW))
    held = {}
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 20:
                    held.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(held.get(key(x), ())) < 3 or d == max(held[key(x)])]
        out.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["kept_2"], r["n_lines_2"], r["n_dropped"]) for r in df.collect()), key=repr)


def test_odd_rows(odd, frame):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(dedup_lines(odd)) == brute(rows)
    assert dedup_lines(frame([])).count() == 0


def test_case_ends_ties_and_threshold(frame):
    line, other = "This Line has twenty and more characters", "exactly twenty chars"
    rows = [(1, f"{line}\nmine"), (2, f"  {line.upper()}\t"), (5, line.lower()), (5, line), (3, other), (4, other), (6, f"{other}\n{other}"), (9, "short\n" * 3)]
    assert result(dedup_lines(frame(rows))) == brute(rows)
    assert result(dedup_lines(frame(rows[:2]))) == brute(rows[:2])


def test_deletion_brings_lines_back(spark, frame):
    line = "a line that is shared by several documents"
    rows = [(k, f"{line}\nown text number {k} of this document") for k in range(1, 6)]
    index = LineIndex(spark, shards=2).insert(frame(rows[:3])).insert(frame(rows[3:]))
    assert {r["doc_id"] for r in index.lost().collect()} == {1, 2, 3, 4}
    index.delete(frame(rows[3:]))  # 4 and 5 go: 3 keeps the line
    assert {r["doc_id"] for r in index.lost().collect()} == {1, 2}
    index.delete(frame(rows[2:3]))  # two are left, too few to be common
    assert index.lost().count() == 0
    index.insert(frame(rows[4:])).insert(frame(rows[4:]))
    assert {r["doc_id"] for r in index.lost().collect()} == {1, 2}


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_filter_holds_all_and_forgets(n):
    keys = np.random.default_rng(n).integers(0, 2**63, (n, 2)).astype(np.uint64)
    held = CuckooFilter.of(keys)
    assert held.contains(keys).all()
    other = np.random.default_rng(99).integers(0, 2**63, (20_000, 2)).astype(np.uint64)
    assert held.contains(other).mean() < 0.01
    again = CuckooFilter.from_bytes(held.to_bytes())
    for mark, bucket in zip(*again.places(keys[::2])):
        assert again.delete(mark, bucket)
    assert again.contains(keys[1::2]).all()
    assert not n or again.contains(keys[::2]).mean() < 0.1


def test_a_batch_writes_only_its_shards(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    index = LineIndex(spark, shards=64).insert(docs)
    root = Path(index.path.removeprefix("file:"))

    def written(batch):
        return {p.relative_to(root).parts[0]: sorted({q.parent.name for q in root.glob(f"{p.name}/batch={batch}/shard=*/*.parquet")}) for p in root.iterdir()}

    assert len(written(1)["counts"]) > 40
    old = {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet")}
    shared = [r["text"] for r in docs.collect()][0].split("\n")[0]
    one = frame([(10**6, "a line of its own that nobody else has\n" + shared)])
    index.insert(one)
    assert 1 <= len(written(2)["counts"]) <= 2 and written(2)["counts"] == written(2)["log"]
    assert all(p.stat().st_mtime_ns == t for p, t in old.items())
    everything = docs.unionByName(one.select("doc_id", "text"))
    lost = {(r["doc_id"], len(r["keys"])) for r in index.lost().collect()}
    want = {(d, n) for d, n in dropped(everything).items() if n}
    assert lost == want and want
    index.delete(one).delete(docs.filter("doc_id % 3 = 0"))
    left = docs.filter("doc_id % 3 != 0")
    assert {(r["doc_id"], len(r["keys"])) for r in index.lost().collect()} == {(d, n) for d, n in dropped(left).items() if n}
    assert index.delete(one).batches == 4  # nothing to take away


def dropped(docs):
    """Number of different common lines that each document loses."""
    held = {}
    for r in docs.collect():
        for x in (r["text"] or "").split("\n"):
            key = x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            if len(key) >= 20:
                held.setdefault(key, set()).add(r["doc_id"])
    out = {}
    for ids in held.values():
        if len(ids) >= 3:
            for d in ids - {max(ids)}:
                out[d] = out.get(d, 0) + 1
    return out
