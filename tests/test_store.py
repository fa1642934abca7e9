import hashlib
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorebase.operators import mutate, reports
from lorebase.operators.embed import embed, split_rejects
from lorebase.plans import ingest
from lorebase.schema import KB_SCHEMA
from lorebase.sources import store
from lorebase.sources.store import KnowledgeBase
from lorebase.streaming import ingest as streaming
from lorebase.streaming.ingest import stream_ingest

DOC = "url string, content string, context string, seq int"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def contents(df):
    return {r.url: (r.content, r.context) for r in df.collect()}


def test_upsert_replaces_every_column_and_moves_context(spark):
    kb = mutate.upsert(spark.createDataFrame([], KB_SCHEMA), docs(spark, [("a", "1", "x", 1), ("b", "1", "x", 1)]))
    kb = mutate.upsert(kb, docs(spark, [("a", "2", "y", 1), ("a", "3", "z", 2), ("c", "1", "x", 1)]), "seq")
    assert contents(kb) == {"a": ("3", "z"), "b": ("1", "x"), "c": ("1", "x")}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("12"), st.sampled_from("xy"), st.integers(0, 3)), max_size=8))
def test_upsert_is_idempotent(spark, rows):
    batch = docs(spark, rows)
    once = mutate.upsert(spark.createDataFrame([], KB_SCHEMA), batch, "seq")
    assert contents(mutate.upsert(once, batch, "seq")) == contents(once)


@pytest.mark.parametrize("limit", [10**9, 100, 0])
def test_keys_are_removed_whatever_their_number(spark, limit):
    kb = docs(spark, [(f"u{i}", "c", "x", 1) for i in range(20)])
    left = mutate.without_urls(kb, docs(spark, [(f"u{i}", "", "", 1) for i in range(0, 40, 2)]).select("url"), limit)
    assert {r.url for r in left.collect()} == {f"u{i}" for i in range(1, 20, 2)}


@pytest.mark.parametrize(
    "prefix, kw, gone",
    [
        ("DOC://A", {}, {"doc://a1", "Doc://A2"}),
        ("doc://a_", {}, {"doc://a1", "Doc://A2"}),
        ("doc://%2", {}, {"Doc://A2"}),
        ("doc://a_", {"literal": True}, set()),
        ("doc://a", {"literal": True}, {"doc://a1"}),
        ("", {}, {"doc://a1", "Doc://A2", "x\\y", "É"}),
        ("x\\", {}, {"x\\y"}),
        ("é", {}, set()),
        ("", {"context": "c2"}, {"Doc://A2"}),
    ],
)
def test_delete_prefix(spark, prefix, kw, gone):
    kb = docs(spark, [("doc://a1", "", "c1", 1), ("Doc://A2", "", "c2", 1), ("x\\y", "", "c1", 1), ("É", "", "c1", 1)])
    kb = mutate.upsert(spark.createDataFrame([], KB_SCHEMA), kb)
    kept = {r.url for r in mutate.delete_prefix(kb, prefix, **kw).collect()}
    assert kept == {"doc://a1", "Doc://A2", "x\\y", "É"} - gone


def test_snapshots(spark, tmp_path):
    kb = KnowledgeBase.open(spark, str(tmp_path / "kb"), buckets=4)
    assert kb.documents().count() == 0 and kb.version() == 0
    kb.upsert(docs(spark, [(f"u{i}", str(i), "x", 1) for i in range(30)]))
    before = kb.documents()
    assert kb.upsert(docs(spark, [("u1", "new", "y", 1), ("v", "v", "y", 1)])) == 2
    assert before.count() == 30  # readers of the earlier snapshot are undisturbed
    again = KnowledgeBase.open(spark, str(tmp_path / "kb"), buckets=99)
    assert again.buckets == 4 and again.documents().count() == 31
    assert again.get_document("u1")["content"] == "new"
    with pytest.raises(KeyError):
        again.get_document("u1", "x")
    again.delete_prefix("u1")
    assert {r.url for r in again.contexts().crossJoin(again.documents()).collect() if r.url.startswith("u1")} == set()
    again.clean()
    assert again.documents().count() == 0


def data_files(path):
    return {p.relative_to(path) for p in path.rglob("data/**/*.parquet")}


def test_upsert_writes_only_touched_buckets(spark, tmp_path):
    kb = KnowledgeBase.open(spark, str(tmp_path), buckets=8)
    kb.upsert(docs(spark, [(f"u{i}", str(i), "x", 1) for i in range(40)]))
    old, before = data_files(tmp_path), kb.documents()
    assert kb.upsert(docs(spark, [("u7", "new", "y", 1)])) == 2
    new = data_files(tmp_path) - old
    assert old <= data_files(tmp_path) and len({f.parent for f in new}) == 1
    versions = kb.snapshot().versions
    assert sorted(versions.values()) == [1] * 7 + [2] and len(versions) == 8
    got = contents(kb.documents())
    assert len(got) == 40 and got["u7"] == ("new", "y") and contents(before)["u7"] == ("7", "x")
    assert kb.upsert(docs(spark, [])) == 2
    kb.delete_prefix("u7")
    assert len({f.parent for f in data_files(tmp_path) - old - new}) == 1 and kb.documents().count() == 39


def test_a_change_that_stops_between_its_steps_did_not_happen(spark, tmp_path, monkeypatch):
    kb = KnowledgeBase.open(spark, str(tmp_path))
    kb.upsert(docs(spark, [("a", "1", "x", 1), ("b", "1", "x", 1)]))

    def stop(now):
        raise RuntimeError("stopped")

    for change in (lambda: kb.upsert(docs(spark, [("a", "2", "x", 1)])), lambda: kb.delete_prefix("a"), lambda: kb.rebucket(64)):
        with monkeypatch.context() as m:
            m.setattr(kb, "_publish", stop)
            with pytest.raises(RuntimeError, match="stopped"):
                change()
        again = KnowledgeBase.open(spark, str(tmp_path))
        assert again.version() == 1 and contents(again.documents()) == {"a": ("1", "x"), "b": ("1", "x")}
    assert kb.upsert(docs(spark, [("b", "2", "x", 1)])) == 2  # over what the stopped ones left
    assert contents(kb.documents()) == {"a": ("1", "x"), "b": ("2", "x")}


def test_the_first_upsert_chooses_the_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_BYTES", 100)
    kb = KnowledgeBase.open(spark, str(tmp_path))
    assert kb.buckets == 0 and kb.documents().count() == 0
    with pytest.raises(KeyError):
        kb.get_document("u1")
    kb.upsert(docs(spark, [(f"u{i}", str(i), "x", 1) for i in range(60)]))
    assert 38 < kb.buckets < 100
    assert kb.get_document("u59")["content"] == "59"


def test_files_of_a_bucket_hold_disjoint_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FILE_BYTES", 2000)
    kb = KnowledgeBase.open(spark, str(tmp_path), buckets=2)
    kb.upsert(docs(spark, [(f"u{i:03d}", str(i), "x", 1) for i in range(300)]))
    spans = kb.stored().groupBy("bucket", F.input_file_name().alias("f")).agg(F.min("url").alias("a"), F.max("url").alias("z"))
    rows = sorted((r.bucket, r.a, r.z) for r in spans.collect())
    assert len(rows) > 6 and all(x[0] != y[0] or x[2] < y[1] for x, y in zip(rows, rows[1:]))


def test_search_and_reports(spark, tmp_path):
    kb = KnowledgeBase.open(spark, str(tmp_path / "kb"))
    with pytest.raises(LookupError):
        kb.search([1.0])
    done = ingest.ingest_rows(docs(spark, [(f"u{i}", f"text number {i} é", "x", 1) for i in range(9)]), "x")
    kb.upsert(done.documents)
    query = kb.get_document("u4")["embeddings"]
    rows = kb.search(query, 2).collect()
    assert rows[0].url == "u4" and rows[0].content == "text number 4 é" and len(rows) == 2
    assert kb.search("text number 7 é", 1, "x").first().url == "u7"
    with pytest.raises(ValueError):
        kb.search("")
    shown = reports.search_report(kb.search(query, 1)).collect()
    assert [(r["rank"], r.url, r.score) for r in shown] == [(1, "u4", "1.0000")]
    listed = reports.list_report(kb.documents()).first()
    assert (listed.url, listed.content_length, listed.embeddings_length) == ("u0", 16, 64)
    page, total = kb.page(4, 8, "x")
    assert total == 9 and [r.url for r in page.collect()] == ["u8"]
    json = reports.to_json_rows(kb.list_documents(1), ["url", "embeddings", "title"]).first().json
    assert json.startswith('{"url":"u0","embeddings":[') and json.endswith('"title":""}')


def test_one_bad_text_costs_only_itself(spark):
    def fussy(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [[] if "none" in t else [float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("ok",), ("bad",), ("none",), (None,), ("fine",)], "content string").coalesce(1)
    good, bad = split_rejects(embed(df, embedder=fussy))
    assert {r.content: list(r.embeddings) for r in good.collect()} == {"ok": [2.0, 1.0], "fine": [4.0, 1.0]}
    errors = {r.content: r.error for r in bad.collect()}
    assert errors == {"bad": "the embedder failed: refused", "none": "the embedder gave no vector", None: "no text"}


def write_files(folder):
    folder.mkdir(exist_ok=True)
    (folder / "guide.md").write_text("# Guide\n\nSome **bold** text.\n")
    (folder / "with space.txt").write_text("spaced")
    (folder / "bom.txt").write_bytes(b"\xef\xbb\xbfmark")
    (folder / "latin.txt").write_bytes(b"caf\xe9")
    (folder / "empty.txt").write_bytes(b"")


def test_ingest_files(spark, tmp_path):
    folder = tmp_path / "in"
    write_files(folder)
    done = ingest.ingest_files(spark, str(folder), "files")
    got = {r.title: r for r in done.documents.collect()}
    assert set(got) == {"guide.md", "with space.txt", "bom.txt"}
    doc = got["with space.txt"]
    assert doc.url == f"file://{folder}/with space.txt" and doc.source_type == "file_read" and doc.description == ""
    assert doc.checksum == hashlib.sha256(b"spaced").hexdigest()
    assert got["bom.txt"].content == "﻿mark"
    assert [r.url for r in done.rejects.collect()] == [f"file://{folder}/latin.txt"]


def test_stream_ingest(spark, tmp_path):
    folder, kb = tmp_path / "in", KnowledgeBase.open(spark, str(tmp_path / "kb"), buckets=300)
    write_files(folder)

    def drain():
        paths = str(tmp_path / "cp"), str(tmp_path / "rejects")
        query = stream_ingest(spark, str(folder), kb, "files", *paths, max_files_per_trigger=2)
        query.awaitTermination()
        return {r.title: r.content for r in kb.documents().collect()}

    assert set(drain()) == {"guide.md", "with space.txt", "bom.txt"}
    (folder / "late.txt").write_text("late")
    old = data_files(tmp_path)
    assert drain()["late.txt"] == "late"
    assert len(data_files(tmp_path) - old) == 1 and old <= data_files(tmp_path)  # the table is not copied
    (folder / "late2.txt").write_bytes(b"\xe9")
    drain()
    rejects = spark.read.parquet(str(tmp_path / "rejects"))
    assert {r.url.rsplit("/", 1)[1] for r in rejects.collect()} == {"latin.txt", "late2.txt"}
    assert rejects.filter("error IS NULL").isEmpty()


def test_stream_replay_gives_the_same_rows(spark, tmp_path):
    folder, kb = tmp_path / "in", KnowledgeBase.open(spark, str(tmp_path / "kb"))
    write_files(folder)
    for run in ("cp1", "cp2"):  # a new checkpoint sees every file again
        stream_ingest(spark, str(folder), kb, "files", str(tmp_path / run), str(tmp_path / f"{run}-rejects")).awaitTermination()
    assert kb.documents().count() == 3


def test_small_files_of_a_stream_share_tasks(spark, tmp_path, monkeypatch):
    folder, kb, seen = tmp_path / "in", KnowledgeBase.open(spark, str(tmp_path / "kb")), []
    folder.mkdir()
    for i in range(200):
        (folder / f"{i}.txt").write_text(f"text {i}")
    keys = "spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = [spark.conf.get(k) for k in keys]

    def watched(docs, *args, real=streaming.embed_documents):
        seen.append((docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get(keys[1]))))
        return real(docs, *args)

    monkeypatch.setattr(streaming, "embed_documents", watched)
    stream_ingest(spark, str(folder), kb, "files", str(tmp_path / "cp"), str(tmp_path / "rejects")).awaitTermination()
    cores = spark.sparkContext.defaultParallelism
    assert len(seen) == 1 and seen[0][0] <= cores + 1 and seen[0][1] <= 4 * cores
    assert [spark.conf.get(k) for k in keys] == before  # the caller's session keeps its settings
    assert {r.title: r.content for r in kb.documents().collect()} == {f"{i}.txt": f"text {i}" for i in range(200)}


def test_only_repeated_urls_are_copied_again(spark, tmp_path, monkeypatch):
    kb, copies = KnowledgeBase.open(spark, str(tmp_path), buckets=2), []
    monkeypatch.setattr(store, "materialize", lambda df, label, real=store.materialize: copies.append(label) or real(df, label))
    kb.upsert(docs(spark, [("a", "1", "x", 1), ("b", "1", "x", 1)]), "seq")
    assert copies == [] and contents(kb.documents()) == {"a": ("1", "x"), "b": ("1", "x")}
    kb.upsert(docs(spark, [("a", "2", "x", 1), ("a", "3", "y", 2), ("c", "1", "x", 1)]), "seq")
    assert copies == ["batch"] and contents(kb.documents()) == {"a": ("3", "y"), "b": ("1", "x"), "c": ("1", "x")}


def test_latest_file_version_wins_inside_a_batch(spark):
    rows = [("u", "old", "x", datetime(2024, 1, 1)), ("u", "new", "x", datetime(2024, 1, 2))]
    batch = spark.createDataFrame(rows, "url string, content string, context string, at timestamp")
    assert [r.content for r in mutate.latest_by_url(batch, "at").collect()] == ["new"]


def test_rows_need_url_and_content(spark):
    with pytest.raises(ValueError):
        ingest.ingest_rows(spark.createDataFrame([("u",)], "url string"))
    rows = spark.createDataFrame([("u", None), (None, "c"), ("v", "c")], "url string, content string")
    done = ingest.ingest_rows(rows)
    assert [(r.url, r.context, r.source_type) for r in done.documents.collect()] == [("v", "", "")]
    assert done.rejects.filter(F.col("error") == "url and content are required").count() == 2


def test_ties_are_settled_by_contents(spark):
    rows = [("u", "a", "x", 1, [1.0]), ("u", "b", "x", 1, [1.0]), ("u", "b", "x", 1, [2.0]), ("u", "z", "x", 0, [1.0])]
    seen = set()
    for some in (rows, rows[::-1], rows[1:] + rows[:1]):
        batch = spark.createDataFrame(some, "url string, content string, context string, at int, embeddings array<float>")
        seen |= {(r.content, tuple(r.embeddings)) for r in mutate.latest_by_url(batch, "at").collect()}
    assert len(seen) == 1 and seen < {("a", (1.0,)), ("b", (1.0,)), ("b", (2.0,))}


def test_duplicates_without_an_order(spark):
    same = spark.createDataFrame([("u", "a"), ("u", "a"), ("v", "b")], "url string, content string")
    assert sorted(r.content for r in mutate.latest_by_url(same).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="order column needed"):
        mutate.latest_by_url(spark.createDataFrame([("u", "a"), ("u", "b")], "url string, content string")).collect()


def test_rebucket(spark, tmp_path):
    kb = KnowledgeBase.open(spark, str(tmp_path), buckets=2)
    rows = spark.createDataFrame([(f"u{k}", f"c{k}") for k in range(40)], "url string, content string")
    kb.upsert(rows)
    finer = kb.rebucket(8)
    again = KnowledgeBase.open(spark, str(tmp_path))
    assert again.buckets == finer.buckets == 8
    assert again.get_document("u7")["content"] == "c7" and again.documents().count() == 40
    with pytest.raises(ValueError):
        finer.rebucket(8)


def test_list_report_holds_every_document(spark):
    kb = spark.range(1500).selectExpr("cast(id AS string) AS url", "'' AS source_type", "'' AS checksum", "'' AS content", "array(cast(1 AS float)) AS embeddings")
    assert reports.list_report(kb).count() == 1500
    assert reports.list_report(kb, 10).count() == 10
