"""Python memory, chunks and files that grow no faster than the input."""

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lorebase.functions import embedders
from lorebase.functions.memory import text_slices
from lorebase.operators import embed, extract, fetchplan
from lorebase.plans import registry, testbed
from lorebase.session import local_folder


def test_slices_are_bounded_and_cover_all():
    texts = pa.array(["a" * 10, None, "é" * 30, "", "b" * 5, "c", "d"])
    assert list(text_slices(texts, 20, 3)) == [(0, 2), (2, 3), (3, 6), (6, 7)]
    assert list(text_slices(texts.slice(2), 20, 3)) == [(0, 1), (1, 4), (4, 5)]
    assert list(text_slices(pa.array([], pa.string()), 20, 3)) == []


def test_pages_are_read_a_slice_at_a_time():
    pages = pa.array([f"<title>t{i}</title><p>{'x' * 5000}</p>" for i in range(1000)])
    parts = list(extract._parsed(iter([pages])))
    assert len(parts) > 4 and max(map(len, parts)) <= extract.HTML_ROWS
    assert [r["title"] for p in parts for r in p.to_pylist()] == [f"t{i}" for i in range(1000)]


def test_embedder_gets_bounded_slices(spark):
    def sizes(texts):
        return [[float(len(texts))] for _ in texts]

    docs = spark.range(0, 5000, 1, 1).select("id", F.lit("x" * 10_000).alias("content"))
    most = embed.embed(docs.coalesce(1), embedder=sizes).agg(F.max(F.col("embeddings")[0]), F.count("embeddings")).first()
    assert most[0] <= embed.TEXT_BYTES // 10_000 and most[1] == 5000


def test_long_texts_embed_as_in_one_go(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.choice([32, 97, 233, 0x4E00, 0x1F600, 0xD800], n))) for n in (1, 2, 3, 6, 7, 8, 9, 50)]
    whole = [embedders.HashingEmbedder().embed(t) for t in texts]
    seen = []
    real = np.bincount
    monkeypatch.setattr(embedders, "WINDOWS_AT_ONCE", 7)
    monkeypatch.setattr(np, "bincount", lambda h, **kw: seen.append(len(h)) or real(h, **kw))
    assert all((a == embedders.HashingEmbedder().embed(t)).all() for a, t in zip(whole, texts))
    assert max(seen) == 7 and sum(seen) == sum(map(len, texts))


def test_hot_hosts_plan_has_a_bounded_number_of_chunks(spark, tmp_path, monkeypatch):
    rows = spark.range(30_000).selectExpr("id AS event_id", "id % 3 AS user_id", "timestamp_micros(id * 1000) AS ts")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    used = []
    monkeypatch.setattr(fetchplan, "ordered_chunks", lambda df, keys, order, n, real=fetchplan.ordered_chunks: used.append(n) or real(df, keys, order, n))
    hot = registry.fetch_plan_hot_hosts(spark, str(tmp_path))
    assert -(-30_000 // used[0]) <= registry.HOT_CHUNKS
    assert {tuple(r) for r in hot.collect()} == {tuple(r) for r in registry.fetch_plan(spark, str(tmp_path)).collect()}


def test_a_stream_gets_a_file_for_each_document(spark, tmp_path):
    rows = [(1, "one"), (301, "two\nlines"), (301, "again"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r["place"], r["content"]) for r in registry.stream_ingest(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("key=1", "again\n"), ("key=1", "one\n"), ("key=1", "two\nlines\n"), ("key=2", "\n"), ("key=3", "\n")]


def test_single_files_are_those_of_sparks_writer(spark, tmp_path, monkeypatch):
    rows = [(1, "one"), (301, "two\nlines"), (301, "again"), (301, "again"), (2, None), (-3, ""), (None, "caf\u00e9"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))

    def written():
        top = Path(testbed.document_files(spark, str(tmp_path), single=True).removeprefix("file:"))
        return top, sorted((p.parent.name, p.read_bytes()) for p in top.rglob("part-*") if p.is_file())

    top, own = written()
    assert len(own) == len(rows) and not [p for p in top.rglob(".*")]  # no checksum and no unfinished files
    assert ("key=297", b"\n") in own and ("key=__HIVE_DEFAULT_PARTITION__", "caf\u00e9\n".encode()) in own
    monkeypatch.setattr(testbed, "local_folder", lambda spark, path: None)
    assert written()[1] == own


def test_a_folder_in_another_store_is_not_local(spark, tmp_path):
    assert local_folder(spark, f"file://{tmp_path}/a b") == f"{tmp_path}/a b" == local_folder(spark, f"{tmp_path}/a b")
    assert local_folder(spark, "viewfs://store/in") is None
