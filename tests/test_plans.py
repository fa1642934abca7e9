"""The physical plans the operators are meant to have."""

import pytest
from pyspark.sql import functions as F

from lorebase import session
from lorebase.operators import crawl, extract, mutate, scan, search
from lorebase.operators.ordering import join_one
from lorebase.plans import testbed as bed
from lorebase.session import materialize
from lorebase.sources.store import KnowledgeBase

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    base = KnowledgeBase.open(spark, str(tmp_path_factory.mktemp("kb") / "kb"), buckets=8)
    base.upsert(bed.derived_kb(spark, SF_DIR))
    return base


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text):
    return [line for line in text.splitlines() if "FileScan" in line]


def test_search_is_a_pruned_top_n(spark, kb):
    text = plan(search.search(kb.stored(), bed.query_vector(spark, SF_DIR), 3, "en"))
    assert "TakeOrderedAndProject" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    docs = next(line for line in scans(text) if "embeddings:" in line)
    assert "EqualTo(context,en)" in docs and "content" not in docs.split("ReadSchema")[1].replace("context", "")


def test_batch_search_has_no_pair_rows(spark, kb):
    queries = bed.query_table(spark, SF_DIR)
    text = plan(search.search_batch(kb.stored(), queries, 5))
    assert "WindowGroupLimit" in text and "NestedLoop" not in text and "CartesianProduct" not in text
    # Only the merge of the partial results, by (query, part of the tasks) and by query.
    assert text.count("Exchange") == 2 and "hashpartitioning(query_id" in text and "_part" in text.split("Exchange")[2]
    sliced = plan(search.search_batch(kb.stored(), queries, 5, slice_bytes=10_000))
    assert "CoGroup" not in sliced and "NestedLoop" not in sliced and "embeddings" not in sliced


def test_wide_batch_search_is_merged_in_levels(spark, kb):
    text = plan(search.search_batch(kb.stored(), bed.query_table(spark, SF_DIR), 1500))
    exchanges = [line for line in text.splitlines() if "Exchange" in line]
    assert len(exchanges) == 3 and sum("_part" in line for line in exchanges) == 2


def test_list_reads_contents_within_the_bounds_of_its_slice(kb):
    text = plan(scan.list_documents(kb.stored(), 5, "fr"))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
    assert "GreaterThanOrEqual(url,doc://" in text and "LessThanOrEqual(url,doc://" in text


def test_lookup_reads_one_bucket(kb, monkeypatch):
    seen = []
    keep = scan.get_document
    monkeypatch.setattr(scan, "get_document", lambda df, *a: seen.append(keep(df, *a)) or seen[-1])
    kb.get_document("doc://src3/3")
    scanned = scans(plan(seen[0]))[0]
    assert "PartitionFilters: [isnotnull(bucket" in scanned and "EqualTo(url,doc://src3/3)" in scanned


def test_upsert_shuffles_keys_not_contents(spark, kb):
    text = plan(mutate.without_urls(kb.documents(), bed.upsert_batch(spark, SF_DIR).select("url").distinct()))
    assert "BroadcastHashJoin" in text and "LeftAnti" in text and "SortMergeJoin" not in text


def test_contents_are_not_aggregated(spark, monkeypatch):
    """Which row of a url or page stays is found on keys and digests."""
    plans = []
    keep = mutate.materialize

    def noted(df, *label):
        plans.append(plan(df))
        return keep(df, *label)

    monkeypatch.setattr(mutate, "materialize", noted)
    monkeypatch.setattr(crawl, "materialize", noted)
    plans.append(plan(mutate.latest_by_url(bed.upsert_batch(spark, SF_DIR), "seq")))
    pages = bed.linked_pages(spark, SF_DIR).select("url", "html")
    plans.append(plan(crawl.page_index(extract.parse_pages(pages).drop("main_text"))))
    lines = [line for text in plans for line in text.splitlines()]
    assert any("HashAggregate" in line for line in lines)
    for line in lines:
        if "Aggregate(" in line or "Exchange hashpartitioning" in line or "Sort [" in line:
            assert not any(wide in line for wide in ("content", "html", "markdown", "embeddings")), line
    assert sum("SortAggregate" in line for line in lines) == 0 or not any("_doc" in line or "_page" in line for line in lines)


def test_a_round_of_a_crawl_meets_the_index_once(spark, monkeypatch):
    pages = bed.linked_pages(spark, SF_DIR).select("url", "html")
    index = materialize(crawl.page_index(extract.parse_pages(pages)).select(*crawl.LINKS), "the-index")
    rounds = []
    keep = crawl.materialize
    monkeypatch.setattr(crawl, "materialize", lambda df, *label: rounds.append(plan(df)) or keep(df, *label))
    seeds = pages.select(F.col("url").alias("base_url")).limit(1)
    result = plan(crawl.crawl(index, seeds, 3))
    assert rounds and all(text.count("the-index") == 1 for text in rounds)
    assert "the-index" not in result and "Join" not in result


def test_literal_prefix_delete_is_pushed_down(kb):
    text = plan(mutate.delete_prefix(kb.stored(), "doc://src1", literal=True))
    assert "Not(StringStartsWith(url,doc://src1))" in text


def test_rounds_of_a_crawl_do_not_shuffle_a_large_page_index(spark, monkeypatch):
    pages = bed.linked_pages(spark, SF_DIR).select("url", "html")
    parsed = materialize(extract.parse_pages(pages).drop("html", "main_text"))
    frontier = materialize(parsed.select(F.col("url").alias("key"), F.lit("b").alias("base_url")))
    monkeypatch.setattr(session, "is_small", lambda df: False)
    index = session.materialize_by(crawl.page_index(parsed), "key")
    text = plan(join_one(frontier.hint("merge"), index.select("key", "hrefs"), "key"))
    assert text.count("Exchange") == 1 and "Bucketed: true" in text
    assert index.count() == 49
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lorebase_")]


def test_search_reads_stored_magnitudes(spark, kb):
    text = plan(search.search(kb.stored(), bed.query_vector(spark, SF_DIR), 3))
    docs = next(line for line in scans(text) if "magnitude" in line)
    assert "url:string,embeddings:array<float>,magnitude:double" in docs.split("ReadSchema")[1]
    stored = search.search(kb.stored(), bed.query_vector(spark, SF_DIR), 50).collect()
    assert stored == search.search(kb.documents(), bed.query_vector(spark, SF_DIR), 50).collect()
