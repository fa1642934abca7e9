import random

import pytest
from pyspark.sql import functions as F

from lorebase.operators import ordering, scan
from lorebase.operators.fetchplan import plan_fetches


def skewed(spark, n=600):
    """A third of the rows in one host; many equal arrivals; one null host."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None]), rng.randint(0, 40), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "host string, arrival long, id long").repartition(5)


def sequential(rows, delay):
    last, out = {}, {}
    for host, arrival, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        start = max(arrival, last[host] + delay) if host in last else arrival
        last[host] = out[i] = start
    return out


@pytest.mark.parametrize("delay", [0, 1, 7])
@pytest.mark.parametrize("rows_per_task", [10**6, 20])
def test_fetch_plan_equals_the_sequential_loop(spark, delay, rows_per_task):
    rows, df = skewed(spark)
    got = {r.id: r.start for r in plan_fetches(df, delay, rows_per_task).collect()}
    assert got == sequential(rows, delay)


@pytest.mark.parametrize("rows_per_task", [10**6, 20])
def test_index_within(spark, rows_per_task):
    rows, df = skewed(spark)
    want, seen = {}, {}
    for host, arrival, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want[i] = seen.get(host, 0)
        seen[host] = want[i] + 1
    got = ordering.index_within(df, ["host"], [F.col("arrival"), F.col("id")], "n", rows_per_task)
    assert {r.id: r.n for r in got.collect()} == want
    whole = ordering.index_within(df, [], [F.col("id")], "n", rows_per_task)
    assert all(r.n == r.id for r in whole.collect())


@pytest.mark.parametrize("rows_per_task", [10**6, 20])
def test_join_one(spark, rows_per_task):
    rows, df = skewed(spark)
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "host string, v int")
    got = ordering.join_one(df, right, "host", rows_per_task)
    value = {"hot": 1, "a": 2}
    assert sorted((r.id, r.v) for r in got.collect()) == sorted((i, value[h]) for h, _, i in rows if h in value)


def kb_of(spark, n):
    rows = [(f"u{i:03d}", "", "", "x", "", None, "even" if i % 2 == 0 else "odd", "") for i in range(n)]
    return spark.createDataFrame(rows, "url string, title string, description string, content string, checksum string, embeddings array<float>, context string, source_type string")


def test_pages_join_up_to_the_ordered_list(spark):
    kb = kb_of(spark, 23)
    pages = [[r.url for r in scan.page(kb, 5, o).collect()] for o in range(0, 30, 5)]
    assert sum(pages, []) == [f"u{i:03d}" for i in range(23)]
    assert [len(p) for p in pages] == [5, 5, 5, 5, 3, 0]
    assert scan.page_total(kb, "odd").first().total == 11


def test_limits(spark):
    kb = kb_of(spark, 23)
    assert scan.list_documents(kb, 0).count() == 10
    assert scan.list_documents(kb, -4).count() == 10
    assert scan.page(kb, 0).count() == 10
    assert [r.url for r in scan.list_documents(kb, 2, "odd").collect()] == ["u001", "u003"]
    assert scan.list_documents(kb, 5, "Odd").count() == 0
    with pytest.raises(ValueError):
        scan.page(kb, 5, -1)


def test_deep_page_is_cut_by_position(spark, monkeypatch):
    monkeypatch.setattr(ordering, "DRIVER_ROWS", 10)
    monkeypatch.setattr(ordering.index_within, "__defaults__", ("idx", 4))
    kb = kb_of(spark, 23)
    assert [r.url for r in scan.page(kb, 5, 15).collect()] == [f"u{i:03d}" for i in range(15, 20)]


def test_contexts(spark):
    kb = kb_of(spark, 4).unionByName(kb_of(spark, 1).withColumn("context", F.lit(""))).unionByName(
        kb_of(spark, 1).withColumn("context", F.lit(None).cast("string"))
    )
    assert {r.context for r in scan.contexts(kb).collect()} == {"even", "odd"}


def test_chunks_hold_about_the_rows_asked_for(spark):
    rows = spark.range(5000).selectExpr("1 AS k", "id")
    sizes = ordering.ordered_chunks(rows, ["k"], [F.col("id")], 500).groupBy("_chunk").count().collect()
    assert len(sizes) >= 9 and max(r["count"] for r in sizes) <= 1000
