"""Knowledge bases and batches derived from the given tables, for the registered queries."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.text import checksum
from lorebase.operators.ordering import index_within
from lorebase.plans import exchange
from lorebase.session import local_folder, materialize, new_work_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a stored row; some lack a vector, some have one of another length or of zeros."""
    docs = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    doc_id, vec = F.col("doc_id"), F.col("embedding")
    zeros = F.transform(vec, lambda v: F.lit(0.0).cast("float"))
    vector = (
        F.when((doc_id > 0) & (doc_id % 17 == 0), F.slice(vec, 1, 32))
        .when((doc_id > 0) & (doc_id % 23 == 0), zeros)
        .otherwise(vec)
    )
    return docs.join(vectors, "doc_id", "left").select(
        F.concat(F.lit("doc://"), "source", F.lit("/"), doc_id.cast("string")).alias("url"),
        F.concat(F.lit("Document "), doc_id.cast("string")).alias("title"),
        F.lit("").alias("description"),
        F.col("text").alias("content"),
        checksum(F.col("text")).alias("checksum"),
        vector.alias("embeddings"),
        F.when(doc_id % 11 == 0, "").otherwise(F.col("lang")).alias("context"),
        F.when(doc_id % 2 == 0, "web_scrape").otherwise("file_read").alias("source_type"),
    )


REFERENCES = [
    "x/y", "../x", "./z?q=1", "?q", "#f", "/abs/../up", "", "//other.invalid/p", "https://elsewhere.invalid/", "mailto:a@b", "a b", "%41%zz",
    "caf\u00e9", "..", "/%7Euser/",
]
"""References to resolve against the pages' addresses."""


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding")


def query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document again, in two versions under a new context, and every conversation turn as a new url."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    versions = F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")
    again = docs.join(labels, "doc_id").select("doc_id", "source", "text", versions)
    text = F.concat("text", F.lit(" v"), F.col("seq").cast("string"))
    replaced = again.select(
        F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("Version "), F.col("seq").cast("string")).alias("title"),
        text.alias("content"),
        F.lit("moved").alias("context"),
        "seq",
    )
    turns = table(spark, sf_dir, "conversations")
    turn_id = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    new = turns.select(
        F.concat(F.lit("conv://"), turn_id).alias("url"),
        F.col("role").alias("title"),
        F.col("text").alias("content"),
        F.lit("talk").alias("context"),
        F.lit(1).alias("seq"),
    )
    return replaced.unionByName(new).withColumn("checksum", checksum(F.col("content")))


def host(url: str = "url"):
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ids and urls numbered from 0 within their host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", host().alias("host"))
    return index_within(pages, ["host"], [F.col("page_id")], "rank")


def site_seeds(ranked: DataFrame) -> DataFrame:
    return ranked.filter(F.col("rank") == 0).select(F.col("url").alias("base_url"))


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages(url, html, host, rank) with a list of links appended that makes each host a small web.

    Page r links to pages 2r+1, 2r+2, 0 and 3r+2 of its host where they exist, and off the site.
    """
    ranked = materialize(ranked_pages(spark, sf_dir), "ranked")
    r = F.col("rank")
    wanted = ranked.select("page_id", "host", F.posexplode(F.array(2 * r + 1, 2 * r + 2, r * 0, 3 * r + 2)).alias("n", "rank"))
    named = wanted.join(ranked.select("host", "rank", F.col("url").alias("to")), ["host", "rank"])
    item = F.concat(
        F.lit('<li><a href="'), F.replace("to", F.lit("&"), F.lit("&amp;")), F.lit('">page '), F.col("rank").cast("string"),
        F.lit("</a></li>"),
    )
    lists = named.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("item")))), lambda s: s.item), "").alias("items")
    )
    away = '<li><a href="https://elsewhere.invalid/">away</a></li>'
    appended = F.concat("html", F.lit("<ul>"), F.coalesce("items", F.lit("")), F.lit(away), F.lit("</ul>"))
    html = table(spark, sf_dir, "pages").select("page_id", "html")
    return (
        html.join(ranked.join(lists, "page_id", "left"), "page_id")
        .select("page_id", "url", appended.alias("html"), "host", "rank")
    )


FILES = 300


def write_single_files(docs: DataFrame, path: str) -> None:
    """A text file for each row of docs(key, text), in the folder of its key.

    Where Hadoop has no native library, Spark's writer starts processes for the permissions of each local file, and
    they take longer than all else. So Python writes to a local folder. A file is named after its split and its place in
    it and is renamed when it is whole: a task that runs again, or twice, leaves the same files.
    """
    folder = local_folder(docs.sparkSession, path)
    if folder is None:
        docs.write.option("maxRecordsPerFile", 1).partitionBy("key").text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, made = TaskContext.get(), 0, set()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                place = f"{folder}/key={'__HIVE_DEFAULT_PARTITION__' if key is None else key}"
                if place not in made:
                    os.makedirs(place, exist_ok=True)
                    made.add(place)
                name = f"part-{task.partitionId():05d}-{done:07d}.txt"
                unfinished = f"{place}/.{name}.{task.taskAttemptId()}"
                with open(unfinished, "wb") as f:
                    f.write(text.as_buffer() or b"")
                    f.write(b"\n")
                os.replace(unfinished, f"{place}/{name}")
                done += 1
        yield pa.record_batch({"files": pa.array([done], pa.int64())})

    os.makedirs(folder)
    docs.select("key", F.col("text").cast("binary")).mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


def document_files(spark: SparkSession, sf_dir: str, broken: bool = False, single: bool = False) -> str:
    """Write the documents into ``FILES`` text files, each with every document of one remainder; returns the folder.

    With ``broken``, every third file ends its documents with a byte that is not UTF-8. With ``single``, every
    document is a file of its own, in the folder of its remainder.
    """
    path = new_work_path(spark, "files")
    key = F.pmod("doc_id", F.lit(FILES)).alias("key")
    text = F.when(key % 3 == 0, F.concat("text", F.unhex(F.lit("E9")).cast("string"))).otherwise(F.col("text")) if broken else F.col("text")
    docs = table(spark, sf_dir, "documents").select(key, "doc_id", text.alias("text"))
    if single:
        write_single_files(docs.select("key", "text"), path)
    else:
        ordered = docs.repartition("key").sortWithinPartitions("key", "doc_id").select("key", "text")
        ordered.write.partitionBy("key").text(path)
    return path


def exchange_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived knowledge base as an exported table, some of whose vectors are null, missing or broken."""
    rows = exchange.export_table(derived_kb(spark, sf_dir))
    doc_id = F.substring("title", len("Document ") + 1, 20).cast("long")
    odd = (
        F.when(doc_id % 13 == 0, "null").when(doc_id % 19 == 0, "[1,").when(doc_id % 29 == 0, None).when(doc_id % 31 == 0, "[]")
        .when(doc_id % 37 == 0, '["a"]').otherwise(F.col("embeddings").cast("string"))
    )
    return rows.withColumn("embeddings", odd.cast("binary"))
