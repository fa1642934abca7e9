"""Whole pipelines: sites and files into documents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import links
from lorebase.operators.crawl import DEFAULT_DEPTH, LINKS, crawl, last_page_per_path, page_index
from lorebase.operators.embed import Embedder, embed, split_rejects
from lorebase.operators.extract import locate, parse_pages, stamp_site_metadata
from lorebase.operators.ordering import join_one
from lorebase.session import broadcast_if_small, materialize, materialize_by
from lorebase.sources.documents import documents_from_rows, make_documents
from lorebase.sources.files import read_files
from lorebase.sources.pages import valid_pages


class Ingested(NamedTuple):
    documents: DataFrame
    rejects: DataFrame


def embed_documents(docs: DataFrame, embedder: Embedder | None = None, kb: DataFrame | None = None) -> Ingested:
    """Embed and split. Written once: embedding is the dear step and both results read it.

    With ``kb`` given, documents it already holds unchanged are left out before embedding.
    """
    if kb is not None:
        same = ["url", "checksum", "context"]
        docs = docs.join(kb.select(*same), same, "left_anti")
    good, bad = split_rejects(materialize(embed(docs, embedder=embedder), "embedded"))
    return Ingested(good, bad)


def site_pages(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Valid pages on the hosts of the seeds; other pages cannot be reached and are not parsed.

    Pages whose address takes more than expressions to read stay: this only spares work.
    """
    hosts = materialize(locate(seeds, "base_url").select(F.col("_at.host").alias("host")).distinct(), "hosts")
    host = F.when(links.usual_url(F.col("url")), F.col("_here.host"))
    located = links.located(valid_pages(pages), "url", "_here").withColumn("host", host).drop("_here")
    wanted = broadcast_if_small(hosts.withColumn("_wanted", F.lit(True)))
    return located.join(wanted, "host", "left").filter("_wanted OR host IS NULL").drop("host", "_wanted")


def crawl_site(
    pages: DataFrame, seeds: DataFrame, max_depth: int = DEFAULT_DEPTH, resolve: str = "base"
) -> tuple[DataFrame, DataFrame]:
    """(one page per path with its key, all pages by key). Pages are parsed once and the result is written."""
    own = site_pages(pages, seeds).select("url", "html")
    parsed = parse_pages(own).withColumn("html_length", F.octet_length("html")).drop("html", "main_text")
    contents = page_index(parsed)
    index = materialize_by(contents.select(*LINKS), "key", "index")
    winners = last_page_per_path(crawl(index, seeds, max_depth, resolve))
    return materialize(winners, "winners"), contents


def ingest_site(
    pages: DataFrame,
    seeds: DataFrame,
    context: str,
    embedder: Embedder | None = None,
    max_depth: int = DEFAULT_DEPTH,
    resolve: str = "base",
    per_page: bool = False,
    url_mode: str = "base",
    skip_unchanged: DataFrame | None = None,
) -> Ingested:
    """Crawl the captured pages from each seed and make one embedded document per path.

    Every document takes title and description of its base page unless ``per_page``.
    """
    winners, contents = crawl_site(pages, seeds, max_depth, resolve)
    content = join_one(winners, contents, "key").withColumnRenamed("markdown", "content")
    if not per_page:
        bases = locate(seeds.select("base_url").distinct(), "base_url").select("base_url", F.col("_at.key").alias("key"))
        base_meta = bases.join(contents.select("key", "title", "description"), "key")
        content = stamp_site_metadata(content, materialize(base_meta.drop("key"), "sites"))
    docs = make_documents(content.filter(F.col("error").isNull()), context, "web_scrape", url_mode)
    done = embed_documents(docs, embedder, skip_unchanged)
    unparsed = content.filter(F.col("error").isNotNull()).select(
        (F.concat("base_url", "path") if url_mode == "base" else F.col("page_url")).alias("url"), "error"
    )
    return Ingested(done.documents, done.rejects.select("url", "error").unionByName(unparsed))


def ingest_files(
    spark: SparkSession,
    path: str,
    context: str,
    embedder: Embedder | None = None,
    skip_unchanged: DataFrame | None = None,
) -> Ingested:
    done = embed_documents(read_files(spark, path, context).drop("modified"), embedder, skip_unchanged)
    return Ingested(done.documents, done.rejects.select("url", "error"))


def ingest_rows(rows: DataFrame, context: str = "", embedder: Embedder | None = None) -> Ingested:
    done = embed_documents(documents_from_rows(rows, context), embedder)
    return Ingested(done.documents, done.rejects.select("url", "error"))
