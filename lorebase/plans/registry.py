"""The registered queries. Each reads whole tables under ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import vectors
from lorebase.functions.text import checksum
from lorebase.operators import crawl, embed, extract, fetchplan, mutate, reports, scan, search
from lorebase.plans import exchange, ingest
from lorebase.plans import testbed as bed
from lorebase.session import materialize, materialize_by, new_work_path
from lorebase.sources.documents import documents_from_rows, make_documents
from lorebase.sources.pages import valid_pages as keep_valid
from lorebase.sources.store import KnowledgeBase
from lorebase.streaming.ingest import stream_ingest as start_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def flat(df: DataFrame) -> DataFrame:
    """Show the vector by its length, its ends and its square."""
    e = F.col("embeddings")
    some = vectors.vector_length(e) > 0
    return df.withColumns({
        "vector_first": F.get(e, F.lit(0)).cast("double"), "vector_last": F.get(e, F.size(e) - 1).cast("double"),
        "vector_square": F.when(some, vectors.dot(e, e)), "embeddings": vectors.vector_length(e),
    })


# -- reads ---------------------------------------------------------------------------


@query
def kb_scan(spark, sf_dir):
    return flat(scan.documents(bed.derived_kb(spark, sf_dir)))


@query
def kb_context_filter(spark, sf_dir):
    return flat(scan.documents(scan.in_context(bed.derived_kb(spark, sf_dir), "en")))


@query
def kb_list_limit(spark, sf_dir):
    return flat(scan.list_documents(bed.derived_kb(spark, sf_dir), 25, "fr"))


@query
def kb_page(spark, sf_dir):
    return flat(scan.page(bed.derived_kb(spark, sf_dir), 20, 30))


@query
def kb_page_total(spark, sf_dir):
    return scan.page_total(bed.derived_kb(spark, sf_dir), "en")


@query
def kb_get_document(spark, sf_dir):
    return flat(scan.get_document(bed.derived_kb(spark, sf_dir), "doc://src3/3"))


@query
def kb_contexts(spark, sf_dir):
    return scan.contexts(bed.derived_kb(spark, sf_dir))


@query
def list_report(spark, sf_dir):
    return reports.list_report(bed.derived_kb(spark, sf_dir))


@query
def document_output(spark, sf_dir):
    return reports.document_output(bed.derived_kb(spark, sf_dir))


@query
def json_rows(spark, sf_dir):
    return reports.to_json_rows(reports.document_output(bed.derived_kb(spark, sf_dir)))


JSON_DOCUMENT = "url string, title string, description string, content string, checksum string, embeddings array<float>, context string, source_type string"


def read_back(rows, shape):
    """JSON rows as columns again: numbers have several texts."""
    return rows.select(F.from_json("json", shape).alias("j")).select("j.*")


@query
def json_documents(spark, sf_dir):
    return flat(read_back(reports.json_documents(bed.derived_kb(spark, sf_dir)), JSON_DOCUMENT))


@query
def json_page(spark, sf_dir):
    page = reports.json_page(bed.derived_kb(spark, sf_dir), 20, 30, "en")
    back = read_back(page, f"documents array<struct<{JSON_DOCUMENT}>>, total long")
    return flat(back.select("total", F.inline("documents")))


@query
def json_hits(spark, sf_dir):
    kb = bed.derived_kb(spark, sf_dir)
    hits = search.search_output(kb, search.search(kb, bed.query_vector(spark, sf_dir), 10))
    return read_back(reports.json_hits(hits), "url string, title string, description string, content string, checksum string, score double")


# -- search --------------------------------------------------------------------------


@query
def search_topn(spark, sf_dir):
    return search.search(bed.derived_kb(spark, sf_dir), bed.query_vector(spark, sf_dir), 10)


@query
def search_context(spark, sf_dir):
    return search.search(bed.derived_kb(spark, sf_dir), bed.query_vector(spark, sf_dir), 5, "de")


@query
def search_skips(spark, sf_dir):
    return search.search_skipped(bed.derived_kb(spark, sf_dir), bed.query_vector(spark, sf_dir))


@query
def search_output(spark, sf_dir):
    kb = bed.derived_kb(spark, sf_dir)
    return search.search_output(kb, search.search(kb, bed.query_vector(spark, sf_dir)))


@query
def search_report(spark, sf_dir):
    return reports.search_report(search_output(spark, sf_dir), verbose=True)


@query
def search_batch_topk(spark, sf_dir):
    return search.search_batch(bed.derived_kb(spark, sf_dir), bed.query_table(spark, sf_dir), 5, -1.0)


@query
def search_batch_threshold(spark, sf_dir):
    return search.search_batch(bed.derived_kb(spark, sf_dir), bed.query_table(spark, sf_dir), 8, 0.25)


@query
def search_batch_grid(spark, sf_dir):
    """The same search in the layout for query tables too large to ship at once: a scan for each of at least three slices."""
    kb, asked = bed.derived_kb(spark, sf_dir), bed.query_table(spark, sf_dir)
    third = search.measure(asked, "query_id", "embedding")["bytes"] // 3
    return search.search_batch(kb, asked, 5, -1.0, slice_bytes=min(search.SLICE_BYTES, third))


@query
def search_batch_wide(spark, sf_dir):
    """More hits of each query than the engine limits a ranked window to."""
    return search.search_batch(bed.derived_kb(spark, sf_dir), bed.query_table(spark, sf_dir).filter("query_id % 10 = 0"), 1500, -1.0)


@query
def cosine_pairs(spark, sf_dir):
    """Each vector against its neighbour by id."""
    e = bed.table(spark, sf_dir, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", vectors.cosine(F.col("embedding"), F.col("other")).alias("score"))


@query
def embedding_json_roundtrip(spark, sf_dir):
    """Vectors through JSON text; some texts say null, are missing or are broken."""
    vec_id, e = F.col("vec_id"), F.col("embedding")
    text = (
        F.when(vec_id % 7 == 0, "null").when(vec_id % 11 == 0, "[1,").when(vec_id % 13 == 0, None).when(vec_id % 17 == 0, '["a"]')
        .otherwise(vectors.embeddings_to_json(e))
    )
    rows = bed.table(spark, sf_dir, "embeddings").withColumn("json", text)
    back, readable = vectors.embeddings_from_json(F.col("json")), vectors.embeddings_json_error(F.col("json")).isNull()
    return rows.select(
        "vec_id",
        F.when(readable, vectors.vector_length(back)).alias("length"),
        F.when(readable, vectors.dot(back, back)).alias("square"),
        F.when(readable, F.coalesce(back == e, F.lit(False))).alias("same"),
        readable.alias("readable"),
    )


@query
def import_table(spark, sf_dir):
    """A table with JSON vectors into documents and rejects."""
    done = exchange.import_table(bed.exchange_rows(spark, sf_dir))
    return flat(done.documents).withColumn("error", F.lit(None).cast("string")).unionByName(done.rejects, allowMissingColumns=True)


@query
def export_table(spark, sf_dir):
    """The JSON vectors of an export, read back."""
    rows = exchange.export_table(bed.derived_kb(spark, sf_dir))
    return flat(rows.withColumn("embeddings", F.from_json(F.col("embeddings").cast("string"), "array<float>")))


# -- writes --------------------------------------------------------------------------


@query
def upsert_lastwins(spark, sf_dir):
    kb, batch = bed.derived_kb(spark, sf_dir), bed.upsert_batch(spark, sf_dir)
    return flat(mutate.upsert(kb, batch, "seq"))


@query
def upsert_moves_context(spark, sf_dir):
    merged = mutate.upsert(bed.derived_kb(spark, sf_dir), bed.upsert_batch(spark, sf_dir), "seq")
    return merged.groupBy("context").agg(F.count("*").alias("n_docs"))


@query
def delete_prefix(spark, sf_dir):
    return flat(mutate.delete_prefix(bed.derived_kb(spark, sf_dir), "DOC://src1"))


@query
def delete_prefix_context(spark, sf_dir):
    return flat(mutate.delete_prefix(bed.derived_kb(spark, sf_dir), "doc://src1", "en"))


@query
def delete_wildcard(spark, sf_dir):
    return flat(mutate.delete_prefix(bed.derived_kb(spark, sf_dir), "doc://src1_/"))


@query
def clean(spark, sf_dir):
    """Urls stored before a clean, after it, and after an upsert that follows."""
    kb = KnowledgeBase.open(spark, new_work_path(spark, "kb"))
    docs = materialize(bed.derived_kb(spark, sf_dir), "docs")
    shown = []
    for stage, step in (("before", lambda: kb.upsert(docs)), ("cleaned", kb.clean), ("after", lambda: kb.upsert(scan.in_context(docs, "en")))):
        step()
        shown.append(kb.documents().select(F.lit(stage).alias("stage"), "url", "checksum"))
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query
def checksums(spark, sf_dir):
    docs = bed.table(spark, sf_dir, "documents")
    return docs.select("doc_id", checksum(F.col("text")).alias("checksum"))


@query
def kb_store(spark, sf_dir):
    """The same upsert and a prefix delete through snapshots on disk."""
    kb = KnowledgeBase.open(spark, new_work_path(spark, "kb"))
    kb.upsert(bed.derived_kb(spark, sf_dir))
    kb.delete_prefix("doc://src1/", literal=True)
    kb.upsert(bed.upsert_batch(spark, sf_dir), "seq")
    return flat(kb.documents())


@query
def make_documents_from_pages(spark, sf_dir):
    pages = bed.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("https://"), bed.host()).alias("base_url"),
        F.concat(F.lit("/"), F.col("page_id").cast("string")).alias("path"),
        F.lit(None).cast("string").alias("title"),
        F.lit("d").alias("description"),
        F.col("html").alias("content"),
    )
    return make_documents(pages, "web")


@query
def documents_from_conversations(spark, sf_dir):
    turns = bed.table(spark, sf_dir, "conversations")
    url = F.concat_ws("/", F.lit("conv:/"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return documents_from_rows(turns.select(url.alias("url"), F.col("text").alias("content"), F.col("role").alias("title")))


# -- pages ---------------------------------------------------------------------------


@query
def valid_pages(spark, sf_dir):
    page_id = F.col("page_id")
    html = F.when(page_id % 3 == 0, "text/html; charset=utf-8").when(page_id % 3 == 1, "text/html")
    captured = bed.table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        "html",
        F.when(page_id % 7 == 0, 404).otherwise(200).alias("status"),
        html.otherwise("application/json").alias("content_type"),
    )
    return keep_valid(captured)


def parsed(spark, sf_dir):
    return extract.parse_pages(bed.table(spark, sf_dir, "pages"))


@query
def page_title(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", "title")


@query
def page_description(spark, sf_dir):
    """The given pages have no description; each gets one that names it."""
    pages = bed.table(spark, sf_dir, "pages")
    meta = F.concat(F.lit('<meta name="description" content="About &amp; around '), F.col("page_id").cast("string"), F.lit('"><title>'))
    described = pages.withColumn("html", F.replace("html", F.lit("<title>"), meta))
    return extract.parse_pages(described).select("page_id", "description", "error")


@query
def main_text(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", "main_text")


@query
def markdown(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", "markdown")


@query
def parse_pages(spark, sf_dir):
    """All outputs of the job at once."""
    links = F.size("hrefs").cast("long").alias("n_links")
    return parsed(spark, sf_dir).select("page_id", "title", "description", "main_text", "markdown", links, "error")


@query
def page_links(spark, sf_dir):
    return extract.link_edges(parsed(spark, sf_dir), "page_id").withColumnRenamed("src_url", "page_id")


@query
def resolve_links(spark, sf_dir):
    edges = extract.link_edges(parsed(spark, sf_dir)).withColumn("base_url", F.col("src_url"))
    found = extract.resolve_links(materialize(edges, "edges"))
    return found.select("src_url", "ord", F.col("_to.host").alias("host"), F.col("_to.path").alias("path"))


@query
def resolve_references(spark, sf_dir):
    """Every page's address as the base of every kind of reference, some of which lead nowhere or elsewhere."""
    pages = bed.table(spark, sf_dir, "pages").select(F.col("url").alias("src_url"))
    kinds = F.array(*[F.lit(r) for r in bed.REFERENCES])
    edges = pages.select("src_url", F.col("src_url").alias("base_url"), F.posexplode(kinds).alias("ord", "href"))
    found = extract.resolve_links(edges)
    return found.select("src_url", "ord", *[F.col(f"_to.{c}").alias(c) for c in ("url", "host", "path", "key")])


@query
def site_metadata(spark, sf_dir):
    ranked = bed.ranked_pages(spark, sf_dir)
    parts = parsed(spark, sf_dir).select("page_id", "title", "description")
    pages = materialize(parts.join(ranked, "page_id"), "meta")
    bases = pages.filter(F.col("rank") == 0).select("host", F.col("url").alias("base_url"), "title", "description")
    of_site = pages.join(bases.select("host", "base_url"), "host")
    return extract.stamp_site_metadata(of_site, bases).select("page_id", "base_url", "title", "description")


# -- crawl ---------------------------------------------------------------------------


def crawled(spark, sf_dir, max_depth=crawl.DEFAULT_DEPTH):
    pages = materialize(bed.linked_pages(spark, sf_dir), "linked")
    contents = crawl.page_index(extract.parse_pages(pages.select("url", "html")).drop("main_text"))
    index = materialize_by(contents.select(*crawl.LINKS), "key", "index")
    return crawl.crawl(index, bed.site_seeds(pages), max_depth), contents


@query
def crawl_depth(spark, sf_dir):
    return crawled(spark, sf_dir)[0].select("base_url", "url", "depth")


@query
def crawl_depth_two(spark, sf_dir):
    return crawled(spark, sf_dir, 2)[0].select("base_url", "url", "depth")


@query
def crawl_paths(spark, sf_dir):
    return crawl.crawl_paths(crawled(spark, sf_dir)[0])


@query
def crawl_last_page(spark, sf_dir):
    return crawl.last_page_per_path(crawled(spark, sf_dir)[0]).select("base_url", "path", "url", "depth")


@query
def crawl_report(spark, sf_dir):
    reached, contents = crawled(spark, sf_dir)
    return crawl.crawl_report(crawl.last_page_per_path(reached).join(contents.select("key", "html"), "key"))


@query
def page_maps(spark, sf_dir):
    reached, contents = crawled(spark, sf_dir)
    return extract.page_maps(crawl.last_page_per_path(reached).join(contents.select("key", "html", "markdown"), "key"))


@query
def crawl_summary(spark, sf_dir):
    return crawl.crawl_summary(crawled(spark, sf_dir)[0])


def requests(spark, sf_dir):
    ts = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return bed.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("host"), F.unix_micros(ts).alias("arrival"), F.col("event_id").alias("id")
    )


FETCH_DELAY = 3_600_000_000
HOT_CHUNKS = 200


@query
def fetch_plan(spark, sf_dir):
    return fetchplan.plan_fetches(requests(spark, sf_dir), FETCH_DELAY)


@query
def fetch_plan_hot_hosts(spark, sf_dir):
    """The same plan in the layout for hosts too large for one task: chunks cut hosts wherever their bounds fall."""
    asked = requests(spark, sf_dir)
    chunk_rows = max(50, -(-asked.count() // HOT_CHUNKS))
    return fetchplan.plan_fetches(asked, FETCH_DELAY, rows_per_task=50, chunk_rows=chunk_rows)


# -- embedding and ingest ------------------------------------------------------------


@query
def embed_docs(spark, sf_dir):
    docs = bed.table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors_ = embed.embed(docs, "text").filter(F.col("error").isNull())
    return vectors_.select("doc_id", F.posexplode("embeddings").alias("pos", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


@query
def search_text(spark, sf_dir):
    """Text queries: every benchmark item against every embedded document."""
    docs = bed.table(spark, sf_dir, "documents")
    kb = embed.embed(docs.select(F.col("doc_id").cast("string").alias("url"), "text"), "text").drop("text")
    items = bed.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = materialize(embed.embed(items, "text", "embedding").select("query_id", "embedding"), "asked")
    return search.search_batch(kb, asked, 3, 0.0)


@query
def rejects(spark, sf_dir):
    """Rows without content and rows without a vector come back with their reason."""
    docs, labels = bed.table(spark, sf_dir, "documents"), bed.table(spark, sf_dir, "labels")
    content = F.when(F.col("quality") == 1, F.col("text")).when(F.col("quality") == 0, "")
    rows = docs.join(labels, "doc_id", "left").select(F.col("doc_id").cast("string").alias("url"), content.alias("content"))
    return ingest.ingest_rows(rows).rejects


@query
def ingest_rows(spark, sf_dir):
    turns = bed.table(spark, sf_dir, "conversations")
    url = F.concat_ws("/", F.lit("conv:/"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    done = ingest.ingest_rows(turns.select(url.alias("url"), F.col("text").alias("content")), "talk")
    return flat(done.documents)


@query
def ingest_site(spark, sf_dir):
    pages = materialize(bed.linked_pages(spark, sf_dir), "linked")
    return flat(ingest.ingest_site(pages, bed.site_seeds(pages), "web").documents)


def by_content(docs):
    """File names are made up by the writer, so documents are shown with their folders."""
    place = F.regexp_extract("url", "/(key=[0-9]+)/", 1).alias("place")
    return flat(docs).select(place, "content", "checksum", "embeddings", "vector_first", "vector_last", "vector_square", "context", "source_type")


@query
def ingest_files(spark, sf_dir):
    return by_content(ingest.ingest_files(spark, bed.document_files(spark, sf_dir), "files").documents)


@query
def stream_ingest(spark, sf_dir):
    """A stream of files, one for each document."""
    folder = bed.document_files(spark, sf_dir, single=True)
    kb = KnowledgeBase.open(spark, new_work_path(spark, "kb"))
    rejects = new_work_path(spark, "stream-rejects")
    start_stream(spark, folder, kb, "files", new_work_path(spark, "stream"), rejects, max_files_per_trigger=100_000).awaitTermination()
    return by_content(kb.documents())


@query
def stream_rejects(spark, sf_dir):
    """What a stream has stored of each file, and why not."""
    folder, rejects = bed.document_files(spark, sf_dir, broken=True), new_work_path(spark, "stream-rejects")
    kb = KnowledgeBase.open(spark, new_work_path(spark, "kb"))
    start_stream(spark, folder, kb, "files", new_work_path(spark, "stream"), rejects).awaitTermination()
    place = F.regexp_extract("url", "/(key=[0-9]+)/", 1).alias("place")
    stored = kb.documents().select(place, "checksum", F.lit(None).cast("string").alias("error"))
    return stored.unionByName(spark.read.parquet(rejects).select(place, F.lit(None).cast("string").alias("checksum"), "error"))
