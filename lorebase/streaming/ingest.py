"""Files arriving in a directory, upserted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lorebase.operators.embed import Embedder
from lorebase.plans.ingest import embed_documents
from lorebase.session import session_with
from lorebase.sources.files import BINARY_FILE_SCHEMA, file_documents
from lorebase.sources.store import KnowledgeBase

OPEN_COST_BYTES = 64 << 10
"""What opening a file counts when files are dealt out to tasks. At Spark's 4 MB a task would get some thirty small files."""
LISTING_TASKS = 4
"""Tasks a core that list the files of a batch. Spark's own number is 10,000."""


def stream_ingest(
    spark: SparkSession,
    directory: str,
    kb: KnowledgeBase,
    context: str,
    checkpoint: str,
    rejects_path: str,
    embedder: Embedder | None = None,
    max_files_per_trigger: int = 10_000,
) -> StreamingQuery:
    """Ingest every file not seen before, then stop (trigger AvailableNow).

    A batch may be replayed after a failure: the upsert is idempotent by url, and versions of
    one file inside a batch are settled by modification time. Rejected files are written with
    their reasons below ``rejects_path``, a folder for each batch that a replay replaces.

    Each batch makes a snapshot, for which only the buckets that it touches are written. The
    stream runs in a session of its own, with settings for many small files.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        done = embed_documents(file_documents(batch, context), embedder)
        done.rejects.write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}")
        kb.upsert(done.documents, "modified")

    settings = {
        "spark.sql.files.openCostInBytes": str(OPEN_COST_BYTES),
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(LISTING_TASKS * spark.sparkContext.defaultParallelism),
    }
    arriving = (
        session_with(spark, settings)
        .readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(directory)
    )
    return (
        arriving.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
