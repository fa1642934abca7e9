"""The knowledge base on disk: Parquet files by bucket, and a table of which of them make up a snapshot.

A url lives in one of B buckets, by its hash. ``<path>/data/buckets=<B>/v=<n>/bucket=<b>/`` holds a
bucket as version n wrote it, sorted by url in files of disjoint ranges, and
``<path>/snapshots/snapshot=<n>/`` names the version that each bucket of snapshot n has. A change
writes the buckets it touches to a new version and then, as one file, the new table: until that file
is there readers see the old snapshot, and no file that a snapshot names is ever replaced. Versions
that no wanted snapshot names can be removed by hand. One writer at a time.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions.vectors import magnitude
from lorebase.operators import mutate, scan
from lorebase.operators import search as vector_search
from lorebase.operators.embed import Embedder, embed_query
from lorebase.schema import KB_COLUMNS, KB_SCHEMA, conform
from lorebase.session import materialize, measured_bytes

STORED_SCHEMA = T.StructType([*KB_SCHEMA.fields, T.StructField("magnitude", T.DoubleType()), T.StructField("bucket", T.IntegerType())])
"""A document as stored: its columns, the magnitude of its vector, which search needs, and its bucket."""
TABLE = "buckets int, bucket int, version int"
FEWEST_BUCKETS = 16
MAX_BUCKETS = 65_536
BUCKET_BYTES = 1 << 30
"""Size of a bucket that the first upsert aims at."""
FILE_BYTES = 128 << 20
"""Size of a range of urls, before compression, that is written as one file of a bucket."""


class Snapshot(NamedTuple):
    number: int
    buckets: int
    """Number of buckets; 0 as long as nothing was ever written."""
    versions: dict[int, int]
    """Bucket -> version; a bucket without documents has none."""


def bucket_of(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


class KnowledgeBase:
    """A handle on the newest snapshot under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int | None = None) -> KnowledgeBase:
        """Open, creating an empty knowledge base if there is none.

        ``buckets`` sets the layout at creation. Without it the first upsert measures its documents
        and takes one bucket for each ``BUCKET_BYTES``; ``rebucket`` refines the layout later.
        """
        if buckets is not None and not 0 < buckets <= MAX_BUCKETS:
            raise ValueError(f"buckets must be between 1 and {MAX_BUCKETS}")
        kb = cls(spark, path)
        if kb.version() is None:
            kb._publish(Snapshot(0, buckets or 0, {}))
        return kb

    # -- snapshots ---------------------------------------------------------------

    def version(self) -> int | None:
        """The newest snapshot, from the names of the files alone."""
        try:
            files = self.spark.read.schema(TABLE).parquet(f"{self.path}/snapshots").inputFiles()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return max((int(n) for f in files for n in re.findall(r"/snapshot=([0-9]+)/", f)), default=None)

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The table of a snapshot, of the newest by default: a row for each bucket, at most ``MAX_BUCKETS``."""
        number = self.version() if number is None else number
        rows = self.spark.read.schema(TABLE).parquet(f"{self.path}/snapshots/snapshot={number}").collect()
        return Snapshot(number, rows[0]["buckets"], {r["bucket"]: r["version"] for r in rows if r["bucket"] >= 0})

    @property
    def buckets(self) -> int:
        return self.snapshot().buckets

    def _folder(self, buckets: int, version: int) -> str:
        return f"{self.path}/data/buckets={buckets}/v={version}"

    def stored(self, snapshot: Snapshot | None = None, only: Collection[int] | None = None) -> DataFrame:
        """Documents with their bucket, which filters and joins can prune on; ``only`` of some buckets."""
        now = snapshot or self.snapshot()
        paths = [f"{self._folder(now.buckets, v)}/bucket={b}" for b, v in sorted(now.versions.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], STORED_SCHEMA)
        read = self.spark.read.schema(STORED_SCHEMA).option("basePath", f"{self.path}/data/buckets={now.buckets}")
        return read.parquet(*paths).select(*STORED_SCHEMA.names)

    def documents(self) -> DataFrame:
        return scan.documents(self.stored())

    def rebucket(self, buckets: int) -> KnowledgeBase:
        """The newest snapshot in more buckets, and each bucket in files of disjoint ranges again."""
        now = self.snapshot()
        if not now.buckets < buckets <= MAX_BUCKETS:
            raise ValueError(f"buckets must be between {now.buckets + 1} and {MAX_BUCKETS}")
        finer = Snapshot(now.number, buckets, {})
        self._write(self._ranged(scan.documents(self.stored(now)), buckets), finer, ())
        return self

    @staticmethod
    def _ranged(docs: DataFrame, buckets: int) -> DataFrame:
        """Documents in ranges of (bucket, url), as many as it takes for about ``FILE_BYTES`` in each."""
        ranges = max(1, -(-measured_bytes(docs, KB_COLUMNS) // FILE_BYTES))
        derived = magnitude(F.col("embeddings")).alias("magnitude"), bucket_of(F.col("url"), buckets).alias("bucket")
        return conform(docs, *derived).repartitionByRange(ranges, "bucket", "url")

    def _write(self, rows: DataFrame, now: Snapshot, touched: Collection[int]) -> int:
        """Write ``rows``, all there is of the ``touched`` buckets, as a new version, and publish it with the other buckets."""
        number = now.number + 1
        folder = self._folder(now.buckets, number)
        # Sorted files give url bounds per row group. A folder that no snapshot names may be left from a crash.
        ordered = rows.select(*STORED_SCHEMA.names).sortWithinPartitions("bucket", "url")
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema(STORED_SCHEMA).parquet(folder).select("bucket").distinct().collect()
        kept = {b: v for b, v in now.versions.items() if b not in touched}
        return self._publish(Snapshot(number, now.buckets, kept | {r["bucket"]: number for r in written}))

    def _publish(self, now: Snapshot) -> int:
        """One small file, so the snapshot is there as a whole or not at all."""
        rows = [(now.buckets, -1, now.number), *((now.buckets, b, v) for b, v in now.versions.items())]
        self.spark.createDataFrame(rows, TABLE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/snapshots/snapshot={now.number}")
        return now.number

    # -- mutations ---------------------------------------------------------------

    def upsert(self, incoming: DataFrame, order_col: str | None = None) -> int:
        """Insert or replace by url, as a new snapshot.

        Only the buckets that the urls fall in are read and written. Their rows that stay are
        copied split by split as they lie; only the incoming ones are shuffled.
        """
        latest, written = mutate.latest_rows(incoming, order_col)
        latest, now = latest if written else materialize(latest, "batch"), self.snapshot()
        if not now.buckets:
            size = -(-measured_bytes(latest, KB_COLUMNS) // BUCKET_BYTES)
            now = now._replace(buckets=min(max(size, FEWEST_BUCKETS), MAX_BUCKETS))
        homes = latest.select(bucket_of(F.col("url"), now.buckets).alias("b")).distinct()
        touched = {r["b"] for r in homes.collect()}  # at most MAX_BUCKETS numbers
        if not touched:
            return now.number
        kept, in_buckets = mutate.keep_others(self.stored(now, touched), latest.select("url"))
        if in_buckets:
            return self._write(kept.unionByName(self._ranged(latest, now.buckets)), now, touched)
        return self._write(self._ranged(scan.documents(kept).unionByName(latest), now.buckets), now, touched)

    def delete_prefix(self, prefix: str, context: str | None = None, literal: bool = False) -> int:
        """Only buckets that hold such a document are written anew; they are found on url and context."""
        now, gone = self.snapshot(), mutate.prefix_match(prefix, context, literal)
        touched = {r["bucket"] for r in self.stored(now).filter(gone).select("bucket").distinct().collect()}
        return self._write(self.stored(now, touched).filter(~gone), now, touched) if touched else now.number

    def clean(self) -> int:
        now = self.snapshot()
        return self._publish(Snapshot(now.number + 1, now.buckets, {}))

    # -- reads -------------------------------------------------------------------

    def get_document(self, url: str, context: str | None = None) -> dict:
        """One document; the bucket filter leaves one directory to read. KeyError if absent."""
        now = self.snapshot()
        home = self.stored(now).filter(F.col("bucket") == bucket_of(F.lit(url), now.buckets)) if now.buckets else self.stored(now)
        rows = scan.get_document(home, url, context).take(1)
        if not rows:
            raise KeyError(f"no document has the url {url}")
        return rows[0].asDict()

    def list_documents(self, limit: int = scan.DEFAULT_LIMIT, context: str | None = None) -> DataFrame:
        return scan.list_documents(self.stored(), limit, context)

    def page(self, limit: int = scan.DEFAULT_LIMIT, offset: int = 0, context: str | None = None) -> tuple[DataFrame, int]:
        total = scan.page_total(self.stored(), context).first()["total"]
        return scan.page(self.stored(), limit, offset, context), total

    def contexts(self) -> DataFrame:
        return scan.contexts(self.stored())

    def search(
        self,
        query: str | Sequence[float],
        n: int = vector_search.DEFAULT_RESULTS,
        context: str | None = None,
        embedder: Embedder | None = None,
    ) -> DataFrame:
        """Fields, score and rank of the ``n`` documents nearest to a text or vector.

        LookupError if there is no document in the context.
        The hits are found on the vectors alone; their contents are then read by bucket and url.
        """
        query = embed_query(query, embedder) if isinstance(query, str) else query
        now = self.snapshot()
        stored = self.stored(now)
        if scan.in_context(stored, context).select("url").isEmpty():
            raise LookupError("the context holds nothing to search")
        hits = materialize(vector_search.search(stored, query, n, context), "hits")
        homes = hits.select(bucket_of(F.col("url"), now.buckets).alias("b")).distinct()
        buckets = {r["b"] for r in homes.collect()}  # at most MAX_BUCKETS numbers
        return vector_search.search_output(self.stored(now, buckets), hits).orderBy("rank")


assert KB_COLUMNS == STORED_SCHEMA.names[:-2]
