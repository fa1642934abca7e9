"""Line deduplication that can be taken back, document by document.

State
    An exact reference table holds one row (key, doc_id) for every distinct long line of a
    document. A line is *common* when at least ``min_docs`` documents refer to it; of the
    documents with a common line only the one with the largest doc_id keeps it. Cuckoo
    filters, one per shard of keys, hold a short fingerprint of each common key. A lookup asks
    the filter of its shard first and only the few that it lets through meet the exact table,
    so a false positive costs a lookup and never a line.

Changing it
    Inserting documents adds references, deleting them takes theirs away, and keys that cross
    ``min_docs`` in either direction are inserted into or deleted from their filters. After a
    deletion the lines of the remaining documents come back exactly as if the deleted ones had
    never been there.

Keys are MD5 values of the stripped, ASCII-lower-cased line.

Defined results: a null or empty text is one empty line. A row without doc_id refers to nothing
and keeps all its lines. Rows that repeat a doc_id are one document. Empty tables give no rows.
Other columns are not read and may have any name.
"""

from __future__ import annotations

import math
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lorebase.llm.frames import free_name, renamed, tidy
from lorebase.session import materialize, new_work_path

MIN_CHARS = 20
MIN_DOCS = 3
STRIPPED = " \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 200_000
LOOKUPS_PER_TASK = 1_000_000


def line_key(line: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(STRIPPED)), upper, upper.lower())


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct (key, doc_id) of the lines with at least ``min_chars`` characters."""
    rows = renamed(docs, doc_id=id_col, text=text_col).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = F.filter(F.transform(F.split("text", "\n", -1), line_key), lambda k: F.char_length(k) >= min_chars)
    keys = F.array_distinct(F.transform(lines, lambda k: F.unhex(F.md5(k))))
    return rows.select(F.explode(keys).alias("key"), "doc_id").distinct()


def common_keys(refs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, n_docs, keeper) of the keys that at least ``min_docs`` documents hold."""
    counted = refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("n_docs") >= min_docs)


# -- cuckoo filters ------------------------------------------------------------------------


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; keys are the two 64-bit halves of an MD5 value."""

    SLOTS, KICKS = 4, 500

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(1, math.ceil(math.log2(max(1, n) / (cls.SLOTS * 0.8))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of ``keys`` (n x 2 uint64), made larger until all of them fit."""
        room = len(keys)
        while True:
            made = cls.sized(room)
            if all(made.insert(f, i) for f, i in zip(*made.places(keys))):
                return made
            room = 2 * max(room, 1)

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (keys[:, 0] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (keys[:, 1] & self.mask).astype(np.int64)

    def other(self, mark, bucket):
        step = (np.asarray(mark, np.uint64) * np.uint64(0x5BD1E995)) & self.mask
        return (np.asarray(bucket, np.uint64) ^ step).astype(np.int64)

    def insert(self, mark, bucket) -> bool:
        mark, bucket = np.uint16(mark), int(bucket)
        for b in (bucket, int(self.other(mark, bucket))):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        for kick in range(self.KICKS):
            slot = (int(mark) + kick) % self.SLOTS
            mark, self.table[b, slot] = self.table[b, slot], mark
            b = int(self.other(mark, b))
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        return False

    def delete(self, mark, bucket) -> bool:
        for b in (int(bucket), int(self.other(mark, bucket))):
            held = np.flatnonzero(self.table[b] == mark)
            if len(held):
                self.table[b, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first = self.places(keys)
        second = self.other(mark, first)
        return ((self.table[first] == mark[:, None]) | (self.table[second] == mark[:, None])).any(axis=1)


def halves(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, keys)), np.uint64).reshape(-1, 2)


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) for a frame with unique ``key`` values."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [CuckooFilter.of(halves(pdf["key"])).to_bytes()]})

    return keys.select(shard_of(shards).alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard int, filter binary")


def change_filters(filters: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """Filters after inserting (``added``) or deleting (not ``added``) keys.

    A filter that gets too full is returned as null; the caller builds it anew from the table.
    """

    def change(held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        shard = (held if len(held) else rows)["shard"].iloc[0]
        now = CuckooFilter.from_bytes(held["filter"].iloc[0]) if len(held) else CuckooFilter.sized(2 * len(rows))
        full = False
        if len(rows):
            rows = rows.sort_values("added")  # deletions make room first
            for mark, bucket, added in zip(*now.places(halves(rows["key"])), rows["added"]):
                full |= not (now.insert(mark, bucket) if added else now.delete(mark, bucket))
        return pd.DataFrame({"shard": [shard], "filter": [None if full else now.to_bytes()]})

    dealt = changes.select(shard_of(shards).alias("shard"), "key", "added")
    return filters.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(change, "shard int, filter binary")


def screen(refs: DataFrame, filters: DataFrame, shards: int, salts: int) -> DataFrame:
    """The references that the filter of their shard lets through.

    A shard is dealt to ``salts`` tasks by doc_id, so a line that a third of all documents hold
    does not fill one task.
    """

    def probe(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(held):
            return pd.DataFrame({"key": [], "doc_id": []})
        found = CuckooFilter.from_bytes(held["filter"].iloc[0]).contains(halves(rows["key"]))
        return rows.loc[found, ["key", "doc_id"]]

    by = ["shard", "salt"]
    dealt = refs.select(shard_of(shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), "key", "doc_id")
    copies = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(probe, refs.select("key", "doc_id").schema)


# -- the operator --------------------------------------------------------------------------


def lost_lines(refs: DataFrame, common: DataFrame, filters: DataFrame | None = None, shards: int = 1) -> DataFrame:
    """(doc_id, keys): the lines that each document loses. ``refs`` and ``common`` are written tables."""
    if filters is None:
        shards = max(1, math.ceil(common.count() / KEYS_PER_SHARD))
        filters = build_filters(common, shards)
    salts = max(1, math.ceil(refs.count() / (shards * LOOKUPS_PER_TASK)))
    maybe = screen(refs, filters, shards, salts)
    lost = maybe.join(common, "key").filter(F.col("doc_id") < F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def without_lines(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str, out: dict[str, str]) -> DataFrame:
    """``docs`` with the columns kept, n_lines and n_dropped, under the names in ``out``."""
    right = lost.select(F.col("doc_id").alias(out["id"]), F.col("keys").alias(out["keys"]))
    joined = docs.join(right, docs[f"`{id_col}`"] == right[out["id"]], "left").drop(out["id"])
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    strip = STRIPPED.encode()

    def rebuild(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            keys = batch.column(batch.schema.get_field_index(out["keys"]))
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(texts.cast(pa.binary()).to_pylist(), keys):
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                if drop.is_valid:
                    gone = set(drop.as_py())
                    stay = [x for x in lines if md5(x.strip(strip).translate(lower)).digest() not in gone]
                    n_dropped.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay))
                else:
                    n_dropped.append(0)
                    kept.append(text or b"")
            arrays = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != out["keys"]]
            arrays += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            names = [name for name in batch.schema.names if name != out["keys"]] + [out["kept"], out["n_lines"], out["n_dropped"]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = StructType([*docs.schema.fields, StructField(out["kept"], StringType()), StructField(out["n_lines"], LongType()), StructField(out["n_dropped"], LongType())])
    return joined.mapInArrow(tidy(rebuild), schema)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """``docs`` plus kept (text without its common lines), n_lines and n_dropped.

    Where a column of that name exists, the new one is called ``kept_2`` and so on.
    """
    refs = materialize(references(docs, id_col, text_col, min_chars), "line-refs")
    common = materialize(common_keys(refs, min_docs), "line-common")
    out = {x: free_name(docs, x) for x in ("kept", "n_lines", "n_dropped", "id", "keys")}
    if out["id"] == id_col:
        out["id"] = free_name(docs, "line_id")
    return without_lines(docs, lost_lines(refs, common), id_col, text_col, out)


class LineIndex:
    """The state above as tables in the shared work folder, changed by batches of documents.

    References are a log of (key, doc_id, change), by batch and shard of the key. Counts and
    filters are held by shard: a batch counts the keys of its own references anew, from the log of
    their shards, and writes these shards, no others. Which batch wrote a shard's newest version is
    known to this object alone and changes last, so a batch that fails has not happened.
    """

    LOG = "key binary, doc_id long, change int"
    COUNTS = "key binary, n_docs long, keeper long"
    FILTERS = "filter binary"

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int = 64):
        self.spark, self.min_docs, self.min_chars, self.shards = spark, min_docs, min_chars, shards
        self.path, self.batches = new_work_path(spark, "line-index"), 0
        self.newest: dict[str, dict[int, int]] = {"counts": {}, "filters": {}}

    # -- tables ------------------------------------------------------------------

    def _write(self, rows: DataFrame, name: str, batch: int) -> set[int]:
        """Write rows by shard; returns the shards that have some."""
        folder = f"{self.path}/{name}/batch={batch}"
        rows.write.mode("overwrite").partitionBy("shard").parquet(folder)
        shape = StructType([f for f in rows.schema.fields if f.name != "shard"]).add("shard", "integer")
        return {r["shard"] for r in self.spark.read.schema(shape).parquet(folder).select("shard").distinct().collect()}

    def _read(self, name: str, shape: str, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{name}/batch={b}/shard={s}" for s, b in sorted(self.newest[name].items()) if only is None or s in only]
        if not paths:
            return self.spark.createDataFrame([], f"{shape}, shard int")
        read = self.spark.read.schema(f"{shape}, shard int").option("basePath", f"{self.path}/{name}").parquet(*paths)
        return read.select(*[c.split()[0] for c in shape.split(", ")], "shard")

    def _live(self, log: DataFrame) -> DataFrame:
        return log.groupBy("key", "doc_id").agg(F.sum("change").alias("n")).filter("n > 0").select("key", "doc_id")

    def _log(self) -> DataFrame:
        if not self.batches:
            return self.spark.createDataFrame([], f"{self.LOG}, batch int, shard int")
        log = self.spark.read.schema(f"{self.LOG}, batch int, shard int").parquet(f"{self.path}/log")
        return log.filter(F.col("batch") <= self.batches)

    # -- changes -----------------------------------------------------------------

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Add documents; one that is there already is replaced."""
        new = references(docs, id_col, text_col, self.min_chars).withColumn("change", F.lit(1))
        return self._apply(new.unionByName(self._taken(renamed(docs, doc_id=id_col))))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        return self._apply(self._taken(renamed(ids, doc_id=id_col)))

    def _taken(self, ids: DataFrame) -> DataFrame:
        own = self._log().join(ids.distinct(), "doc_id", "left_semi").select("key", "doc_id", "change")
        return self._live(own).withColumn("change", F.lit(-1))

    def _apply(self, changes: DataFrame) -> LineIndex:
        batch = self.batches + 1
        net = changes.groupBy("key", "doc_id").agg(F.sum("change").cast("int").alias("change")).filter("change != 0")
        touched = self._write(net.withColumn("shard", shard_of(self.shards)), "log", batch)
        if not touched:
            return self
        log = self.spark.read.schema(f"{self.LOG}, batch int, shard int").parquet(f"{self.path}/log")
        log = log.filter((F.col("batch") <= batch) & F.col("shard").isin(sorted(touched)))
        keys = materialize(log.filter(F.col("batch") == batch).select("key").distinct(), "line-keys")
        before = self._read("counts", self.COUNTS, touched)
        counted = self._live(log.join(keys, "key", "left_semi")).groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        after = before.drop("shard").join(keys, "key", "left_anti").unionByName(counted)
        after = materialize(after.withColumn("shard", shard_of(self.shards)), "line-counts")
        had, has = (t.filter(F.col("n_docs") >= self.min_docs).select("key") for t in (before, after))
        sides = [has.join(had, "key", "left_anti").withColumn("added", F.lit(True)), had.join(has, "key", "left_anti").withColumn("added", F.lit(False))]
        held = self._read("filters", self.FILTERS, touched).select("shard", "filter")
        changed = materialize(change_filters(held, reduce(DataFrame.unionByName, sides), self.shards), "line-filters")
        full = changed.filter("filter IS NULL").select("shard")
        again = after.filter(F.col("n_docs") >= self.min_docs).join(full, "shard", "left_semi")
        filters = changed.filter("filter IS NOT NULL").unionByName(build_filters(again, self.shards))
        written = {"counts": self._write(after, "counts", batch), "filters": self._write(filters, "filters", batch)}
        for name, shards in written.items():
            kept = {s: b for s, b in self.newest[name].items() if s not in touched}
            self.newest[name] = kept | dict.fromkeys(shards, batch)
        self.batches = batch
        return self

    def lost(self) -> DataFrame:
        refs = materialize(self._live(self._log()), "line-refs")
        common = self._read("counts", self.COUNTS).filter(F.col("n_docs") >= self.min_docs).drop("shard")
        return lost_lines(refs, common, self._read("filters", self.FILTERS).select("shard", "filter"), self.shards)
