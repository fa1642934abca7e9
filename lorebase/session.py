"""Session defaults, the shared work folder, and the size checks behind every broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20
"""Largest join side that is shipped to every executor."""

BUCKET_BYTES = 256 << 20
"""Size of a bucket of an intermediate table, of which a join reads one in a task."""

ROWS_PER_TASK = 2_000_000
"""Largest ordered group that is handled by one task; larger ones are split (see ordering.py)."""


def build_session(app: str = "lorebase", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def session_with(spark: SparkSession, conf: dict[str, str]) -> SparkSession:
    """A session of its own with the settings of ``spark`` and, in place of some of them, ``conf``."""
    own = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, value in conf.items():
        own.conf.set(key, value)
    return own


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its machine, so the setting is required there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="lorebase-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_work_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/lorebase/{label}-{uuid.uuid4().hex}"


def local_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as the machines' own file system has it, or None if it is in another store."""
    files, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    at = files.Path(path)
    if (at.toUri().getScheme() or files.FileSystem.getDefaultUri(conf).getScheme()) != "file":
        return None
    return at.getFileSystem(conf).makeQualified(at).toUri().getPath()


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage, survives the loss of any executor, and unlike a row checkpoint the
    Parquet copy keeps column pruning and size statistics for whatever reads it next.
    """
    path = new_work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Whether the optimizer's size estimate is below one reader split per core."""
    spark = df.sparkSession
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate < spark.sparkContext.defaultParallelism * split


def materialize_by(df: DataFrame, key: str, label: str = "stage") -> DataFrame:
    """Like ``materialize``, bucketed by ``key`` so that repeated joins on it do not shuffle this side.

    The table is written plainly and measured first; there is a bucket for each ``BUCKET_BYTES``.
    The catalog entry is only needed while the table is opened. A small table is left unbucketed:
    many files would cost more than its shuffles.
    """
    df, spark = materialize(df, label), df.sparkSession
    if is_small(df):
        return df
    path = new_work_path(spark, label)
    name = "lorebase_" + uuid.uuid4().hex
    buckets = max(1, -(-measured_bytes(df, df.columns) // BUCKET_BYTES))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def fits_broadcast(df: DataFrame, columns: list[str], max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``columns`` of ``df`` (string or binary-sized values) against the broadcast limit."""
    return measured_bytes(df, columns) <= max_bytes


def measured_bytes(df: DataFrame, columns: list[str]) -> int:
    # 64 bytes per row cover the hash table entry and fixed-width values; 8 an item of an array of numbers.
    width = F.lit(64)
    for name in columns:
        kind = df.schema[name].dataType
        numbers = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)
        size = 8 * F.size(name) if numbers else F.octet_length(F.col(name).cast("string"))
        width = width + F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))
    return df.select(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("n")).first()["n"]


def broadcast_if_small(df: DataFrame, columns: list[str] | None = None, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its measured size allows it, else ``df`` for a shuffled join.

    ``df`` should be materialized: it is scanned once for the measurement.
    """
    return F.broadcast(df) if fits_broadcast(df, columns or df.columns, max_bytes) else df


def spread_small(df: DataFrame) -> DataFrame:
    """Use every core for per-row Python work on an input too small to be split by the reader.

    Inputs with enough splits are left unshuffled.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if is_small(df) else df
