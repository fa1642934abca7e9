"""Work on groups that must not depend on one group fitting in one task.

A plain window gathers each group in a single task. When the largest group is too big for
that, rows are range-partitioned into ordered chunks, each chunk is handled on its own, and
only one summary row per (group, chunk) is combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.session import ROWS_PER_TASK, materialize

DRIVER_ROWS = 100_000
"""Largest ordered prefix taken with a top-n plan, which gathers it in one place."""


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]


def join_one(left: DataFrame, right: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK, how: str = "inner") -> DataFrame:
    """Inner or left join to a ``right`` side with unique keys, when some keys of ``left`` may be very frequent.

    Keys with more than ``rows_per_task`` rows are spread over salts, and only their rows of
    ``right`` are repeated. There are at most count/rows_per_task such keys, few enough to
    broadcast. Without any, this is a plain join, which can use the bucketing of ``right``.
    """
    if largest_group(left, [key]) <= rows_per_task:
        return left.join(right, key, how)
    parts = F.ceil(F.col("_n") / rows_per_task).cast("int")
    frequent = left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_per_task)
    frequent = F.broadcast(frequent.select(key, parts.alias("_parts")))
    salts = F.coalesce("_parts", F.lit(1))
    spread = left.join(frequent, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int"))
    copies = right.join(frequent, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return spread.drop("_parts").join(copies.drop("_parts"), [key, "_salt"], how).drop("_salt")


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Range-partition by (keys, order) and label rows with their partition as ``_chunk``.

    There are as many chunks as it takes for about ``rows_per_task`` rows in each; a number that
    is given is not merged to fewer at run time.
    The labels are written to the shared folder, because range bounds come from a sample and
    a recomputed partition could otherwise disagree with the summary built from it.
    """
    chunks = max(1, -(-df.count() // rows_per_task))
    ranged = df.repartitionByRange(chunks, *[F.col(k) for k in keys], *order)
    return materialize(ranged.withColumn("_chunk", F.spark_partition_id()), "chunks")


def preceding_chunks(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def join_chunk_summary(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach per-chunk values; both sides hash on (keys, _chunk), null keys included."""
    on = [*keys, "_chunk"]
    right = summary.select(*[F.col(c).alias(f"_s_{c}") for c in on], *[c for c in summary.columns if c not in on])
    match = F.lit(True)
    for c in on:
        match = match & rows[c].eqNullSafe(right[f"_s_{c}"])
    return rows.join(right, match).drop(*[f"_s_{c}" for c in on])


def index_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "idx", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add the 0-based position (long) of each row inside its group; ``order`` must be total."""
    if largest_group(df, keys) <= rows_per_task:
        spec = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(spec).cast("long") - 1)
    rows = ordered_chunks(df, keys, order, rows_per_task)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    summary = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(preceding_chunks(keys)), F.lit(0)))
        .drop("_n")
    )
    numbered = rows.withColumn("_i", F.row_number().over(local).cast("long") - 1)
    return (
        join_chunk_summary(numbered, summary, keys)
        .withColumn(out, F.col("_base") + F.col("_i"))
        .drop("_base", "_i", "_chunk")
    )


def best_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, deal: Column, parts: int, fan: int = 64) -> DataFrame:
    """The first ``k`` rows of each group in ``order`` (total), numbered from 1 as ``rank``.

    Rows are dealt by the hash ``deal`` over ``parts`` parts of their group; each part keeps its
    first k, and ``fan`` parts at a time are merged until one is left. So no task gets a whole group:
    the first merge sees a part of one, every later one at most ``fan`` x k rows. The engine's own
    limit of a ranked window ends at a thousand rows.
    """
    top, parts = df.withColumn("_part", F.pmod(deal, F.lit(max(1, parts)))), max(1, parts)
    while True:
        spec = Window.partitionBy(*keys, *(["_part"] if parts > 1 else [])).orderBy(*order)
        top = top.withColumn("rank", F.row_number().over(spec)).filter(F.col("rank") <= k)
        if parts == 1:
            return top.drop("_part")
        parts = -(-parts // fan)
        top = top.withColumn("_part", F.pmod(F.col("_part"), F.lit(parts)))


def ordered_slice(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows [offset, offset+limit) of ``df`` in ``order``.

    Small prefixes compile to a top-n plan. A deep page would make that plan gather
    offset+limit rows in one task, so it is cut by position instead.
    """
    if offset + limit <= DRIVER_ROWS:
        ordered = df.orderBy(*order)
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    idx = F.col("_pos")
    return (
        index_within(df, [], order, "_pos")
        .filter((idx >= offset) & (idx < offset + limit))
        .orderBy("_pos")
        .drop("_pos")
    )
