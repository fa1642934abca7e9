"""Earliest start of each request when requests to one host keep a minimum distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.ordering import join_chunk_summary, largest_group, ordered_chunks, preceding_chunks
from lorebase.session import ROWS_PER_TASK


def plan_fetches(requests: DataFrame, delay: int, rows_per_task: int = ROWS_PER_TASK, chunk_rows: int | None = None) -> DataFrame:
    """Add ``start`` to requests(host, arrival, id); arrival and delay are integers of one unit.

    A request starts at its arrival or ``delay`` after the previous start of its host. With
    i the position in arrival order this is i*delay + max over the requests so far of
    (arrival - i*delay), a running maximum. The maximum of a host too large for one task is
    taken per ordered chunk and carried over from the chunks before it. A chunk is a task and has
    about ``chunk_rows`` rows, ``rows_per_task`` by default.
    """
    order = [F.col("arrival"), F.col("id")]
    step = F.lit(delay).cast("long")
    lead = F.col("arrival").cast("long") - F.col("_i") * step
    running = (Window.unboundedPreceding, Window.currentRow)
    if largest_group(requests, ["host"]) <= rows_per_task:
        spec = Window.partitionBy("host").orderBy(*order)
        rows = requests.withColumn("_i", F.row_number().over(spec).cast("long") - 1)
        start = F.col("_i") * step + F.max(lead).over(spec.rowsBetween(*running))
        return rows.withColumn("start", start).drop("_i")

    spec = Window.partitionBy("host", "_chunk").orderBy(*order)
    rows = ordered_chunks(requests, ["host"], order, chunk_rows or rows_per_task).withColumn("_i", F.row_number().over(spec).cast("long") - 1)
    rows = rows.withColumn("_run", F.max(lead).over(spec.rowsBetween(*running)))
    before = preceding_chunks(["host"])
    summary = (
        rows.groupBy("host", "_chunk")
        .agg(F.count("*").alias("_n"), F.max("_run").alias("_top"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_carry", F.max(F.col("_top") - F.col("_base") * step).over(before))
        .select("host", "_chunk", "_base", "_carry")
    )
    # Positions in a chunk start at 0: shifting them by _base lowers each lead by _base*delay.
    peak = F.greatest(F.col("_run") - F.col("_base") * step, F.col("_carry"))
    joined = join_chunk_summary(rows, summary, ["host"])
    return joined.withColumn("start", (F.col("_base") + F.col("_i")) * step + peak).drop(
        "_i", "_run", "_base", "_carry", "_chunk"
    )
