"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.session import materialize

MAX_ROUNDS = 60


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every vertex is either a root or has exactly one root."""
    ends = edges.select(F.col("hi").alias("v"), F.lit(1).alias("as_hi"), F.lit(0).alias("as_lo"))
    ends = ends.unionByName(edges.select(F.col("lo").alias("v"), F.lit(0).alias("as_hi"), F.lit(1).alias("as_lo")))
    per = ends.groupBy("v").agg(F.sum("as_hi").alias("n_hi"), F.max("as_lo").alias("is_lo"))
    return per.filter((F.col("n_hi") > 1) | ((F.col("n_hi") > 0) & (F.col("is_lo") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(lo, hi) with ``lo`` the least vertex of the component of ``hi``; roots have no row.

    ``edges`` has two long columns of any order; loops and repeats do no harm. Alternating
    large-star and small-star steps: each hangs the neighbours of a vertex on the least of them.
    Minima are combined on the map side and joined back, so no vertex gathers its neighbours,
    and each round is written to the shared folder.
    """
    a, b = edges.columns
    now = materialize(
        edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct(), "edges"
    )
    for _ in range(MAX_ROUNDS):
        if _is_star_forest(now):
            return now
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        large = materialize(large, "edges")
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").filter("lo != m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        now = materialize(small.unionByName(root.select(F.col("m").alias("lo"), "hi")).distinct(), "edges")
    raise RuntimeError("components did not settle")
