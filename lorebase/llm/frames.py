"""Small helpers for frames whose columns may carry any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.memory import give_back, tidy  # noqa: F401


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first ``name_2``, ``name_3``... that ``df`` does not have (case does not count)."""
    taken, out, k = {c.lower() for c in df.columns}, name, 1
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under the names of the arguments."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` plus columns that are computed once a row, whatever refers to them later.

    The optimizer may put an expression in the place of its column, even inside a function applied
    to every element of an array. It never looks through a generator, here one of a single row.
    """
    once = df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once"))
    return once.select(*df.columns, *[F.col("_once")[n].alias(n) for n in columns])
