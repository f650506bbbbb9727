"""Selections by presence or absence: the shapes that the unused-* rules share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def absent(rows: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner. Null keys have none, so they are kept."""
    return rows.join(used.select(*on).distinct(), on, "left_anti")


def present(rows: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(used.select(*on), on, "left_semi")


def flag(rows: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """rows with a boolean column that says whether a partner exists."""
    marked = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return rows.join(marked, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def confidence(damped: Column, repeated: Column | None = None) -> Column:
    """2 (high) unless something makes a dynamic use likely (1); repeated: referenced elsewhere in its own file."""
    base = F.when(damped, 1).otherwise(2)
    return base if repeated is None else F.when(repeated, F.least(base, F.lit(1))).otherwise(base)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
