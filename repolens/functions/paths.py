"""Path expressions over ``/``-separated strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Fold ``.``, ``..`` and empty segments; ``..`` above the root is ignored."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def parent(path: Column) -> Column:
    """Directory of a path; '' at the root."""
    return F.when(F.instr(path, "/") == 0, "").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory and all those above it, '' included, the deepest first."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit(""))))


def join_path(directory: Column, name: Column) -> Column:
    return normalize(F.concat_ws("/", directory, name))
