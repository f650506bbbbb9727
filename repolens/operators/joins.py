"""First-match joins and longest-prefix ownership as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions import paths


def first_match(candidates: DataFrame, targets: DataFrame, key: list[str], target: list[str], priority: str = "priority", keep: list[str] | None = None) -> DataFrame:
    """For each key the existing candidate of least priority: candidates ⋈ targets on ``target``, then arg-min.

    The minimum is taken map-side before the shuffle by key, so a key with many candidates costs no more.
    """
    columns = keep or target
    hit = candidates.join(targets.select(*target).distinct(), target, "left_semi")
    best = hit.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(priority, *columns)).alias("best"), F.min(priority).alias(priority))
    return best.select(*key, priority, *[F.col(f"best.{c}").alias(c) for c in columns])


def prefix_owner(items: DataFrame, owners: DataFrame, path: Column, root: str = "root", keep: str = "owner", by: list[str] | None = None) -> DataFrame:
    """items with the owner whose root is the deepest ancestor directory of ``path``.

    Ancestors are exploded and equi-joined rather than compared by prefix, so no pair of item and owner is tried in vain.
    """
    by = by or ["repo_id"]
    keyed = items.withColumn("_path", path)
    steps = keyed.select(*by, "_path").distinct().withColumn("_dir", F.explode(paths.ancestors(paths.parent(F.col("_path")))))
    named = owners.select(*by, F.col(root).alias("_dir"), keep)
    found = steps.join(named, [*by, "_dir"]).groupBy(*by, "_path").agg(F.max_by(keep, F.struct(F.length("_dir"), F.col(keep))).alias(keep))
    return keyed.join(found, [*by, "_path"], "left").drop("_path")
