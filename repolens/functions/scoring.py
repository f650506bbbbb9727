"""Scores as expressions: CRAP, triage bands, weights, grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crap(cyclomatic: Column, coverage: Column) -> Column:
    """Change risk: complexity squared by the cube of the uncovered share, plus complexity."""
    covered = F.least(F.greatest(coverage.cast("double"), F.lit(0.0)), F.lit(100.0)) / 100
    cc = cyclomatic.cast("double")
    return cc * cc * F.pow(1 - covered, F.lit(3)) + cc


def round1(x: Column) -> Column:
    return F.round(x * 10) / 10


def band(cyclomatic: Column, cognitive: Column, score: Column) -> Column:
    """Triage band of a function over its limits."""
    return (
        F.when((score >= 500) | (cyclomatic >= 50) | (cognitive >= 50), "CRITICAL")
        .when((score >= 100) | (cyclomatic >= 30) | (cognitive >= 30), "HIGH")
        .when(score >= 30, "ELEVATED")
        .otherwise("OVER")
    )


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def effort(loc: Column) -> Column:
    return F.when(loc <= 120, "small").when(loc <= 400, "medium").otherwise("large")
