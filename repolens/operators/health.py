"""Aggregations over findings: rule counts, capped health components, refactor targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.scoring import effort, grade, round1

# Component, its cap, and for each of its rules the weight and the title used in reasons.
COMPONENTS = {
    "api-surface": (12.0, {"unused-export": (1.0, "unused export"), "unused-type": (0.75, "unused type")}),
    "dead-code": (45.0, {"unused-file": (8.0, "unused file"), "unused-import": (1.0, "unused import"), "unused-enum-member": (1.5, "unused enum member"), "unused-class-member": (1.5, "unused class member"), "unused-parameter": (1.0, "unused parameter"), "unused-dependency": (4.0, "unused dependency"), "only-used-in-tests": (3.0, "only used in tests")}),
    "maintenance": (10.0, {"expected-unused-but-used": (1.0, "stale expected-unused tag"), "missing-suppression-reason": (1.0, "missing suppression reason")}),
    "cycles": (25.0, {"circular-imports": (6.0, "circular imports")}),
    "complexity": (25.0, {"high-complexity": (4.0, "high complexity"), "large-function": (4.0, "large function")}),
    "duplication": (20.0, {"duplicate-code": (5.0, "duplicate code")}),
    "architecture": (25.0, {"banned-import": (5.0, "banned import"), "banned-call": (5.0, "banned call"), "banned-effect": (5.0, "banned effect"), "boundary-violation": (6.0, "boundary violation")}),
    "styling": (15.0, {"unused-css-token": (2.0, "unused CSS token"), "broken-css-reference": (3.0, "broken CSS reference"), "unused-css-class": (2.0, "unused CSS class")}),
}
KINDS = {
    "unused-file": "dead file", "unused-export": "API surface review", "unused-type": "API surface review", "circular-imports": "cycle", "high-complexity": "complexity hotspot", "large-function": "large function refactor",
    "duplicate-code": "duplicate block", "banned-import": "architecture violation", "banned-call": "architecture violation", "banned-effect": "architecture violation", "boundary-violation": "architecture violation",
    "unused-css-token": "style cleanup", "broken-css-reference": "style cleanup", "unused-css-class": "style cleanup",
}
METRICS = ("unused-file", "unused-export", "unused-type", "unused-import", "unused-dependency", "unused-enum-member", "unused-class-member", "unused-parameter", "only-used-in-tests", "circular-imports", "high-complexity", "large-function", "duplicate-code")


def _of_rule(values: dict[str, object]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("rule"))


def rule_counts(findings: DataFrame, rules: tuple[str, ...] = METRICS, by: tuple[str, ...] = ("repo_id",)) -> DataFrame:
    """One row for each repository, a column for each rule."""
    return findings.groupBy(*by).agg(*[F.count(F.when(F.col("rule") == r, 1)).alias(r.replace("-", "_")) for r in rules])


def metrics(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Rule counts, the file count and the share of dead files in per cent."""
    many = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))
    counts = many.join(rule_counts(findings), "repo_id", "left").na.fill(0)
    return counts.withColumn("dead_file_pct", F.when(F.col("files") > 0, round1(F.col("unused_file") * 100 / F.col("files"))).otherwise(0.0)).withColumn("duplication_pct", F.lit(None).cast("double"))


def weight() -> Column:
    """Weight of a finding: by rule, more for complex, long and cyclic ones (column ``magnitude``), by severity."""
    base = _of_rule({r: w for _, rules in COMPONENTS.values() for r, (w, _) in rules.items()})
    size = F.coalesce(F.col("magnitude"), F.lit(0.0))
    more = F.when(F.col("rule") == "high-complexity", F.when(F.col("magnitude").isNull(), 1.0).otherwise(F.round(size, 1) / 30)).when(F.col("rule") == "large-function", (F.col("end_line") - F.col("start_line") + 1) / 60.0).when(F.col("rule") == "circular-imports", F.coalesce(F.col("magnitude"), F.lit(2.0))).otherwise(0.0)
    return (base + more) * F.when(F.col("severity") == 2, 1.5).when(F.col("severity") == 1, 1.0).otherwise(0.0)


def components(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, component, penalty, score): weights per hundred files, capped."""
    many = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"))
    name, cap = _of_rule({r: c for c, (_, rules) in COMPONENTS.items() for r in rules}), _of_rule({r: k for k, rules in COMPONENTS.values() for r in rules})
    high = findings.filter("confidence = 2").withColumn("weight", weight()).withColumn("component", name).withColumn("cap", cap)
    summed = high.groupBy("repo_id", "component", "cap").agg(F.sum("weight").alias("weight")).join(many, "repo_id")
    return summed.select("repo_id", "component", round1(F.least(F.col("weight") * 100 / F.greatest("files", F.lit(1)), F.col("cap"))).alias("penalty")).withColumn("score", round1(100 - F.col("penalty")))


def health(found: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, score, grade) of each repository; one without findings has 100."""
    lost = found.groupBy("repo_id").agg(F.sum("penalty").alias("lost"))
    every = files.select("repo_id").distinct().join(lost, "repo_id", "left")
    score = round1(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.coalesce("lost", F.lit(0.0)))))
    return every.select("repo_id", score.alias("score")).withColumn("grade", grade(F.col("score")))


def targets(findings: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """The files whose findings pay off most for their size: rank, score, payoff, kind, effort, three reasons."""
    some = findings.filter("confidence = 2").filter(~F.col("rule").isin("missing-suppression-reason", "expected-unused-but-used")).withColumn("weight", weight())
    title = _of_rule({r: t for _, rules in COMPONENTS.values() for r, (_, t) in rules.items()})
    # on equal weights the last in order counts
    order = F.struct("weight", "start_line", "rule", F.coalesce("symbol", F.lit("")))
    by_file = some.groupBy("repo_id", "file").agg(F.sum("weight").alias("payoff"), F.max_by("rule", order).alias("rule"))
    counted = some.withColumn("title", title).groupBy("repo_id", "file", "title").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("repo_id", "file").orderBy(F.desc("n"), "title"))).filter("k <= 3")
    reasons = ranked.groupBy("repo_id", "file").agg(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("n") == 1, F.col("title")).otherwise(F.concat_ws(" ", F.col("n").cast("string"), "title")).alias("t")))).alias("r")).select("repo_id", "file", F.col("r.t").alias("reasons"))
    sized = by_file.join(files.select("repo_id", F.col("path").alias("file"), "loc"), ["repo_id", "file"], "left").withColumn("loc", F.coalesce("loc", F.lit(0)))
    scored = sized.withColumn("score", round1(F.col("payoff") / (1 + F.sqrt("loc") / 8)))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc(F.col("payoff") / (1 + F.sqrt("loc") / 8)), F.desc("payoff"), F.split("file", "/")))
    top = scored.withColumn("rank", place).filter(F.col("rank") <= most).join(reasons, ["repo_id", "file"])
    kind = F.coalesce(_of_rule(KINDS), F.lit("dead-code cleanup"))
    return top.select("repo_id", "rank", "file", "score", round1(F.col("payoff")).alias("payoff"), kind.alias("kind"), effort(F.col("loc")).alias("effort"), "reasons")
