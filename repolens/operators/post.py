"""What happens to findings after the rules: overrides, ignores, suppressions, ratchet, order, threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions.globs import matches_any

OFF, WARN, ERROR = 0, 1, 2


def override_severity(findings: DataFrame, levels: dict[str, int]) -> DataFrame:
    """The configured severity of a rule, else its own."""
    if not levels:
        return findings
    table = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    return findings.withColumn("severity", F.coalesce(F.try_element_at(table, F.col("rule")), F.col("severity")))


def drop_off(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("severity") > OFF)


def drop_ignored(findings: DataFrame, globs: list[str]) -> DataFrame:
    return findings.filter(~matches_any(F.col("file"), globs)) if globs else findings


def suppressed(findings: DataFrame, suppressions: DataFrame, how: str = "left_anti") -> DataFrame:
    """Findings outside (or with left_semi inside) a suppression of their file and rule: of the file, or of a line in their span."""
    s = suppressions.select(F.col("repo_id").alias("_r"), F.col("path").alias("_p"), F.col("rule").alias("_rule"), "file_scoped", F.col("line").alias("_line"))
    inside = F.col("file_scoped") | F.col("_line").between(F.col("start_line"), F.col("end_line"))
    return findings.join(s, (F.col("repo_id") == F.col("_r")) & (F.col("file") == F.col("_p")) & (F.col("rule") == F.col("_rule")) & inside, how)


def stable_key() -> Column:
    return F.concat_ws("|", "rule", F.coalesce("symbol", "file"))


def baseline_keys(findings: DataFrame) -> DataFrame:
    return findings.select("repo_id", stable_key().alias("key")).distinct()


def ratchet(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose key the baseline does not hold; keys are a set, so one entry hides all findings of its key."""
    return findings.withColumn("key", stable_key()).join(baseline.select("repo_id", "key").distinct(), ["repo_id", "key"], "left_anti").drop("key")


def ordered(findings: DataFrame) -> DataFrame:
    """By path segments, line, rule, symbol (none first)."""
    return findings.orderBy("repo_id", F.split("file", "/"), "start_line", "rule", F.asc_nulls_first("symbol"))


def select_rules(findings: DataFrame, rules: list[str]) -> DataFrame:
    return findings.filter(F.col("rule").isin(rules))


def visible(findings: DataFrame, show_all: bool = False) -> DataFrame:
    return findings if show_all else findings.filter(F.col("confidence") == 2)


def exit_codes(findings: DataFrame, fail_on: int = ERROR) -> DataFrame:
    """(repo_id, exit_code): 1 where a finding is as severe as the threshold."""
    return findings.groupBy("repo_id").agg(F.max(F.when((F.col("severity") >= fail_on) & (F.col("severity") > OFF), 1).otherwise(0)).alias("exit_code"))
