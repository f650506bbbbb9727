"""Findings as documents: JSON reports, SARIF, workflow annotations, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.operators.joins import prefix_owner
from repolens.session import by_shuffle

LABELS = ("off", "warn", "error")
CONFIDENCE = ("low", "medium", "high")


def _label(column: str, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), F.col(column))


def shaped(findings: DataFrame) -> DataFrame:
    """findings with one struct column ``f`` as reports carry it, and ``ord`` to sort a repository's findings by."""
    body = F.struct("rule", _label("severity", LABELS).alias("severity"), _label("confidence", CONFIDENCE).alias("confidence"), "symbol", "file", F.struct("start_line", "end_line").alias("span"), "message", "reason")
    return findings.select("repo_id", body.alias("f"), F.struct(F.split("file", "/").alias("a"), F.col("start_line").alias("b"), F.col("rule").alias("c"), F.coalesce("symbol", F.lit("")).alias("d")).alias("ord"))


def _listed(findings: DataFrame, item: Column) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ord", item.alias("f"))))
    return shaped(findings).groupBy("repo_id").agg(ordered.alias("x")).select("repo_id", F.col("x.f").alias("items"))


def to_json(findings: DataFrame, metrics: DataFrame, health: DataFrame, components: DataFrame, targets: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo_id, json): schema version 1, a document per repository; findings without a symbol leave it out."""
    whole = lambda df, name: df.select("repo_id", F.struct(*[c for c in df.columns if c != "repo_id"]).alias("s")).groupBy("repo_id").agg(F.array_sort(F.collect_list("s")).alias(name))
    first = lambda df, name: df.select("repo_id", F.struct(*[c for c in df.columns if c != "repo_id"]).alias(name))
    out = first(metrics, "metrics").join(first(health, "health"), "repo_id", "left").join(whole(components, "components"), "repo_id", "left").join(whole(targets, "targets"), "repo_id", "left").join(whole(roots, "scan_roots"), "repo_id", "left")
    out = out.join(_listed(findings, F.col("f")), "repo_id", "left")
    doc = F.struct(F.lit(1).alias("schema_version"), "repo_id", "scan_roots", "metrics", F.struct("health.score", "health.grade", "components", "targets").alias("health"), F.coalesce("items", F.array().cast("array<struct<rule:string,severity:string,confidence:string,symbol:string,file:string,span:struct<start_line:int,end_line:int>,message:string,reason:string>>")).alias("findings"))
    return out.select("repo_id", F.to_json(doc).alias("json"))


def to_sarif(findings: DataFrame, version: str = "1") -> DataFrame:
    """(repo_id, sarif): a SARIF 2.1.0 log per repository."""
    level = F.when(F.col("f.severity") == "error", "error").when(F.col("f.severity") == "warn", "warning").otherwise("none")
    region = F.struct(F.col("f.span.start_line").alias("startLine"), F.col("f.span.end_line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("f.file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    item = F.struct(F.col("f.rule").alias("ruleId"), level.alias("level"), F.struct(F.col("f.message").alias("text")).alias("message"), F.array(place).alias("locations"))
    run = F.struct(F.struct(F.struct(F.lit("repolens").alias("name"), F.lit(version).alias("version")).alias("driver")).alias("tool"), F.col("items").alias("results"))
    doc = F.struct(F.lit("2.1.0").alias("version"), F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.array(run).alias("runs"))
    return _listed(findings, item).select("repo_id", F.to_json(doc).alias("sarif"))


def to_annotations(findings: DataFrame) -> DataFrame:
    """(repo_id, line): workflow annotation commands, a row per finding."""
    level = F.when(F.col("severity") == 2, "error").otherwise("warning")
    return findings.select("repo_id", F.format_string("::%s file=%s,line=%d::[%s] %s", level, "file", "start_line", "rule", "message").alias("line"))


def by_package(findings: DataFrame, roots: DataFrame) -> DataFrame:
    """findings with ``package``: that of the longest root (repo_id, root, package) above the file, ``.`` where there is none."""
    owned = prefix_owner(by_shuffle(findings), by_shuffle(roots.select("repo_id", "root", F.col("package").alias("owner"))), F.col("file"))
    return owned.withColumn("package", F.coalesce("owner", F.lit("."))).drop("owner")


def to_text_by_package(findings: DataFrame, roots: DataFrame, show_all: bool = False, per_rule: int = 10) -> str:
    """The report of to_text for each package, those with the most findings first. Only the lines shown reach the driver."""
    from pyspark.sql import Window

    from repolens.operators.post import visible

    shown = by_package(visible(findings, show_all), roots)
    of, rule = Window.partitionBy("repo_id", "package"), Window.partitionBy("repo_id", "package", "rule")
    ranked = shown.withColumn("all", F.count(F.lit(1)).over(of)).withColumn("n", F.count(F.lit(1)).over(rule)).withColumn("k", F.row_number().over(rule.orderBy(F.split("file", "/"), "start_line", "message")))
    out, last = [], (None, None, None)
    for r in ranked.filter(F.col("k") <= per_rule).orderBy("repo_id", F.desc("all"), "package", F.desc("n"), "rule", "k").collect():
        if (r["repo_id"], r["package"]) != last[:2]:
            out.append(f"{r['repo_id']}  {r['package']}  {r['all']}")
        if (r["repo_id"], r["package"], r["rule"]) != last:
            last = (r["repo_id"], r["package"], r["rule"])
            out.append(f"  {r['rule']}  {r['n']}")
        out.append(f"    {r['file']}:{r['start_line']}  {r['message']}")
    return "\n".join(out)


def to_text(findings: DataFrame, show_all: bool = False, per_rule: int = 10) -> str:
    """A report to read: for each repository and rule the count and the first findings. Only those rows reach the driver."""
    from pyspark.sql import Window

    from repolens.operators.post import visible

    w = Window.partitionBy("repo_id", "rule")
    ranked = visible(findings, show_all).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy(F.split("file", "/"), "start_line", "message"))).filter(F.col("k") <= per_rule)
    out, last = [], None
    for r in ranked.orderBy("repo_id", F.desc("n"), "rule", "k").collect():
        if (r["repo_id"], r["rule"]) != last:
            last = (r["repo_id"], r["rule"])
            out.append(f"{r['repo_id']}  {r['rule']}  {r['n']}")
        out.append(f"  {r['file']}:{r['start_line']}  {r['message']}")
    return "\n".join(out)


EXPLANATIONS = {
    "unused-file": "No entry point, configuration file or test leads to the file over imports.",
    "only-used-in-tests": "Tests reach the file, production code does not.",
    "unused-export": "The name is exported, but no file imports it.",
    "unused-type": "The type is exported, but no file imports it.",
    "expected-unused-but-used": "A tag says that nothing uses the symbol, yet something does.",
    "unused-enum-member": "No file accesses a member of this name.",
    "unused-class-member": "The private member is never accessed.",
    "unused-parameter": "A trailing parameter that the body does not name.",
    "unused-import": "The file never refers to the imported name.",
    "unused-dependency": "The manifest declares the dependency, but no import resolves to it.",
    "circular-imports": "Files that import each other in a circle.",
    "high-complexity": "Cyclomatic or cognitive complexity, or the change risk from both complexity and coverage, is over its limit.",
    "large-function": "The function has more lines than the limit.",
    "banned-import": "A policy forbids this import here.",
    "banned-call": "A policy forbids this call here.",
    "banned-effect": "A policy forbids what this import or call does.",
    "boundary-violation": "A layer imports one that it may not use.",
    "duplicate-code": "The same tokens, up to the mode's tolerance, are in several places.",
    "unused-css-token": "The custom property is declared but no var() refers to it.",
    "broken-css-reference": "A var() refers to a custom property that nothing declares.",
    "unused-css-class": "No markup refers to the class.",
    "missing-suppression-reason": "A suppression or tag gives no reason though the configuration asks for one.",
}


def explain(rule: str) -> str:
    if rule not in EXPLANATIONS:
        raise ValueError(f"unknown rule {rule}")
    return EXPLANATIONS[rule]
