"""Fixes: findings to planned actions, actions to new file contents and diffs, with the old contents kept."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIXABLE = ("unused-file", "unused-export", "unused-type", "unused-import", "unused-dependency")


def plan(findings: DataFrame, imports: DataFrame, files: bool = True, dependencies: bool = False, least_confidence: int = 2) -> DataFrame:
    """(repo_id, path, kind, start_line, end_line, names): delete-file, edit-import, unexport, drop-dependency.

    Import edits of one statement are one action. Dependencies are of medium confidence and so need ``dependencies``.
    """
    f = findings.filter(F.col("rule").isin(*FIXABLE))
    sure = f.filter(F.col("confidence") >= least_confidence)
    name = F.regexp_extract("message", "'([^']*)'", 1)
    out = sure.filter("rule = 'unused-import'").withColumn("name", name).alias("f").join(
        imports.select("repo_id", "path", F.col("start_line").alias("a"), F.col("end_line").alias("b"), "names").alias("i"),
        (F.col("f.repo_id") == F.col("i.repo_id")) & (F.col("f.file") == F.col("i.path")) & (F.col("start_line") <= F.col("b")) & (F.col("a") <= F.col("end_line")) & F.exists("names", lambda n: n["local"] == F.col("name")),
    ).groupBy("f.repo_id", "path", F.col("a").alias("start_line"), F.col("b").alias("end_line")).agg(F.array_sort(F.collect_set("name")).alias("names")).select("repo_id", "path", F.lit("edit-import").alias("kind"), "start_line", "end_line", "names")
    simple = lambda df, kind: df.select("repo_id", F.col("file").alias("path"), F.lit(kind).alias("kind"), "start_line", "end_line", F.array(name).alias("names"))
    out = out.unionByName(simple(sure.filter("rule in ('unused-export', 'unused-type')"), "unexport"))
    if files:
        out = out.unionByName(simple(sure.filter("rule = 'unused-file'"), "delete-file"))
    if dependencies:
        out = out.unionByName(simple(f.filter("rule = 'unused-dependency'"), "drop-dependency"))
    return out


def affected(actions: DataFrame) -> DataFrame:
    return actions.select("repo_id", "path").distinct()


def patch_import(statement: str, names: set[str], python: bool) -> str | None:
    """The import without ``names``; None where nothing of it is left."""
    if python:
        m = re.match(r"(\s*)(from\s+\S+\s+)?import\s+(.*)$", statement.replace("\\\n", " "), re.DOTALL)
        if not m:
            return statement
        parts = [x.split("#")[0].strip() for x in re.sub(r"[()\n]", " ", m[3]).split(",")]
        local = lambda x: re.split(r"\s+as\s+", x)[-1].split("." if not m[2] else "\0")[0].strip()
        kept = [x for x in parts if x and local(x) not in names]
        return f"{m[1]}{m[2] or ''}import {', '.join(kept)}" if kept else None
    m = re.match(r"(\s*import\s+(?:type\s+)?)(.*?)(\s+from\s+['\"][^'\"]*['\"].*)$", statement, re.DOTALL)
    if not m:
        return statement
    braces = re.search(r"\{(.*)\}", m[2], re.DOTALL)
    inner = [x.strip() for x in braces[1].split(",") if x.strip()] if braces else []
    kept = [x for x in inner if re.split(r"\s+as\s+", x)[-1].removeprefix("type ").strip() not in names]
    rest = [x.strip() for x in re.sub(r"\{.*\}", "", m[2], flags=re.DOTALL).split(",") if x.strip()]
    rest = [x for x in rest if re.split(r"\s+as\s+", x)[-1].strip() not in names]
    clause = [*rest, *(["{ " + ", ".join(kept) + " }"] if kept else [])]
    return m[1] + ", ".join(clause) + m[3] if clause else None


def drop_dependency(text: str, path: str, name: str) -> str:
    """A manifest without the dependency; other lines stay as they are."""
    if path.endswith("package.json"):
        try:
            d = json.loads(text)
        except ValueError:
            return text
        for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
            if isinstance(d.get(section), dict):
                d[section].pop(name, None)
        indent = re.search(r"\n([ \t]+)\"", text)
        return json.dumps(d, indent=indent[1] if indent else 2, ensure_ascii=False) + ("\n" if text.endswith("\n") else "")
    text = re.sub(rf"[ \t]*([\"']){re.escape(name)}(?![\w.-])[^\"']*\1\s*,?[ \t]*\n?", "", text)
    return re.sub(rf"(?m)^{re.escape(name)}\s*=.*\n?", "", text)


def edit(text: str, path: str, actions: list[dict]) -> str | None:
    """All actions of a file, from its end to its start, so that line numbers stay right. None: the file goes."""
    if any(a["kind"] == "delete-file" for a in actions):
        return None
    lines = text.split("\n")
    for a in sorted((a for a in actions if a["kind"] in ("edit-import", "unexport")), key=lambda a: (a["start_line"], a["end_line"]), reverse=True):
        lo, hi = a["start_line"] - 1, a["end_line"]
        if a["kind"] == "edit-import":
            new = patch_import("\n".join(lines[lo:hi]), set(a["names"]), path.endswith((".py", ".pyi")))
            lines[lo:hi] = [] if new is None else new.split("\n")
        elif not path.endswith((".py", ".pyi")):
            lines[lo] = re.sub(r"^(\s*)export\s+(?!default\b|\{|\*)", r"\1", lines[lo])
    text = "\n".join(lines)
    for a in actions:
        if a["kind"] == "drop-dependency":
            for name in a["names"]:
                text = drop_dependency(text, path, name)
    return text


def diff(old: str, new: str | None, path: str) -> str:
    """One hunk between the common head and tail."""
    a, b = old.split("\n"), [] if new is None else new.split("\n")
    if a == b:
        return ""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    gone, come = a[head : len(a) - tail], b[head : len(b) - tail]
    return "\n".join([f"--- a/{path}", "+++ /dev/null" if new is None else f"+++ b/{path}", f"@@ -{head + 1},{len(gone)} +{head + 1},{len(come)} @@", *("-" + x for x in gone), *("+" + x for x in come)])


def apply(tree: DataFrame, actions: DataFrame) -> DataFrame:
    """(repo_id, path, old, new, diff) of every affected file; ``old`` is the snapshot that restore() brings back."""

    def run(keys: tuple, c: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(a):
            return pd.DataFrame({k: [] for k in ("repo_id", "path", "old", "new", "diff")})
        path, old = c["path"].iloc[0], bytes(c["content"].iloc[0]).decode("utf-8", "replace")
        new = edit(old, path, [{**r, "names": list(r["names"])} for r in a.to_dict("records")])
        return pd.DataFrame({"repo_id": [c["repo_id"].iloc[0]], "path": [path], "old": [old], "new": [new], "diff": [diff(old, new, path)]})

    content = tree.select("repo_id", "path", F.col("content").cast("binary").alias("content")).join(affected(actions), ["repo_id", "path"], "left_semi")
    return content.groupBy("repo_id", "path").cogroup(actions.groupBy("repo_id", "path")).applyInPandas(run, "repo_id string, path string, old string, new string, diff string")


def patched(tree: DataFrame, edits: DataFrame) -> DataFrame:
    """The tree after the edits."""
    rest = tree.join(edits.select("repo_id", "path"), ["repo_id", "path"], "left_anti").select("repo_id", "path", "content")
    return rest.unionByName(edits.filter("new is not null").select("repo_id", "path", F.col("new").cast("binary").alias("content")))


def restore(tree: DataFrame, edits: DataFrame) -> DataFrame:
    """The tree before the edits."""
    rest = tree.join(edits.select("repo_id", "path"), ["repo_id", "path"], "left_anti").select("repo_id", "path", "content")
    return rest.unionByName(edits.select("repo_id", "path", F.col("old").cast("binary").alias("content")))
