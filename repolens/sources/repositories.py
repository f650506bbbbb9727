"""Repositories as a table (repo_id, path, content), and the files, manifests and facts in them."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from repolens.functions import paths
from repolens.session import broadcast_if_small, materialize
from repolens.sources.frontends.common import LANGUAGES
from repolens.sources.schema import FACT_SCHEMA, MANIFEST_SCHEMA

MANIFESTS = {"package.json": "PackageJson", "pyproject.toml": "PyProject", "setup.py": "SetupPy", "setup.cfg": "SetupPy"}
#: Directories that are never walked.
SKIPPED = ("node_modules", ".git", ".venv", "__pycache__")


def read_tree(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    """Regular files below root. Without a repo_id each directory right below root is a repository."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    inner = F.element_at(F.split("path", re.escape(base), 2), -1)
    if repo_id is not None:
        return raw.select(F.lit(repo_id).alias("repo_id"), inner.alias("path"), "content")
    return raw.select(F.substring_index(inner, "/", 1).alias("repo_id"), F.regexp_replace(inner, "^[^/]*/", "").alias("path"), "content")


def ignore_rule(directory: str, line: str) -> tuple[str, bool, bool] | None:
    """(expression for paths, only directories, negated) of a line of the ``.gitignore`` in directory; None for no rule."""
    line = re.sub(r"(?<!\\)[ \t\r]+$", "", line)
    if not line or line[0] == "#":
        return None
    negated = line[0] == "!"
    body = line[negated:]
    only_directories = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    out, i = [re.escape(directory + "/") if directory else "", "" if anchored else "(?:.*/)?"], 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if body[i:] == "**" and i and body[i - 1] == "/":
            out.append(".+")
            break
        end = body.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif end > 0:
            inner = body[i + 1 : end]
            inner = "^" + inner[1:] if inner[0] in "!^" else inner
            out.append("(?!/)[" + inner.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = end
        else:
            i += c == "\\" and i + 1 < len(body)
            out.append(re.escape(body[i]))
        i += 1
    pattern = "(?s)^" + "".join(out) + "$"
    try:
        re.compile(pattern)
    except re.error:
        return None
    return (pattern, only_directories, negated) if body else None


#: Files that name what is ignored, in the order of their weight.
IGNORE_FILES = (".git/info/exclude", ".gitignore", ".ignore")


def ignored_patterns(tree: DataFrame) -> DataFrame:
    """(repo_id, kind, depth, directory, line, pattern, only_directories, negated): a row per rule of each ignore file. Those of a later kind count for more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r, p, c in zip(*(x.to_pylist() for x in b.columns)):
                kind = IGNORE_FILES.index(".git/info/exclude" if p == ".git/info/exclude" else p.rpartition("/")[2])
                folder = p.rpartition("/")[0] if kind else ""
                found = (ignore_rule(folder, x) for x in (c or b"").decode("utf-8", "replace").split("\n"))
                rows += [(r, kind, folder.count("/") + bool(folder), folder, i, *x) for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], type=t) for i, t in enumerate(kinds)], names=names)

    names = ["repo_id", "kind", "depth", "directory", "line", "pattern", "only_directories", "negated"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
    schema = "repo_id string, kind int, depth int, directory string, line int, pattern string, only_directories boolean, negated boolean"
    named = (F.col("path") == IGNORE_FILES[0]) | paths.base_name(F.col("path")).isin(*IGNORE_FILES[1:])
    return tree.filter(named).select("repo_id", "path", "content").mapInArrow(run, schema)


def walk(tree: DataFrame) -> DataFrame:
    """The tree without skipped directories and ignored files. The last rule that matches decides, deeper files last; what is in an ignored directory stays ignored."""
    kept = tree.filter(~F.col("path").rlike("(^|/)(" + "|".join(map(re.escape, SKIPPED)) + ")/"))
    rules = ignored_patterns(kept.unionByName(tree.filter(F.col("path") == IGNORE_FILES[0]))).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("kind", "depth", "directory", "line", "pattern", "only_directories", "negated"))).alias("_rules"))
    joined = kept.join(broadcast_if_small(materialize(rules, "ignored")), "repo_id", "left")
    parts = F.split("path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), (n < F.size(parts)).alias("directory")))

    def decided(x):
        return F.aggregate("_rules", F.lit(False), lambda acc, r: F.when((x["directory"] | ~r["only_directories"]) & F.regexp_like(x["path"], r["pattern"]), ~r["negated"]).otherwise(acc))

    return joined.filter(F.col("_rules").isNull() | ~F.exists(upto, decided)).drop("_rules")


def language():
    """Language by extension, null for unknown ones."""
    extension = F.regexp_extract("path", r"\.([^./]*)$", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension)


def role():
    """Role of a file from its lower-cased name."""
    name = F.lower(paths.base_name(F.col("path")))
    return (
        F.when(name == "__init__.py", "PackageInit")
        .when(name.rlike(r"\.pyi$|\.d\.[mc]?ts$"), "TypeDecl")
        .when(name.rlike(r"^(.*\.config|\..*rc)\.(ts|mts|cts|tsx|jsx|js|mjs|cjs)$"), "Config")
        .otherwise("Source")
    )


def manifest_kind():
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv]), paths.base_name(F.col("path")))


def source_files(tree: DataFrame) -> DataFrame:
    """(repo_id, path, language, role, content): files of a known language that are no manifest."""
    return tree.withColumn("language", language()).filter(F.col("language").isNotNull() & manifest_kind().isNull()).withColumn("role", role())


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings are left alone."""
    out = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", out)


def dependency_name(spec: str) -> str:
    return re.match(r"[^ <>=!~;\[(]*", spec.strip())[0]


def parse_manifest(name: str, text: str) -> dict:
    """What a manifest declares; an unreadable one declares nothing."""
    out: dict = {"name": None, "dependencies": [], "entries": [], "base_url": None, "aliases": []}
    try:
        if name == "package.json":
            d = json.loads(text)
            out["name"] = d.get("name")
            out["dependencies"] = sorted({k for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for k in d.get(section) or {}})
            targets = d.get("bin")
            out["entries"] = [x for x in [d.get("main"), *([targets] if isinstance(targets, str) else list((targets or {}).values()))] if isinstance(x, str)]
        elif name == "pyproject.toml":
            d = tomllib.loads(text)
            project, poetry = d.get("project", {}), d.get("tool", {}).get("poetry", {})
            out["name"] = project.get("name") or poetry.get("name")
            out["dependencies"] = sorted({dependency_name(x) for x in project.get("dependencies", [])} | {k for k in poetry.get("dependencies", {}) if k != "python"})
            out["entries"] = [str(x).split(":")[0] for x in project.get("scripts", {}).values()]
        elif name == "tsconfig.json":
            d = json.loads(strip_jsonc(text)).get("compilerOptions") or {}
            out["base_url"] = d.get("baseUrl")
            out["aliases"] = [{"prefix": k.removesuffix("*"), "star": k.endswith("*"), "targets": [str(x) for x in v]} for k, v in sorted((d.get("paths") or {}).items())]
    except (ValueError, AttributeError, TypeError):
        pass
    return out


def manifests(tree: DataFrame) -> DataFrame:
    """A row per manifest or tsconfig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for repo, path, content in zip(*(x.to_pylist() for x in b.columns)):
                directory, _, name = path.rpartition("/")
                rows.append({"repo_id": repo, "dir": directory, "kind": MANIFESTS.get(name, "TsConfig")} | parse_manifest(name, (content or b"").decode("utf-8", "replace")))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = to_arrow_schema(_struct(MANIFEST_SCHEMA))
    some = tree.filter(manifest_kind().isNotNull() | (paths.base_name(F.col("path")) == "tsconfig.json"))
    return some.select("repo_id", "path", F.col("content").cast("binary")).mapInArrow(run, MANIFEST_SCHEMA)


def _struct(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def extract_facts(files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Facts of every file. Rows whose (repo_id, path, content_hash) the cache holds are taken from it, the rest extracted."""
    keyed = files.select("repo_id", "path", F.col("content").cast("binary").alias("content"), F.xxhash64("content").alias("content_hash"))
    key = ["repo_id", "path", "content_hash"]
    fresh = keyed if cache is None else keyed.join(cache.select(*key), key, "left_anti")
    schema = to_arrow_schema(_struct(FACT_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from repolens.sources.frontends import extract

        for b in batches:
            columns = [b.column(b.schema.get_field_index(n)).to_pylist() for n in ("repo_id", "path", "content", "content_hash")]
            for start in range(0, b.num_rows, 64):
                rows = []
                for repo, path, content, digest in zip(*(c[start : start + 64] for c in columns)):
                    rows.append({"repo_id": repo, "path": path, "content_hash": digest} | extract(path, (content or b"").decode("utf-8", "replace")))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    found = fresh.select("repo_id", "path", "content", "content_hash").mapInArrow(run, FACT_SCHEMA)
    if cache is None:
        return found
    return found.unionByName(cache.join(keyed.select(*key), key, "left_semi").select(*found.columns))


def token_streams(files: DataFrame) -> DataFrame:
    """(repo_id, path, family, texts, kinds, lines, ends): a row per file, for clone detection."""
    ddl = "repo_id string, path string, family string, texts array<string>, kinds array<string>, lines array<int>, ends array<boolean>"
    schema = to_arrow_schema(_struct(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from repolens.sources.frontends.common import language_of
        from repolens.sources.frontends.css import css_tokens
        from repolens.sources.frontends.python import python_tokens
        from repolens.sources.frontends.script import script_tokens

        for b in batches:
            rows = []
            for repo, path, content in zip(*(x.to_pylist() for x in b.columns)):
                text, lang = (content or b"").decode("utf-8", "replace"), language_of(path)
                tokens = python_tokens(text) if lang == "Python" else css_tokens(text) if lang == "Css" else script_tokens(text, lang)
                texts, kinds, lines, ends = ([t[i] for t in tokens] for i in range(4))
                rows.append({"repo_id": repo, "path": path, "family": "python" if lang == "Python" else "js", "texts": texts, "kinds": kinds, "lines": lines, "ends": ends})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("repo_id", "path", F.col("content").cast("binary")).mapInArrow(run, ddl)
