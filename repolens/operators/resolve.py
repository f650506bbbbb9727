"""Imports to files and external packages: candidates with priorities, then one first-match join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions import paths
from repolens.operators.joins import first_match
from repolens.session import by_shuffle

# What a specifier may stand for, in order, and import names that differ from their distribution's.
PROBES = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
PY_PROBES = (".py", "/__init__.py", ".pyi")
RENAMES = {"cv2": "opencv-python", "PIL": "pillow", "sklearn": "scikit-learn", "yaml": "pyyaml", "bs4": "beautifulsoup4", "dotenv": "python-dotenv", "jwt": "pyjwt"}


def _probe(base: Column, suffixes: tuple[str, ...], first: Column | int = 0) -> Column:
    """Candidates (priority, target) of one base path."""
    return F.array(*[F.struct((F.lit(first) + i).cast("int").alias("priority"), F.concat(base, F.lit(s)).alias("target")) for i, s in enumerate(suffixes)])


def _under(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).when(name == "", directory).otherwise(F.concat_ws("/", directory, name))


def package_top(specifier: Column) -> Column:
    """``@scope/name`` or the first segment."""
    return F.when(specifier.startswith("@"), F.regexp_extract(specifier, "^(@[^/]*/?[^/]*)", 1)).otherwise(F.substring_index(specifier, "/", 1))


def external_name(specifier: Column, language: Column) -> Column:
    """The distribution that an import outside the repository comes from."""
    top = F.substring_index(specifier, ".", 1)
    renamed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RENAMES.items() for x in kv]), top), top)
    return F.when(language == "Python", renamed).otherwise(package_top(specifier))


def script_candidates(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(…, priority, target) for TypeScript and JavaScript: relative, then path aliases, then workspace packages."""
    key = ["repo_id", "path", "import_id"]
    i = imports.filter((F.col("language") != "Python") & (F.col("language") != "Css"))
    relative = i.filter(F.col("specifier").startswith("."))
    a = relative.select(*key, F.explode(_probe(paths.join_path(F.col("dir"), F.col("specifier")), PROBES)).alias("c"))
    rooted = i.filter(~F.col("specifier").startswith("."))
    tops = packages.select("repo_id", F.col("root").alias("pkg_root"), "base_url", "aliases")
    alias = rooted.join(by_shuffle(tops), ["repo_id", "pkg_root"]).withColumn("base", F.when(F.col("base_url").isNotNull(), paths.join_path(F.col("pkg_root"), F.col("base_url"))).otherwise(F.col("pkg_root")))
    alias = alias.select(*key, "specifier", "base", F.posexplode("aliases").alias("n", "alias"))
    alias = alias.filter(F.when(F.col("alias.star"), F.expr("startswith(specifier, alias.prefix)")).otherwise(F.col("specifier") == F.col("alias.prefix")))
    alias = alias.select(*key, "base", "n", F.expr("substring(specifier, length(alias.prefix) + 1)").alias("rest"), F.posexplode("alias.targets").alias("m", "to"))
    b = alias.select(*key, F.explode(_probe(paths.join_path(F.col("base"), F.expr("replace(to, '*', rest)")), PROBES, 100 + F.col("n") * 1000 + F.col("m") * 20)).alias("c"))
    named = packages.filter("id is not null").groupBy("repo_id", F.col("id").alias("top")).agg(F.min("root").alias("root"))
    inner = rooted.withColumn("top", package_top(F.col("specifier"))).join(by_shuffle(named), ["repo_id", "top"])
    sub = F.expr("substring(specifier, length(top) + 2)")
    base = _under(F.col("root"), sub)
    c = inner.select(*key, F.explode(F.when(sub == "", _probe(_under(F.col("root"), F.lit("index")), PROBES[1:8], 1_000_000)).otherwise(_probe(base, PROBES, 1_000_000))).alias("c"))
    return a.union(b).union(c).select(*key, "c.priority", "c.target")


def _relative_base(directory: Column, dots: Column, module: Column) -> Column:
    parts = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/"))
    up = F.slice(parts, 1, F.greatest(F.size(parts) - dots + 1, F.lit(0)))
    return _under(F.array_join(up, "/"), F.replace(module, F.lit("."), F.lit("/")))


def python_bases(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """(…, priority, base) of the places a Python module may be: one for relative imports, one per import root for others."""
    roots = packages.select("repo_id", F.explode("py_roots").alias("r")).union(packages.select("repo_id", F.lit(""))).distinct().groupBy("repo_id").agg(F.array_sort(F.collect_set("r")).alias("roots"))
    i = imports.filter("language = 'Python'").withColumn("dots", F.length(F.regexp_extract("specifier", r"^(\.*)", 1))).withColumn("module", F.regexp_extract("specifier", r"^\.*(.*)$", 1))
    key = ["repo_id", "path", "import_id", "names", "is_namespace", "module", "dots"]
    relative = i.filter("dots > 0").select(*key, F.lit(0).alias("n"), _relative_base(F.col("dir"), F.col("dots"), F.col("module")).alias("base"))
    absolute = i.filter("dots = 0").join(by_shuffle(roots), "repo_id").select(*key, F.posexplode("roots").alias("n", "r")).select(*key, "n", _under(F.col("r"), F.replace("module", F.lit("."), F.lit("/"))).alias("base"))
    return relative.union(absolute)


def resolve_imports(imports: DataFrame, packages: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, external, submodules).

    imports: repo_id, path, import_id, specifier, language, pkg_root, dir, names, is_namespace, kind, is_reexport.
    resolved: repo_id, path, import_id, target; external: repo_id, dep; submodules: repo_id, path, target, more edges.
    """
    key = ["repo_id", "path", "import_id"]
    bases = python_bases(imports, packages)
    init = F.array(F.struct(F.lit(0).alias("priority"), F.concat(F.when(F.col("base") == "", "").otherwise(F.concat("base", F.lit("/"))), F.lit("__init__.py")).alias("target")))
    modules = bases.select(*key, F.explode(F.when(F.col("module") == "", init).otherwise(_probe(F.col("base"), PY_PROBES, F.col("n") * 10))).alias("c")).select(*key, "c.priority", "c.target")
    candidates = script_candidates(imports, packages).unionByName(modules)
    targets = by_shuffle(files.select("repo_id", F.col("path").alias("target")))
    resolved = first_match(candidates, targets, key, ["repo_id", "target"], keep=["target"])
    resolved = resolved.select(*key, "target")
    outside = imports.filter(~F.col("specifier").startswith(".") & ~F.col("specifier").startswith("/") & (F.col("language") != "Css")).join(by_shuffle(resolved), key, "left_anti")
    external = outside.select("repo_id", external_name(F.col("specifier"), F.col("language")).alias("dep")).distinct()
    subs = bases.filter("not is_namespace").select(*key, "n", "base", F.explode("names.imported").alias("name"))
    subs = subs.select(*key, "name", F.explode(_probe(_under(F.col("base"), F.col("name")), PY_PROBES, F.col("n") * 10)).alias("c")).select(*key, "name", "c.priority", "c.target")
    # a name of a package that does not resolve is external, not a file of the same name
    known = resolved.select(*key).union(imports.filter(F.col("specifier").startswith(".")).select(*key)).distinct()
    submodules = first_match(subs, targets, [*key, "name"], ["repo_id", "target"], keep=["target"]).join(by_shuffle(known), key, "left_semi").select("repo_id", "path", "target")
    return resolved, external, submodules


def used_names(imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """(repo_id, path, name) that files import from a file; ``*`` stands for everything."""
    names = F.when(F.col("is_namespace") | (F.col("kind") == "Require"), F.array(F.lit("*"))).otherwise(F.col("names.imported"))
    return imports.join(by_shuffle(resolved), ["repo_id", "path", "import_id"]).select("repo_id", F.col("target").alias("path"), F.explode(names).alias("name")).distinct()
