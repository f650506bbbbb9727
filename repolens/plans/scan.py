"""A scan: repositories to findings and a report, many repositories at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import paths
from repolens.operators import graph, health, post, resolve, rules
from repolens.operators.joins import prefix_owner
from repolens.operators.liveness import union_all
from repolens.sources import plugins as plugin_table
from repolens.sources import repositories as repos
from repolens.sources.config import Config
from repolens.session import by_shuffle, materialize, ship


@dataclass
class Scan:
    workspace: rules.Workspace
    findings: DataFrame
    suppressed: DataFrame  # findings that a suppression hid
    all_findings: DataFrame  # before configuration: what metrics and health are made from

    def metrics(self) -> DataFrame:
        return health.metrics(self.all_findings, self.workspace.files)

    def components(self) -> DataFrame:
        return health.components(self.all_findings, self.workspace.files)

    def health(self) -> DataFrame:
        return health.health(self.components(), self.workspace.files)

    def targets(self) -> DataFrame:
        return health.targets(self.all_findings, self.workspace.files)

    def scan_roots(self) -> DataFrame:
        """Files and entries of each package that has files."""
        return self.workspace.files.groupBy("repo_id", F.col("pkg_root").alias("root"), "package").agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("is_entry"), 1)).alias("entries")).orderBy("repo_id", "root")

    def package_graph(self, depth: int = 0, min_weight: int = 1, max_nodes: int = 40) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, weighted edges and cycle members of the coarse graph: by package, or by path segments below it."""
        f = self.workspace.files
        bucket = graph.bucket_of(F.col("path"), F.col("pkg_root"), depth)
        nodes = f.select("repo_id", F.col("path").alias("node"), bucket.alias("bucket"), (F.col("package") if depth == 0 else bucket).alias("label"))
        kept, heavy = graph.coarse_graph(nodes, self.workspace.edges, min_weight, max_nodes)
        return kept, heavy, graph.strong_components(heavy.select("repo_id", F.col("from").alias("src"), F.col("to").alias("dst")))


def build_packages(tree: DataFrame, files: DataFrame, config: Config) -> DataFrame:
    """Packages by manifest directory, a root one always, with what their plugins say."""
    m = repos.manifests(tree)
    order = {"PackageJson": 0, "PyProject": 1, "SetupPy": 2}
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("kind")), F.lit(9))
    own = m.filter("kind <> 'TsConfig'").groupBy("repo_id", F.col("dir").alias("root")).agg(F.min_by("kind", rank).alias("manifest_kind"), F.min_by("name", F.when(F.col("name").isNotNull(), rank)).alias("id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("dependencies")))).alias("dependencies"), F.array_distinct(F.flatten(F.collect_list("entries"))).alias("targets"))
    tops = tree.select("repo_id").distinct().select("repo_id", F.lit("").alias("root"))
    every = own.select("repo_id", "root").union(tops).distinct().join(by_shuffle(own), ["repo_id", "root"], "left")
    ts = m.filter("kind = 'TsConfig'").select("repo_id", F.col("dir").alias("root"), "base_url", "aliases")
    every = every.join(by_shuffle(ts), ["repo_id", "root"], "left")
    # names of the files right in each root, and whether it has a src directory
    names = tree.select("repo_id", paths.parent(F.col("path")).alias("root"), paths.base_name(F.col("path")).alias("name"))
    sources = tree.filter(F.col("path").rlike("(^|/)src/")).select("repo_id", F.regexp_replace(F.regexp_extract("path", "^(.*?)(?:^|/)src/", 0), "/?src/$", "").alias("root")).distinct().withColumn("src_layout", F.lit(True))
    every = every.join(by_shuffle(names.groupBy("repo_id", "root").agg(F.collect_set("name").alias("root_files"))), ["repo_id", "root"], "left").join(by_shuffle(sources), ["repo_id", "root"], "left")
    # an implicit package speaks the language of most of its files
    votes = prefix_owner(by_shuffle(files.select("repo_id", "path", "language")), by_shuffle(every.select("repo_id", "root", F.col("root").alias("pkg_root"))), F.col("path"), keep="pkg_root").groupBy("repo_id", F.col("pkg_root").alias("root")).agg(F.sum(F.when(F.col("language") == "Python", 1).otherwise(-1)).alias("vote"))
    every = every.join(by_shuffle(votes), ["repo_id", "root"], "left")
    language = F.when(F.col("manifest_kind") == "PackageJson", "TypeScript").when(F.col("manifest_kind").isin("PyProject", "SetupPy"), "Python").when(F.col("vote") > 0, "Python").otherwise("TypeScript")
    file = F.when(F.col("manifest_kind") == "PackageJson", "package.json").when(F.col("manifest_kind") == "PyProject", "pyproject.toml").when(F.col("manifest_kind") == "SetupPy", "setup.py")
    under = lambda name: F.when(F.col("root") == "", name).otherwise(F.concat_ws("/", "root", name))
    empty = F.array().cast("array<string>")
    shaped = every.select(
        "repo_id", "root", F.coalesce("id", F.when(F.col("root") == "", ".").otherwise(F.col("root"))).alias("id"), language.alias("language"), under(file).alias("manifest_path"), F.coalesce("dependencies", empty).alias("dependencies"), F.coalesce("targets", empty).alias("targets"), "base_url",
        F.coalesce("aliases", F.array().cast("array<struct<prefix:string,star:boolean,targets:array<string>>>")).alias("aliases"), F.coalesce("root_files", empty).alias("root_files"), F.when(F.col("src_layout"), F.array(under(F.lit("src")), F.col("root"))).otherwise(F.array("root")).alias("py_roots"),
    )
    extra = plugin_table.load(list(config.plugins))
    return plugin_table.with_plugins(shaped, plugin_table.registry(extra), list(config.entry_points))


def mark_entries(files: DataFrame, packages: DataFrame, facts: DataFrame) -> DataFrame:
    """files with is_entry and is_test: by plugin globs, manifest targets and route decorators."""
    p = packages.select("repo_id", F.col("root").alias("pkg_root"), F.col("id").alias("package"), F.col("language").alias("pkg_language"), "entry_pattern", "test_pattern", "route_decorators", "targets")
    # rows of one pattern stand together, so that it is compiled once
    f = files.join(by_shuffle(p), ["repo_id", "pkg_root"]).sortWithinPartitions("entry_pattern", "test_pattern")
    rel = F.when(F.col("pkg_root") == "", F.col("path")).otherwise(F.expr("substring(path, length(pkg_root) + 2)"))
    f = f.withColumn("is_test", F.regexp_like(rel, F.col("test_pattern"))).withColumn("by_glob", F.regexp_like(rel, F.col("entry_pattern")))
    # manifest targets, each the first of its spellings that exists
    t = p.select("repo_id", "pkg_root", "pkg_language", F.explode("targets").alias("t")).withColumn("at", paths.join_path(F.col("pkg_root"), F.col("t")))
    bare = F.regexp_replace("at", r"\.c?js$", "")
    module = paths.join_path(F.col("pkg_root"), F.replace("t", F.lit("."), F.lit("/")))
    in_src = paths.join_path(F.concat_ws("/", "pkg_root", F.lit("src")), F.replace("t", F.lit("."), F.lit("/")))
    spelt = F.when(F.col("pkg_language") == "Python", F.array(*[F.concat(b, F.lit(s)) for b in (module, in_src) for s in (".py", "/__main__.py")])).otherwise(F.array("at", *[F.concat(bare, F.lit(s)) for s in (".ts", ".tsx", ".mts")]))
    from repolens.operators.joins import first_match

    named = first_match(t.select("repo_id", "pkg_root", "t", F.posexplode(spelt).alias("priority", "path")), by_shuffle(files.select("repo_id", "path")), ["repo_id", "pkg_root", "t"], ["repo_id", "path"], keep=["path"]).select("repo_id", "path").distinct().withColumn("by_target", F.lit(True))
    routes = facts.select("repo_id", "path", F.explode("markers").alias("m")).filter("m.kind = 'Decorator'").select("repo_id", "path", F.substring_index("m.dotted", ".", -1).alias("tail"))
    routed = f.select("repo_id", "path", "route_decorators").join(by_shuffle(routes), ["repo_id", "path"]).filter(F.array_contains("route_decorators", F.col("tail"))).select("repo_id", "path").distinct().withColumn("by_route", F.lit(True))
    f = f.join(by_shuffle(named), ["repo_id", "path"], "left").join(by_shuffle(routed), ["repo_id", "path"], "left")
    entry = F.col("is_test") | F.col("by_glob") | F.coalesce("by_target", F.lit(False)) | F.coalesce("by_route", F.lit(False))
    return f.withColumn("is_entry", entry).drop("by_glob", "by_target", "by_route", "entry_pattern", "test_pattern", "route_decorators", "targets", "pkg_language")


def scan(tree: DataFrame, config: Config | None = None, cache: DataFrame | None = None, baseline: DataFrame | None = None) -> Scan:
    """Analyse the repositories of ``tree`` (repo_id, path, content).

    Facts are extracted once and written; every rule is a projection, semi- or anti-join over them, keyed by
    repository, so one job analyses thousands of repositories.
    """
    config = config or Config()
    ship(tree.sparkSession)
    kept = repos.walk(tree)
    sources = repos.source_files(kept)
    facts = materialize(repos.extract_facts(sources, cache), "facts")
    found = sources.select("repo_id", "path", "language", "role")
    packages = materialize(build_packages(kept, found, config), "packages")
    owned = prefix_owner(by_shuffle(found), by_shuffle(packages.select("repo_id", "root", F.col("root").alias("pkg_root"))), F.col("path"), keep="pkg_root")
    files = materialize(mark_entries(owned.join(by_shuffle(facts.select("repo_id", "path", "content_hash", "loc")), ["repo_id", "path"]), packages, facts), "files")
    imports = facts.select("repo_id", "path", F.posexplode("imports").alias("import_id", "i")).select("repo_id", "path", "import_id", "i.*").join(by_shuffle(files.select("repo_id", "path", "language", "role", "pkg_root")), ["repo_id", "path"]).withColumn("dir", paths.parent(F.col("path")))
    imports = materialize(imports, "imports")
    resolved, external, submodules = resolve.resolve_imports(imports, packages, files)
    resolved = materialize(resolved, "resolved")
    edges = resolved.select("repo_id", F.col("path").alias("src"), F.col("target").alias("dst")).union(submodules.select("repo_id", "path", "target"))
    edges = materialize(graph.distinct_edges(edges), "edges")
    used = materialize(resolve.used_names(imports, resolved), "used")
    seeds = files.filter("is_entry or role = 'Config'").select("repo_id", F.col("path").alias("node"), "is_test")
    seeds = union_all([seeds.select("repo_id", F.lit("all").alias("seed_class"), "node"), seeds.select("repo_id", F.when(F.col("is_test"), "test").otherwise("prod").alias("seed_class"), "node")])
    reached = graph.reachable(edges, seeds).groupBy("repo_id", F.col("node").alias("path")).agg(*[F.bool_or(F.col("seed_class") == k).alias(n) for k, n in (("all", "live"), ("prod", "prod"), ("test", "test"))])
    reach = materialize(reached, "reach")
    tokens = repos.token_streams(sources) if config.duplication else None
    w = rules.Workspace(files, packages, facts, imports, edges, used, external, reach, config, tokens)
    every = rules.run_all(w)
    if not config.complexity:
        every = every.filter(~F.col("rule").isin("high-complexity", "large-function"))
    every = materialize(every, "findings")
    f = post.drop_ignored(post.drop_off(post.override_severity(every, config.severities)), list(config.ignore))
    s = by_shuffle(w.each("suppressions", "t").select("repo_id", "path", "t.rule", "t.file_scoped", "t.line"))
    hidden, f = post.suppressed(f, s, "left_semi"), post.suppressed(f, s)
    extra = rules.missing_reasons(w)
    f = f.unionByName(extra) if extra is not None else f
    if baseline is not None:
        f = post.ratchet(f, baseline)
    return Scan(w, f, hidden, every)
