"""The rules: each takes a Workspace of tables and returns findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions import paths
from repolens.functions.globs import any_glob, first_match, matches_any
from repolens.functions.scoring import crap, round1
from repolens.operators import clones, graph, liveness
from repolens.operators.liveness import confidence, union_all
from repolens.session import by_shuffle

RULES: dict[str, Callable] = {}
WARN, ERROR = 1, 2

# What an effect consists of.
EFFECTS = {
    "network": ["fetch", "axios", "axios.*", "http", "https", "http.request", "https.request", "node:http", "node:https", "requests", "requests.*", "urllib", "urllib.*", "httpx", "httpx.*", "aiohttp", "aiohttp.*"],
    "process": ["child_process", "child_process.*", "node:child_process", "subprocess", "subprocess.*", "os.system", "os.popen"],
    "fs": ["fs", "fs.*", "node:fs", "shutil", "shutil.*", "os.remove", "os.rmdir"],
}


@dataclass(frozen=True)
class PolicyRule:
    id: str
    kind: str  # banned-import, banned-call or banned-effect
    patterns: tuple[str, ...]
    paths: tuple[str, ...] = ()
    severity: int = WARN
    hint: str = ""

    def globs(self) -> list[str]:
        return [g for p in self.patterns for g in EFFECTS.get(p, [p] if self.kind != "banned-effect" else [])]


@dataclass(frozen=True)
class Layer:
    name: str
    paths: tuple[str, ...]
    allow: tuple[str, ...] = ()


@dataclass
class Workspace:
    """Tables of a scan. facts: a nested row per file; the rest is derived from them."""

    files: DataFrame  # repo_id path language role package pkg_root is_entry is_test loc
    packages: DataFrame
    facts: DataFrame
    imports: DataFrame
    edges: DataFrame
    used: DataFrame
    external: DataFrame
    reach: DataFrame  # repo_id path live prod test
    config: object = None
    tokens: DataFrame | None = None
    cache: dict = field(default_factory=dict)

    def each(self, column: str, name: str = "x") -> DataFrame:
        return self.facts.select("repo_id", "path", F.explode(column).alias(name))

    def words(self) -> DataFrame:
        """Words inside string literals: names that may be used dynamically."""
        return self.facts.select("repo_id", F.explode("strings").alias("s")).select("repo_id", F.explode(F.split("s", r"[^\p{IsAlphabetic}\p{N}_]")).alias("name")).filter("name <> ''").distinct()

    def members(self) -> DataFrame:
        return self.facts.select("repo_id", F.explode("member_access").alias("name")).distinct()

    def dynamic(self) -> DataFrame:
        """Packages with an import that cannot be resolved."""
        marked = self.facts.filter(F.exists("markers", lambda m: m["kind"] == "UnresolvableDynamicImport")).select("repo_id", "path")
        return self.files.join(by_shuffle(marked), ["repo_id", "path"], "left_semi").select("repo_id", "pkg_root").distinct()

    def damped(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (with pkg_root) and a column ``damped``: the package imports dynamically, or a literal holds the name."""
        words = self.words().withColumnRenamed("name", name)
        both = flag(flag(rows, words, ["repo_id", name], "_word"), self.dynamic(), ["repo_id", "pkg_root"], "_dynamic")
        return both.withColumn("damped", F.col("_word") | F.col("_dynamic")).drop("_word", "_dynamic")


def absent(rows: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    return liveness.absent(rows, by_shuffle(used), on)


def flag(rows: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    return liveness.flag(rows, by_shuffle(keys), on, name)


def rule(*names: str):
    def register(run):
        for name in names:
            RULES[name] = run
        return run

    return register


def finding(name: Column | str, file: Column, message: Column, reason: Column | str, conf: Column | int = 2, severity: Column | int = WARN, symbol: Column | None = None, first: Column | int = 1, last: Column | int = 1, magnitude: Column | None = None) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        F.col("repo_id"), lit(name).alias("rule"), lit(severity).cast("int").alias("severity"), lit(conf).cast("int").alias("confidence"), (F.lit(None).cast("string") if symbol is None else symbol).alias("symbol"),
        file.alias("file"), lit(first).cast("int").alias("start_line"), lit(last).cast("int").alias("end_line"), message.alias("message"), lit(reason).alias("reason"), (F.lit(None).cast("double") if magnitude is None else magnitude.cast("double")).alias("magnitude"),
    ]


def symbol_id() -> Column:
    """``path::name``; members and parameters ``path::Parent.name@line``."""
    return F.when(F.col("s.parent").isNull(), F.concat_ws("::", "path", "s.name")).otherwise(F.concat(F.col("path"), F.lit("::"), F.col("s.parent"), F.lit("."), F.col("s.name"), F.lit("@"), F.col("s.start_line").cast("string")))


@rule("unused-file", "only-used-in-tests")
def dead_files(w: Workspace) -> DataFrame:
    seen = w.files.join(by_shuffle(w.reach), ["repo_id", "path"], "left").na.fill(False, ["live", "prod", "test"])
    name = paths.stem(F.col("path"))
    dead = w.damped(seen.filter("not live and not is_entry and role = 'Source'").withColumn("name", name), "name")
    a = dead.select(*finding("unused-file", F.col("path"), F.format_string("File '%s' is not reachable from any entry point.", "path"), "no entry point, configuration or test leads to this file", confidence(F.col("damped"))))
    # a package marker is alive if anything below its directory is
    alive = graph.ancestor_directories(seen.filter("live and role <> 'PackageInit'"))
    marker = seen.filter("not live and not is_entry and role = 'PackageInit'").withColumn("dir", paths.parent(F.col("path")))
    b = absent(marker, alive, ["repo_id", "dir"]).select(*finding("unused-file", F.col("path"), F.format_string("Package '%s' holds no reachable module.", "dir"), "nothing below this directory is reachable", 0))
    c = seen.filter("live and not prod and not is_test and role = 'Source'").select(*finding("only-used-in-tests", F.col("path"), F.format_string("File '%s' is only reached from tests.", "path"), "no production entry point leads to this file"))
    return union_all([a, b, c])


@rule("unused-export", "unused-type", "expected-unused-but-used")
def exports(w: Workspace) -> DataFrame:
    own = w.files.join(by_shuffle(w.reach.select("repo_id", "path", "live")), ["repo_id", "path"], "left")
    s = w.each("symbols", "s").filter("s.exported and s.kind not in ('EnumMember', 'Field', 'Parameter')").join(by_shuffle(own), ["repo_id", "path"]).withColumn("name", F.col("s.name"))
    s = s.filter("s.visibility is null or s.visibility <> 'Public'")
    named = w.used.filter("name <> '*'")
    if not w.config.strict_parity:  # importing the default uses what the default stands for
        behind = w.each("exports", "e").filter("e.kind = 'Default' and e.source is not null").select("repo_id", "path", F.col("e.source").alias("name"))
        named = named.unionByName(behind.join(by_shuffle(w.used.filter("name = 'default'")), ["repo_id", "path"], "left_semi"))
    s = flag(s, named, ["repo_id", "path", "name"], "by_name")
    s = flag(s, w.used.filter("name = '*'"), ["repo_id", "path"], "by_star").withColumn("used", F.col("by_name") | F.col("by_star"))
    stale = s.filter("s.visibility = 'ExpectedUnused' and used").select(*finding("expected-unused-but-used", F.col("path"), F.format_string("'%s' is tagged as unused but is imported.", "name"), "drop the tag", symbol=symbol_id(), first=F.col("s.start_line"), last=F.col("s.end_line")))
    handlers = w.each("markers", "m").filter("m.kind = 'Decorator' and m.on_symbol is not null").join(by_shuffle(w.files.select("repo_id", "path", "pkg_root")), ["repo_id", "path"]).join(by_shuffle(w.packages.select("repo_id", F.col("root").alias("pkg_root"), "route_decorators")), ["repo_id", "pkg_root"])
    handlers = handlers.filter(F.array_contains("route_decorators", F.substring_index("m.dotted", ".", -1))).select("repo_id", "path", F.col("m.on_symbol").alias("name"))
    rest = s.filter("(s.visibility is null or s.visibility <> 'ExpectedUnused') and live and (not is_entry or s.visibility = 'Internal') and role = 'Source' and not used")
    rest = absent(rest, handlers, ["repo_id", "path", "name"])
    often = w.each("refs", "name").groupBy("repo_id", "path", "name").count().filter("count >= 2")
    rest = w.damped(flag(rest, often, ["repo_id", "path", "name"], "repeated"), "name")
    word = F.when(F.col("s.kind") == "Type", "unused-type").otherwise("unused-export")
    reason = F.when(F.col("repeated"), "no other file imports it, though its own file uses it").otherwise("no file imports it")
    found = rest.select(*finding(word, F.col("path"), F.format_string("%s '%s' is exported but never imported.", F.lower("s.kind"), "name"), reason, confidence(F.col("damped"), F.col("repeated")), symbol=symbol_id(), first=F.col("s.start_line"), last=F.col("s.end_line")))
    return found.unionByName(stale)


@rule("unused-enum-member", "unused-class-member", "unused-parameter")
def symbols(w: Workspace) -> DataFrame:
    live = w.files.join(by_shuffle(w.reach.filter("live")), ["repo_id", "path"], "left_semi").filter("role = 'Source' and not is_test")
    s = w.each("symbols", "s").filter("s.kind in ('EnumMember', 'Method', 'Field', 'Parameter') and (s.visibility is null or s.visibility <> 'Public')").join(by_shuffle(live), ["repo_id", "path"]).withColumn("name", F.col("s.name"))
    owned = F.concat_ws(".", "s.parent", "name")
    p = s.filter("s.kind = 'Parameter'").select(*finding("unused-parameter", F.col("path"), F.format_string("Parameter '%s' is never used.", owned), "the body does not name it", symbol=symbol_id(), first=F.col("s.start_line"), last=F.col("s.end_line")))
    m = w.damped(absent(s.filter("s.kind <> 'Parameter'"), w.members(), ["repo_id", "name"]), "name")
    word = F.when(F.col("s.kind") == "EnumMember", "unused-enum-member").otherwise("unused-class-member")
    return p.unionByName(m.select(*finding(word, F.col("path"), F.format_string("%s '%s' is never accessed.", F.lower("s.kind"), owned), "no file accesses a member of this name", confidence(F.col("damped")), symbol=symbol_id(), first=F.col("s.start_line"), last=F.col("s.end_line"))))


@rule("unused-import")
def unused_imports(w: Workspace) -> DataFrame:
    i = w.imports.filter("not is_reexport and role <> 'PackageInit'").select("repo_id", "path", "specifier", "kind", "start_line", "end_line", F.explode("names.local").alias("name"))
    if not w.config.strict_parity:  # require() and import() bind no name of their own
        i = i.filter("kind = 'Static' or name <> 'default'")
    refs = w.each("refs", "name")
    return absent(i, refs, ["repo_id", "path", "name"]).select(*finding("unused-import", F.col("path"), F.format_string("Import '%s' from '%s' is never used.", "name", "specifier"), "the file does not refer to it", first=F.col("start_line"), last=F.col("end_line"), symbol=None))


@rule("unused-dependency")
def dependencies(w: Workspace) -> DataFrame:
    d = w.packages.filter("manifest_path is not null").select("repo_id", "manifest_path", "framework_deps", F.explode("dependencies").alias("dep")).filter(~F.array_contains("framework_deps", F.col("dep")) & (F.col("dep") != "@types/node"))
    d = d.withColumn("stub", F.when(F.col("dep").startswith("@types/"), F.expr("substring(dep, 8)")))
    left = absent(absent(d, w.external, ["repo_id", "dep"]), w.external.withColumnRenamed("dep", "stub"), ["repo_id", "stub"])
    return left.select(*finding("unused-dependency", F.col("manifest_path"), F.format_string("Dependency '%s' is declared but never imported.", "dep"), "no import resolves to it", 1))


@rule("circular-imports")
def cycles(w: Workspace) -> DataFrame:
    parts = graph.strong_components(w.edges).join(by_shuffle(w.files.select("repo_id", F.col("path").alias("node"), "language")), ["repo_id", "node"])
    g = parts.groupBy("repo_id", "comp").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.split("node", "/").alias("k"), "node"))).alias("m"), F.bool_and(F.col("language") == "Python").alias("py"))
    message = F.format_string("Circular import group (%d files): %s", "n", F.array_join("m.node", " ⇄ "))
    return g.select(*finding("circular-imports", F.col("comp"), message, "these files import each other", severity=F.when(F.col("py"), ERROR).otherwise(WARN), magnitude=F.col("n")))


@rule("high-complexity", "large-function")
def complexity(w: Workspace) -> DataFrame:
    c = w.config
    tests = w.files.filter("is_test").select("repo_id", "path")
    reach = w.reach.filter("test").select("repo_id", F.lit("test").alias("seed_class"), F.col("path").alias("node"))
    covered = graph.test_coverage(w.files, w.edges, reach, tests)
    f = w.each("functions", "s").join(by_shuffle(covered), ["repo_id", "path"]).withColumn("crap", round1(crap(F.col("s.cyclomatic"), F.col("coverage"))))
    limits = F.lit(None)
    for o in reversed(c.complexity_overrides):  # the first that matches counts
        limits = F.when(matches_any(F.col("path"), list(o.paths)), F.struct(F.lit(o.max_cyclomatic).alias("cyc"), F.lit(o.max_cognitive).alias("cog"), F.lit(o.max_loc).alias("loc"), F.lit(float(o.max_crap)).alias("crap"), F.lit(o.severity).alias("sev"))).otherwise(limits)
    base = F.struct(F.lit(c.max_cyclomatic).alias("cyc"), F.lit(c.max_cognitive).alias("cog"), F.lit(c.max_loc).alias("loc"), F.lit(float(c.max_crap)).alias("crap"), F.lit(WARN).alias("sev"))
    f = f.withColumn("l", F.coalesce(limits, base) if c.complexity_overrides else base)
    sid = F.concat(F.col("path"), F.lit("::"), F.coalesce(F.concat("s.parent", F.lit(".")), F.lit("")), F.col("s.name"), F.lit("@"), F.col("s.start_line").cast("string"))
    over = F.array_compact(F.array(F.when(F.expr("s.cyclomatic > l.cyc"), F.format_string("cyclomatic %d > %d", "s.cyclomatic", "l.cyc")), F.when(F.expr("s.cognitive > l.cog"), F.format_string("cognitive %d > %d", "s.cognitive", "l.cog")), F.when(F.expr("crap >= l.crap"), F.format_string("CRAP %.1f >= %.1f", "crap", "l.crap"))))
    encoded = F.format_string("metrics:cyclomatic=%d,cognitive=%d,loc=%d,crap=%.1f,coverage=%.0f", "s.cyclomatic", "s.cognitive", "s.loc", "crap", "coverage")
    high = f.filter(F.size(over) > 0).select(*finding("high-complexity", F.col("path"), F.format_string("Function '%s' is too complex: %s.", "s.name", F.array_join(over, ", ")), encoded, severity=F.col("l.sev"), symbol=sid, first=F.col("s.start_line"), last=F.col("s.end_line"), magnitude=F.col("crap")))
    large = f.filter("s.loc > l.loc").select(*finding("large-function", F.col("path"), F.format_string("Function '%s' has %d lines (limit %d).", "s.name", "s.loc", "l.loc"), "long functions are hard to review", severity=F.col("l.sev"), symbol=sid, first=F.col("s.start_line"), last=F.col("s.end_line")))
    return high.unionByName(large)


@rule("banned-import", "banned-call", "banned-effect")
def policy(w: Workspace) -> DataFrame | None:
    found = []
    imports = w.imports.select("repo_id", "path", F.col("specifier").alias("what"), "start_line", "end_line", F.lit("import of").alias("how"))
    calls = w.each("calls", "c").select("repo_id", "path", F.col("c.callee").alias("what"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"), F.lit("call to").alias("how"))
    for p in w.config.policy:
        rows = {"banned-import": imports, "banned-call": calls, "banned-effect": imports.unionByName(calls)}[p.kind]
        hit = rows.filter(F.col("what").rlike(any_glob(p.globs())))
        hit = hit.filter(matches_any(F.col("path"), list(p.paths))) if p.paths else hit
        text = F.concat(F.lit(f"Policy '{p.id}' forbids this "), F.col("how"), F.lit(" '"), F.col("what"), F.lit("'." + (" " + p.hint if p.hint else "")))
        found.append(hit.select(*finding(p.kind, F.col("path"), text, f"policy {p.id}", severity=p.severity, first=F.col("start_line"), last=F.col("end_line"))))
    return union_all(found) if found else None


@rule("boundary-violation")
def boundaries(w: Workspace) -> DataFrame | None:
    layers = w.config.layers
    if not layers:
        return None
    of = lambda c: first_match(c, [(x.name, list(x.paths)) for x in layers])
    e = w.edges.withColumn("a", of(F.col("src"))).withColumn("b", of(F.col("dst"))).filter("a <> b")
    allowed = [F.lit(f"{x.name}>{y}") for x in layers for y in x.allow]
    e = e.filter(~F.concat_ws(">", "a", "b").isin(*allowed)) if allowed else e
    return e.select(*finding("boundary-violation", F.col("src"), F.format_string("Layer '%s' may not import layer '%s': %s -> %s.", "a", "b", "src", "dst"), F.format_string("target %s is in a layer that '%s' does not allow", "dst", "a"), severity=ERROR))


@rule("duplicate-code")
def duplicates(w: Workspace) -> DataFrame | None:
    c = w.config
    if not c.duplication or w.tokens is None:
        return None
    g = clones.clone_groups(w.tokens, c.min_tokens, c.duplication_mode, c.skip_local)
    at = lambda m: F.concat(m["path"], F.lit(":"), m["start_line"].cast("string"))
    one = F.element_at(F.array_sort(F.transform("members", lambda m: F.struct(F.split(m["path"], "/").alias("k"), m["start_line"].alias("l"), m.alias("m")))), 1)["m"]
    g = g.withColumn("p", one)
    others = F.array_join(F.transform(F.filter("members", lambda m: at(m) != at(F.col("p"))), at), ", ")
    return g.select(*finding("duplicate-code", F.col("p.path"), F.format_string("%d tokens repeated at %d places, also %s.", "length", F.size("members"), others), f"mode {c.duplication_mode}", 2 if c.duplication_mode in ("exact", "mild") else 1, symbol=F.concat(F.lit("dup:"), "fingerprint"), first=F.col("p.start_line"), last=F.col("p.end_line")))


@rule("unused-css-token", "broken-css-reference", "unused-css-class")
def style(w: Workspace) -> DataFrame | None:
    if not w.config.style:
        return None
    declared, refs = w.each("css_tokens", "t").withColumn("name", F.col("t.name")), w.each("css_var_refs", "name")
    inside = w.facts.select("repo_id", F.explode("strings").alias("s")).select("repo_id", F.explode(F.regexp_extract_all("s", F.lit(r"var\(\s*(--[^,)]*)"), 1)).alias("name")).select("repo_id", F.trim("name").alias("name"))
    a = absent(declared, refs.select("repo_id", "name").union(inside), ["repo_id", "name"]).select(*finding("unused-css-token", F.col("path"), F.format_string("Custom property '%s' is never used.", "name"), "no var() refers to it", first=F.col("t.start_line"), last=F.col("t.end_line")))
    b = absent(refs, declared, ["repo_id", "name"]).select(*finding("broken-css-reference", F.col("path"), F.format_string("Custom property '%s' is not declared.", "name"), "no stylesheet declares it"))
    used = w.each("css_class_refs", "name")
    c = absent(w.each("css_classes", "t").withColumn("name", F.col("t.name")), used, ["repo_id", "name"]).select(*finding("unused-css-class", F.col("path"), F.format_string("Class '%s' is never used.", "name"), "no markup refers to it", 1, first=F.col("t.start_line"), last=F.col("t.end_line")))
    return union_all([a, b, c])


def missing_reasons(w: Workspace) -> DataFrame | None:
    """Suppressions and expected-unused tags without a reason; added after filtering, so nothing suppresses them."""
    level = w.config.require_reason
    if not level:
        return None
    s = w.each("suppressions", "t").filter("t.reason is null or t.reason = ''").select("repo_id", "path", F.col("t.line").alias("line"), F.concat(F.lit("Suppression of '"), F.col("t.rule"), F.lit("' gives no reason.")).alias("text"))
    a = w.each("annotations", "t").filter("t.visibility = 'ExpectedUnused' and t.reason is null").select("repo_id", "path", F.col("t.line").alias("line"), F.lit("Tag @expected-unused gives no reason.").alias("text"))
    return s.unionByName(a).select(*finding("missing-suppression-reason", F.col("path"), F.col("text"), "the configuration asks for a reason", severity=level, first=F.col("line"), last=F.col("line")))


def run_all(w: Workspace) -> DataFrame:
    """Findings of every rule, in no order."""
    frames = [f for run in dict.fromkeys(RULES.values()) if (f := run(w)) is not None]
    return union_all(frames)
