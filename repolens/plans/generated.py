"""Source repositories made from the ``part`` table by arithmetic on its keys, so that SQL can say what a scan must find.

Part k of size s is module j = k % 50 of repository k // 50. Module j lies in one of four layers and imports module
j // 3; sizes decide what else it holds (unused imports, cycles, tags, complexity, styles). Every fifth module is also a
Python file. All parts take part, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.operators import post, sinks
from repolens.plans.scan import Scan, scan
from repolens.session import by_shuffle
from repolens.sources.config import parse

PER_REPOSITORY = 50

CONFIG = """
[rules]
unused-type = "error"
require-suppression-reason = "warn"
[ignore]
paths = ["src/ui/m?.ts"]
[entry_points]
add = ["src/entry/*"]
[complexity]
max-cyclomatic = 4
max-cognitive = 8
max-loc = 9
max-crap = 20
[style]
enabled = true
[boundaries]
preset = "layered"
[[policy.rule]]
id = "no-dep1"
kind = "banned-import"
specifiers = ["dep1/*"]
severity = "error"
[[policy.rule]]
id = "no-f7"
kind = "banned-call"
callees = ["f7"]
[[policy.rule]]
id = "no-network"
kind = "banned-effect"
effects = ["network"]
paths = ["src/domain/**", "src/app/**"]
"""


def _text(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{{")
        parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}}")
        parts.append(values[name].cast("string"))
    return F.concat(*parts)


def module_path(j: Column) -> Column:
    layer = F.get(F.array(*[F.lit(x) for x in ("domain", "app", "infra", "ui")]), (j % 4).cast("int"))
    return F.concat(layer, F.lit("/m"), j.cast("string"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, path, content) of all repositories."""
    part = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("s"))
    n, j, s = F.expr(f"k div {PER_REPOSITORY}"), F.col("k") % PER_REPOSITORY, F.col("s")
    p = part.select(F.concat(F.lit("g"), n.cast("string")).alias("repo_id"), n.alias("n"), j.alias("j"), "s")
    j, b = F.col("j"), F.expr("j div 3")
    here, there = module_path(j), module_path(b)
    line = lambda test, text: F.when(test, F.concat(text, F.lit("\n"))).otherwise("")
    # children that their parent imports in turn
    child = p.filter("s <= 2 and j > 0").select("repo_id", b.alias("j"), F.struct(j.alias("c"), here.alias("at")).alias("x")).groupBy("repo_id", "j").agg(F.sort_array(F.collect_list("x")).alias("children"))
    m = p.join(by_shuffle(child), ["repo_id", "j"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<struct<c:bigint,at:string>>")))
    each = lambda text: F.array_join(F.transform("children", text), "")
    even, deep = s % 2 == 0, (s % 6).cast("int")
    nested = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda i: F.concat(F.lit("if (a > "), i.cast("string"), F.lit(") { "))), ""), F.lit("a = a + 1;"), F.repeat(F.lit(" }"), deep))
    code = F.concat(
        line((s % 13 == 5) & even, F.lit("// tool-ignore-file unused-export")),
        line((s % 13 == 5) & ~even, F.lit("// tool-ignore-file unused-export -- made by rule")),
        line(j > 0, _text('import { f{{b}} } from "../{{there}}";', b=b, there=there)),
        each(lambda x: F.concat(F.lit("import { f"), x["c"].cast("string"), F.lit(' } from "../'), x["at"], F.lit('";\n'))),
        line(s % 7 == 3, _text('import { z } from "dep{{d}}/sub";', d=j % 10)),
        line((s % 17 == 0) & even, F.lit("// @expected-unused")),
        line((s % 17 == 0) & ~even, F.lit("// @expected-unused -- kept")),
        line(F.lit(True), _text("export function f{{j}}(a{{more}}) {", j=j, more=F.when(s % 9 == 4, ", b").otherwise(""))),
        line(even & (j > 0), _text("  f{{b}}(a);", b=b)),
        each(lambda x: F.concat(F.lit("  f"), x["c"].cast("string"), F.lit("(a);\n"))),
        line((s % 7 == 3) & even, F.lit("  z(a);")),
        line(s % 11 == 0, F.lit('  fetch("u");')),
        line(deep > 0, F.concat(F.lit("  "), nested)),
        F.repeat(F.lit("  a = a + 1;\n"), (s % 8).cast("int")),
        F.lit("  return a;\n}\n"),
        line(s % 19 == 0, F.lit("// @public")),
        line(F.lit(True), _text("export const k{{j}} = 1;", j=j)),
        line(s % 5 == 0, _text("export type T{{j}} = number;", j=j)),
        line(s % 5 == 1, _text("enum E{{j}} { A{{j}}, B{{j}} }\nE{{j}}.A{{j}};", j=j)),
        line(s % 5 == 2, _text("class C{{j}} { private p{{j}}() { return 1; } }\nnew C{{j}}();", j=j)),
    )
    row = lambda path, text: (F.col("repo_id"), path.alias("path"), text.alias("content"))
    modules = m.select(*row(F.concat(F.lit("src/"), here, F.lit(".ts")), code))
    uses = _text('import { f{{j}} } from "../{{here}}";\nf{{j}}(1);\n', j=j, here=here)
    entries = p.filter("s = 50").select(*row(_text("src/entry/e{{j}}.ts", j=j), uses))
    tests = p.filter("s = 49").select(*row(_text("src/tests/t{{j}}.test.ts", j=j), uses))
    # one style sheet and its markup a repository
    rule = _text(".c{{j}} { --t{{j}}: 1px; color: var(--t{{w}}); }\n", j=j, w=j * 2)
    styles = p.groupBy("repo_id", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(j.alias("j"), rule.alias("text")))), lambda x: x["text"]), "").alias("css"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(even, j))), lambda x: F.concat(F.lit("c"), x.cast("string"))), " ").alias("names"))
    css = styles.select(*row(F.lit("src/theme.css"), F.col("css")))
    markup = styles.select(*row(F.lit("src/entry/view.tsx"), _text('import "../theme.css";\nexport const v = <p className="{{names}}"/>;\n', names=F.col("names"))))
    depends = ", ".join(f'"dep{i}": "1"' for i in range(10))
    manifest = styles.select(*row(F.lit("package.json"), _text('{"name": "g{{n}}", "dependencies": {' + depends + "}}", n=F.col("n"))))
    project = styles.select(*row(F.lit("py/pyproject.toml"), _text('[project]\nname = "pyg{{n}}"\ndependencies = ["requests>=2", "numpy"]\n[project.scripts]\nrun = "pk.p0:main"\n', n=F.col("n"))))
    marker = styles.select(*row(F.lit("py/pk/__init__.py"), F.lit("")))
    script = F.concat(
        line(s % 3 == 0, F.lit("import requests")),
        line(j < 45, _text("from .p{{w}} import v{{w}}", w=j + 5)),
        line((s <= 4) & (j >= 5), _text("from .p{{w}} import v{{w}}", w=j - 5)),
        line(F.lit(True), _text("\n\ndef v{{j}}(x):\n    return x\n", j=j)),
        line((s % 3 == 0) & even, F.lit("\nrequests.get(1)")),
        line(even & (j < 45), _text("v{{w}}(1)", w=j + 5)),
        line((s <= 4) & (j >= 5), _text("v{{w}}(2)", w=j - 5)),
    )
    scripts = p.filter("j % 5 = 0").select(*row(_text("py/pk/p{{j}}.py", j=j), script))
    out = modules
    for more in (entries, tests, css, markup, manifest, project, marker, scripts):
        out = out.unionByName(more)
    return out.withColumn("content", F.encode("content", "UTF-8"))


_scans: dict[tuple[str, str], Scan] = {}


def scanned(spark: SparkSession, sf_dir: str) -> Scan:
    """The scan of all generated repositories; one for all queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _scans:
        _scans[key] = scan(tree(spark, sf_dir), parse(CONFIG))
    return _scans[key]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        SQL[run.__name__] = sql
        return run

    return register


# The same repositories in SQL: modules with the lines their parts are on, the import graph, and what is reached.
MODULES = """p AS (SELECT 'g' || (p_partkey // 50) AS repo_id, p_partkey % 50 AS j, p_size AS s, p_size % 2 = 0 AS even FROM part),
kids AS (SELECT repo_id, j // 3 AS j, count(*) AS kids FROM p WHERE s <= 2 AND j > 0 GROUP BY ALL),
m0 AS (SELECT p.*, j // 3 AS b, ['domain', 'app', 'infra', 'ui'][j % 4 + 1] AS layer, coalesce(kids, 0) AS kids FROM p LEFT JOIN kids USING (repo_id, j)),
m AS (SELECT *, 'src/' || layer || '/m' || j || '.ts' AS path, CAST(s % 13 = 5 AS INT) + CAST(j > 0 AS INT) + kids AS top, top + CAST(s % 7 = 3 AS INT) + CAST(s % 17 = 0 AS INT) + 1 AS line,
  CAST(even AND j > 0 AS INT) + kids + CAST(s % 7 = 3 AND even AS INT) AS calls, s % 6 AS deep, 3 + calls + CAST(s % 11 = 0 AS INT) + CAST(deep > 0 AS INT) + s % 8 AS loc FROM m0),
py AS (SELECT *, 'py/pk/p' || j || '.py' AS path FROM p WHERE j % 5 = 0)"""
EDGES = MODULES + """,
up AS (SELECT a.repo_id, a.j, a.s, a.path AS src, q.path AS dst FROM m a JOIN m q ON q.repo_id = a.repo_id AND q.j = a.b WHERE a.j > 0),
e AS (SELECT repo_id, src, dst FROM up UNION SELECT repo_id, dst, src FROM up WHERE s <= 2 UNION SELECT repo_id, 'src/entry/e' || j || '.ts', path FROM m WHERE s = 50 UNION SELECT repo_id, 'src/tests/t' || j || '.test.ts', path FROM m WHERE s = 49
  UNION SELECT repo_id, 'src/entry/view.tsx', 'src/theme.css' FROM p UNION SELECT a.repo_id, a.path, q.path FROM py a JOIN py q ON q.repo_id = a.repo_id AND (q.j = a.j + 5 OR q.j = a.j - 5 AND a.s <= 4))"""
REACH = EDGES + """,
seeds AS (SELECT DISTINCT repo_id, src AS path, starts_with(src, 'src/tests/') AS test FROM e WHERE starts_with(src, 'src/entry/') OR starts_with(src, 'src/tests/') UNION SELECT repo_id, path, FALSE FROM py WHERE j = 0),
r AS (SELECT repo_id, path, test FROM seeds UNION SELECT r.repo_id, e.dst, r.test FROM r JOIN e ON e.repo_id = r.repo_id AND e.src = r.path),
live AS (SELECT repo_id, path, bool_or(NOT test) AS prod, bool_or(test) AS test FROM r GROUP BY ALL),
used AS (SELECT repo_id, b AS j FROM m WHERE j > 0 UNION SELECT m.repo_id, m.j FROM m JOIN m q ON q.repo_id = m.repo_id AND q.j = m.b WHERE m.s <= 2 AND m.j > 0 UNION SELECT repo_id, j FROM m WHERE s >= 49)"""
SHOWN = "NOT regexp_matches(file, '^src/ui/m.\\.ts$')"


def findings(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return scanned(spark, sf_dir).findings.filter(F.col("rule").isin(*names))


@query(f"""WITH RECURSIVE {REACH}, f AS (
SELECT repo_id, 'unused-file' AS rule, 2 AS confidence, path AS file, 'File ''' || path || ''' is not reachable from any entry point.' AS message FROM (SELECT repo_id, path FROM m UNION ALL SELECT repo_id, path FROM py) x WHERE (repo_id, path) NOT IN (SELECT repo_id, path FROM live)
UNION ALL SELECT repo_id, 'only-used-in-tests', 2, path, 'File ''' || path || ''' is only reached from tests.' FROM live WHERE NOT prod AND NOT starts_with(path, 'src/tests/')
UNION ALL SELECT DISTINCT repo_id, 'unused-file', 0, 'py/pk/__init__.py', 'Package ''py/pk'' holds no reachable module.' FROM p WHERE repo_id NOT IN (SELECT repo_id FROM live WHERE starts_with(path, 'py/pk/')))
SELECT * FROM f WHERE {SHOWN}""")
def scan_dead_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, and packages, that nothing or only a test leads to."""
    return findings(spark, sf_dir, "unused-file", "only-used-in-tests").select("repo_id", "rule", "confidence", "file", "message")


EXPORTS = f"""x AS (SELECT m.*, 'f' || j AS name, 'function' AS kind, line AS spot, line + loc - 1 AS until FROM m WHERE s % 17 <> 0 AND (repo_id, j) NOT IN (SELECT repo_id, j FROM used)
UNION ALL SELECT *, 'k' || j, 'variable', line + loc + CAST(s % 19 = 0 AS INT), line + loc + CAST(s % 19 = 0 AS INT) FROM m WHERE s % 19 <> 0
UNION ALL SELECT *, 'T' || j, 'type', line + loc + CAST(s % 19 = 0 AS INT) + 1, line + loc + CAST(s % 19 = 0 AS INT) + 1 FROM m WHERE s % 5 = 0),
f AS (SELECT repo_id, CASE kind WHEN 'type' THEN 'unused-type' ELSE 'unused-export' END AS rule, CASE kind WHEN 'type' THEN 2 ELSE 1 END AS severity, path || '::' || name AS symbol, path AS file, CAST(spot AS INT) AS start_line, CAST(until AS INT) AS end_line,
  kind || ' ''' || name || ''' is exported but never imported.' AS message, s FROM x WHERE (repo_id, path) IN (SELECT repo_id, path FROM live))"""


@query(f"WITH RECURSIVE {REACH}, {EXPORTS} SELECT * EXCLUDE (s) FROM f WHERE {SHOWN} AND NOT (s % 13 = 5 AND rule = 'unused-export')")
def scan_unused_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports and types that no file imports, less those that a comment suppresses."""
    return findings(spark, sf_dir, "unused-export", "unused-type").select("repo_id", "rule", "severity", "symbol", "file", "start_line", "end_line", "message")


@query(f"WITH RECURSIVE {REACH}, {EXPORTS} SELECT repo_id, rule, symbol FROM f WHERE {SHOWN} AND s % 13 = 5 AND rule = 'unused-export'")
def scan_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the suppressions of a file hid."""
    return scanned(spark, sf_dir).suppressed.select("repo_id", "rule", "symbol")


@query(f"""WITH RECURSIVE {REACH}, f AS (
SELECT repo_id, 'expected-unused-but-used' AS rule, path AS file, CAST(line AS INT) AS start_line, '''f' || j || ''' is tagged as unused but is imported.' AS message FROM m WHERE s % 17 = 0 AND (repo_id, j) IN (SELECT repo_id, j FROM used))
SELECT * FROM f WHERE {SHOWN} UNION ALL SELECT repo_id, 'missing-suppression-reason', path, CAST(1 AS INT), 'Suppression of ''unused-export'' gives no reason.' FROM m WHERE s % 13 = 5 AND even
UNION ALL SELECT repo_id, 'missing-suppression-reason', path, CAST(line AS INT), 'Tag @expected-unused gives no reason.' FROM m WHERE s % 17 = 0 AND even""")
def scan_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale tags, and tags and suppressions without a reason."""
    return findings(spark, sf_dir, "expected-unused-but-used", "missing-suppression-reason").select("repo_id", "rule", "file", "start_line", "message")


@query(f"""WITH RECURSIVE {REACH}, x AS (SELECT m.*, line + loc + CAST(s % 19 = 0 AS INT) AS after FROM m WHERE (repo_id, path) IN (SELECT repo_id, path FROM live)),
f AS (SELECT repo_id, 'unused-enum-member' AS rule, path AS file, path || '::E' || j || '.B' || j || '@' || (after + 1) AS symbol, 'enummember ''E' || j || '.B' || j || ''' is never accessed.' AS message FROM x WHERE s % 5 = 1
UNION ALL SELECT repo_id, 'unused-class-member', path, path || '::C' || j || '.p' || j || '@' || (after + 1), 'method ''C' || j || '.p' || j || ''' is never accessed.' FROM x WHERE s % 5 = 2
UNION ALL SELECT repo_id, 'unused-parameter', path, path || '::f' || j || '.b@' || line, 'Parameter ''f' || j || '.b'' is never used.' FROM x WHERE s % 9 = 4)
SELECT * FROM f WHERE {SHOWN}""")
def scan_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and parameters that nothing uses."""
    return findings(spark, sf_dir, "unused-enum-member", "unused-class-member", "unused-parameter").select("repo_id", "rule", "file", "symbol", "message")


@query(f"""WITH {MODULES}, i AS (
SELECT repo_id, path AS file, 'f' || b AS name, '../' || ['domain', 'app', 'infra', 'ui'][b % 4 + 1] || '/m' || b AS spec, CAST(s % 13 = 5 AS INT) + 1 AS spot FROM m WHERE j > 0 AND NOT even
UNION ALL SELECT repo_id, path, 'z', 'dep' || (j % 10) || '/sub', top + 1 FROM m WHERE s % 7 = 3 AND NOT even
UNION ALL SELECT repo_id, path, 'requests', 'requests', 1 FROM py WHERE s % 3 = 0 AND NOT even
UNION ALL SELECT repo_id, path, 'v' || (j + 5), '.p' || (j + 5), 1 + CAST(s % 3 = 0 AS INT) FROM py WHERE j < 45 AND NOT even)
SELECT repo_id, file, CAST(spot AS INT) AS start_line, 'Import ''' || name || ''' from ''' || spec || ''' is never used.' AS message FROM i WHERE {SHOWN}""")
def scan_unused_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported names that their file does not use."""
    return findings(spark, sf_dir, "unused-import").select("repo_id", "file", "start_line", "message")


@query(f"""WITH {MODULES}, i AS (SELECT repo_id, path AS file FROM m WHERE j > 0 AND NOT even UNION ALL SELECT repo_id, path FROM m WHERE s % 7 = 3 AND NOT even UNION ALL SELECT repo_id, path FROM py WHERE s % 3 = 0 AND NOT even UNION ALL SELECT repo_id, path FROM py WHERE j < 45 AND NOT even)
SELECT repo_id, CASE WHEN starts_with(file, 'py/') THEN 'pyg' ELSE 'g' END || substring(repo_id, 2) AS package, count(*) AS n FROM i WHERE {SHOWN} GROUP BY ALL""")
def scan_findings_by_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unused imports counted by the package that owns the file."""
    found = sinks.by_package(findings(spark, sf_dir, "unused-import"), scanned(spark, sf_dir).scan_roots())
    return found.groupBy("repo_id", "package").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {MODULES}, r AS (SELECT DISTINCT repo_id FROM p), d AS (
SELECT repo_id, 'package.json' AS file, 'dep' || i AS dep FROM r, range(10) t(i) WHERE (repo_id, i) NOT IN (SELECT repo_id, j % 10 FROM m WHERE s % 7 = 3)
UNION ALL SELECT repo_id, 'py/pyproject.toml', 'numpy' FROM r UNION ALL SELECT repo_id, 'py/pyproject.toml', 'requests' FROM r WHERE repo_id NOT IN (SELECT repo_id FROM py WHERE s % 3 = 0))
SELECT repo_id, file, 1 AS confidence, 'Dependency ''' || dep || ''' is declared but never imported.' AS message FROM d""")
def scan_unused_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of both kinds of manifest that no import stands for."""
    return findings(spark, sf_dir, "unused-dependency").select("repo_id", "file", "confidence", "message")


@query(f"""WITH RECURSIVE {EDGES}, c AS (SELECT repo_id, src AS a, dst AS b FROM e UNION SELECT c.repo_id, c.a, e.dst FROM c JOIN e ON e.repo_id = c.repo_id AND e.src = c.b),
w AS (SELECT x.repo_id, x.a, list_sort(list(string_split(x.b, '/'))) AS g FROM c x JOIN c y ON x.repo_id = y.repo_id AND x.a = y.b AND x.b = y.a GROUP BY ALL),
g AS (SELECT DISTINCT repo_id, g, len(g) AS n FROM w WHERE len(g) > 1), f AS (
SELECT repo_id, array_to_string(g[1], '/') AS file, CASE WHEN g[1][1] = 'py' THEN 2 ELSE 1 END AS severity, CAST(n AS DOUBLE) AS magnitude, 'Circular import group (' || n || ' files): ' || array_to_string(list_transform(g, lambda x: array_to_string(x, '/')), ' ⇄ ') AS message FROM g)
SELECT * FROM f WHERE {SHOWN}""")
def scan_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that import each other."""
    return findings(spark, sf_dir, "circular-imports").select("repo_id", "file", "severity", "magnitude", "message")


@query(f"""WITH RECURSIVE {REACH}, v AS (SELECT m.*, 1 + deep AS cyc, deep * (deep + 1) // 2 AS cog, CASE WHEN s = 49 THEN 85.0 WHEN coalesce(l.test, FALSE) THEN 40.0 ELSE 0.0 END::DOUBLE AS cov FROM m LEFT JOIN live l ON l.repo_id = m.repo_id AND l.path = m.path),
x AS (SELECT *, round((cyc * cyc * pow(1 - cov / 100, 3) + cyc) * 10) / 10 AS crap, path || '::f' || j || '@' || line AS symbol FROM v),
y AS (SELECT *, list_filter([CASE WHEN cyc > 4 THEN 'cyclomatic ' || cyc || ' > 4' END, CASE WHEN cog > 8 THEN 'cognitive ' || cog || ' > 8' END, CASE WHEN crap >= 20 THEN 'CRAP ' || printf('%.1f', crap) || ' >= 20.0' END], lambda t: t IS NOT NULL) AS over FROM x),
f AS (SELECT repo_id, 'high-complexity' AS rule, path AS file, symbol, 'Function ''f' || j || ''' is too complex: ' || array_to_string(over, ', ') || '.' AS message, printf('metrics:cyclomatic=%d,cognitive=%d,loc=%d,crap=%.1f,coverage=%.0f', cyc, cog, loc, crap, cov) AS reason FROM y WHERE len(over) > 0
UNION ALL SELECT repo_id, 'large-function', path, symbol, 'Function ''f' || j || ''' has ' || loc || ' lines (limit 9).', 'long functions are hard to review' FROM x WHERE loc > 9)
SELECT * FROM f WHERE {SHOWN}""")
def scan_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions over the limits, by branches, nesting and change risk, and long ones."""
    return findings(spark, sf_dir, "high-complexity", "large-function").select("repo_id", "rule", "file", "symbol", "message", "reason")


@query(f"""WITH {MODULES}, f AS (
SELECT repo_id, 'banned-import' AS rule, 2 AS severity, path AS file, CAST(top + 1 AS INT) AS start_line, 'Policy ''no-dep1'' forbids this import of ''dep1/sub''.' AS message FROM m WHERE s % 7 = 3 AND j % 10 = 1
UNION ALL SELECT repo_id, 'banned-effect', 1, path, CAST(line + calls + 1 AS INT), 'Policy ''no-network'' forbids this call to ''fetch''.' FROM m WHERE s % 11 = 0 AND layer IN ('domain', 'app')
UNION ALL SELECT repo_id, 'banned-call', 1, file, CAST(spot AS INT), 'Policy ''no-f7'' forbids this call to ''f7''.' FROM (SELECT repo_id, path AS file, line + 1 AS spot FROM m WHERE b = 7 AND even AND j > 0
  UNION ALL SELECT a.repo_id, a.path, a.line + CAST(a.even AND a.j > 0 AS INT) + (SELECT count(*) FROM m q WHERE q.repo_id = a.repo_id AND q.b = a.j AND q.s <= 2 AND q.j <= 7 AND q.j > 0) FROM m a JOIN m c ON c.repo_id = a.repo_id AND c.j = 7 AND c.b = a.j AND c.s <= 2
  UNION ALL SELECT repo_id, 'src/entry/e7.ts', 2 FROM m WHERE j = 7 AND s = 50 UNION ALL SELECT repo_id, 'src/tests/t7.test.ts', 2 FROM m WHERE j = 7 AND s = 49))
SELECT * FROM f WHERE {SHOWN}""")
def scan_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, calls and effects that a policy forbids."""
    return findings(spark, sf_dir, "banned-import", "banned-call", "banned-effect").select("repo_id", "rule", "severity", "file", "start_line", "message")


@query(f"""WITH {EDGES}, l AS (SELECT *, CASE string_split(src, '/')[2] WHEN 'domain' THEN 'domain' WHEN 'app' THEN 'application' WHEN 'infra' THEN 'infrastructure' WHEN 'ui' THEN 'ui' END AS a, CASE string_split(dst, '/')[2] WHEN 'domain' THEN 'domain' WHEN 'app' THEN 'application' WHEN 'infra' THEN 'infrastructure' WHEN 'ui' THEN 'ui' END AS b FROM e),
f AS (SELECT repo_id, src AS file, 2 AS severity, 'Layer ''' || a || ''' may not import layer ''' || b || ''': ' || src || ' -> ' || dst || '.' AS message FROM l WHERE a <> b AND a || '>' || b NOT IN ('application>domain', 'infrastructure>domain', 'infrastructure>application', 'ui>application', 'ui>domain'))
SELECT * FROM f WHERE {SHOWN}""")
def scan_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports from a layer into one that it may not use."""
    return findings(spark, sf_dir, "boundary-violation").select("repo_id", "file", "severity", "message")


@query(f"""WITH {MODULES}, l AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY j) AS INT) AS spot FROM p)
SELECT repo_id, 'unused-css-token' AS rule, spot AS start_line, 'Custom property ''--t' || j || ''' is never used.' AS message FROM l WHERE (repo_id, j) NOT IN (SELECT repo_id, j * 2 FROM p)
UNION ALL SELECT repo_id, 'broken-css-reference', 1, 'Custom property ''--t' || (j * 2) || ''' is not declared.' FROM l WHERE (repo_id, j * 2) NOT IN (SELECT repo_id, j FROM p)
UNION ALL SELECT repo_id, 'unused-css-class', spot, 'Class ''c' || j || ''' is never used.' FROM l WHERE NOT even""")
def scan_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom properties and classes that are not used or not declared."""
    return findings(spark, sf_dir, "unused-css-token", "broken-css-reference", "unused-css-class").select("repo_id", "rule", "start_line", "message")


@query(f"WITH {EDGES} SELECT DISTINCT repo_id, src, dst FROM e")
def scan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import graph, after resolution."""
    return scanned(spark, sf_dir).workspace.edges.select("repo_id", "src", "dst")


@query(f"""WITH {MODULES}, r AS (SELECT DISTINCT repo_id FROM p), f AS (SELECT repo_id, path, 'TypeScript' AS language, 'Source' AS role, FALSE AS is_entry, FALSE AS is_test FROM m
UNION ALL SELECT repo_id, 'src/entry/e' || j || '.ts', 'TypeScript', 'Source', TRUE, FALSE FROM m WHERE s = 50 UNION ALL SELECT repo_id, 'src/tests/t' || j || '.test.ts', 'TypeScript', 'Source', TRUE, TRUE FROM m WHERE s = 49
UNION ALL SELECT repo_id, 'src/entry/view.tsx', 'Tsx', 'Source', TRUE, FALSE FROM r UNION ALL SELECT repo_id, 'src/theme.css', 'Css', 'Source', FALSE, FALSE FROM r UNION ALL SELECT repo_id, path, 'Python', 'Source', j = 0, FALSE FROM py
UNION ALL SELECT repo_id, 'py/pk/__init__.py', 'Python', 'PackageInit', FALSE, FALSE FROM r)
SELECT *, CASE WHEN starts_with(path, 'py/') THEN 'pyg' ELSE 'g' END || substring(repo_id, 2) AS package FROM f""")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, role, entry and test marks, and owner of every file."""
    return scanned(spark, sf_dir).workspace.files.select("repo_id", "path", "language", "role", "is_entry", "is_test", "package")


@query(f"""WITH {MODULES}, r AS (SELECT DISTINCT repo_id FROM p)
SELECT repo_id, 'g' || substring(repo_id, 2) AS package, '' AS root, 'TypeScript' AS language, array_to_string(list_transform(range(10), lambda i: 'dep' || i), ',') AS dependencies, '' AS targets FROM r
UNION ALL SELECT repo_id, 'pyg' || substring(repo_id, 2), 'py', 'Python', 'numpy,requests', 'pk.p0' FROM r""")
def scan_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifests say: names, languages, dependencies and entry targets."""
    p = scanned(spark, sf_dir).workspace.packages
    return p.select("repo_id", F.col("id").alias("package"), "root", "language", F.array_join(F.array_sort("dependencies"), ",").alias("dependencies"), F.array_join(F.array_sort("targets"), ",").alias("targets"))


@query(f"""WITH {MODULES}, f AS (SELECT repo_id, path, CAST(j > 0 AS INT) + kids + CAST(s % 7 = 3 AS INT) AS imports, 2 + CAST(s % 5 = 0 AS INT) AS exports, 1 + CAST(s % 5 = 2 AS INT) AS functions, calls + CAST(s % 11 = 0 AS INT) AS calls, CAST(s % 13 = 5 AS INT) AS suppressions,
  CAST(s % 17 = 0 AS INT) + CAST(s % 19 = 0 AS INT) AS annotations, 2 + CAST(s % 5 = 0 AS INT) AS exported, CASE s % 5 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS members, CAST(s % 9 = 4 AS INT) AS parameters, line + loc + CAST(s % 19 = 0 AS INT) + CASE s % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS loc FROM m)
SELECT repo_id, path, {", ".join(f"CAST({c} AS INT) AS {c}" for c in ("imports", "exports", "functions", "calls", "suppressions", "annotations", "exported", "members", "parameters", "loc"))} FROM f""")
def scan_module_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many facts of each kind the front-end reads from each module."""
    f = scanned(spark, sf_dir).workspace.facts.filter("path rlike '^src/[a-z]+/m[0-9]+[.]ts$'")
    of = lambda test: F.size(F.filter("symbols", test))
    counts = [F.size(c).alias(c) for c in ("imports", "exports", "functions", "calls", "suppressions", "annotations")]
    kinds = [of(lambda x: x["exported"]).alias("exported"), of(lambda x: x["kind"].isin("EnumMember", "Method", "Field")).alias("members"), of(lambda x: x["kind"] == "Parameter").alias("parameters")]
    return f.select("repo_id", "path", *counts, *kinds, F.col("loc").cast("int").alias("loc"))


@query(f"""WITH {MODULES}, f AS (SELECT repo_id, count(*) AS files, count(*) FILTER (entry) AS entries, root FROM (SELECT repo_id, '' AS root, FALSE AS entry FROM m UNION ALL SELECT repo_id, '', TRUE FROM m WHERE s >= 49 UNION ALL SELECT DISTINCT repo_id, '', TRUE FROM p UNION ALL SELECT DISTINCT repo_id, '', FALSE FROM p
  UNION ALL SELECT repo_id, 'py', j = 0 FROM py UNION ALL SELECT * FROM (SELECT DISTINCT repo_id, 'py', FALSE FROM p)) GROUP BY ALL)
SELECT repo_id, root, files, entries FROM f""")
def scan_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and entries by package."""
    return scanned(spark, sf_dir).scan_roots().select("repo_id", "root", "files", "entries")


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT repo_id, CASE WHEN starts_with(src, 'py/') THEN 'pyg' ELSE 'g' END || '/' || string_split(src, '/')[2] AS a, string_split(src, '/')[2] AS x, string_split(dst, '/')[2] AS y, src, dst FROM e WHERE NOT starts_with(src, 'py/')),
k AS (SELECT repo_id, 'src/' || x AS "from", CASE WHEN dst = 'src/theme.css' THEN 'src/theme' ELSE 'src/' || y END AS "to" FROM b)
SELECT repo_id, "from", "to", count(*) AS weight FROM k WHERE "from" <> "to" GROUP BY ALL HAVING count(*) >= 2""")
def scan_coarse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges between directories of two levels."""
    return scanned(spark, sf_dir).package_graph(2, 2)[1].select("repo_id", "from", "to", "weight")


@query(f"""WITH {MODULES}, r AS (SELECT DISTINCT repo_id FROM p) SELECT repo_id, CAST(1 AS INT) AS exit_code FROM r WHERE repo_id IN (SELECT a.repo_id FROM m a JOIN m q ON q.repo_id = a.repo_id AND q.j = a.b WHERE a.j > 0 AND a.layer = 'domain' AND q.layer <> 'domain')""")
def scan_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories that fail at the error threshold by an import out of the innermost layer."""
    return post.exit_codes(scanned(spark, sf_dir).findings.filter("rule = 'boundary-violation' and message like \"Layer 'domain'%\"")).filter("exit_code = 1")
