"""The operators bound to relational tables, each with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions import paths, scoring
from repolens.functions.globs import glob_to_regex
from repolens.operators import clones, graph, health, joins, liveness, post, resolve, rules, sinks
from repolens.plans import generated
from repolens.session import materialize, ship
from repolens.sources import repositories
from repolens.sources.config import Config
from repolens.streaming import rescan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


EDGES_SQL = """e AS (SELECT DISTINCT 'p' || a AS src, 'p' || b AS dst FROM (SELECT p_partkey AS a, p_partkey // 3 AS b FROM part UNION ALL SELECT p_partkey // 3, p_partkey FROM part WHERE p_size <= 2) WHERE a <> b)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of all parts: each points to that of a third its key, and small ones are pointed back to."""
    third = F.floor(F.col("p_partkey") / 3)
    part = table(spark, sf_dir, "part")
    pairs = part.select(F.col("p_partkey").alias("a"), third.alias("b")).union(part.filter("p_size <= 2").select(third, "p_partkey"))
    return graph.distinct_edges(pairs.select(F.lit("parts").alias("repo_id"), F.concat(F.lit("p"), "a").alias("src"), F.concat(F.lit("p"), "b").alias("dst")))


def part_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of size 50 as production seeds, of size 49 as test seeds, both as seeds of all."""
    node = F.concat(F.lit("p"), "p_partkey").alias("node")
    s = table(spark, sf_dir, "part").filter("p_size >= 49").select(F.lit("parts").alias("repo_id"), F.when(F.col("p_size") == 49, "test").otherwise("prod").alias("seed_class"), node)
    return s.union(s.select("repo_id", F.lit("all"), "node"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, r(node) AS (SELECT 'p' || p_partkey FROM part WHERE p_size >= 49 UNION SELECT e.dst FROM r JOIN e ON r.node = e.src)
SELECT node FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) n WHERE node NOT IN (SELECT node FROM r)""")
def reach_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that no seed reaches, by distributed rounds."""
    edges = part_edges(spark, sf_dir)
    nodes = edges.select("repo_id", F.col("src").alias("node")).union(edges.select("repo_id", F.col("dst").alias("node"))).distinct()
    seeds = part_seeds(spark, sf_dir).filter("seed_class = 'all'")
    return liveness.absent(nodes, graph.reachable_by_rounds(edges, seeds), ["repo_id", "node"]).select("node")


@query(f"""WITH RECURSIVE {EDGES_SQL}, seeds AS (SELECT CASE p_size WHEN 49 THEN 'test' ELSE 'prod' END AS seed_class, 'p' || p_partkey AS node FROM part WHERE p_size >= 49),
r(seed_class, node) AS (SELECT seed_class, node FROM seeds UNION SELECT 'all', node FROM seeds UNION SELECT r.seed_class, e.dst FROM r JOIN e ON r.node = e.src)
SELECT node, CAST(bool_or(seed_class = 'all') AS BOOLEAN) AS live, bool_or(seed_class = 'prod') AS prod, bool_or(seed_class = 'test') AS test FROM r GROUP BY node""")
def reach_three_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability from all, production and test seeds."""
    ship(spark)
    reach = graph.reachable(part_edges(spark, sf_dir), part_seeds(spark, sf_dir))
    return reach.groupBy("node").agg(*[F.bool_or(F.col("seed_class") == k).alias(n) for k, n in (("all", "live"), ("prod", "prod"), ("test", "test"))])


@query(f"""WITH RECURSIVE {EDGES_SQL}, c(a, b) AS (SELECT src, dst FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON c.b = e.src),
s AS (SELECT x.a AS node, least(x.a, min(x.b)) AS comp, count(DISTINCT x.b) AS size FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT node, comp, CAST(size AS INTEGER) AS size FROM s WHERE size > 1""")
def scc_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each cycle group."""
    ship(spark)
    return graph.strong_components(part_edges(spark, sf_dir)).select("node", "comp", "size")


@query(f"""WITH RECURSIVE {EDGES_SQL}, t AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size = 49), r(node) AS (SELECT node FROM t UNION SELECT e.dst FROM r JOIN e ON r.node = e.src),
v AS (SELECT 'p' || p_partkey AS node, p_size AS cc, CASE WHEN 'p' || p_partkey IN (SELECT dst FROM e WHERE src IN (SELECT node FROM t)) THEN 85.0 WHEN 'p' || p_partkey IN (SELECT node FROM r) THEN 40.0 ELSE 0.0 END::DOUBLE AS coverage FROM part)
SELECT node, cc, coverage, round(cc * cc * pow(1 - coverage / 100, 3) + cc, 4) AS crap FROM v""")
def direct_vs_transitive_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage estimated from test imports, and the change risk that follows."""
    ship(spark)
    edges = part_edges(spark, sf_dir)
    files = table(spark, sf_dir, "part").select(F.lit("parts").alias("repo_id"), F.concat(F.lit("p"), "p_partkey").alias("path"), F.col("p_size").alias("cc"))
    tests = files.join(part_seeds(spark, sf_dir).filter("seed_class = 'test'").select("repo_id", F.col("node").alias("path")), ["repo_id", "path"], "left_semi")
    reach = graph.reachable(edges, tests.select("repo_id", F.lit("test").alias("seed_class"), F.col("path").alias("node")))
    covered = graph.test_coverage(files, edges, reach, tests)
    return files.join(covered, ["repo_id", "path"]).select(F.col("path").alias("node"), "cc", "coverage", F.round(scoring.crap(F.col("cc"), F.col("coverage")), 4).alias("crap"))


@query("""WITH p AS (SELECT DISTINCT regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages), s AS (SELECT string_split(path, '/') AS x FROM p)
SELECT DISTINCT array_to_string(x[1 : i], '/') AS dir FROM s, LATERAL (SELECT unnest(range(0, len(x))) AS i)""")
def ancestor_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every directory at or above a path."""
    path = table(spark, sf_dir, "pages").select(F.lit("web").alias("repo_id"), F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("path")).distinct()
    return graph.ancestor_directories(path).select("dir")


@query("SELECT p_partkey, p_name FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)")
def unused_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared things without a use."""
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return liveness.absent(table(spark, sf_dir, "part").select("p_partkey", "p_name"), used, ["p_partkey"])


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.095 AND l_quantity > 49 AND l_suppkey IS NOT NULL)")
def unused_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared dependencies that nothing imports."""
    used = table(spark, sf_dir, "lineitem").filter("l_discount > 0.095 and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return liveness.absent(table(spark, sf_dir, "supplier").select("s_suppkey"), used, ["s_suppkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def broken_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, each occurrence, to what is not declared."""
    declared = table(spark, sf_dir, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return liveness.absent(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), declared, ["l_partkey"])


@query("SELECT o_orderkey, o_orderpriority FROM orders o WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def stale_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Things tagged as unused that are used."""
    used = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return liveness.present(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority"), used, ["o_orderkey"])


@query("""WITH refs AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1), d AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_tax = 0 AND l_quantity < 2)
SELECT s_suppkey, CASE WHEN coalesce(n, 0) >= 2 THEN least(CASE WHEN d.k IS NOT NULL THEN 1 ELSE 2 END, 1) WHEN d.k IS NOT NULL THEN 1 ELSE 2 END AS confidence FROM supplier s LEFT JOIN refs ON refs.k = s_suppkey LEFT JOIN d ON d.k = s_suppkey""")
def export_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High confidence, dampened by dynamic uses and by references in the same file."""
    lines = table(spark, sf_dir, "lineitem")
    refs = lines.filter("l_quantity > 48").groupBy(F.col("l_suppkey").alias("s_suppkey")).count().filter("count >= 2")
    dynamic = lines.filter("l_tax = 0 and l_quantity < 2").select(F.col("l_suppkey").alias("s_suppkey"))
    rows = liveness.flag(liveness.flag(table(spark, sf_dir, "supplier").select("s_suppkey"), refs, ["s_suppkey"], "repeated"), dynamic, ["s_suppkey"], "damped")
    return rows.select("s_suppkey", liveness.confidence(F.col("damped"), F.col("repeated")).alias("confidence"))


GLOBS = (("no-ads", "*ads*"), ("no-mobile-fr", "m.*/fr/**"), ("html", "**/*.html"), ("either", "{blog,www}.*/en/**"), ("digits", "*/[0-9]?"))


@query("WITH g(rule, re) AS (VALUES " + ", ".join(f"('{n}', '{glob_to_regex(g)}')" for n, g in GLOBS) + ") SELECT page_id, rule FROM pages, g WHERE regexp_matches(regexp_replace(url, '^[a-z]*://', ''), re)")
def glob_policy_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which policy globs each row breaks: rules become columns of one pass, not a join of rows and rules."""
    bare = F.regexp_replace("url", "^[a-z]*://", "")
    hits = F.array_compact(F.array(*[F.when(bare.rlike(glob_to_regex(g)), n) for n, g in GLOBS]))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(hits).alias("rule"))


LAYERS = [("core", ["AFRICA", "ASIA"]), ("edge", ["EUROPE"]), ("out", ["AMERICA", "MIDDLE*"])]


def workspace(**tables) -> rules.Workspace:
    """A workspace of the tables that a rule reads."""
    return rules.Workspace(**dict.fromkeys(("files", "packages", "facts", "imports", "edges", "used", "external", "reach")) | tables)


@query("""WITH l AS (SELECT n_nationkey, r_name || '/n' || n_nationkey AS path, CASE WHEN r_name IN ('AFRICA', 'ASIA') THEN 'core' WHEN r_name = 'EUROPE' THEN 'edge' WHEN r_name = 'AMERICA' OR r_name LIKE 'MIDDLE%' THEN 'out' END AS layer FROM nation JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT DISTINCT c.c_nationkey AS a, s.s_nationkey AS b FROM orders JOIN customer c ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier s ON l_suppkey = s_suppkey)
SELECT x.path AS file, concat('Layer ', chr(39), x.layer, chr(39), ' may not import layer ', chr(39), y.layer, chr(39), ': ', x.path, ' -> ', y.path, '.') AS message FROM e JOIN l x ON x.n_nationkey = e.a JOIN l y ON y.n_nationkey = e.b
WHERE x.layer <> y.layer AND NOT (x.layer = 'edge' AND y.layer = 'core' OR x.layer = 'out' AND y.layer IN ('core', 'edge'))""")
def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a layer to one that it may not use."""
    allow = {"core": (), "edge": ("core",), "out": ("core", "edge")}
    config = Config(layers=tuple(rules.Layer(name, tuple(f"{x}/**" for x in regions), allow[name]) for name, regions in LAYERS))
    of = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat("r_name", F.lit("/n"), "n_nationkey").alias("path"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("c_nationkey", "s_nationkey").distinct()
    a, b = of.select(F.col("n_nationkey").alias("c_nationkey"), F.col("path").alias("src")), of.select(F.col("n_nationkey").alias("s_nationkey"), F.col("path").alias("dst"))
    edges = e.join(a, "c_nationkey").join(b, "s_nationkey").select(F.lit("r").alias("repo_id"), "src", "dst")
    return rules.boundaries(workspace(edges=edges, config=config)).select("file", "message")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([l_partkey * 7, l_partkey * 3, l_suppkey]) AS k, unnest([0, 1, 2]) AS pr FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, arg_min(k, pr) AS target, min(pr) AS priority FROM c JOIN part ON p_partkey = k GROUP BY ALL""")
def first_match_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered fallbacks: the first candidate that exists."""
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.posexplode(F.array(F.col("l_partkey") * 7, F.col("l_partkey") * 3, F.col("l_suppkey"))).alias("priority", "target"))
    found = joins.first_match(c, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target")), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["target"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "target", "priority")


OWNERS = (("", "root"), ("en", "english"), ("fr", "french"), ("en/1000", "thousand"))


@query("""WITH o(root, owner) AS (VALUES ('', 'root'), ('en', 'english'), ('fr', 'french'), ('en/1000', 'thousand')), p AS (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, arg_max(owner, length(root)) AS owner FROM p JOIN o ON root = '' OR starts_with(path, root || '/') GROUP BY page_id""")
def longest_prefix_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest root above each path."""
    owners = spark.createDataFrame(OWNERS, "root string, owner string").withColumn("repo_id", F.lit("web"))
    pages = table(spark, sf_dir, "pages").select(F.lit("web").alias("repo_id"), "page_id", F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("path"))
    return joins.prefix_owner(pages, owners, F.col("path")).select("page_id", "owner")


FINDINGS_SQL = "f AS (SELECT 'events' AS repo_id, event_type AS rule, 'u' || user_id AS file, CAST(date_part('hour', ts) AS INTEGER) AS start_line, CAST(date_part('hour', ts) AS INTEGER) + 3 AS end_line, event_id FROM events)"


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("ts")
    return table(spark, sf_dir, "events").select(F.lit("events").alias("repo_id"), F.col("event_type").alias("rule"), F.concat(F.lit("u"), "user_id").alias("file"), hour.alias("start_line"), (hour + 3).alias("end_line"), "event_id", "value")


@query(f"""WITH {FINDINGS_SQL}, s AS (SELECT 'u' || o_custkey AS path, CASE o_orderstatus WHEN 'F' THEN 'click' WHEN 'O' THEN 'view' ELSE 'error' END AS rule, o_orderpriority = '1-URGENT' AS file_scoped, CAST(o_orderkey % 24 AS INTEGER) AS line FROM orders)
SELECT event_id FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.path = f.file AND s.rule = f.rule AND (s.file_scoped OR s.line BETWEEN f.start_line AND f.end_line))""")
def suppression_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that no suppression of their file, rule and lines covers."""
    s = table(spark, sf_dir, "orders").select(F.lit("events").alias("repo_id"), F.concat(F.lit("u"), "o_custkey").alias("path"), F.when(F.col("o_orderstatus") == "F", "click").when(F.col("o_orderstatus") == "O", "view").otherwise("error").alias("rule"), (F.col("o_orderpriority") == "1-URGENT").alias("file_scoped"), (F.col("o_orderkey") % 24).cast("int").alias("line"))
    return post.suppressed(event_findings(spark, sf_dir), s).select("event_id")


@query("""SELECT event_id, event_type AS rule, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 2 ELSE 1 END AS severity FROM events WHERE event_type <> 'click' AND NOT regexp_matches('u' || user_id, '^(?:u1.*|u.2)$')""")
def severity_override_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides, then what is off and what is ignored goes."""
    f = event_findings(spark, sf_dir).withColumn("severity", F.lit(1))
    f = post.drop_ignored(post.drop_off(post.override_severity(f, {"click": post.OFF, "error": post.ERROR})), ["u1*", "u?2"])
    return f.select("event_id", "rule", "severity")


@query("""WITH k AS (SELECT o_orderkey, o_orderstatus || '|c' || o_custkey AS key, o_orderdate FROM orders) SELECT o_orderkey FROM k WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND key NOT IN (SELECT key FROM k WHERE o_orderdate < TIMESTAMP '1996-01-01')""")
def baseline_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that the baseline does not know."""
    f = table(spark, sf_dir, "orders").select(F.lit("r").alias("repo_id"), F.col("o_orderstatus").alias("rule"), F.concat(F.lit("c"), "o_custkey").alias("file"), F.lit(None).cast("string").alias("symbol"), "o_orderkey", "o_orderdate")
    old = f.filter("o_orderdate < timestamp '1996-01-01'")
    return post.ratchet(f.filter("o_orderdate >= timestamp '1996-01-01'"), post.baseline_keys(old)).select("o_orderkey")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def rule_metrics_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column per rule by conditional counts."""
    f = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("rule"))
    return health.rule_counts(f, ("click", "error", "purchase", "signup", "view"), ("user_id",))


RULE_OF = {"click": "unused-export", "error": "circular-imports", "purchase": "unused-file", "signup": "duplicate-code", "view": "unused-css-token"}


def weighted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.create_map(*[F.lit(x) for kv in RULE_OF.items() for x in kv])[F.col("event_type")]
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("repo_id"), rule.alias("rule"), F.concat(F.lit("d/u"), "user_id").alias("file"), F.lit(None).cast("string").alias("symbol"), F.when(F.col("event_id") % 3 == 0, 2).otherwise(1).alias("severity"), F.when(F.col("event_id") % 5 == 0, 1).otherwise(2).alias("confidence"), F.col("event_id").cast("int").alias("start_line"), F.col("event_id").cast("int").alias("end_line"), F.lit(None).cast("double").alias("magnitude"))


def weighted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("loc")).select(F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("repo_id"), F.concat(F.lit("d/u"), "user_id").alias("path"), "loc")


WEIGHTED_SQL = """f AS (SELECT 'r' || (user_id % 10) AS repo_id, event_type, 'd/u' || user_id AS file, event_id, CASE event_type WHEN 'click' THEN 1.0 WHEN 'error' THEN 8.0 WHEN 'purchase' THEN 8.0 WHEN 'signup' THEN 5.0 ELSE 2.0 END * CASE WHEN event_id % 3 = 0 THEN 1.5 ELSE 1.0 END AS w FROM events WHERE event_id % 5 <> 0),
n AS (SELECT 'r' || (user_id % 10) AS repo_id, count(DISTINCT user_id) AS files FROM events GROUP BY 1),
c AS (SELECT f.repo_id, CASE event_type WHEN 'click' THEN 'api-surface' WHEN 'error' THEN 'cycles' WHEN 'purchase' THEN 'dead-code' WHEN 'signup' THEN 'duplication' ELSE 'styling' END AS component,
  CASE event_type WHEN 'click' THEN 12.0 WHEN 'error' THEN 25.0 WHEN 'purchase' THEN 45.0 WHEN 'signup' THEN 20.0 ELSE 15.0 END AS cap, sum(w) AS w FROM f GROUP BY ALL),
p AS (SELECT repo_id, component, round(least(CAST(w AS DOUBLE) * 100 / files, cap), 1) AS penalty FROM c JOIN n USING (repo_id))"""


@query(f"WITH {WEIGHTED_SQL} SELECT repo_id, component, penalty, round(100 - penalty, 1) AS score FROM p")
def health_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights per hundred files by component, capped."""
    return health.components(weighted_findings(spark, sf_dir), weighted_files(spark, sf_dir))


@query(f"WITH {WEIGHTED_SQL}, h AS (SELECT repo_id, round(greatest(0.0, least(100.0, 100 - sum(penalty))), 1)::DOUBLE AS score FROM p GROUP BY repo_id) SELECT repo_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM h")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and grade."""
    files = weighted_files(spark, sf_dir)
    return health.health(health.components(weighted_findings(spark, sf_dir), files), files)


@query(f"""WITH {WEIGHTED_SQL}, l AS (SELECT 'd/u' || user_id AS file, count(*) AS loc FROM events GROUP BY 1), t AS (SELECT *, CASE event_type WHEN 'click' THEN 'unused-export' WHEN 'error' THEN 'circular-imports' WHEN 'purchase' THEN 'unused-file' WHEN 'signup' THEN 'duplicate-code' ELSE 'unused-css-token' END AS rule,
  CASE event_type WHEN 'click' THEN 'unused export' WHEN 'error' THEN 'circular imports' WHEN 'purchase' THEN 'unused file' WHEN 'signup' THEN 'duplicate code' ELSE 'unused CSS token' END AS title FROM f),
g AS (SELECT repo_id, file, sum(w)::DOUBLE AS payoff, arg_max(rule, (w, event_id, rule)) AS rule FROM t GROUP BY ALL),
told AS (SELECT file, title, count(*) AS n FROM t GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, title) AS place FROM told),
y AS (SELECT file, string_agg(CASE WHEN n = 1 THEN title ELSE n || ' ' || title END, '; ' ORDER BY place) AS reasons FROM o WHERE place <= 3 GROUP BY file),
s AS (SELECT g.*, loc, payoff / (1 + sqrt(loc) / 8) AS x FROM g JOIN l USING (file)),
k AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY x DESC, payoff DESC, string_split(file, '/')) AS rank FROM s)
SELECT repo_id, CAST(rank AS INTEGER) AS rank, file, round(x, 1) AS score, round(payoff, 1) AS payoff, CASE rule WHEN 'unused-export' THEN 'API surface review' WHEN 'circular-imports' THEN 'cycle' WHEN 'unused-file' THEN 'dead file' WHEN 'duplicate-code' THEN 'duplicate block' ELSE 'style cleanup' END AS kind,
  CASE WHEN loc <= 120 THEN 'small' WHEN loc <= 400 THEN 'medium' ELSE 'large' END AS effort, reasons FROM k JOIN y USING (file) WHERE rank <= 5""")
def refactor_targets_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five files of each repository that pay off most, with kind and reasons."""
    top = health.targets(weighted_findings(spark, sf_dir), weighted_files(spark, sf_dir))
    return top.select("repo_id", "rank", "file", "score", "payoff", "kind", "effort", F.array_join("reasons", "; ").alias("reasons"))


@query("""WITH e AS (SELECT c.c_nationkey AS a, s.s_nationkey AS b FROM orders JOIN customer c ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier s ON l_suppkey = s_suppkey),
k AS (SELECT n_nationkey FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_name, n_nationkey) AS n FROM nation) WHERE n <= 20)
SELECT a AS src, b AS dst, count(*) AS weight FROM e WHERE a <> b AND a IN (SELECT * FROM k) AND b IN (SELECT * FROM k) GROUP BY ALL HAVING count(*) >= 10""")
def coarse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges between buckets, light ones dropped, nodes truncated."""
    nation = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_nationkey").alias("bucket"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_nationkey").alias("bucket"))
    # every nation is a bucket, even one without a member
    own = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_nationkey").alias("bucket"))
    nodes = c.union(s).union(own).join(nation.select(F.col("n_nationkey").alias("bucket"), F.col("n_name").alias("label")), "bucket").withColumn("repo_id", F.lit("r"))
    e = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = e.select(F.lit("r").alias("repo_id"), F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    _, heavy = graph.coarse_graph(nodes, edges, min_weight=10, max_nodes=20)
    return heavy.select(F.col("from").alias("src"), F.col("to").alias("dst"), "weight")


WINDOW_SQL = """t AS (SELECT doc_id, source, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+') AS w FROM documents),
x AS (SELECT doc_id, source, i - 1 AS start, w[i : i + 29] AS g, CASE WHEN i > 1 THEN w[i - 1] END AS prev FROM t, LATERAL (SELECT unnest(range(1, len(w) - 28)) AS i)),
h AS (SELECT g, count(*) AS n, count(DISTINCT prev) AS n_prev, count(*) FILTER (prev IS NULL) AS at_start, count(DISTINCT source) AS sources FROM x GROUP BY g HAVING count(*) >= 2)"""


def repeated_windows(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    ship(spark)
    return clones.repeated(table(spark, sf_dir, "documents"), 30, "text", **how)


@query(f"WITH {WINDOW_SQL} SELECT x.doc_id, CAST(x.start AS INTEGER) AS start, h.n FROM x JOIN h USING (g)")
def clone_windows_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of 30 tokens that occurs twice or more, with its number of places."""
    return repeated_windows(spark, sf_dir, file="doc_id").select("doc_id", "start", "n")


@query(f"WITH {WINDOW_SQL} SELECT n, n_prev, count(*) AS groups FROM h WHERE n_prev + at_start > 1 GROUP BY ALL")
def clone_left_maximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that no common token to the left extends, counted by size."""
    return clones.left_maximal(repeated_windows(spark, sf_dir)).groupBy("n", "n_prev").agg(F.count(F.lit(1)).alias("groups"))


@query(f"WITH {WINDOW_SQL} SELECT n, sources, count(*) AS groups FROM h WHERE sources > 1 GROUP BY ALL")
def clone_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with members in more than one place of origin."""
    groups = repeated_windows(spark, sf_dir, of="source").withColumnRenamed("n_prev", "sources").filter("sources > 1")
    return groups.groupBy("n", "sources").agg(F.count(F.lit(1)).alias("groups"))


@query("""WITH b AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations),
x AS (SELECT w[i : i + 11] AS w FROM b, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i)),
k AS (SELECT array_to_string(list_transform(w, lambda v: list_position(w, v)), ',') AS key FROM x) SELECT key, count(*) AS n FROM k GROUP BY key HAVING count(*) >= 2""")
def clone_alpha_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of twelve words that are alike up to consistent renaming: the first place of each word is the key."""
    ship(spark)
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    found = clones.renamed_windows(table(spark, sf_dir, "conversations").select("conv_id", words.alias("syms")), 12, ["conv_id"])
    return found.groupBy(F.col("alpha").alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 7 = 0 OR text IS NULL")
def content_hash_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is extracted again: files whose (path, content hash) the cache does not hold. Cached facts are marked by their number of lines."""
    ship(spark)
    path = F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn", F.lit(".css"))
    files = table(spark, sf_dir, "conversations").select(F.lit("r").alias("repo_id"), path.alias("path"), "conv_id", F.encode("text", "UTF-8").alias("content"))
    known = materialize(repositories.extract_facts(files.filter("content is not null")).withColumn("loc", F.lit(-1)), "cache")
    changed = files.withColumn("content", F.when(F.col("conv_id") % 7 == 0, F.concat("content", F.lit(b" changed"))).otherwise(F.col("content")))
    fresh = repositories.extract_facts(changed, known).filter("loc >= 0")
    number = lambda i: F.regexp_extract("path", "c(-?[0-9]+)_(-?[0-9]+)", i).cast("long")
    return fresh.select(number(1).alias("conv_id"), number(2).alias("turn"))


@query("""WITH d AS (SELECT page_id, unnest(string_split(array_to_string(regexp_extract_all(html, 'class="([^"]*)"', 1), ' '), ' ')) AS name FROM pages),
s AS (SELECT page_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?s)<style>(.*?)</style>', 1), ' '), '\\.([a-zA-Z_][a-zA-Z0-9_-]*)', 1)) AS name FROM pages)
SELECT DISTINCT page_id, name FROM d WHERE name <> '' AND NOT EXISTS (SELECT 1 FROM s WHERE s.page_id = d.page_id AND s.name = d.name)""")
def css_class_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class names that markup uses but the page's own styles do not declare, by the front-ends' facts."""
    ship(spark)
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("repo_id"), "html")
    classes = F.array_join(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), 1), " ")
    markup = pages.select("repo_id", F.lit("v.tsx").alias("path"), F.concat(F.lit('const v = <p className="'), classes, F.lit('"/>;')).alias("content"))
    styles = pages.select("repo_id", F.lit("s.css").alias("path"), F.array_join(F.regexp_extract_all("html", F.lit("(?s)<style>(.*?)</style>"), 1), " ").alias("content"))
    w = workspace(facts=materialize(repositories.extract_facts(markup.unionByName(styles).withColumn("content", F.encode("content", "UTF-8"))), "facts"))
    used, declared = w.each("css_class_refs", "name"), w.each("css_classes", "t").withColumn("name", F.col("t.name"))
    return liveness.absent(used, declared, ["repo_id", "name"]).select(F.expr("cast(substring(repo_id, 2) as long)").alias("page_id"), "name").distinct()


@query("SELECT key AS dep, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL) GROUP BY key")
def json_manifest_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependencies of manifests, one an event."""
    ship(spark)
    text = F.concat(F.lit('{"name": "e", "dependencies": '), "props", F.lit("}"))
    found = repositories.manifests(table(spark, sf_dir, "events").select(F.lit("r").alias("repo_id"), F.concat(F.lit("e"), "event_id", F.lit("/package.json")).alias("path"), F.encode(text, "UTF-8").alias("content")))
    return found.select(F.explode("dependencies").alias("dep")).groupBy("dep").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT page_id, string_split(regexp_extract(url, '://([^?#]*)', 1) || '/./x/../y', '/') AS x FROM pages)
SELECT page_id, array_to_string(list_filter(x[1 : len(x) - 4], lambda v: v <> '' AND v <> '.'), '/') || '/y' AS path FROM p""")
def normalized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical folding of dots and empty segments."""
    raw = F.concat(F.regexp_extract("url", "://([^?#]*)", 1), F.lit("/./x/../y"))
    return table(spark, sf_dir, "pages").select("page_id", paths.normalize(raw).alias("path"))


@query("""SELECT DISTINCT event_type || '|u' || user_id AS key FROM events""")
def baseline_key_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct keys that a baseline file holds."""
    return post.baseline_keys(event_findings(spark, sf_dir).withColumn("symbol", F.lit(None).cast("string"))).select("key")


@query("""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[^\\p{L}\\p{N}_]')) AS word FROM benchmark) SELECT word FROM w WHERE word <> ''""")
def string_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier-like words inside literals."""
    facts = table(spark, sf_dir, "benchmark").select(F.lit("r").alias("repo_id"), F.array("text").alias("strings"))
    return workspace(facts=facts).words().select(F.col("name").alias("word"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of changes that one rescan answers: a session ends after a quiet gap."""
    return rescan.bursts(table(spark, sf_dir, "events"), ["user_id"], "ts", "10 minutes")




@query("SELECT rule || ':' || file AS line FROM (SELECT DISTINCT '::' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END || ' file=u' || user_id || ',line=' || date_part('hour', ts) || '::[' || event_type || '] m' AS rule, user_id AS file FROM events)")
def annotations_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as annotation commands."""
    f = event_findings(spark, sf_dir).withColumn("severity", F.when(F.col("rule") == "error", 2).otherwise(1)).withColumn("message", F.lit("m"))
    lines = sinks.to_annotations(f.select("repo_id", "severity", "file", "start_line", "rule", "message")).distinct()
    return lines.select(F.concat("line", F.lit(":"), F.regexp_extract("line", r"file=u(\d+)", 1)).alias("line"))


@query("SELECT 'r' || (user_id % 10) AS repo_id, max(CASE WHEN event_id % 3 = 0 AND event_type = 'error' THEN 1 ELSE 0 END) AS exit_code FROM events GROUP BY 1")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which repositories fail at the error threshold."""
    f = table(spark, sf_dir, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("repo_id"), F.when((F.col("event_id") % 3 == 0) & (F.col("event_type") == "error"), 2).otherwise(1).alias("severity"))
    return post.exit_codes(f)


@query("""WITH p AS (SELECT DISTINCT string_split(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/') AS x FROM pages)
SELECT array_to_string(x[1 : 1], '/') AS bucket, count(*) AS files FROM (SELECT CASE WHEN len(x) > 1 THEN x ELSE [regexp_replace(x[1], '(.)\\.[^.]*$', '\\1')] END AS x FROM p) GROUP BY 1""")
def bucket_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their first path segment below the root."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("path")).distinct()
    return p.groupBy(graph.bucket_of(F.col("path"), F.lit(""), 1).alias("bucket")).agg(F.count(F.lit(1)).alias("files"))


@query("""WITH f AS (SELECT p_partkey, p_size AS cyc, p_size % 17 AS cog, CASE p_partkey % 3 WHEN 0 THEN 85.0 WHEN 1 THEN 40.0 ELSE 0.0 END::DOUBLE AS cov FROM part), c AS (SELECT *, round((cyc * cyc * pow(1 - cov / 100, 3) + cyc) * 10) / 10 AS crap FROM f)
SELECT p_partkey, crap, CASE WHEN crap >= 500 OR cyc >= 50 OR cog >= 50 THEN 'CRITICAL' WHEN crap >= 100 OR cyc >= 30 OR cog >= 30 THEN 'HIGH' WHEN crap >= 30 THEN 'ELEVATED' ELSE 'OVER' END AS band FROM c WHERE cyc > 20 OR cog > 15 OR crap >= 30""")
def complexity_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions over their limits, with risk and triage band."""
    f = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("cyc"), (F.col("p_size") % 17).alias("cog"), F.when(F.col("p_partkey") % 3 == 0, 85.0).when(F.col("p_partkey") % 3 == 1, 40.0).otherwise(0.0).alias("cov"))
    f = f.withColumn("crap", scoring.round1(scoring.crap(F.col("cyc"), F.col("cov")))).filter("cyc > 20 or cog > 15 or crap >= 30")
    return f.select("p_partkey", "crap", scoring.band(F.col("cyc"), F.col("cog"), F.col("crap")).alias("band"))


NAMES_SQL = "n AS (SELECT p_partkey, 'src/' || CASE p_partkey % 9 WHEN 0 THEN '__init__.py' WHEN 1 THEN 'x.d.ts' WHEN 2 THEN 'vite.config.ts' WHEN 3 THEN '.eslintrc.js' WHEN 4 THEN 'Page.TSX' WHEN 5 THEN 'a.css' WHEN 6 THEN 'stub.pyi' WHEN 7 THEN 'm.mjs' ELSE 'plain.py' END AS path FROM part)"


@query(f"WITH {NAMES_SQL} SELECT p_partkey, CASE p_partkey % 9 WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'TypeScript' WHEN 3 THEN 'JavaScript' WHEN 5 THEN 'Css' WHEN 7 THEN 'JavaScript' WHEN 4 THEN NULL ELSE 'Python' END AS language, CASE WHEN p_partkey % 9 = 0 THEN 'PackageInit' WHEN p_partkey % 9 IN (1, 6) THEN 'TypeDecl' WHEN p_partkey % 9 IN (2, 3) THEN 'Config' ELSE 'Source' END AS role FROM n")
def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by extension and role by name."""
    names = ["__init__.py", "x.d.ts", "vite.config.ts", ".eslintrc.js", "Page.TSX", "a.css", "stub.pyi", "m.mjs", "plain.py"]
    n = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("src/"), F.get(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % 9).cast("int"))).alias("path"))
    return n.select("p_partkey", repositories.language().alias("language"), repositories.role().alias("role"))


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '@acme/' || p_size || '/deep/x' WHEN 1 THEN 'pkg' || p_size || '/sub' WHEN 2 THEN 'yaml.nodes' WHEN 3 THEN 'os.path' ELSE 'cv2' END AS spec FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN regexp_extract(spec, '^(@[^/]*/[^/]*)', 1) WHEN 1 THEN string_split(spec, '/')[1] WHEN 2 THEN 'pyyaml' WHEN 3 THEN 'os' ELSE 'opencv-python' END AS dep FROM s""")
def external_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution an import comes from."""
    k = F.col("p_partkey") % 5
    spec = F.when(k == 0, F.concat(F.lit("@acme/"), "p_size", F.lit("/deep/x"))).when(k == 1, F.concat(F.lit("pkg"), "p_size", F.lit("/sub"))).when(k == 2, "yaml.nodes").when(k == 3, "os.path").otherwise("cv2")
    return table(spark, sf_dir, "part").select("p_partkey", resolve.external_name(spec, F.when(k < 2, "TypeScript").otherwise("Python")).alias("dep"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+') AS w FROM documents), p AS (SELECT doc_id, i AS pos FROM t, LATERAL (SELECT unnest(range(0, len(w))) AS i) WHERE length(w[i + 1]) > 9)
SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, pos, list_reduce(list_prepend(-1000, list_sort(list(pos) OVER (PARTITION BY doc_id))), lambda a, x: CASE WHEN x <= pos AND x >= a + 5 THEN x ELSE a END) AS last FROM p) WHERE last = pos GROUP BY doc_id""")
def clone_overlap_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy removal of blocks of five that overlap an earlier kept one, as a fold over sorted starts (an example on long words)."""
    words = F.regexp_extract_all("text", F.lit(r"([^ \t\n\r\f\x0B]+)"), 1)
    t = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.transform(words, lambda w, i: F.when(F.length(w) > 9, i)), lambda x: x.isNotNull()).alias("starts"))
    return t.filter("size(starts) > 0").select("doc_id", F.size(clones.greedy_starts(F.col("starts"), F.lit(5))).cast("long").alias("kept"))


@query()
def scan_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that the front-ends extract from the repositories generated from the parts, counted by kind."""
    facts = generated.scanned(spark, sf_dir).workspace.facts
    return facts.select("repo_id", "path", "loc", *[F.size(c).alias(c) for c in ("symbols", "imports", "exports", "refs", "member_access", "markers", "suppressions", "annotations", "strings", "functions", "calls", "css_tokens", "css_var_refs", "css_classes", "css_class_refs")])


@query()
def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the repositories generated from the parts, in one job."""
    return post.ordered(generated.scanned(spark, sf_dir).findings)


@query()
def sarif_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SARIF log per repository of weighted findings."""
    f = weighted_findings(spark, sf_dir).withColumn("message", F.col("rule")).withColumn("reason", F.lit("r"))
    return sinks.to_sarif(f)


@query()
def clone_groups_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of words that whole documents share, as long as all members agree, sentences as statements."""
    ship(spark)
    words = F.filter(F.split("text", r"[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.concat_ws("/", "source", "doc_id").alias("path"), words.alias("texts"))
    files = docs.select(F.lit("docs").alias("repo_id"), F.lit("text").alias("family"), "path", "texts", F.transform("texts", lambda w: F.lit("punct")).alias("kinds"), F.transform("texts", lambda w, i: i).alias("lines"), F.transform("texts", lambda w: w.rlike("[.!?]$")).alias("ends"))
    return clones.clone_groups(files, 30, "exact").select("length", "fingerprint", F.size("members").alias("members"), F.get("members", F.lit(0))["path"].alias("first"))


@query()
def clone_groups_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clones up to consistent renaming in the repositories generated from the parts."""
    ship(spark)
    tree = generated.tree(spark, sf_dir)
    return clones.clone_groups(repositories.token_streams(repositories.source_files(tree)), 20, "semantic").select("repo_id", "family", "length", "fingerprint", F.size("members").alias("members"))


QUERIES |= generated.QUERIES
SQL |= generated.SQL
