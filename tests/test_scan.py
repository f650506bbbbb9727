import pytest

from repolens.plans.scan import scan
from repolens.sources import config as cfg
from repolens.plans.samples import REPOSITORIES

CONFIG = cfg.parse(
    """
[rules]
require-suppression-reason = "warn"
[complexity]
max-cyclomatic = 5
max-cognitive = 5
[[complexity.override]]
paths = ["legacy/**"]
max-cyclomatic = 99
max-cognitive = 99
max-crap = 999
reason = "frozen"
[duplication]
mode = "semantic"
min-tokens = 20
[style]
enabled = true
[[policy.rule]]
id = "no-axios"
kind = "banned-import"
specifiers = ["axios"]
paths = ["src/domain/**"]
[[policy.rule]]
id = "no-eval"
kind = "banned-call"
callees = ["eval"]
[[policy.rule]]
id = "pure"
kind = "banned-effect"
effects = ["process"]
severity = "error"
[boundaries]
preset = "layered"
"""
)


@pytest.fixture(scope="module")
def result(spark):
    rows = [(repo, path, text.encode()) for repo, files in REPOSITORIES.items() for path, text in files.items()]
    tree = spark.createDataFrame(rows, "repo_id string, path string, content binary")
    s = scan(tree, CONFIG)
    return s, [r.asDict() for r in s.findings.collect()]


def of(result, repo, *rules):
    return sorted((r["rule"], r["symbol"] or r["message"], r["file"], r["confidence"]) for r in result[1] if r["repo_id"] == repo and r["rule"] in rules)


def files(result, repo, rule):
    return sorted((r["file"], r["confidence"]) for r in result[1] if r["repo_id"] == repo and r["rule"] == rule)


def test_unused_files(result):
    assert files(result, "mixed", "unused-file") == [("apps/api/app/orphan.py", 2), ("apps/web/src/dead.ts", 2), ("apps/web/src/deader.ts", 2)]
    assert files(result, "mixed", "only-used-in-tests") == [("apps/web/src/helper.ts", 2)]
    assert files(result, "roles", "unused-file") == [("deadpkg/__init__.py", 0), ("orphan.ts", 2)]


def test_exports_and_types(result):
    assert {x[1] for x in of(result, "mixed", "unused-export")} == {"apps/web/src/ui/card.tsx::Orphaned", "apps/api/app/routes.py::router"} - {"apps/api/app/routes.py::router"}
    assert [x[1] for x in of(result, "symbols", "unused-type")] == ["types.ts::Dead"]


def test_members_and_parameters(result):
    assert [x[1] for x in of(result, "symbols", "unused-enum-member")] == ["colors.ts::Color.Blue@4", "colors.ts::Color.Green@3"]
    assert [x[1] for x in of(result, "symbols", "unused-class-member")] == ["service.py::Service._dead@8", "widget.ts::Widget.cache@2", "widget.ts::Widget.hidden@4"]
    assert [x[1] for x in of(result, "symbols", "unused-parameter")] == ["service.py::act.leftover@12", "widget.ts::open.extra@7"]


def test_imports_and_dependencies(result):
    assert [x[1] for x in of(result, "mixed", "unused-import")] == ["Import 'React' from 'react' is never used.", "Import 'unusedName' from '@acme/shared' is never used."]
    assert {x[1] for x in of(result, "mixed", "unused-dependency")} == {"Dependency 'lodash' is declared but never imported.", "Dependency 'requests' is declared but never imported.", "Dependency '@acme/shared' is declared but never imported."}


def test_cycles(result):
    found = [r for r in result[1] if r["rule"] == "circular-imports"]
    assert [(r["repo_id"], r["file"], r["severity"], r["magnitude"]) for r in found] == [("mixed", "apps/api/app/models.py", 2, 2.0)]


def test_annotations_and_suppressions(result):
    assert {x[1] for x in of(result, "annotations", "unused-export")} == {"index.ts::guarded", "lib.ts::flagged"}
    assert [x[1] for x in of(result, "annotations", "expected-unused-but-used")] == ["lib.ts::stale"]
    assert [r["start_line"] for r in result[1] if r["rule"] == "missing-suppression-reason"] == [4]
    assert [(r["file"], r["symbol"]) for r in result[0].suppressed.collect()] == [("lib.ts", "lib.ts::hidden")]


def test_complexity(result):
    assert {x[1] for x in of(result, "complexity", "high-complexity")} == {"index.ts::knot@1"}
    assert {x[1] for x in of(result, "complexity", "large-function")} == {"big.ts::big@1"}


def test_duplicates(result):
    found = [r for r in result[1] if r["repo_id"] == "duplication" and r["rule"] == "duplicate-code"]
    assert len(found) == 1 and found[0]["file"] == "src/a.ts" and "src/b.ts:1" in found[0]["message"]


def test_defaults(result):
    assert of(result, "defaults", "unused-export", "unused-import", "unused-file") == [("unused-export", "run.ts::spare", "run.ts", 2)]


def test_policy_and_boundaries(result):
    assert files(result, "policy", "banned-import") == [("src/domain/model.ts", 2)]
    assert files(result, "policy", "banned-call") == [("src/domain/model.ts", 2)]
    assert {x[0] for x in files(result, "policy", "banned-effect")} == {"worker.py"}
    assert files(result, "policy", "boundary-violation") == [("src/domain/model.ts", 2)]


def test_style(result):
    assert [x[1] for x in of(result, "style", "unused-css-token")] == ["Custom property '--dead' is never used."]
    assert [x[1] for x in of(result, "style", "broken-css-reference")] == ["Custom property '--missing' is not declared."]
    assert [x[1] for x in of(result, "style", "unused-css-class")] == ["Class 'gone' is never used.", "Class 'lost' is never used."]


def test_report(result):
    s = result[0]
    m = {r["repo_id"]: r for r in s.metrics().collect()}
    assert m["roles"]["files"] == 9 and m["roles"]["unused_file"] == 2 and m["roles"]["dead_file_pct"] == 22.2
    h = {r["repo_id"]: (r["score"], r["grade"]) for r in s.health().collect()}
    assert all(0 <= score <= 100 for score, _ in h.values()) and set(h) == set(REPOSITORIES)
    ranks = [r["rank"] for r in s.targets().filter("repo_id = 'mixed'").collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) <= 5
    nodes, edges, _ = s.package_graph()
    assert {(r["from"], r["to"]) for r in edges.filter("repo_id = 'mixed'").collect()} == {("apps/web", "packages/shared")}
    assert sum(r["files"] for r in s.scan_roots().filter("repo_id = 'mixed'").collect()) == 15
