import json

import pytest
from pyspark.sql import functions as F

from repolens.operators import draw, fix, sinks
from repolens.sources import config as cfg
from repolens.streaming import rescan
from repolens.streaming.rescan import CHANGES, Rescanner, watch
from repolens.plans.scan import scan
from repolens.plans.samples import REPOSITORIES


@pytest.fixture(scope="module")
def small(spark):
    rows = [("mixed", path, text.encode()) for path, text in REPOSITORIES["mixed"].items()]
    tree = spark.createDataFrame(rows, "repo_id string, path string, content binary")
    return tree, scan(tree)


def test_documents(small):
    s = small[1]
    doc = json.loads(sinks.to_json(s.findings, s.metrics(), s.health(), s.components(), s.targets(), s.scan_roots()).first()["json"])
    assert doc["schema_version"] == 1 and len(doc["findings"]) == s.findings.count()
    assert [f["file"].split("/") for f in doc["findings"]] == sorted(f["file"].split("/") for f in doc["findings"])
    assert all("symbol" not in f for f in doc["findings"] if f["rule"] == "unused-file")
    log = json.loads(sinks.to_sarif(s.findings).first()["sarif"])
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == len(doc["findings"])
    assert any(r["line"].startswith("::error file=apps/api/app/models.py,line=1::[circular-imports]") for r in sinks.to_annotations(s.findings).collect())
    assert "unused-file" in sinks.to_text(s.findings)


def test_fix_round_trip(small):
    tree, s = small
    actions = fix.plan(s.findings, s.workspace.imports, dependencies=True)
    edits = fix.apply(tree, actions).cache()
    got = {r["path"]: r for r in edits.collect()}
    assert got["apps/web/src/dead.ts"]["new"] is None
    assert got["apps/web/app/page.tsx"]["new"].startswith('import { greet } from "@acme/shared";\nimport { Card }')
    assert "requests" not in got["apps/api/pyproject.toml"]["new"] and "pyyaml" in got["apps/api/pyproject.toml"]["new"]
    assert "lodash" not in got["apps/web/package.json"]["new"]
    assert "export const Orphaned" not in got["apps/web/src/ui/card.tsx"]["new"]
    after = fix.patched(tree, edits)
    assert after.count() == tree.count() - sum(r["new"] is None for r in got.values())
    back = fix.restore(after, edits)
    assert back.exceptAll(tree).isEmpty() and tree.exceptAll(back).isEmpty()


def test_patch_import():
    assert fix.patch_import("from a import b, c as d", {"d"}, True) == "from a import b"
    assert fix.patch_import("import os.path", {"os"}, True) is None
    assert fix.patch_import('import x, { y as z, w } from "m";', {"x", "z"}, False) == 'import { w } from "m";'
    assert fix.patch_import('import { y } from "m";', {"y"}, False) is None


def test_draw():
    nodes, edges = ["a", "b", "c"], [("a", "b", 2), ("b", "c", 1), ("c", "a", 1)]
    rank, back = draw.layout(nodes, edges)
    assert back == {("c", "a")} and rank == {"a": 0, "b": 1, "c": 2}
    assert "↺" in draw.as_tree(nodes, edges) and draw.as_svg(nodes, edges).count("<rect") == 3 and "<svg" in draw.as_html("t", nodes, edges)


def test_every_rule_is_explained():
    from repolens.operators.rules import RULES

    assert set(RULES) | {"missing-suppression-reason"} == set(sinks.EXPLANATIONS) and len(sinks.EXPLANATIONS) == 22
    with pytest.raises(ValueError):
        sinks.explain("nothing")


def test_config():
    assert cfg.parse("not toml [") == cfg.Config()
    c = cfg.parse('[rules]\nunused-file = {level = "error"}\n[boundaries]\npreset = "feature-sliced"\n[complexity]\nmax-loc = 0\n')
    assert c.severities == {"unused-file": 2} and c.layers[2].allow == ("shared", "entities") and c.max_loc == 1


def test_report_by_package_and_dashboard(small):
    s = small[1]
    roots = s.scan_roots()
    text = sinks.to_text_by_package(s.findings, roots, show_all=True, per_rule=10_000)
    names = {r["package"] for r in roots.collect()}
    heads = [line.split("  ")[1] for line in text.split("\n") if not line.startswith(" ")]
    assert set(heads) <= names and len(heads) > 1
    assert sum(line.startswith("    ") for line in text.split("\n")) == s.findings.count()
    nodes, edges, _ = s.package_graph(0)
    pairs = [(r["from"], r["to"], r["weight"]) for r in edges.collect()]
    own = [(r["root"], r["package"], r["files"], r["entries"]) for r in roots.collect()]
    ids = [r["bucket"] for r in nodes.orderBy("bucket").collect()]
    board = json.loads(draw.dashboard(own, 0, ids, pairs, as_text=False))
    assert len(board["scan_roots"]) == len(own) and [n["id"] for n in board["graph"]["nodes"]] == ids and board["depth_guide"][0]["depth"] == 0
    shown = draw.dashboard(own, 0, ids, pairs)
    assert all(p in shown for _, p, _, _ in own) and "(shown)" in shown


def test_stream_extracts_only_changes_and_survives_restarts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rescan, "COMPACT", 3)
    source, state = str(tmp_path / "in"), f"file://{tmp_path}/state"
    seen = []
    emit = lambda s, i: seen.append({x["file"] for x in s.findings.filter("rule = 'unused-file'").collect()})
    number = iter(range(100))

    def change(*rows):
        """A new stream and a new rescanner each time: nothing but the folders lives on."""
        r = Rescanner(spark, state, emit=emit)
        spark.createDataFrame([("r", p, None if t is None else t.encode(), next(number)) for p, t in rows], CHANGES).coalesce(1).write.mode("append").parquet(source)
        watch(spark.readStream.schema(CHANGES).parquet(source), r, str(tmp_path / "cp"), available_now=True).awaitTermination()
        return r.extracted

    assert change(("index.ts", 'import "./a";\n'), ("a.ts", "export const a = 1;\n"), ("b.ts", "export const b = 0;\n"), ("b.ts", "export const b = 1;\n"), ("notes.md", "x")) == 3
    assert change(("index.ts", 'import "./b";\n')) == 1
    assert change(("c.ts", "export const c = 1;\n"), ("a.ts", None)) == 1
    assert change(("index.ts", 'import "./a";\nimport "./c";\n')) == 1  # after a whole copy
    assert change(("a.ts", "export const a = 1;\n")) == 1  # a whole copy forgets the facts of deleted files
    assert seen == [{"b.ts"}, {"a.ts"}, {"c.ts"}, {"b.ts"}, {"b.ts"}]
    text = Rescanner(spark, state).state("contents", 99).filter("path = 'b.ts'").first()["content"]
    assert bytes(text) == b"export const b = 1;\n"
    # a batch that is run again gives the same state
    again = Rescanner(spark, state, emit=emit)
    again(spark.createDataFrame([("r", "a.ts", b"export const a = 1;\n", 50)], CHANGES), 4)
    assert seen[-1] == {"b.ts"} and again.extracted == 1 and again.state("contents", 99).filter("content is not null").count() == 4
