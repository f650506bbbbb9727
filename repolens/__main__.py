"""Command line: python -m repolens COMMAND ROOT [options]."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from repolens.operators import draw, fix, post, sinks
from repolens.plans.scan import scan
from repolens.session import build_session
from repolens.sources import config as cfg
from repolens.sources.repositories import read_tree

# The rules that each command shows.
COMMANDS = {
    "scan": None, "audit": None, "dead": ["unused-file", "unused-export", "unused-type", "only-used-in-tests"], "cycles": ["circular-imports"], "deps": ["unused-dependency"], "dupes": ["duplicate-code"],
    "baseline": None, "fix": list(fix.FIXABLE), "graph": None, "explain": None, "init": None,
}
TEMPLATE = '[rules]\n# unused-export = "warn"\n\n[ignore]\npaths = []\n\n[audit]\nfail-on = "error"\n\n[complexity]\nmax-cyclomatic = 20\nmax-cognitive = 15\n'


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="repolens")
    p.add_argument("command", choices=list(COMMANDS))
    p.add_argument("root")
    p.add_argument("--config", help="TOML file; repolens.toml below ROOT by default")
    p.add_argument("--format", choices=["text", "json", "sarif", "github"], default="text")
    p.add_argument("--filter", help="rules, comma-separated")
    p.add_argument("--all", action="store_true", help="medium and low confidence too")
    p.add_argument("--baseline", default=None)
    p.add_argument("--include-deps", action="store_true")
    p.add_argument("--write", action="store_true", help="fix: change the files instead of showing diffs")
    p.add_argument("--depth", type=int, default=0)
    p.add_argument("--draw", choices=["tree", "svg", "html", "json", "dashboard"], default="tree")
    a = p.parse_args(argv)
    if a.command == "explain":
        try:
            print(sinks.explain(a.root))
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        return 0
    root = Path(a.root)
    settings = Path(a.config) if a.config else root / "repolens.toml"
    if a.command == "init":
        if settings.exists():
            print(f"{settings} exists", file=sys.stderr)
            return 2
        settings.write_text(TEMPLATE)
        return 0
    if not root.is_dir():
        print(f"{root} is no directory", file=sys.stderr)
        return 2
    chosen = COMMANDS[a.command]
    if a.filter:
        names = a.filter.split(",")
        if unknown := [n for n in names if n not in sinks.EXPLANATIONS]:
            print(f"unknown rules {unknown}", file=sys.stderr)
            return 2
        chosen = [n for n in names if chosen is None or n in chosen]
    config = cfg.load(str(settings))
    own = [*sorted((root / ".repolens" / "plugins").glob("*.toml")), *sorted(root.glob("repolens-plugin-*.toml"))]
    config = replace(config, plugins=(*config.plugins, *map(str, own)))
    spark = build_session(master="local[*]")
    tree = read_tree(spark, str(root.resolve()), root.resolve().name)
    keys = Path(a.baseline or root / ".repolens-baseline.json")
    baseline = None
    if a.command == "audit" and keys.exists():
        baseline = spark.createDataFrame([(root.resolve().name, k) for k in json.loads(keys.read_text())] or [("", "")], "repo_id string, key string")
    found = scan(tree, config, baseline=baseline)
    findings = post.select_rules(found.findings, chosen) if chosen is not None else found.findings
    if a.command == "baseline":
        keys.write_text(json.dumps(sorted(r["key"] for r in post.baseline_keys(findings).collect()), indent=2))
        return 0
    if a.command == "fix":
        edits = fix.apply(tree, fix.plan(findings, found.workspace.imports, dependencies=a.include_deps)).orderBy("path")
        for r in edits.toLocalIterator():
            print(r["diff"])
            if a.write:
                target = root / r["path"]
                target.unlink() if r["new"] is None else target.write_text(r["new"])
        return 0
    if a.command == "graph":
        nodes, edges, cycles = found.package_graph(a.depth)
        names = [r["bucket"] for r in nodes.orderBy("label", "bucket").collect()]
        pairs = [(r["from"], r["to"], r["weight"]) for r in edges.orderBy("from", "to").collect()]
        groups: dict[str, list[str]] = {}
        for r in cycles.collect():
            groups.setdefault(r["comp"], []).append(r["node"])
        if a.draw == "dashboard":
            roots = [(r["root"], r["package"], r["files"], r["entries"]) for r in found.scan_roots().collect()]
            print(draw.dashboard(roots, a.depth, names, pairs, list(groups.values()), a.format != "json"))
            return 0
        print({"tree": lambda: draw.as_tree(names, pairs), "svg": lambda: draw.as_svg(names, pairs), "html": lambda: draw.as_html(root.name, names, pairs), "json": lambda: draw.as_json([{"id": n} for n in names], [{"from": x, "to": y, "weight": w} for x, y, w in pairs], list(groups.values()))}[a.draw]())
        return 0
    if a.format == "json":
        for r in sinks.to_json(findings, found.metrics(), found.health(), found.components(), found.targets(), found.scan_roots()).toLocalIterator():
            print(r["json"])
    elif a.format == "sarif":
        for r in sinks.to_sarif(findings).toLocalIterator():
            print(r["sarif"])
    elif a.format == "github":
        for r in sinks.to_annotations(post.ordered(findings)).toLocalIterator():
            print(r["line"])
    else:
        roots = found.scan_roots()
        print(sinks.to_text_by_package(findings, roots, a.all) if roots.count() > 1 else sinks.to_text(findings, a.all))
    code = post.exit_codes(findings, config.fail_on).first()
    return code["exit_code"] if code else 0


if __name__ == "__main__":
    sys.exit(main())
