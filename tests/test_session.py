"""Shared folders and the tables written there."""

import os
import re

import pytest
from pyspark.sql import functions as F

from repolens import session
from repolens.operators import clones, graph, resolve
from repolens.plans import generated, scan
from repolens.sources import repositories


def paths_in(folder):
    return {x for x in os.listdir(folder.removeprefix("file://")) if not x.startswith(".")}


def test_tables_are_dropped(spark):
    folder = session.shared_folder(spark)
    before = paths_in(folder)
    first, second = (session.materialize(spark.range(n).toDF("id"), "dropped") for n in (3, 5))
    assert len(paths_in(folder) - before) == 2 and (first.count(), second.count()) == (3, 5)
    session.forget(first, spark.range(1).toDF("id"))
    assert len(paths_in(folder) - before) == 1
    path = second._repolens_path
    session.drop_tables(path)
    session.drop_tables(path)
    assert paths_in(folder) == before


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Unset:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None), "set": staticmethod(lambda *a: pytest.fail("set"))})

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: type("Sc", (), {"getCheckpointDir": staticmethod(lambda: type("No", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(RuntimeError):
        session.shared_folder(Unset)


def test_tables_that_files_make_look_small_are_not_broadcast(spark):
    few, many = (session.materialize(spark.range(n).select("id", F.repeat(F.lit("x"), 2000).alias("text")), "wide") for n in (100, 20_000))
    plan = lambda other: spark.range(10**9).join(other, "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan(many)  # 40 MB in a file of some KB: what Spark does by itself
    assert "BroadcastHashJoin" not in plan(session.by_shuffle(many))
    assert "BroadcastHashJoin" in plan(session.broadcast_if_small(few)) and "BroadcastHashJoin" not in plan(session.broadcast_if_small(many))


def test_a_scan_broadcasts_nothing_that_grows(spark, sf_dir, monkeypatch):
    plans = []

    def recorded(df, label="step"):
        plans.append((label, df._jdf.queryExecution().sparkPlan().toString()))
        return session.materialize(df, label)

    for module in (scan, graph, clones, repositories):
        monkeypatch.setattr(module, "materialize", recorded)
    found = scan.scan(generated.tree(spark, sf_dir), generated.parse(generated.CONFIG))
    w = found.workspace
    shown = [("findings", found.findings), ("suppressed", found.suppressed), ("coarse", found.package_graph(2, 2)[1]), ("external", w.external)]
    plans += [(label, df._jdf.queryExecution().sparkPlan().toString()) for label, df in shown]
    broadcasts = [(label, line.strip()) for label, plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    # of a scan's tables only the ignore rules, a row per repository of measured size, are sent to all executors
    assert len(plans) > 10 and not [x for x in broadcasts if not re.search(r"Join \[repo_id#\d+\], \[repo_id#\d+\], LeftOuter, BuildRight", x[1])]


def test_rounds_over_a_large_graph_broadcast_nothing(spark, monkeypatch):
    plans = []

    def recorded(df, label="step"):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return session.materialize(df, label)

    monkeypatch.setattr(graph, "materialize", recorded)
    pairs = [(i, i // 3) for i in range(1, 200)] + [(i // 3, i) for i in range(1, 200, 7)]
    edges = spark.createDataFrame([("r", f"p{a}", f"p{b}") for a, b in pairs], "repo_id string, src string, dst string")
    found = {r.node: (r.comp, r.size) for r in graph.strong_components(edges, 10).collect()}
    want = {x: (part[0], len(part)) for part in graph.tarjan((f"p{a}", f"p{b}") for a, b in pairs if a != b) for x in part}
    assert found == want and len(plans) > 10
    # the names of the large graphs are few, their nodes and edges are not
    assert not [p for p in plans if re.search(r"BroadcastHashJoin \[repo_id#\d+, ", p)]
