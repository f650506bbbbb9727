"""Graph operators over ``edges(repo_id, src, dst)``: reachability, strong components, coarse graphs."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions import paths
from repolens.session import by_shuffle, forget, materialize


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Adjacency as a set, without self-edges."""
    return edges.filter(F.col("src") != F.col("dst")).select("repo_id", "src", "dst").distinct()


#: A repository of so many edges at most is walked in one task; larger graphs take rounds over all executors.
GRAPH_EDGES = 100_000
#: Steps along the edges in one round.
HOPS = 3


def split_by_size(edges: DataFrame, most: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """The edges of repositories that one task can walk, and those of larger ones; None where there are none."""
    large = edges.groupBy("repo_id").count().filter(F.col("count") > (GRAPH_EDGES if most is None else most)).select("repo_id")
    if large.isEmpty():
        return edges, None
    large = materialize(large, "large")
    small = edges.join(large, "repo_id", "left_anti")
    return (None if small.isEmpty() else small), edges.join(large, "repo_id", "left_semi")


def reachable(edges: DataFrame, seeds: DataFrame, most_edges: int | None = None) -> DataFrame:
    """(repo_id, seed_class, node) for every node that a seed reaches, seeds included.

    Repositories of GRAPH_EDGES at most go through one task each, all others through reachable_by_rounds.
    """
    edges = materialize(distinct_edges(edges), "edges")
    seeds = seeds.select("repo_id", "seed_class", "node").distinct()
    _, large = split_by_size(edges, most_edges)
    if large is None:
        return reachable_per_repo(edges, seeds)
    seeds = materialize(seeds, "seeds")
    of = large.select("repo_id").distinct()
    rounds = reachable_by_rounds(large, seeds.join(of, "repo_id", "left_semi"))
    return rounds.unionByName(reachable_per_repo(edges.join(of, "repo_id", "left_anti"), seeds.join(of, "repo_id", "left_anti")))


def reachable_by_rounds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The same for graphs of any size.

    Semi-naive rounds of HOPS steps: only the last round's new nodes are joined to the edges. All seed classes and
    repositories run in the same rounds; each round is a written table, so the plan stays short and no executor's loss
    costs more than a round. Rounds end when one finds nothing new, which a finite graph always comes to.
    """
    edges = materialize(distinct_edges(edges).select("repo_id", F.col("src").alias("node"), "dst"), "edges")
    visited = frontier = materialize(seeds.select("repo_id", "seed_class", "node").distinct(), "reach")
    turn = 0
    while True:
        step, found = frontier, []
        for _ in range(HOPS):
            step = step.join(by_shuffle(edges), ["repo_id", "node"]).select("repo_id", "seed_class", F.col("dst").alias("node")).distinct()
            found.append(step)
        new = found[0]
        for more in found[1:]:
            new = new.unionByName(more)
        frontier = materialize(new.distinct().join(by_shuffle(visited), ["repo_id", "seed_class", "node"], "left_anti"), "reach")
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)
        turn += 1
        if turn % 4 == 0:  # else the plan reads a table for every round so far
            visited = materialize(visited, "reach")


def reachable_per_repo(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The same in one pass, a repository's graph at a time: for repositories that each fit a worker."""

    names = ["repo_id", "seed_class", "node"]

    def walk(e: pa.Table, s: pa.Table) -> pa.Table:
        n, many = e.num_rows, s.num_rows
        coded = pa.chunked_array([*e["src"].chunks, *e["dst"].chunks, *s["node"].chunks], type=pa.string()).combine_chunks().dictionary_encode()
        code, nodes = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        order = np.argsort(code[:n], kind="stable")
        target = code[n : 2 * n][order]
        first = np.searchsorted(code[:n][order], np.arange(nodes + 1))
        start, kind = code[2 * n :], np.array(s["seed_class"].to_pylist(), dtype=object)
        places, kinds = [], []
        for one in sorted(set(kind)):
            seen = np.zeros(nodes, dtype=bool)
            now = np.unique(start[kind == one])
            while len(now):  # a whole front at a time
                seen[now] = True
                size = first[now + 1] - first[now]
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[now], size)
                now = np.unique(target[at])
                now = now[~seen[now]]
            found = np.flatnonzero(seen)
            places.append(found)
            kinds += [one] * len(found)
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        repo = [s["repo_id"][0].as_py()] * len(at) if many else []
        return pa.table([pa.array(repo, type=pa.string()), pa.array(kinds, type=pa.string()), coded.dictionary.take(pa.array(at))], names=names)

    return edges.select("repo_id", "src", "dst").groupBy("repo_id").cogroup(seeds.select("repo_id", "seed_class", "node").groupBy("repo_id")).applyInArrow(walk, "repo_id string, seed_class string, node string")


def tarjan(edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Strong components of more than one node, members sorted; iterative."""
    following: dict[str, list[str]] = {}
    for a, b in edges:
        following.setdefault(a, []).append(b)
        following.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    on: set[str] = set()
    out = []
    for root in sorted(following):
        if root in index:
            continue
        work = [(root, iter(following[root]))]
        index[root] = low[root] = len(index)
        held.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for b in rest:
                if b not in index:
                    index[b] = low[b] = len(index)
                    held.append(b)
                    on.add(b)
                    work.append((b, iter(following[b])))
                    break
                if b in on:
                    low[node] = min(low[node], index[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        part.append(held.pop())
                        on.discard(part[-1])
                        if part[-1] == node:
                            break
                    if len(part) > 1:
                        out.append(sorted(part, key=lambda p: p.split("/")))
    return sorted(out, key=lambda m: (len(m), m[0].split("/")))


def strong_components(edges: DataFrame, most_edges: int | None = None) -> DataFrame:
    """(repo_id, comp, node, size) for every node on a cycle; comp is the component's first node in path order.

    Edges that can be on no cycle are cut first. What is left of a repository goes through one task if it has GRAPH_EDGES
    at most, and else through components_by_colour.
    """
    small, large = split_by_size(on_cycles(distinct_edges(edges)), most_edges)
    if large is None:
        return _components_per_repo(small)
    found = components_by_colour(large)
    return found if small is None else found.unionByName(_components_per_repo(small))


def _components_per_repo(edges: DataFrame) -> DataFrame:
    def run(e: pd.DataFrame) -> pd.DataFrame:
        rows = [(e["repo_id"].iloc[0], part[0], x, len(part)) for part in tarjan(zip(e["src"], e["dst"])) for x in part]
        return pd.DataFrame(rows, columns=["repo_id", "comp", "node", "size"])

    return edges.select("repo_id", "src", "dst").groupBy("repo_id").applyInPandas(run, "repo_id string, comp string, node string, size int")


def on_cycles(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """The edges without those that some ``rounds`` of cutting show to be on no cycle: out of a node nobody points to, or into one that points nowhere."""
    e = materialize(edges.select("repo_id", "src", "dst"), "cycles")
    for _ in range(rounds):
        e = e.join(by_shuffle(e.select("repo_id", F.col("dst").alias("src")).distinct()), ["repo_id", "src"], "left_semi")
        e = e.join(by_shuffle(e.select("repo_id", F.col("src").alias("dst")).distinct()), ["repo_id", "dst"], "left_semi")
        e = materialize(e.select("repo_id", "src", "dst"), "cycles")
    return e


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """Each node's colour (repo_id, node, colour) after it was spread along the edges (repo_id, src, dst) until nothing changes: the least that reaches it."""
    while True:
        step = colour
        for _ in range(HOPS):
            sent = edges.join(by_shuffle(step.withColumnRenamed("node", "src")), ["repo_id", "src"]).select("repo_id", F.col("dst").alias("node"), "colour")
            step = step.unionByName(sent).groupBy("repo_id", "node").agg(F.min("colour").alias("colour"))
        after = materialize(step, "colours")
        changed = not after.join(by_shuffle(colour), ["repo_id", "node", "colour"], "left_anti").isEmpty()
        forget(colour)
        colour = after
        if not changed:
            return colour


def components_by_colour(edges: DataFrame) -> DataFrame:
    """Strong components of graphs of any size, by forward and backward rounds.

    Every node takes the least node that reaches it as its colour; the nodes that reach their colour's own node along edges
    of one colour are its component. These are taken out, with the edges between colours, until no edges are left;
    every turn takes out a component of each colour at least.
    """
    edges = materialize(edges.select("repo_id", "src", "dst"), "graph")
    out = None
    while not edges.isEmpty():
        nodes = edges.select("repo_id", F.col("src").alias("node")).union(edges.select("repo_id", F.col("dst").alias("node"))).distinct()
        colour = _spread(edges, materialize(nodes.withColumn("colour", F.split("node", "/")), "colours"))
        of = lambda c: colour.select("repo_id", F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))
        same = edges.join(by_shuffle(of("src")), ["repo_id", "src"]).join(by_shuffle(of("dst")), ["repo_id", "dst"]).filter("src_colour = dst_colour")
        same = materialize(same.select("repo_id", "src", "dst"), "graph")
        # backwards from each colour's own node, within the colour
        roots = colour.filter(F.array_join("colour", "/") == F.col("node")).select("repo_id", F.lit("root").alias("seed_class"), "node")
        back = reachable_by_rounds(same.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst")), roots)
        part = materialize(back.select("repo_id", "node").join(by_shuffle(colour), ["repo_id", "node"]), "part")
        sizes = part.groupBy("repo_id", "colour").agg(F.count(F.lit(1)).cast("int").alias("size")).filter("size > 1")
        found = materialize(part.join(by_shuffle(sizes), ["repo_id", "colour"]).select("repo_id", F.array_join("colour", "/").alias("comp"), "node", "size"), "components")
        out = found if out is None else out.unionByName(found)
        left = same.join(by_shuffle(part.select("repo_id", F.col("node").alias("src"))), ["repo_id", "src"], "left_anti").join(by_shuffle(part.select("repo_id", F.col("node").alias("dst"))), ["repo_id", "dst"], "left_anti")
        rest = on_cycles(left, 1)
        forget(edges, same, colour, part)
        edges = rest
    return out if out is not None else edges.select("repo_id", F.col("src").alias("comp"), F.col("dst").alias("node"), F.lit(0).alias("size"))


def ancestor_directories(files: DataFrame, path: str = "path") -> DataFrame:
    """(repo_id, dir): every directory at or above a file."""
    return files.select("repo_id", F.explode(paths.ancestors(paths.parent(F.col(path)))).alias("dir")).distinct()


def test_coverage(files: DataFrame, edges: DataFrame, reach: DataFrame, tests: DataFrame) -> DataFrame:
    """(repo_id, path, coverage): 85 where a test imports the file itself, 40 where tests reach it, else 0."""
    direct = edges.join(by_shuffle(tests.select("repo_id", F.col("path").alias("src"))), ["repo_id", "src"], "left_semi").select("repo_id", F.col("dst").alias("path")).distinct().withColumn("direct", F.lit(True))
    by_test = reach.filter("seed_class = 'test'").select("repo_id", F.col("node").alias("path")).distinct().withColumn("reached", F.lit(True))
    joined = files.select("repo_id", "path").join(by_shuffle(direct), ["repo_id", "path"], "left").join(by_shuffle(by_test), ["repo_id", "path"], "left")
    return joined.select("repo_id", "path", F.when(F.col("direct"), 85.0).when(F.col("reached"), 40.0).otherwise(0.0).alias("coverage"))


def coarse_graph(nodes: DataFrame, edges: DataFrame, min_weight: int = 1, max_nodes: int = 40) -> tuple[DataFrame, DataFrame]:
    """Nodes and weighted edges of buckets.

    nodes: (repo_id, node, bucket, label); edges: (repo_id, src, dst). Buckets are ordered by (label, bucket) and
    the first max_nodes kept; edges within a bucket do not count, and light ones are dropped.
    """
    counted = nodes.groupBy("repo_id", "bucket").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("files"))
    kept = counted.withColumn("n", F.row_number().over(Window.partitionBy("repo_id").orderBy("label", "bucket"))).filter(F.col("n") <= max_nodes).drop("n")
    of = nodes.join(by_shuffle(kept.select("repo_id", "bucket")), ["repo_id", "bucket"], "left_semi").select("repo_id", "node", "bucket")
    a, b = of.select("repo_id", F.col("node").alias("src"), F.col("bucket").alias("from")), of.select("repo_id", F.col("node").alias("dst"), F.col("bucket").alias("to"))
    heavy = edges.join(by_shuffle(a), ["repo_id", "src"]).join(by_shuffle(b), ["repo_id", "dst"]).filter(F.col("from") != F.col("to")).groupBy("repo_id", "from", "to").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= min_weight)
    return kept, heavy


def bucket_of(path, root, depth: int):
    """Bucket key of a file below a package root: the root at depth 0, else the first ``depth`` segments (the last one's stem)."""
    inner = F.when(root == "", path).otherwise(F.expr("''") if root is None else F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path))
    parts = F.split(inner, "/")
    named = F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")))
    return root if depth == 0 else F.array_join(F.slice(named, 1, depth), "/")
