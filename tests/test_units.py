import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repolens.functions import paths, scoring
from repolens.functions.globs import any_glob, glob_to_regex
from repolens.operators import clones, graph, joins
from repolens.sources.frontends import extract
from repolens.sources.frontends.common import annotation, role_of, suppression
from repolens.sources.frontends.lexer import Lexer
from repolens.sources.repositories import dependency_name, parse_manifest, strip_jsonc


@pytest.mark.parametrize(("glob", "yes", "no"), [("**/cli/*.{ts,py}", ["cli/a.ts", "a/b/cli/x/y.py"], ["cli/a.js"]), ("src/**", ["src/a", "src/a/b"], ["src", "lib/a"]), ("a?[0-9].ts", ["ab1.ts"], ["ab.ts"]), ("*.test.ts", ["a/b.test.ts"], ["a.ts"])])
def test_globs(glob, yes, no):
    r = re.compile(glob_to_regex(glob))
    assert all(r.search(x) for x in yes) and not any(r.search(x) for x in no)


def test_invalid_globs():
    assert glob_to_regex("{a") is None and glob_to_regex("[a") is None
    assert not re.search(any_glob(["{a"]), "a")


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../../../c//d",), ("x",), ("",)], "p string")
    assert [r[0] for r in df.select(paths.normalize(F.col("p"))).collect()] == ["c/d", "x", ""]
    assert [r[0] for r in spark.createDataFrame([("a/b/c.ts",), ("c.ts",)], "p string").select(paths.ancestors(paths.parent(F.col("p")))).collect()] == [["a/b", "a", ""], [""]]


def test_crap(spark):
    assert [round(r[0], 2) for r in spark.createDataFrame([(5, 0.0), (5, 100.0), (5, 85.0)], "c int, v double").select(scoring.crap(F.col("c"), F.col("v"))).collect()] == [30.0, 5.0, 5.08]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=60), st.integers(1, 9))
def test_window_hashes_match_windows(tokens, size):
    t = np.array(tokens, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = clones.window_hashes(t, size, 0xD6E8FEB86659FD93)
    windows = [tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)]
    assert len(h) == len(windows)
    for i in range(len(h)):
        for j in range(i):
            assert (h[i] == h[j]) == (windows[i] == windows[j])


def test_overlap_and_renaming():
    assert clones.without_overlap([0, 3, 5, 9, 10, 20], 5) == [0, 5, 10, 20]
    assert clones.alpha_key(["x", "y", "x", "z"]) == (0, 1, 0, 3) == clones.alpha_key(["a", "b", "a", "c"])


@settings(max_examples=50, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=24))
def test_tarjan_is_mutual_reachability(pairs):
    edges = [(str(a), str(b)) for a, b in pairs if a != b]
    reach = {n: {n} for e in edges for n in e}
    for _ in reach:
        for a, b in edges:
            for n in reach:
                if a in reach[n]:
                    reach[n] |= reach[b]
    want = {frozenset(m for m in reach if m in reach[n] and n in reach[m]) for n in reach}
    assert {frozenset(x) for x in graph.tarjan(edges)} == {w for w in want if len(w) > 1}


def test_reachability_loop_and_group_agree(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "d", "e"), ("q", "a", "d"), ("r", "x", "x")], "repo_id string, src string, dst string")
    seeds = spark.createDataFrame([("r", "all", "a"), ("q", "test", "a"), ("r", "all", "a")], "repo_id string, seed_class string, node string")
    want = {("r", "all", "a"), ("r", "all", "b"), ("r", "all", "c"), ("q", "test", "a"), ("q", "test", "d")}
    assert {tuple(r) for r in graph.reachable(edges, seeds).collect()} == want
    assert {tuple(r) for r in graph.reachable_per_repo(edges, seeds).collect()} == want
    for most in (0, 1, 10_000):  # by rounds, both ways, in one task
        assert {tuple(r) for r in graph.reachable(edges, seeds, most).collect()} == want


def test_components_of_large_graphs(spark):
    rng = random.Random(4)
    rows = [("a", f"d{rng.randrange(5)}/n{rng.randrange(40)}", f"d{rng.randrange(5)}/n{rng.randrange(40)}") for _ in range(170)]
    rows += [("b", f"m{i}", f"m{(i + 1) % 30}") for i in range(30)] + [("b", "m3", "x"), ("b", "x", "y"), ("b", "y", "x"), ("c", "p", "q"), ("c", "q", "r"), ("d", "s", "t"), ("d", "t", "s")]
    edges = spark.createDataFrame(rows, "repo_id string, src string, dst string")
    want = {(repo, part[0], x, len(part)) for repo in "abcd" for part in graph.tarjan([(a, b) for r, a, b in rows if r == repo and a != b]) for x in part}
    assert len(want) > 35
    for most in (0, 100, 10_000):
        assert {tuple(r) for r in graph.strong_components(edges, most).collect()} == want
    assert graph.strong_components(edges.limit(0)).count() == 0 and graph.components_by_colour(edges.limit(0)).count() == 0


def test_prefix_owner_without_owner(spark):
    items = spark.createDataFrame([("r", "a/b/c.ts"), ("r", "z.ts"), ("q", "a/x.ts")], "repo_id string, path string")
    owners = spark.createDataFrame([("r", "a", "A"), ("r", "a/b", "B")], "repo_id string, root string, owner string")
    assert {(r["repo_id"], r["path"]): r["owner"] for r in joins.prefix_owner(items, owners, F.col("path")).collect()} == {("r", "a/b/c.ts"): "B", ("r", "z.ts"): None, ("q", "a/x.ts"): None}


def test_manifests():
    assert parse_manifest("package.json", "{broken") == {"name": None, "dependencies": [], "entries": [], "base_url": None, "aliases": []}
    assert parse_manifest("package.json", '{"name": "x", "main": "m.js", "bin": {"a": "b.js"}, "devDependencies": {"z": "1"}, "dependencies": {"y": "1"}}')["entries"] == ["m.js", "b.js"]
    assert parse_manifest("pyproject.toml", '[project]\nname = "p"\ndependencies = ["a[x]>=1; python_version>\'3\'"]\nscripts = {run = "m.cli:main"}\n[tool.poetry.dependencies]\npython = "3"\nq = "1"\n') == {"name": "p", "dependencies": ["a", "q"], "entries": ["m.cli"], "base_url": None, "aliases": []}
    assert dependency_name("uvicorn[standard]>=1") == "uvicorn"
    assert strip_jsonc('{"a": "//x", /* c */ "b": [1,], // t\n}') == '{"a": "//x",  "b": [1] \n}'


def test_roles_and_tags():
    assert [role_of(x) for x in ("a/__init__.py", "b.pyi", "c.d.ts", "vite.config.ts", ".eslintrc.js", "d.css")] == ["PackageInit", "TypeDecl", "TypeDecl", "Config", "Config", "Source"]
    assert suppression("// lint-ignore-file unused-export -- old", 3) == {"rule": "unused-export", "file_scoped": True, "line": 3, "reason": "old"}
    assert suppression("// lint-ignore-next-line", 3) is None
    assert annotation("/**\n * @internal -- why\n */", 9) == {"visibility": "Internal", "line": 9, "reason": "why"}
    assert annotation("// mentions @public inside", 9) is None


def test_python_front_end():
    f = extract("m.py", "import a.b as c\nfrom .x import y, z as w\nfrom q import *\n__all__ = ['k']\ndef f(p, gone=1):\n    if p and c:\n        return [i for i in y if i]\n    elif w:\n        return 2\n    else:\n        return 3\n")
    assert [(i["specifier"], i["is_namespace"], [n["local"] for n in i["names"]]) for i in f["imports"]] == [("a.b", True, ["c"]), (".x", False, ["y", "w"]), ("q", True, [])]
    assert [(x["cyclomatic"], x["cognitive"]) for x in f["functions"]] == [(4, 4)]
    assert [s["name"] for s in f["symbols"]] == ["f", "gone"] and f["exports"][0]["name"] == "k"
    broken = extract("m.py", "import os\ndef f(:\n    os.x\n")
    assert broken["imports"][0]["specifier"] == "os" and "x" in broken["member_access"]


def test_script_front_end():
    f = extract("m.ts", 'const re = /a"b/g; const t = `x ${a.b + `${c}`} y`;\nexport const fn = (x: number) => x ? 1 : 2;\nexport { fn as other };\nconst { d, e: g } = obj;\n')
    assert {"a", "c", "fn", "obj", "d"} <= set(f["refs"]) and "b" in f["member_access"] and "e" not in f["refs"]
    assert {e["name"] for e in f["exports"]} == {"fn", "other"}
    assert [(x["name"], x["cyclomatic"], x["cognitive"]) for x in f["functions"]] == [("fn", 2, 1)]
    t = extract("m.tsx", "const X = <A b={c}>it's <i>fine</i> {d && <E />}</A>;\nfunction g<T>(v: T) { return v }\n")
    assert {"A", "c", "d", "E", "i", "X"} <= set(t["refs"]) and [s["name"] for s in t["symbols"]] == ["X", "g"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab<>/{}()[]`'\"$\\;:=.,?!&|#@*\n import export class function", max_size=80), st.sampled_from(["a.ts", "a.tsx", "a.js", "a.py", "a.css"]))
def test_front_ends_never_fail(text, path):
    extract(path, text)


def test_lexer_keeps_comments_apart():
    lexer = Lexer("a // x\n/* y\n */ b", False)
    assert [t.text for t in lexer.tokens()] == ["a", "b"] and [(c, a, b) for c, a, b in lexer.comments] == [("// x", 1, 1), ("/* y\n */", 2, 3)]


def naive_clones(files, size):
    groups = {}
    for p, s in files.items():
        for i in range(len(s) - size + 1):
            groups.setdefault(tuple(s[i : i + size]), []).append((p, i))
    out = set()
    for places in groups.values():
        if len(places) < 2 or len({files[p][i - 1] if i else ("start", p) for p, i in places}) < 2:
            continue
        length = size
        while all(i + length < len(files[p]) for p, i in places) and len({files[p][i + length] for p, i in places}) == 1:
            length += 1
        kept = []
        for path in sorted({p for p, _ in places}):
            kept += [(path, i) for i in clones.without_overlap([i for p, i in places if p == path], length)]
        if len(kept) >= 2:
            out.add((length, tuple(kept)))
    return out


def test_clone_groups_against_naive_search(spark):
    import random

    rng = random.Random(4)
    schema = "repo_id string, family string, path string, texts array<string>, kinds array<string>, lines array<int>, ends array<boolean>"
    every = {f"r{k}": {f"d/f{j}": [rng.choice("abc") for _ in range(rng.randint(0, 40))] for j in range(4)} for k in range(5)}
    df = spark.createDataFrame([(r, "js", p, s, ["punct"] * len(s), list(range(len(s))), [True] * len(s)) for r, files in every.items() for p, s in files.items()], schema)
    rows = clones.clone_groups(df, 4, "exact").collect()
    for repo, files in every.items():
        got = {(r["length"], tuple((m["path"], m["start"]) for m in r["members"])) for r in rows if r["repo_id"] == repo}
        assert got == naive_clones(files, 4)
