"""Repeated windows against a plain count, and how they are shuffled."""

import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from repolens import session
from repolens.operators import clones
from repolens.plans import generated, table_queries
from repolens.session import ship
from repolens.sources import repositories


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [rng.choice("abcdef") * rng.randint(1, 3) for _ in range(90)]
    rows = [(i, rng.choice(["x", "y", None]), " ".join(words[a : a + rng.randint(0, 60)])) for i in range(120) for a in [rng.randrange(80)]]
    return [*rows, (None, "x", " ".join(words[:40])), (900, "y", None), (901, "y", ""), *((1000 + i, "x", " ".join(["same"] * 30)) for i in range(9))]


def brute(texts, size, mark):
    """Places, and values of mark (row, words, start), of each window that occurs twice or more."""
    places, marks, without = defaultdict(list), defaultdict(set), Counter()
    for row in texts:
        w = (row[2] or "").split()
        for start in range(len(w) - size + 1):
            g = tuple(w[start : start + size])
            places[g].append((row[0], start))
            value = mark(row, w, start)
            marks[g] |= {value} - {None}
            without[g] += value is None
    return {g: (p, len(marks[g]), without[g]) for g, p in places.items() if len(p) > 1}


@pytest.mark.parametrize("buffer", [1_000_000, 50])
def test_repeated_windows_are_what_counting_finds(spark, texts, monkeypatch, buffer):
    ship(spark)
    monkeypatch.setattr(clones, "BUFFER", buffer)
    files = spark.createDataFrame(texts, "doc_id long, source string, text string").repartition(3)
    before, source = brute(texts, 8, lambda row, w, start: w[start - 1] if start else None), brute(texts, 8, lambda row, w, start: row[1])
    found = lambda **how: clones.repeated(files, 8, "text", **how)
    assert Counter((r.n, r.n_prev, r.at_start) for r in found().collect()) == Counter((len(p), k, z) for p, k, z in before.values())
    assert Counter((r.n, r.n_prev, r.at_start) for r in found(of="source").collect()) == Counter((len(p), k, z) for p, k, z in source.values())
    assert Counter((r.doc_id, r.start, r.n) for r in found(file="doc_id").collect()) == Counter((*x, len(p)) for p, *_ in before.values() for x in p)
    assert Counter((r.doc_id, r.start, r.n) for r in found(file="doc_id", leftmost=True).collect()) == Counter((*x, len(p)) for p, k, z in before.values() if k + z > 1 for x in p)
    apart = brute([(r[0], r[1], " ".join(f"{r[1]}:{x}" for x in (r[2] or "").split())) for r in texts], 8, lambda row, w, start: w[start - 1] if start else None)
    assert Counter(r.n for r in found(by=["source"]).collect()) == Counter(len(p) for p, *_ in apart.values())


def test_windows_are_shuffled_once_and_packed(spark, sf_dir):
    for name in ("clone_windows_exact", "clone_left_maximal", "clone_cross_source"):
        plan = table_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
        assert "share" in plan and "Join" not in plan and plan.count("Exchange") - plan.count("hashpartitioning(n") == 1, plan


@pytest.mark.parametrize("mode", ["exact", "semantic"])
def test_groups_are_joined_by_shuffle_and_blocks_made_once(spark, sf_dir, monkeypatch, mode):
    ship(spark)
    plans = []
    plan_of = lambda df: df._jdf.queryExecution().sparkPlan().toString()

    def recorded(df, label="step"):
        plans.append(plan_of(df))
        return session.materialize(df, label)

    monkeypatch.setattr(clones, "materialize", recorded)
    streams = repositories.token_streams(repositories.source_files(generated.tree(spark, sf_dir).filter("repo_id = 'g1'")))
    groups = clones.clone_groups(streams, 20, mode)
    plans.append(plan_of(groups))
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans if "part.parquet" not in p)
    assert plans[-1].count("MapInArrow") == 1
    # members of a group show the same tokens from their starts on, one more they do not all show
    words = {(r.repo_id, r.path): list(zip(r.texts, r.kinds)) for r in streams.collect()}
    alike = {"exact": (), "semantic": ("num", "str", "ident")}[mode]
    coded = lambda t: [k if k in alike else (k, x) for x, k in t]
    rows = groups.select("repo_id", "length", F.explode("members").alias("m"), "fingerprint").collect()
    assert rows
    for r in rows:
        block = coded(words[r.repo_id, r.m.path][r.m.start : r.m.start + r.length])
        assert len(block) == r.length
        assert coded(words[r.repo_id, (first := next(x for x in rows if (x.repo_id, x.fingerprint, x.length) == (r.repo_id, r.fingerprint, r.length))).m.path][first.m.start : first.m.start + r.length]) == block
