"""The pipeline's near-dedup stage against brute force."""

import random

import pytest

import corpus_pipeline
from repolens.llm import simhash, similar
from tests.llm.test_text_ops import brute_fingerprint, lowered


def shingles(text):
    w = lowered(text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(i for i in sets if find(i) == i)


def corpus():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    common = [word() for _ in range(25)]
    texts = []
    for n in range(12):
        base = [word() for _ in range(rng.choice((90, 150, 240)))]
        for _ in range(8):  # copies with a few words changed: similarities from about 0.6 to 1
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    base = [word() for _ in range(200)]
    for _ in range(40):  # a large group, linked by chains
        base[rng.randrange(200)] = word()
        texts.append(" ".join(base))
    texts += [" ".join([*common, *(word() for _ in range(60))]) for _ in range(30)]
    texts += ["", None, "one two", "ONE  two", "a b c d e f"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("frequent", [0, 100_000])
def test_stage_keeps_one_of_each_similar_group(spark, sf_dir, monkeypatch, frequent):
    monkeypatch.setattr(similar, "FREQUENT", frequent)
    rows = corpus()
    far = sum((brute_fingerprint(a) ^ brute_fingerprint(b)).bit_count() > 4 for i, a in rows for j, b in rows if i < j and a and b and 5 * len(shingles(a) & shingles(b)) >= 4 * len(shingles(a) | shingles(b)))
    assert far > 20  # pairs that four bits do not link
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, df, sf_dir).collect()) == brute_kept(rows)


def test_stage_on_a_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, sf_dir).collect()) == brute_kept(rows)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_small_graphs_take_few_jobs(spark, monkeypatch, shape):
    """One task joins as the rounds do; every job of a round would hold memory of the driver."""
    r = random.Random(3)
    pairs = {
        "chain": [(i * 7919 % 2003 - 1000, (i + 1) * 7919 % 2003 - 1000) for i in range(300)], "star": [(-5, i) for i in range(200)] + [(9, 9), (3, -5)],
        "random": [(r.randrange(-200, 200), r.randrange(-200, 200)) for _ in range(180)], "none": [],
    }[shape]
    edges = spark.createDataFrame(pairs, "a long, b long")
    context = spark.sparkContext
    context.setJobGroup(f"components-{shape}", "")
    got = sorted(map(tuple, simhash.components(edges).collect()))
    jobs = len(context.statusTracker().getJobIdsForGroup(f"components-{shape}"))
    context.setJobGroup("rest", "")
    monkeypatch.setattr(simhash, "ONE_TASK_LINKS", -1)
    assert got == sorted(map(tuple, simhash.components(edges).collect()))
    assert jobs <= 8
