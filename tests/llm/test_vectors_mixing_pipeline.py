"""Nearest neighbours, mixing and the pipeline against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from repolens.llm import mixing, neighbours, packing, quality, queries, rules
from tests.llm.test_similar import brute_kept


def brute_nearest(rows, k=20):
    out = {}
    usable = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and None not in v and len(v) == 8 and np.isfinite(np.array(v, dtype=float)).all() and np.any(np.array(v, dtype=float) != 0)]
    for q, x in usable:
        if q % 20 == 0:
            out[q] = sorted((-(x * y).sum(), i) for i, y in usable if i != q)[:k]
    return out


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(700, 8)) * rng.uniform(0.2, 3, (700, 1)))]
    rows += [(700 + i, rows[0][1]) for i in range(60)]  # ties
    rows += [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (920, [1.0, 2.0]), (921, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    want = brute_nearest(rows)
    for shard_rows, block in ((16_384, 32_768), (40, 32_768), (40, 7), (16_384, 7)):
        monkeypatch.setattr(neighbours, "QUERY_BLOCK", block)
        got: dict = {}
        for r in neighbours.nearest(df, shard_rows=shard_rows).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        assert set(got) == set(want)
        hits = total = 0
        for q, best in want.items():
            assert sorted(got[q]) == list(range(1, len(best) + 1))
            hits += len({i for _, i in best} & {i for i, _ in got[q].values()})
            total += len(best)
            assert [s for _, (_, s) in sorted(got[q].items())] == sorted((s for _, s in got[q].values()), reverse=True)
        assert hits / total >= 0.9
    assert [i for _, i in want[0]] == [got[0][k][0] for k in range(1, 21)]  # sixty equal vectors: the smallest ids
    assert neighbours.nearest(df.limit(0)).count() == 0
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 0.0)]


def test_recall_on_whole_table(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(e["embedding"].to_numpy()).astype(float), e["vec_id"].to_numpy()
    got = queries.op3_nearest_neighbours(spark, sf_dir).toPandas()
    hits = total = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[np.searchsorted(ids, q)]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g["vec_id"]))
        total += 20
    assert total == 20 * (ids % 20 == 0).sum() and hits / total >= 0.9


def test_chi_square_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(neighbours.chi_square_quantile(0.5, 2) - 1.3863) < 1e-3


@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 3, 2], [97, 2, 1], [7, 7, 7, 1, 13]])
def test_period_is_fair(weights):
    turns, count, total = mixing.period(weights), [0] * len(weights), sum(weights)
    for t, s in enumerate(turns):
        count[s] += 1
        assert all(abs(c * total - w * (t + 1)) < total for c, w in zip(count, weights))
    assert count == weights


def test_phases_place_every_block():
    weights, blocks = [3, 2, 1], [2, 9, 4]
    order = []
    plan = mixing.phases(weights, blocks)
    for (start, turns, done), following in zip(plan, [*(p[0] for p in plan[1:]), sum(blocks)]):
        assert start == len(order) and Counter(order) == Counter({k: v for k, v in done.items() if v})
        order += [turns[t % len(turns)] for t in range(following - start)]
    assert Counter(order) == Counter(dict(enumerate(blocks)))


def brute_order(weights, blocks):
    """The source of every slot: earliest deadline first, slot by slot, over all blocks."""
    left, out, start, done = list(blocks), [], 0, [0] * len(blocks)
    alive = None
    while any(left):
        now = [i for i, n in enumerate(left) if n]
        w = {i: weights[i] for i in now if weights[i]} or dict.fromkeys(now, 1)
        if alive != list(w):
            alive, start, done = list(w), len(out), [0] * len(blocks)
        total, t = sum(w.values()), len(out) - start
        ready = [(-(-(done[i] + 1) * total // w[i]), i) for i in w if done[i] * total // w[i] <= t]
        _, i = min(ready)
        out.append(i)
        done[i] += 1
        left[i] -= 1
    return out


def brute_positions(df, weights, block, other=1):
    """position of each (source, h, h2, id) by brute force."""
    body = F.xxhash64("text")
    rows = df.select("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.shiftrightunsigned(F.xxhash64("doc_id", body, F.lit(4)), 2).alias("h"), body.alias("h2")).collect()
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r["s"], []).append((r["h"], r["h2"], r["doc_id"] is not None, r["doc_id"] or 0))
    names = sorted(by_source)
    given = mixing.tempered({k: len(v) for k, v in by_source.items()}) if weights is None else weights
    queues = {k: sorted(v) for k, v in by_source.items()}
    order = brute_order(mixing.whole([given.get(k, other) for k in names]), [-(-len(queues[k]) // block) for k in names])
    out = []
    for i in order:
        mine = queues[names[i]]
        out += [(names[i], x[3] if x[2] else None) for x in mine[:block]]
        del mine[:block]
    return out


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    monkeypatch.setattr(mixing, "GROUP", 4)
    monkeypatch.setattr(mixing, "PART_ROWS", 40)
    rows = [(i, f"t{i}", s, "x") for i, s in enumerate(["a"] * 100 + ["b"] * 37 + [None] * 11 + ["c"] * 3)] + [(5, "t5", "a", "x")] * 2 + [(None, None, "b", None), (None, "z", "b", None), (None, "z", "d", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string")
    for weights, ranges in (({"a": 5, "b": 3}, 1 << 16), ({"a": 50_000, "b": 30_011, "c": 0, "": 0}, 7), ({"a": 0, "b": 0, "c": 0, "d": 0, "": 0}, 64), (None, 2)):
        monkeypatch.setattr(mixing, "RANGES", ranges)
        got = sorted(mixing.mix(df, weights, block=4).collect(), key=lambda r: r["position"])
        assert [r["position"] for r in got] == list(range(len(rows)))
        assert [(r["source"], r["doc_id"]) for r in got] == brute_positions(df, weights, 4)
    assert mixing.mix(df.limit(0)).count() == 0
    mixed = mixing.in_order(df, weights, block=4)
    assert mixed.columns == df.columns
    assert [(r["source"] or "", r["doc_id"]) for r in mixed.collect()] == [(r["source"], r["doc_id"]) for r in got]
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": -1})


def test_mix_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(queries.op4_mixing_sources(spark, sf_dir).collect(), key=lambda r: r["position"])
    assert [(r["source"], r["doc_id"]) for r in got] == brute_positions(docs, None, mixing.BLOCK)


def test_more_sources_than_are_scheduled_at_once(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 6)
    monkeypatch.setattr(mixing, "BUNDLE", 4)
    rows = [(i, f"t{i}", f"s{i * i % 41}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter(s for _, _, s in rows)
    for weights in (None, dict.fromkeys(sizes, 1)):
        got = sorted(mixing.mix(df, weights, block=4).collect(), key=lambda r: r["position"])
        assert [r["position"] for r in got] == list(range(900)) and sorted(r["doc_id"] for r in got) == list(range(900))
        slots: dict = {}
        for r in got:
            slots.setdefault(r["slot"], set()).add((r["source"], r["block_no"]))
        assert all(len(v) == 1 for v in slots.values()) and sorted(slots) == list(range(len(slots)))
        order = [next(iter(slots[t])) for t in sorted(slots)]
        for name in sizes:  # a source's blocks keep their order
            assert [b for s, b in order if s == name] == list(range(-(-sizes[name] // 4)))
    share = len(sizes)  # equal weights: until the first source runs out none is far from its share
    first = min(max(t for t, (s, _) in enumerate(order) if s == name) for name in sizes)
    count = Counter()
    for t in range(first):
        count[order[t][0]] += 1
        assert all(abs(count[n] - (t + 1) / share) < 3 for n in sizes)


def test_whole_weights():
    assert mixing.whole([10, 20, 0]) == [1, 2, 0] and mixing.whole([0, 0]) == [0, 0] and mixing.whole([]) == []
    assert sum(mixing.whole([10**9, 1, 3.5])) <= mixing.PERIOD + 3 and min(mixing.whole([10**9, 1, 3.5])) == 1


def test_pipeline_stages(spark, sf_dir, tmp_path):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_stage", "rules_stage", "dedup_stage", "mixing_stage", "packing_stage"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k < 4:
            assert out.columns == columns
        after = [r["doc_id"] for r in out.collect()]
        if k == 0:
            scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
            assert sorted(after) == sorted(i for i, s in scores.items() if s >= 0.3)
        elif k == 1:
            assert sorted(after) == sorted(r["doc_id"] for r in rules.judge(docs).filter("kept").collect())
        elif k == 2:
            assert sorted(after) == brute_kept(sorted(before.items()))
        elif k == 3:
            assert sorted(after) == sorted(before) and after != sorted(after)
        else:
            assert set(after) == set(before)
            import public_tokenizers

            tokens = {r["doc_id"]: r["doc_tokens"] for r in packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
            assert sum(tokens.values()) == sum(r["length"] for r in out.collect())
        docs = out
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_empty_and_odd_tables_pass_every_stage(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, position string"
    rows = [(1, None, None, None, None, "r", "p"), (2, "", "en", "s", 0, "r", "p"), (2, "", "en", "s", 0, "r", "p"), (None, "word " * 30, "en", "s", 1, "r", "p")]
    for frame in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, sf_dir)
            assert out.count() <= max(1, frame.count()) and (k == 4 or out.columns == frame.columns)
