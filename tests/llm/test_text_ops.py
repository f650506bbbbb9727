"""Operators on texts against brute force: chat, licences, classifier, rules, language model, packing, SimHash, URLs."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repolens.llm import chat, licenses, lm, packing, quality, queries, rules, simhash, urls
from repolens.llm.text import sort_index, words_of
from repolens.llm.xxh import xxh64_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, label string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "One two three four."), (6, "One two three four."), (6, "One two three four."), (7, LONG), (8, "\x0b\x0c x\x1cy\xa0z\u2028 É ß"),
    (None, "One two three four."), (9, "b " * 50), (10, "Licensed under the Apache License, Version 2.0.\nplain text here"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", None, 0, "s", None) for i, t in EDGE], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- shared helpers
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\xa0é", max_size=30), max_size=6))
def test_words(texts):
    ids, offsets, words = words_of(pa.array(texts, type=pa.string()))
    got = [[words[k].decode() for k in ids[a:b]] for a, b in zip(offsets, offsets[1:])]
    assert got == [WORD.findall(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.data())
def test_xxh64(data, draw):
    spans = draw.draw(st.lists(st.tuples(st.integers(0, len(data) - 1), st.integers(0, 150)), max_size=60))
    spans = [(a, min(n, len(data) - a)) for a, n in spans] * 30
    start, length = np.array([a for a, _ in spans], dtype=np.int64), np.array([n for _, n in spans], dtype=np.int64)
    assert xxh64_spans(data, start, length, 42).tolist() == [xxhash.xxh64_intdigest(data[a : a + n], 42) for a, n in spans]


def test_sort_index_ties():
    order, values = sort_index(np.array([2, 1, 2, 0]), 3)
    assert order.tolist() == [3, 1, 0, 2] and values.tolist() == [0, 1, 2, 2]


# -- 1 chat
@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "]", "\\", ""]), st.text(alphabet="a<>[]/\\ISTNRUOB_s \n=é", max_size=20)), max_size=6))
def test_chat_round_trip(turns):
    assert chat.parse("".join(chat.render(r, t)[0] for r, t in turns)) == turns
    for r, t in turns:
        text, a, b = chat.render(r, t)
        assert chat.unescape(text[a:b]) == t


def test_chat_folding(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 0, "start", "assistant", None), (1, 1, 1, "delta", None, "Hel"), (1, 1, 3, "delta", None, "p"), (1, 1, 2, "delta", None, "lo "),
        (1, 2, 0, "message", "user", "x"), (1, 2, 5, "edit", None, "edited"), (1, 3, 0, "delta", "assistant", "draft"), (1, 3, 1, "regenerate", None, None), (1, 3, 2, "delta", None, "final"),
        (1, 4, 0, "message", "user", "gone"), (1, 4, 1, "delete", None, None), (2, 0, 0, "message", "user", None), (2, 0, 0, "message", "user", None), (None, 0, 0, "message", None, "n"), (3, 0, 0, "message", "user", "y"), (3, 0, 1, "delete", None, None),
    ]
    events = spark.createDataFrame(rows, "conv_id long, message long, seq long, kind string, role string, text string")
    for part in (1, 1 << 20):
        out = chat.format_events(events, part).orderBy("conv_id", "part").collect()
        got = {c: chat.parse("".join(r["formatted"] for r in out if r["conv_id"] == c)) for c in {r["conv_id"] for r in out}}
        assert got == {1: [("user", "hi"), ("assistant", "Hello p"), ("user", "edited"), ("assistant", "final")], 2: [("user", ""), ("user", "")], None: [("", "n")], 3: []}
        assert sum(r["last"] for r in out) == 4
    assert chat.format_events(events.limit(0)).count() == 0


def test_a_very_long_turn(spark):
    long = "a\\[<b] \n" * 400_000  # longer than a part of output
    rows = [(1, 0, "user", long, "x"), (1, 1, "assistant", long + "!", "y"), (1, 2, "user", "end", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat.digests(chat.format_events(chat.as_events(df))).collect()
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t, _ in rows).encode()).hexdigest()
    assert [(r["n_turns"], r["turns_sha256"], r["loss_chars"]) for r in got] == [(3, want, len(long) + 1)]


def test_chat_query(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    want = {}
    for conv, g in [*c.groupby("conv_id"), (-7, None)]:
        turns = list(zip(g["role"], g["text"].fillna(""))) if g is not None else [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
        loss = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.render(r, t)[0]) for r, t in turns))
    got = {r[0]: tuple(r[1:]) for r in queries.op1_chat_formatting(spark, sf_dir).collect()}
    assert got == want


# -- 2 licences
NOTICES = [
    # worded otherwise than the templates
    ("apache-2.0", "This product is distributed under the Apache License 2.0; see the file LICENSE."),
    ("apache-2.0", 'Copyright 2021 Foo Inc.\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n'),
    ("mit", "The code in this repository is released under the terms of the MIT license."), ("mit", "/* This software is licensed under the MIT License */"), ("mit", "Licensed under MIT"),
    ("gpl-3.0", "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl-2.0", "# This file is licensed under the terms of the GNU General Public License version 2."), ("lgpl", "This module is distributed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "// SPDX-License-Identifier: LGPL-3.0-only"), ("agpl-3.0", "The server is licensed under the GNU Affero General Public License v3."), ("agpl-3.0", "Licensed under AGPL-3.0."), ("bsd", "This code is under the BSD 3-Clause license."),
    ("bsd", "Redistribution and use in source and binary forms are permitted provided that the above copyright notice and this list of conditions are retained."),
    ("mpl-2.0", "The files are subject to the terms of the Mozilla Public License, version 2.0."), ("cc-by-sa", "Except where noted, the content is available under the Creative Commons Attribution-ShareAlike 4.0 License."),
    ("cc-by-sa", "Content licensed under CC BY-SA 4.0"), ("cc-by", "The data set is licensed under CC BY 4.0."), ("cc-by-nc", "The images are licensed under CC BY-NC 4.0."),
    ("cc0", "The author has waived all copyright and related rights to the work; it is CC0 1.0 Universal."), ("unlicense", "It is free and unencumbered software released into the public domain."), ("isc", "The package is released under the ISC License."),
    ("unknown", "Licensed under the Foo Bar Community License, version 9."), ("unknown", "SPDX-License-Identifier: Zork-1.0"), ("none", "Copyright (c) 2015 Example Ltd."), ("none", "He kept the license plate of his first car on the wall."),
    ("none", "The lawyer said that copyright had run out long ago."), ("none", "That thention thaned on the river of general thations."), ("unknown", "license"),
]


def wrapped(notices, width, mark):
    return "\n".join(mark + line for line in "\n\n".join(textwrap.fill(x, width) for x in notices).split("\n"))


def test_licenses_against_plain_form(spark, edge, none, docs):
    model = licenses.trained()
    notices = [t for v in licenses.TEMPLATES.values() for t in v] + licenses.ORDINARY + [x for _, x in NOTICES] + ["Copyright 2020 Someone", "one-\ntwo license\n\n\n* three\r\n*/ license of four-\nfive", "license " + "word " * 20_000]
    notices += [wrapped(v, 72, mark) for v in licenses.TEMPLATES.values() for mark in ("# ", " * ")]
    rows = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(notices)], "doc_id long, text string")
    frame = edge.select("doc_id", "text").union(docs.select("doc_id", "text")).union(rows)
    want = Counter()
    for doc_id, text in frame.collect():
        found = licenses.paragraphs(text or "")
        names = [model.classify(p) for p in found]
        known = [n for n in names if n not in (licenses.NONE, licenses.UNKNOWN)]
        want[(doc_id, ",".join(sorted(set(known))), sum(bool(re.search(licenses.CUE, p)) for p in found), len(known), names.count(licenses.UNKNOWN))] += 1
    got = Counter(tuple(r) for r in licenses.scan(frame.select("*", F.lit("x").alias("families"), F.lit(1).alias("rid"))).collect())
    assert got == want
    assert licenses.scan(none).count() == 0


def test_licenses_of_texts_without_a_stem(spark):
    """Texts with none of oracle()'s stems: cues of their own, cues over wrapped lines, paragraphs that only the templates know."""
    model = licenses.trained()
    texts = [
        "GNU software", "Some files are under MPL", licenses.TEMPLATES["isc"][3], wrapped(licenses.TEMPLATES["isc"][3:4], 72, "# "), licenses.TEMPLATES["unlicense"][3],
        "released into the public\ndomain by its owner", "of the", "in no event", "the software", "work", "", "- . -", "\n\n", "of this software " * 50, "The software is in the source form of the work.",
    ]
    assert not any(x in t.lower() for t in texts for x in licenses.STEMS)
    # pieces of notices without their cues, mixed with other words
    r = random.Random(5)
    notices = [re.sub(licenses.CUE, "thing", t).split() for v in licenses.TEMPLATES.values() for t in v]
    for _ in range(300):
        words = r.choice(notices)
        a = r.randrange(len(words))
        texts.append(" ".join(w if r.random() > 0.15 else "river" for w in words[a : a + r.randint(1, 40)]))
    names = [[model.classify(p) for p in licenses.paragraphs(t)] for t in texts]
    assert names[:6] == [["unknown"], ["unknown"], ["isc"], ["isc"], ["unlicense"], ["unlicense"]]
    assert len({x for n in names for x in n}) > 5
    want = [
        (i, ",".join(sorted(set(n) - {licenses.NONE, licenses.UNKNOWN})), sum(bool(re.search(licenses.CUE, p)) for p in licenses.paragraphs(t)), sum(x not in (licenses.NONE, licenses.UNKNOWN) for x in n), n.count(licenses.UNKNOWN))
        for i, (t, n) in enumerate(zip(texts, names))
    ]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == want


def test_license_families():
    model = licenses.trained()
    for name, notices in licenses.TEMPLATES.items():
        assert all(model.classify(n) == name for n in notices), name
        assert all(model.classify("/* " + n.lower() + " */") == name for n in notices)
    assert all(model.classify(t) in (licenses.NONE, licenses.UNKNOWN) for t in licenses.ORDINARY)


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * "])
@pytest.mark.parametrize("width", [72, 76, 80])
def test_wrapped_notices_are_read_whole(width, mark):
    """Whole texts of every family: no paragraph is unknown or of another family."""
    model = licenses.trained()
    for name, notices in licenses.TEMPLATES.items():
        names = {model.classify(p) for p in licenses.paragraphs(wrapped(notices, width, mark))}
        assert names - {licenses.NONE} == {name}


def test_notices_that_no_template_words():
    model = licenses.trained()
    for name, text in NOTICES:
        names = {model.classify(p) for p in licenses.paragraphs(text)} - {licenses.NONE}
        assert names == {name} - {licenses.NONE}, text


# -- 5 classifier
def test_quality(spark, sf_dir, edge, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [(r["quality"], got[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40 and np.mean([(s >= 0.3) == bool(y) for y, s in held]) > 0.93
    scored = quality.score(edge, model).collect()
    assert len(scored) == len(EDGE) and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (1, 2)}) == 1
    assert quality.score(none, model).count() == 0 and quality.keep_good(none, model).columns == none.columns
    assert quality.train(docs, labels.limit(0)).predict(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]


def plain_statistics(t):
    w = WORD.findall(t)
    n, chars = max(len(w), 1), max(len(t), 1)
    lines = [x.strip() for x in t.split("\n") if x.strip()]
    count = lambda chars: sum(c in chars for c in t)
    often = Counter(w)
    many = max(len(lines), 1)
    return [
        math.log1p(len(w)), chars / n, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars, (count("\"'()+-:;=?@[\\]^_`~,.!")) / n, count("#*$%&<>") / n, t.count("!!") / n, count("|") / n, count("0123456789") / chars,
        len(often) / n, max(often.values(), default=0) / n, sum(a == b for a, b in zip(w, w[1:])) / n, brute_rules(t)[4] / n, (len(lines) - len(set(lines))) / many, len(w) / many, sum(x[-1] in ".!?:;" for x in lines) / many,
        count(",") / n, count(".") / n, sum(ord(c) > 127 for c in t) / chars, sum(len(x.encode()) <= 2 for x in w) / n, sum(len(x.encode()) >= 14 for x in w) / n, count("{}") / n, count("/") / n,
    ]


def test_statistics_against_plain_form(edge, docs):
    texts = [r["text"] or "" for r in edge.union(edge).select("text").collect()] + [r["text"] or "" for r in docs.collect()] + ["a b a b " * 30, "x!! {y} | z/z 12, ABC.\n\nx!! {y} | z/z 12, ABC."]
    got = quality.statistics(pa.array(texts))
    assert np.allclose(got, [plain_statistics(t) for t in texts], rtol=1e-12)
    assert quality.statistics(pa.array([], type=pa.string())).shape == (0, len(quality.FEATURES))


def test_quality_query(spark, sf_dir):
    """The query: learnt outside the held-out fold alone, by the plain statistics."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    known = [(plain_statistics(docs[i]), i) for i in labels if i in docs and labels[i] in (0, 1) and not held(i)]
    known.sort()
    model = quality.fit(np.array([x for x, _ in known]), np.array([float(labels[i]) for _, i in known]))
    ids = sorted(docs)
    want = dict(zip(ids, model.predict(np.array([plain_statistics(docs[i]) for i in ids]))))
    got = queries.op5_quality_classifier(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == ids
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-6 and r["held_out"] == held(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.3)


def test_one_text_of_a_repeated_labelled_id_is_learnt(spark):
    rows = [(i, ("junk! " if i % 2 else "Fine words stay here. ") * 20) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id long, quality int")
    once, often = (spark.createDataFrame(rows * k, "doc_id long, text string") for k in (1, 3))
    a, b = quality.train(once, labels), quality.train(often, labels)
    assert (a.threshold == b.threshold).all() and (a.value == b.value).all()


def test_trees_walk_like_nested_ifs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), trees=7, depth=3)

    def walk(row):
        m = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            m += v[node - len(f)]
        return 1 / (1 + math.exp(-m))

    assert np.allclose(model.predict(x), [walk(r) for r in x]) and model.predict(x[:0]).shape == (0,)


# -- 6 rules
def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    kept = sum(len(WORD.findall(x)) for x in text.split("\n") if not rules.line_verdict(x))
    return (len(words), sum(map(len, words)), sum(c in rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered), failed, not failed and 100 * kept >= 50 * len(words))


def test_rules(spark, edge, none, docs):
    junk = ["home | about | news | contact | help", "Buy!! now!! it!! is!! free!!", "a b c d " * 12, "x y\n" * 3 + "one two three four five six seven eight nine ten. " * 3, "Real sentence with enough words to stay here.\n" * 2 + " ".join(map(str, range(30))) + "."]
    frame = edge.select("doc_id", "text").union(docs.select("doc_id", "text")).union(spark.createDataFrame([(500 + i, t) for i, t in enumerate(junk)], "doc_id long, text string"))
    want = Counter((d, *brute_rules(t)) for d, t in frame.collect())
    assert Counter(tuple(r)[:8] for r in rules.judge(frame).collect()) == want
    assert rules.judge(none).count() == 0 and rules.keep_good(none).columns == none.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=4))
def test_repeated_words(texts):
    texts = [" ".join(x) for x in texts]
    ids, offsets, words = words_of(pa.array(texts))
    assert rules.repeated_words(ids, offsets, max(len(words), 1)).tolist() == [brute_rules(t)[4] for t in texts]


def test_line_removal():
    text = "A whole sentence that stays here.\nhome | about | us\nread more\nAnother whole sentence stays.\n"
    assert rules.clean_text(text) == ("A whole sentence that stays here.\nAnother whole sentence stays.\n", [(1, "navigation"), (2, "punctuation")])
    assert rules.clean_text("") == ("", [])
    text = "Home About News Contact Help Login\nThis sentence is wrapped and goes\non in the next line. It ends there.\nTrailing words of a line that nothing ends"
    assert rules.clean_text(text) == ("This sentence is wrapped and goes\non in the next line. It ends there.", [(0, "punctuation"), (3, "punctuation")])
    assert rules.clean_text(text, plain=True) == rules.clean_text(text) and rules.removed_words(text, True) == rules.removed_words(text, False) == 14


def test_kept_texts_lose_their_failing_lines(spark, edge, docs):
    body = "\n".join(f"Line {i} of word{i} and word{i}x stays here for good." for i in range(6))
    rows = [(1, body + "\nhome | about | us\nread more", "x", 7), (2, "Too short.", "y", None), (3, None, None, None), (4, body, "z", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = {r["doc_id"]: r for r in rules.keep_good(frame).collect()}
    assert sorted(got) == [1, 4] and got[1]["text"] == rules.clean_text(rows[0][1])[0] == body and got[4]["text"] == rows[3][1]
    assert (got[1]["kept"], got[1]["n_words"]) == ("x", 7)
    assert {r["doc_id"]: r["text"] for r in rules.keep_good(frame, clean=False).collect()} == {1: rows[0][1], 4: rows[3][1]}
    known = {r["doc_id"]: r["text"] for r in rules.cleaned(docs).collect()}
    for r in rules.keep_good(docs).collect():
        assert r["text"] == known[r["doc_id"]]


# -- 7 language model
def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, universe in ((0, 10), (1, 1), (50, 60), (3000, 1 << 60)):
        values = np.unique(rng.integers(0, universe, n)).astype(np.uint64)
        low_bits, low, high = lm.EliasFano.encode(values, universe)
        e = lm.EliasFano(len(values), low_bits, low, high)
        assert (e.access(np.arange(len(values))) == values).all() and (e.find(values) == np.arange(len(values))).all()
        other = np.setdiff1d(rng.integers(0, universe, 200).astype(np.uint64), values)
        assert (e.find(other) == -1).all()


def test_codes_and_packed_search():
    p = np.array([1.0, 0.5, 1e-3, 1e-12, 3e-17])
    assert (np.abs(np.log2(lm.probability_of(lm.code_of(p))) - np.log2(p)) <= 1 / 512 + 1e-9).all() and lm.code_of(np.array([1.0]))[0] == 1
    values = np.array([0, 0, 3, 3, 9, 200, 201], dtype=np.uint64)
    e = lm.EliasFano(len(values), *lm.EliasFano.encode(values, 256))
    assert e.access(np.arange(7)).tolist() == values.tolist() and (e.high.size + 8 * e.ones.size) < 200
    at = e.find(values, np.zeros(7, np.int64), np.full(7, 4))  # only within the range that is given
    assert (at[:4] >= 0).all() and (at[4:] == -1).all()


def test_probabilities_of_a_context_sum_to_one():
    rows = [(i, t) for i, t in enumerate(["a b a c", "b a", "c c a b", "a"])]
    tokens = [w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.split(), "\n"]]
    c = Counter(tokens)
    whole = len(tokens) + len(c) + 1
    own = np.array([(n + 1) / whole for n in c.values()] + [1 / whole])  # all words and the unknown one
    assert abs(own.sum() - 1) < 1e-12
    for context in c:
        after = Counter(b for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for a, b in zip(t.split(), [*t.split()[1:], "\n"]) if a == context)
        n = np.array([after[w] for w in c] + [0])
        p = (n + lm.MASS * own) / (n.sum() + lm.MASS)
        held = np.where(n > 0, lm.probability_of(lm.code_of((n + lm.MASS * lm.probability_of(lm.code_of(own))) / (n.sum() + lm.MASS))), lm.MASS * own / (n.sum() + lm.MASS))
        assert abs(p.sum() - 1) < 1e-12 and abs(held.sum() - 1) < 0.005


def brute_lm(rows):
    tokens = [(i, [*WORD.findall(lowered(t)), "\n"], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    c, pairs, texts = Counter(), Counter(), 0
    for _, w, held in tokens:
        if not held:
            c.update(w)
            pairs.update(zip(["\n\n", *w], w))
            texts += 1
    n, whole = sum(c.values()), sum(c.values()) + len(c) + 1
    out = []
    for i, w, held in tokens:
        base = sum(math.log10((c[x] + 1) / whole) for x in w)
        score = sum(math.log10((pairs[a, x] + lm.MASS * (c[x] + 1) / whole) / ((texts if a == "\n\n" else c[a]) + lm.MASS)) for a, x in zip(["\n\n", *w], w))
        out.append((i, held, len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out


def test_lm(monkeypatch, edge, none, docs):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(lm, "SHARD_BYTES", 90_000)
    frame = edge.select("doc_id", "text").union(docs.select("doc_id", "text"))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r) for r in lm.score(frame).collect()), key=key), sorted(brute_lm(frame.collect()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and abs(g[6] - w[6]) <= 2e-3 * w[2]
    assert lm.score(none).count() == 0


# -- 8 packing
def public(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=40))
def test_karmarkar_karp(sizes):
    for k in (1, 2, 5):
        parts = packing.karmarkar_karp(sizes, k)
        assert len(parts) == k and sorted(sum(parts, [])) == list(range(len(sizes)))
    windows = packing.pack(sizes, 64)
    assert sorted(sum(windows, [])) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= 64 for w in windows)


def test_differencing_beats_chance():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.karmarkar_karp([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_packing(edge, none, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public())
    frame = edge.select("doc_id", "text", "lang").union(docs.select("doc_id", "text", "lang"))
    rows = packing.pack_documents(frame, public()).collect()
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x, _ in frame.collect())
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    got = Counter()
    for (i, n), pieces in by_doc.items():
        many = sum(p["length"] for p in pieces) // n
        starts = sorted((p["start"], tuple(p["ids"])) for p in pieces)
        assert len(starts) % many == 0
        got[(i, sum((ids for _, ids in starts[::many]), ()))] += many
    assert got == want
    windows: dict = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none, public()).count() == 0


@lru_cache(1)
def coder():
    return packing.ChunkTokenizer(public())


def test_chunks_encode_like_whole_texts():
    tok = packing.ChunkTokenizer(public())
    texts = ["", " a  b ", "<|endoftext|>x y", "don't we'll ΑΣ Σ", "é ́x \x1c z\xa0q", "tab\tand\nline\u2028sep", "日本 語 12ab!?"]
    flat, first = tok.encode(pa.array(texts), 2)
    for i, t in enumerate(texts):
        assert flat[first[i] : first[i + 1]].tolist() == [*tok.inner.encode(t, add_special_tokens=False).ids, 2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abAZ éßÀ×÷Ã'stredl.,!#-<|>0123\u0338\u0301\u0130ς\x1c\x7f\n", max_size=24), min_size=1, max_size=5), st.integers(1, 4))
def test_pieces_encode_like_whole_texts(texts, cache):
    tok = coder()
    tok.cache = cache
    for _ in range(2):  # the second time from memory, whose generations change all the time
        flat, first = tok.encode(pa.array(texts), 2)
        for i, t in enumerate(texts):
            assert flat[first[i] : first[i + 1]].tolist() == [*tok.inner.encode(t, add_special_tokens=False).ids, 2]


# -- 9 SimHash
def brute_fingerprint(text):
    w = WORD.findall(lowered(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, edge, none, docs):
    frame = edge.select("doc_id", "text").union(docs.select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    rows = frame.collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = brute_groups(fps)
    least = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = Counter((i, f, least.get(g)) for (i, _), f, g in zip(rows, fps, groups))
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(frame).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_dense_groups_and_small_trees(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, 6)
    fps = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in np.repeat(centres, 60)] + [int(x) for x in rng.integers(0, 1 << 62, 200)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    groups = brute_groups(fps)
    for trees in (50_000, 16):
        root = {}
        for a, b in simhash.links(df, 4, trees).collect():
            root.setdefault(a, set()).add(b)
            root.setdefault(b, set()).add(a)
        seen, parts = set(), set()
        for f in [r[0] for r in df.collect()]:
            if f in seen:
                continue
            part, stack = set(), [f]
            while stack:
                x = stack.pop()
                if x not in part:
                    part.add(x)
                    stack += root.get(x, ())
            seen |= part
            parts.add(frozenset(x & (1 << 64) - 1 for x in part))
        assert parts == {frozenset(f for f, g in zip(fps, groups) if g == k) for k in set(groups)}
        assert sum(map(len, root.values())) < 60 * len(fps)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 75), (200, 200), (7, 3)]
    got = {tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(75, 50), (100, 50)}


def test_keep_one(spark, edge):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [1, 4, 5, 7, 8, 9, 10]  # the row of null id is a copy of 5


def test_keep_one_of_clashing_ids(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, one, "x", {"k": 1}), (1, two, "x", {"k": 1}), (2, two, "y", None), (2, one, "z", None), (None, three, "u", None), (None, three, "v", None), (None, None, "w", None), (3, one, "q", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string, body map<string,int>")
    first = simhash.keep_one(df)
    assert first.columns == df.columns
    got = sorted(((r["doc_id"], r["text"], r["root"]) for r in first.collect()), key=str)
    assert [(i, t) for i, t, _ in got if t != three] == [(1, one), (1, two), (None, None)] and sum(t == three for _, t, _ in got) == 1
    again = sorted(((r["doc_id"], r["text"], r["root"]) for r in simhash.keep_one(df.repartition(5)).collect()), key=str)
    assert again == got
    assert simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("wide", [1, 2, 3])
def test_wider_keys_lose_no_link(spark, wide):
    rng = np.random.default_rng(wide)
    for masks in [simhash.block_masks(4, 0, wide)]:
        for _ in range(300):
            bits = set(rng.choice(64, 4, replace=False).tolist())
            assert any(not bits & set(m) for m in masks)
    base = [int(x) for x in rng.integers(0, 1 << 62, 30)]
    fps = sorted({f ^ sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for f in base for k in (0, 3, 4, 6)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {tuple(r) for r in simhash.components(simhash.links(df, 4, wide=wide)).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    groups = brute_groups(fps)
    least = {g: min(x for x, y in zip(signed, groups) if y == g) for g in set(groups)}
    assert found == {(x, least[g]) for x, g in zip(signed, groups) if x != least[g]}


def test_fingerprint_of_a_very_long_text():
    """Beyond 2 ** 24 shingles a count no longer fits a 32-bit float."""
    n = 1 << 24
    ones = simhash._BYTE_BITS
    assert ones.dtype == np.float64 and float(n + 1) * ones[1, 7] == n + 1


def test_hot_keys_are_met_by_broadcast(spark):
    rows = spark.range(400).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("k"), "id")
    values = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    want = sorted((r["k"], r["id"], r["top"]) for r in rows.join(values, "k").collect())
    for share in (1, 20_000, 10):
        simhash.HOT_SHARE, old = share, simhash.HOT_SHARE
        got = sorted((r["k"], r["id"], r["top"]) for r in simhash.join_by_key(rows, values, "k", 400).collect())
        simhash.HOT_SHARE = old
        assert got == want


# -- 10 URLs
def test_urls(spark):
    table = [
        ("https://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12?x", "example.org", "/en/12", "example.org/en/1", "block"), ("HTTP://B.ORG", "b.org", "", None, "allow"),
        ("http://b.org/", "b.org", "/", "org/", "allow"), ("http://x.com/fr/2#t", "x.com", "/fr/2", "com/fr/", "allow"), ("http://xcom/fr/2", "xcom", "/fr/2", None, "allow"), ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        ("http://m.ads-track.example.net/q", "m.ads-track.example.net", "/q", None, "block"), ("http://m.ads-track.example.com/fr/1", "m.ads-track.example.com", "/fr/1", "com/fr/", "allow"), ("http://x.net/banner9/ad", "x.net", "/banner9/ad", None, "block"),
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], "x") for i, r in enumerate(table)], "page_id long, url string, host string")
    assert [tuple(r)[1:] for r in urls.filter_urls(df).orderBy("page_id").collect()] == [r[1:] for r in table]
    assert urls.filter_urls(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.filter_urls(df, urls.compile_rules(patterns=["/*/^"]))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeorgmsnt./:-?#*=&019 ADS", max_size=40), st.sampled_from(["http://", "https://m.", "", "http://ads-track.", "http://doubleclick.net"]))
def test_index_misses_no_rule(tail, head):
    compiled = urls.compile_rules()
    index = urls.RuleIndex(compiled, {})
    url = head + tail
    host, path = urls.split_url(url)
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url)
    hosts = [r for r in compiled if r.kind == "host" and r.matches(host, path, low)]
    best = max(hosts, key=lambda r: len(r.text), default=None)
    blocked = any(r.matches(host, path, low) for r in compiled if r.kind == "pattern")
    assert index.judge(url) == (host, path, best.text if best else None, best.verdict if best else "block" if blocked else "allow")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab1*^/|.-", min_size=1, max_size=9).filter(lambda x: re.search("[ab1]", x)), max_size=6), st.lists(st.text(alphabet="ab1/.-?B", max_size=14), min_size=1, max_size=6))
def test_pieces_miss_no_pattern(patterns, tails):
    compiled = urls.compile_rules(patterns=patterns)
    index = urls.RuleIndex(compiled, {})
    for tail in tails:
        url = "http://" + tail
        got = index.judge(url)
        if got[2] is None:
            assert (got[3] == "block") == any(r.matches(*urls.split_url(url), url.lower()) for r in compiled if r.kind == "pattern")


def test_only_fetched_candidates_run(monkeypatch):
    """Every rule is filed under a literal, so that a URL without any of these runs no expression."""
    index = urls.RuleIndex(urls.compile_rules(), {})
    assert all(token for _, token in index.by_piece)
    monkeypatch.setattr(urls.Rule, "matches", lambda *a: pytest.fail("not a candidate"))
    assert index.judge("http://plain.sample/reading/room?x=1")[3] == "allow"
