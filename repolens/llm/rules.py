"""Line-first quality rules (operator 6).

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a
document is rejected if it keeps too few of its words or too little text. A line of any length needs end
punctuation, unless it is wrapped: the next line goes on in lower case. Base measures of repetition are
exact: the words inside 8-word windows that occur twice or more in a text.

Defined results: null or empty texts have no words and are rejected (too few words); very long texts are judged whole;
repeated rows are judged each by itself; other columns pass through ``keep_good`` untouched whatever their names; empty
tables give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.text import byte_classes, sliced, sort_index, text_column, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document keeps at least this share of its words after line removal.
MIN_KEPT_PERCENT = 50

TERMINAL = (".", "!", "?", ":", ";", "…", '"', "”", "»", "。", ")")
BOILERPLATE = re.compile(
    r"cookie policy|accept (?:all )?cookies|enable javascript|terms of (?:use|service)|privacy policy|all rights reserved"
    r"|lorem ipsum|click here|sign in to|subscribe to our|share on (?:facebook|twitter)|page not found|skip to content",
    re.IGNORECASE,
)
BARS = frozenset(("|", "»", "›", ">", "•", "·", "&gt;", "::"))
_GOES_ON = re.compile(r"[ \t]*[a-z]")
_SPECIAL = r"[#*$%&|<>{}»›•·]|!!|::"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile("[" + re.escape(SYMBOLS) + "]")


def line_verdict(line: str, plain: bool = False, following: str = "") -> str:
    """Why a line is removed: navigation, boilerplate, symbols, shouting, stutter, code or punctuation; '' if it stays. Blank lines stay.

    following: the next line. plain: the line is known to hold no symbol, ``!!``, brace, boilerplate phrase or word said twice running, so only punctuation is left to test.
    """
    if plain:
        bare = line.rstrip()
        return "punctuation" if bare and not bare.endswith(TERMINAL) and not _GOES_ON.match(following) else ""
    words = line.split()
    n = len(words)
    if not n:
        return ""
    bars = sum(map(BARS.__contains__, words))
    if bars * 5 >= n and "|" in line or bars * 3 >= n:
        return "navigation"
    if n <= 40 and BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 4 and len(_SYMBOL.findall(line)) * 4 >= n:
        return "symbols"
    if n >= 4 and line.count("!!") * 4 >= n:
        return "shouting"
    if n >= 8 and sum(map(str.__eq__, words, words[1:])) * 3 >= n:
        return "stutter"
    if n >= 4 and "{" in line and "}" in line and ";" in line:
        return "code"
    return "punctuation" if not line.rstrip().endswith(TERMINAL) and not _GOES_ON.match(following) else ""


def clean_text(text: str, plain: bool = False) -> tuple[str, list[tuple[int, str]]]:
    """The text without failing lines, and (line number, reason) of those removed."""
    kept, gone = [], []
    lines = text.split("\n")
    for i, (line, following) in enumerate(zip(lines, [*lines[1:], ""])):
        why = line_verdict(line, plain, following)
        if why:
            gone.append((i, why))
        else:
            kept.append(line)
    return "\n".join(kept), gone


def removed_words(text: str, plain: bool) -> int:
    """Words on the lines that fail."""
    lines = text.split("\n")
    return sum(len(_WORD.findall(line)) for line, following in zip(lines, [*lines[1:], ""]) if line_verdict(line, plain, following))


def repeated_words(ids: np.ndarray, offsets: np.ndarray, n_words: int, window: int = WINDOW) -> np.ndarray:
    """Per text, the words that lie in a window found twice or more in it. Exact: windows get ranks word by word."""
    counts = np.diff(offsets)
    n, docs = len(ids), len(counts)
    out = np.zeros(docs, dtype=np.int64)
    if not n or counts.max() < window + 1:
        return out
    doc = np.repeat(np.arange(docs), counts)
    # a word that is single in its text breaks every window over it
    order, codes = sort_index(doc * n_words + ids, docs * n_words)
    same = codes[1:] == codes[:-1]
    often = np.zeros(n, dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    run = np.concatenate(([0], np.cumsum(often)))
    here = np.flatnonzero((run[window:] - run[:-window] == window) & (doc[window - 1 :] == doc[: n - window + 1]))
    if not len(here):
        return out
    rank = np.zeros(n, dtype=np.int64)  # of the words at hand, by text
    rank[order] = np.concatenate(([0], np.cumsum(~same)))
    key = rank[here]
    for step in range(1, window):  # rank of the window of step + 1 words at every place in question
        order, codes = sort_index(key * n_words + ids[here + step], (int(key.max()) + 1) * n_words)
        key = np.empty(len(here), dtype=np.int64)
        key[order] = np.concatenate(([0], np.cumsum(codes[1:] != codes[:-1])))
    order, codes = sort_index(key, int(key.max()) + 1)
    twice = np.zeros(len(here), dtype=bool)
    eq = codes[1:] == codes[:-1]
    twice[order[1:][eq]] = True
    twice[order[:-1][eq]] = True
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, here[twice], 1)
    np.add.at(cover, here[twice] + window, -1)
    covered = np.cumsum(cover[:-1]) > 0
    np.add.at(out, doc[covered], 1)
    return out


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base measures and the line rules' verdict of each text."""
    ids, offsets, words = words_of(texts)
    n_words = np.diff(offsets)
    of = byte_classes(texts)
    symbols = of["symbol"] + of["pipe"]
    special = pc.match_substring_regex(texts, _SPECIAL).to_numpy(zero_copy_only=False)
    special |= pc.match_substring_regex(texts, BOILERPLATE.pattern, ignore_case=True).to_numpy(zero_copy_only=False)
    twice = np.concatenate(([False], (ids[1:] == ids[:-1])))[: len(ids)]
    special |= np.bincount(np.repeat(np.arange(len(texts)), n_words), weights=twice, minlength=len(texts)) > 0
    repeat = repeated_words(ids, offsets, max(len(words), 1))
    raw = texts.to_pylist()
    dup = np.fromiter(map(_duplicate_lines, raw), dtype=np.int64, count=len(raw))
    kept_words = n_words - np.fromiter(map(removed_words, raw, (~special).tolist()), dtype=np.int64, count=len(raw))
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words, "word_chars": of["bytes"] - of["tail"] - of["blank"], "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat,
        "base_failed": failed, "kept": ~failed & (100 * kept_words >= MIN_KEPT_PERCENT * n_words), "kept_words": kept_words,
    }


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_words long"


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the base measures, base_failed, kept, and kept_words after line removal."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            m = measures(text_column(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[x]) for x in names)], names=["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {RESULT}")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the text without failing lines, and the removed lines as (line, reason)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line", pa.int32()), ("reason", pa.string())]))
        for batch in sliced(batches):
            got = [clean_text(x) for x in text_column(batch).to_pylist()]
            gone = pa.array([[{"line": i, "reason": why} for i, why in g] for _, g in got], type=kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in got], type=pa.string()), gone], names=["doc_id", "text", "removed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, text string, removed array<struct<line:int,reason:string>>")


def keep_good(docs: DataFrame, text_col: str = "text", clean: bool = True) -> DataFrame:
    """The rows of docs that pass, their texts without the failing lines (``clean``); all other columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            texts = text_column(batch, text_col)
            m = measures(texts)
            kept = np.flatnonzero(m["kept"])
            out = batch.take(pa.array(kept))
            lost = np.flatnonzero(m["kept_words"][kept] < m["n_words"][kept])
            if clean and len(lost):
                at = out.schema.get_field_index(text_col)
                new = np.zeros(len(kept), dtype=bool)
                new[lost] = True
                shorter = pa.array([clean_text(texts[int(i)].as_py())[0] for i in kept[lost]], type=out.column(at).type)
                out = out.set_column(at, out.schema.field(at), pc.replace_with_mask(out.column(at), pa.array(new), shorter))
            yield out

    return docs.mapInArrow(run, docs.schema)


def oracle() -> str:
    """DuckDB SQL for judge() over ``documents`` (without kept_words)."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    bars, ends = ", ".join(map(quoted, sorted(BARS))), " OR ".join(f"ends_with(rtrim(x), {quoted(e)})" for e in TERMINAL)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i : i + 7] AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 8) ks(k) GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
lines AS (SELECT doc_id, x, lead(x, 1, '') OVER (PARTITION BY doc_id ORDER BY place) AS y, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM split),
m AS (SELECT doc_id, x, y, w, len(w) AS n, len(list_filter(w, lambda v: v IN ({bars}))) AS bars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS symbols, (length(x) - length(replace(x, '!!', ''))) / 2 AS bangs,
  len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS again FROM lines WHERE len(w) > 0),
v AS (SELECT doc_id, x, n, (bars * 5 >= n AND contains(x, '|')) OR bars * 3 >= n OR (n <= 40 AND regexp_matches(x, {quoted('(?i)' + BOILERPLATE.pattern)})) OR (n >= 4 AND symbols * 4 >= n) OR (n >= 4 AND bangs * 4 >= n)
  OR (n >= 8 AND again * 3 >= n) OR (n >= 4 AND contains(x, '{{') AND contains(x, '}}') AND contains(x, ';')) OR NOT ({ends} OR regexp_matches(y, '^[ \t]*[a-z]')) AS gone FROM m),
per AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines, coalesce(sum(n) FILTER (NOT gone), 0) AS kept_words FROM v GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(kept_words, 0) AS kept_words FROM d LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * kept_words >= {MIN_KEPT_PERCENT} * n_words AS kept FROM b"""
