"""Quality classifier (operator 5): histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts in Arrow batches; the trees are trained on the driver from a bounded
sample of labelled rows and flattened into arrays, which numpy walks for a whole batch at once.

Defined results: null texts count as empty and get the score of an empty text; very long texts are measured whole;
repeated rows each get a row (of several texts with one labelled id that of the smallest hash is learnt); without a
usable label of both classes every score is the labels' mean (0.5 if there are none); an empty table gives no rows;
extra columns play no part, and ``keep_good`` passes them on whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.rules import repeated_words
from repolens.llm.text import byte_classes, sliced, text_column, words_of

#: Labelled rows used for training at most (those with the smallest hash of their id).
TRAIN_ROWS = 20_000

FEATURES = (
    "log_words", "chars_per_word", "upper_share", "punct_per_word", "symbol_per_word", "bang_per_word", "pipe_per_word", "digit_share",
    "distinct_share", "top_share", "repeat_next_share", "repeat8_share", "dup_line_share", "words_per_line", "terminal_share",
    "comma_per_word", "dot_per_word", "non_ascii_share", "short_share", "long_share", "brace_per_word", "slash_per_word",
)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    ids, offsets, words = words_of(texts)
    docs = len(texts)
    n = np.diff(offsets)
    some = np.maximum(n, 1).astype(float)
    doc = np.repeat(np.arange(docs), n)

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=docs)

    of = {k: v.astype(float) for k, v in byte_classes(texts).items()}
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))[ids] if len(ids) else np.zeros(0, np.int64)
    chars = np.maximum(of["bytes"] - of["tail"], 1)
    bangs = pc.count_substring(texts, "!!").to_numpy(zero_copy_only=False)
    code = doc * max(len(words), 1) + ids
    ordered = np.sort(code)
    head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    often = np.diff(np.concatenate((head, [len(ordered)])))
    owner = ordered[head] // max(len(words), 1)
    distinct = np.bincount(owner, minlength=docs)
    top = np.zeros(docs)
    np.maximum.at(top, owner, often)
    next_same = np.zeros(len(ids))
    next_same[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    raw = texts.to_pylist()
    lines = [[x.strip() for x in t.split("\n") if x.strip()] for t in raw]
    n_lines = np.maximum([len(x) for x in lines], 1).astype(float)
    dup = np.array([len(x) - len(set(x)) for x in lines], dtype=float)
    ends = np.array([sum(x[-1] in ".!?:;" for x in y) for y in lines], dtype=float)
    columns = [
        np.log1p(n), chars / some, of["upper"] / chars, (of["punct"] + of["comma"] + of["dot"] + of["bang"]) / some, of["symbol"] / some, bangs / some, of["pipe"] / some, of["digit"] / chars,
        distinct / some, top / some, total(next_same) / some, repeated_words(ids, offsets, max(len(words), 1)) / some, dup / n_lines, n / n_lines, ends / n_lines,
        of["comma"] / some, of["dot"] / some, of["lead"] / chars, total(size <= 2) / some, total(size >= 14) / some, of["brace"] / some, of["slash"] / some,
    ]
    return np.stack([np.asarray(x, dtype=float) for x in columns], axis=1) if docs else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class Boosted:
    """Trees of one depth as complete binary arrays: feature and threshold by inner node, value by leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[:1].size and node[0] < inner:  # complete trees: all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += value[node - inner]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 48, l2: float = 2.0, least: int = 20) -> Boosted:
    """Boost depth-limited trees on the log loss over feature histograms. Deterministic."""
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return Boosted(np.log(p / (1 - p)), np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)  # x <= cuts[code]
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    margin = np.full(n, base)
    out_f, out_t, out_v = [], [], []
    flat = code + np.arange(m) * bins
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = node - first
            cell = (local[:, None] * (m * bins) + flat).ravel()
            size = many * m * bins
            shape = (many, m, bins)
            hg, hh, hn = (np.bincount(cell, weights=np.repeat(w, m), minlength=size).reshape(shape) for w in (g, h, np.ones(n)))
            lg, lh, ln = hg.cumsum(2), hh.cumsum(2), hn.cumsum(2)
            tg, th, tn = lg[:, :, -1:], lh[:, :, -1:], ln[:, :, -1:]
            gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
            gain[(ln < least) | (tn - ln < least)] = -1
            for j in range(m):
                gain[:, j, len(cuts[j]) :] = -1
            best = gain.reshape(many, -1).argmax(1)
            good = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
            for k in np.flatnonzero(good):
                feature[first + k], threshold[first + k] = best[k] // bins, cuts[best[k] // bins][best[k] % bins]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        sg, sh = np.bincount(leaf, weights=g, minlength=inner + 1), np.bincount(leaf, weights=h, minlength=inner + 1)
        value = -rate * sg / (sh + l2)
        margin += value[leaf]
        out_f.append(feature)
        out_t.append(threshold)
        out_v.append(value)
    return Boosted(base, np.array(out_f), np.array(out_t), np.array(out_v))


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True where crc32 of the id as text leaves no remainder. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, most: int = TRAIN_ROWS) -> Boosted:
    """Fit on labelled rows that are not held out. Of more than ``most`` those with the smallest id hashes are taken."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("double").alias("y")).filter(F.col("y").isin(0.0, 1.0) & ~held_out("k", folds))
    chosen = known.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(most)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "k").select("k", "y", "text", F.xxhash64("text").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = statistics(text_column(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["k", "y", "body", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    measured = rows.mapInArrow(run, f"k {kind}, y double, body long, x array<double>")
    got = measured.groupBy("k").agg(F.first("y").alias("y"), F.min_by("x", "body").alias("x")).toPandas()  # ``most`` rows at most
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy()
    order = np.lexsort((*x.T[::-1], got["k"].to_numpy()))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Boosted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.predict(statistics(text_column(batch))))], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Boosted, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs that score ``least`` or more, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            yield batch.filter(pa.array(model.predict(statistics(text_column(batch, text_col))) >= least))

    return docs.mapInArrow(run, docs.schema)
