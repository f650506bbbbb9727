"""Approximate nearest neighbours by inner product (operator 3).

Vectors are lifted so that the largest inner product is the smallest distance (one more coordinate fills every
vector up to the largest norm), and projected to DIMS stable (Gaussian) coordinates. A kd-tree in the projected
space hands out leaves nearest first; their vectors are verified with exact inner products until the chi-square
test holds: projected distance^2 / distance^2 follows chi-square with DIMS degrees of freedom, so once the next
leaf is farther than quantile(CONFIDENCE) times the k-th distance, an unseen neighbour is unlikely.

The upper part of the tree is cut from a sample of some SAMPLE rows, chosen by hash; every row is dealt to one of its cells,
and cells over SHARD_ROWS (many equal vectors, say) are salted into shards, each with a kd-tree of its own.
Queries first search their home shard; the bound they bring from there lets the same test rule out whole
cells, and only blocks of queries that still need a shard meet it.

Defined results: vectors that are null, zero, of another than the most frequent size, or hold null or
non-finite components take no part; rows that share a query's id are its own; of queries with equal ids one
takes part; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.session import materialize

DIMS = 8
CONFIDENCE = 0.98
#: Sampled rows for the upper tree, about; twice as many at most.
SAMPLE = 20_000
SHARD_ROWS = 16_384
MAX_CELLS = 4096
LEAF = 256
#: Queries that meet a shard in one task at most.
QUERY_BLOCK = 32_768


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile for an even number of degrees of freedom, by bisection of the closed form."""

    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - exp(-x / 2) * total

    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def stable_projection(size: int, dims: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size + 1, dims))


def split_tree(points: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and threshold of each inner node of a complete kd-tree with ``cells`` leaves (a power of two)."""
    axis, at = np.zeros(cells - 1, dtype=np.int64), np.zeros(cells - 1)
    parts = {0: np.arange(len(points))}
    for node in range(cells - 1):
        mine = parts.pop(node, np.zeros(0, dtype=np.int64))
        if len(mine):
            p = points[mine]
            axis[node] = int(np.argmax(p.max(0) - p.min(0)))
            at[node] = float(np.median(p[:, axis[node]]))
            right = p[:, axis[node]] > at[node]
            parts[2 * node + 1], parts[2 * node + 2] = mine[~right], mine[right]
    return axis, at


def cell_of(points: np.ndarray, axis: np.ndarray, at: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), dtype=np.int64)
    rows = np.arange(len(points))
    for _ in range(int(np.log2(len(axis) + 1))):
        node = 2 * node + 1 + (points[rows, axis[node]] > at[node])
    return node - len(axis)


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree, halved at the median of the widest axis."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        mine = stack.pop()
        if len(mine) <= leaf:
            out.append(mine)
            continue
        p = points[mine]
        j = int(np.argmax(p.max(0) - p.min(0)))
        order = mine[np.argpartition(p[:, j], len(mine) // 2)]
        stack += [order[: len(mine) // 2], order[len(mine) // 2 :]]
    return out


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        out += np.maximum(np.maximum(low[None, :, j] - q[:, None, j], q[:, None, j] - high[None, :, j]), 0) ** 2
    return out


class Searcher:
    """What both rounds of search share: sizes, projection, largest norm and test."""

    def __init__(self, size: int, norm2: float, k: int, confidence: float = CONFIDENCE, dims: int = DIMS):
        self.size, self.norm2, self.k = size, norm2, k
        self.matrix = stable_projection(size, dims)
        self.quantile = chi_square_quantile(confidence, dims)

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))
        lift[lift < 1e-6 * np.sqrt(self.norm2)] = 0
        return x @ self.matrix[:-1] + lift[:, None] * self.matrix[-1]

    def far(self, box2: np.ndarray, q2: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The stopping test: True where nothing in a box at projected distance^2 box2 is expected to beat kth."""
        d2 = np.maximum(self.norm2 + q2 - 2 * kth, 0)
        return (box2 > self.quantile * d2) & (box2 > 1e-12 * self.norm2)

    def search(self, qid: np.ndarray, q: np.ndarray, bound: np.ndarray, cid: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate id, score): up to k nearest of each query that reach its bound."""
        k, n = self.k, len(q)
        leaves = kd_leaves(self.project(c))
        pc = self.project(c)
        low, high = np.array([pc[x].min(0) for x in leaves]), np.array([pc[x].max(0) for x in leaves])
        box2 = box_distance(self.project(q, True), low, high)
        turn = np.argsort(box2, axis=1, kind="stable")
        q2 = (q * q).sum(1)
        kth = bound.copy()
        got_q, got_id, got_s = np.zeros(0, np.int64), np.zeros(0, cid.dtype), np.zeros(0)
        active = np.arange(n)
        done, step = 0, 1
        while done < len(leaves) and len(active):  # each round takes as many leaves as all before, so that products are large
            near_leaves = turn[active, done : done + step]
            go = ~self.far(box2[active[:, None], near_leaves], q2[active][:, None], kth[active][:, None])
            rows, leaf = np.repeat(active, go.sum(1)), near_leaves[go]
            active = active[go[:, -1]]  # leaves come nearest first
            done, step = done + step, done + step
            order = np.argsort(leaf, kind="stable")
            rows, cuts = rows[order], np.searchsorted(leaf[order], np.arange(len(leaves) + 1))
            new_q, new_c = [], []
            for j in np.flatnonzero(np.diff(cuts)):
                mine = rows[cuts[j] : cuts[j + 1]]
                near = q[mine] @ c[leaves[j]].T >= (kth[mine] - 1e-9 * (1 + np.abs(kth[mine])))[:, None]
                near &= qid[mine][:, None] != cid[leaves[j]][None, :]
                a, b = np.nonzero(near)
                new_q.append(mine[a])
                new_c.append(leaves[j][b])
            nq, nc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (new_q, new_c))
            if not len(nq):
                continue
            score = np.concatenate([(q[nq[i : i + 65536]] * c[nc[i : i + 65536]]).sum(1) for i in range(0, len(nq), 65536)])
            aq, ai, as_ = np.concatenate((got_q, nq)), np.concatenate((got_id, cid[nc])), np.concatenate((got_s, score))
            order = np.lexsort((ai, -as_, aq))
            aq, ai, as_ = aq[order], ai[order], as_[order]
            first = np.flatnonzero(np.concatenate(([True], aq[1:] != aq[:-1])))
            count = np.diff(np.concatenate((first, [len(aq)])))
            keep = np.arange(len(aq)) - np.repeat(first, count) < k
            full = first[count >= k]
            kth[aq[full]] = np.maximum(kth[aq[full]], as_[full + k - 1])
            got_q, got_id, got_s = aq[keep], ai[keep], as_[keep]
        return got_q, got_id, got_s


def _usable(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors that take part."""
    col = batch.column(1)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    lengths = np.diff(col.offsets.to_numpy()).astype(np.int64)
    fit = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False) & (lengths == size))
    if not n or not len(fit):
        return fit[:0], np.zeros((0, size))
    flat = col.take(pa.array(fit)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)  # null becomes nan
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return fit[good], x[good]


def _vectors(column: pd.Series | list[bytes], size: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(-1, size).astype(np.float64)


def nearest(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k nearest found for each query, ties to the smaller id."""
    spark = vectors.sparkSession
    # single numbers stay single on their way: they are exact as such
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = "query_id long, rank int, vec_id long, score double"
    top = base.filter("v is not null and size(v) > 0").groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if top is None:
        return spark.createDataFrame([], schema)
    size = top["size"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most = 0, 0.0
        for batch in batches:
            _, x = _usable(batch, size)
            n += len(x)
            most = max(most, float((x * x).sum(1).max())) if len(x) else most
        yield pa.RecordBatch.from_arrays([pa.array([n], type=pa.int64()), pa.array([most])], names=["n", "most"])

    n, norm2 = base.mapInArrow(measure, "n long, most double").agg(F.sum("n"), F.max("most")).first()
    if not n:
        return spark.createDataFrame([], schema)
    find = Searcher(size, norm2, k, confidence)

    # the upper tree, from a bounded sample
    cells = 1
    while cells < MAX_CELLS and cells * shard_rows < n:
        cells *= 2
    fit = base.filter(F.size("v") == size)
    share = F.shiftrightunsigned(F.xxhash64("vec_id", "v"), 1) / 2.0**63
    chosen = fit.filter(share < min(1.0, SAMPLE / n)).limit(2 * SAMPLE).select("vec_id", "v").toArrow()
    sample = np.concatenate([_usable(b, size)[1] for b in chosen.combine_chunks().to_batches()] or [np.zeros((0, size))])
    axis, at = split_tree(find.project(sample), cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _usable(batch, size)
            cell = cell_of(find.project(x), axis, at)
            home = cell_of(find.project(x, True), axis, at)
            raw, wide = x.astype(kind).tobytes(), size * int(kind[-1])
            blobs = pa.array([raw[i : i + wide] for i in range(0, len(raw), wide)], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cell), pa.array(home), blobs], names=["vec_id", "cell", "home", "x"])

    dealt = materialize(base.mapInArrow(deal, "vec_id long, cell long, home long, x binary"), "vectors")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, low, high = np.zeros(cells, np.int64), np.full((cells, DIMS), np.inf), np.full((cells, DIMS), -np.inf)
        for batch in batches:
            cell = batch.column(0).to_numpy()
            p = find.project(_vectors(batch.column(1).to_pylist(), size, kind))
            np.add.at(count, cell, 1)
            np.minimum.at(low, cell, p)
            np.maximum.at(high, cell, p)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(low[some].tolist(), type=pa.list_(pa.float64())), pa.array(high[some].tolist(), type=pa.list_(pa.float64()))], names=["cell", "n", "low", "high"])

    ends = [f(F.col(c)[j]).alias(f"{c}{j}") for j in range(DIMS) for c, f in (("low", F.min), ("high", F.max))]
    found = dealt.select("cell", "x").mapInArrow(boxes, "cell long, n long, low array<double>, high array<double>").groupBy("cell").agg(F.sum("n").alias("n"), *ends).collect()
    salts = np.zeros(cells, dtype=np.int64)
    low, high = np.full((cells, DIMS), np.inf), np.full((cells, DIMS), np.inf)
    for r in found:
        salts[r["cell"]] = -(-r["n"] // (2 * shard_rows))
        for j in range(DIMS):
            low[r["cell"], j], high[r["cell"], j] = r[f"low{j}"], r[f"high{j}"]
    first = np.concatenate(([0], np.cumsum(salts)))  # shards of a cell: first[cell] .. first[cell + 1]
    if not first[-1]:
        return spark.createDataFrame([], schema)
    filled = np.flatnonzero(salts)
    nearest_filled = filled[np.argmin(np.abs(np.arange(cells)[:, None] - filled[None, :]), axis=1)] if len(filled) < cells else np.arange(cells)
    # at most MAX_CELLS rows: a cell's first shard, its number of shards, and the filled cell that stands for it
    own_cells = F.broadcast(spark.createDataFrame([(c, int(first[c]), max(1, int(salts[c])), int(nearest_filled[c])) for c in range(cells)], "cell long, first_shard long, wide long, filled long"))
    dealt_out = lambda salt: F.col("first_shard") + F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col("wide"))
    candidates = dealt.join(own_cells, "cell").select(dealt_out(3).alias("shard"), "vec_id", "x")

    chosen_q = dealt.filter(F.expr(is_query)).groupBy("vec_id").agg(F.min(F.struct("x", "home")).alias("s")).select("vec_id", "s.x", "s.home")
    n_queries = chosen_q.count()
    # neighbouring cells share a block, so that its queries need the same shards; blocks are bounded by salting
    blocks = -(-n_queries // QUERY_BLOCK)
    salted = max(1, -(-2 * blocks // cells))
    lived = chosen_q.join(own_cells.select(F.col("cell").alias("home"), F.col("filled").alias("cell")), "home").join(own_cells, "cell")
    block = F.expr(f"cell * {max(1, min(cells, 2 * blocks - 1))} div {cells}") * salted + F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(salted))
    queries = lived.select("vec_id", "x", block.alias("block"), dealt_out(6).alias("own"))

    def visit(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"vec_id": pd.Series(dtype="int64"), "ids": [], "scores": [], "kth": pd.Series(dtype="float64")})
        qid, x = q["vec_id"].to_numpy(), _vectors(q["x"], size, kind)
        a, i, s = find.search(qid, x, q["kth"].to_numpy(), c["c_id"].to_numpy(), _vectors(c["c_x"], size, kind))
        cuts = np.searchsorted(a, np.arange(len(q) + 1))
        ids, scores = [i[m:z] for m, z in zip(cuts, cuts[1:])], [s[m:z] for m, z in zip(cuts, cuts[1:])]
        kth = [float(v[k - 1]) if len(v) >= k else -np.inf for v in scores]
        return pd.DataFrame({"vec_id": qid, "ids": ids, "scores": scores, "kth": kth})

    def meet(asked: DataFrame) -> DataFrame:
        """asked: vec_id, x, block, shard, kth. Every shard goes to the blocks that ask for it."""
        pairs = asked.select(F.col("shard").alias("to"), F.col("block").alias("for")).distinct()
        sent = candidates.join(pairs, F.col("shard") == F.col("to")).select("to", "for", F.col("vec_id").alias("c_id"), F.col("x").alias("c_x"))
        return asked.groupBy("shard", "block").cogroup(sent.groupBy("to", "for")).applyInPandas(visit, "vec_id long, ids array<long>, scores array<double>, kth double")

    at_home = materialize(meet(queries.select("vec_id", "x", "block", F.col("own").alias("shard"), F.lit(float("-inf")).alias("kth"))), "home")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1).to_pylist(), size, kind)
            kth, own = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            box2 = box_distance(find.project(x, True), low[filled], high[filled])
            near = ~find.far(box2, (x * x).sum(1)[:, None], kth[:, None])
            shards = [np.concatenate([np.arange(first[c], first[c + 1]) for c in filled[row]] or [np.zeros(0, np.int64)]) for row in near]
            shards = [s[s != o] for s, o in zip(shards, own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shards, type=pa.list_(pa.int64()))], names=["vec_id", "x", "block", "kth", "shards"])

    bounded = queries.join(at_home.select("vec_id", "kth"), "vec_id").select("vec_id", "x", "block", "kth", "own")
    asked = bounded.mapInArrow(route, "vec_id long, x binary, block long, kth double, shards array<long>").select("vec_id", "x", "block", "kth", F.explode("shards").alias("shard"))
    away = meet(asked)
    both = at_home.unionByName(away).select("vec_id", F.arrays_zip(F.transform("scores", lambda s: -s).alias("s"), F.col("ids").alias("i")).alias("hits"))
    best = both.groupBy("vec_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("best"))
    return best.select(F.col("vec_id").alias("query_id"), F.posexplode("best").alias("place", "hit")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit")["i"].alias("vec_id"), (-F.col("hit")["s"]).alias("score"))
