"""SimHash near-duplicate groups (operator 9).

Fingerprints are made in Arrow batches. Linking searches BK-trees (children keyed by the integer Hamming
distance to their parent) and follows only edges within the radius. The trees are sharded by pigeonhole
blocks: of ``radius + 1`` disjoint bit blocks two linked fingerprints share one at least, so a tree per
(block, value) misses no link. A shard over ``TREE_ROWS`` fingerprints is split into several trees, each of
which is searched by all fingerprints of the shard. Trees go to their queries by shuffle, as their total
size grows with the data and so has no bound that would allow a broadcast.

Nodes in the subtree keyed d of a node are all at distance d from it. If a query is within the radius of a
node, subtrees with d <= radius are of that node's component already and are skipped; so a dense group of
n near copies gives about n links, not n * n, and no component is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.text import sliced, text_column, words_of
from repolens.llm.xxh import xxh64_spans
from repolens.session import broadcast_if_small, forget, materialize

BITS = 64
#: Fingerprints in one BK-tree at most.
TREE_ROWS = 50_000
#: Frontier entries (query, node) held at once.
FRONTIER = 1 << 20
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def fingerprints_of(texts: pa.Array, width: int = 4, seed: int = 42) -> np.ndarray:
    """One unsigned 64-bit SimHash per text over word shingles, repeats included; no words: zero."""
    n = len(texts)
    out = np.zeros(n, dtype=np.uint64)
    ids, offsets, words = words_of(texts, lower=True)
    if not len(ids):
        return out
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    joined = b" ".join(map(words.__getitem__, ids.tolist()))
    start = np.concatenate(([0], np.cumsum(size[ids] + 1)))
    counts = np.diff(offsets)
    many = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    edges = np.concatenate(([0], np.cumsum(many)))
    doc = np.repeat(np.arange(n), many)
    first = offsets[doc] + (np.arange(edges[-1]) - edges[doc])
    last = np.minimum(first + width, offsets[doc + 1])
    h = xxh64_spans(joined, start[first], start[last] - 1 - start[first], seed)
    octet = np.ascontiguousarray(h.astype(">u8")).view(np.uint8).reshape(-1, 8)
    ones = np.zeros((n, BITS), dtype=np.int64)
    for a in range(0, n, 256):  # how often each byte value is at each of the 8 places, then its bits
        b = min(a + 256, n)
        lo, hi = edges[a], edges[b]
        cell = octet[lo:hi] + (np.arange(8) * 256)[None, :] + ((doc[lo:hi] - a) * 2048)[:, None]
        seen = np.bincount(cell.ravel(), minlength=(b - a) * 2048).reshape(b - a, 8, 256)
        ones[a:b] = np.einsum("dpv,vb->dpb", seen.astype(np.float64), _BYTE_BITS, optimize=True).reshape(b - a, BITS)
    full = np.flatnonzero(many)
    major = (2 * ones[full] > many[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(major, axis=1).reshape(-1).view(">u8").astype(np.uint64)
    return out


def body_hash(text_col: str) -> Column:
    """A 64-bit hash of the text; null like empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, body: the text's hash, fp long: the fingerprint's bits) for every row. Null text: no words, fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            fp = fingerprints_of(text_column(batch), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64))], names=["id", "body", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), body_hash(text_col).alias("body")).mapInArrow(run, f"id {kind}, body long, fp long")


class BkForest:
    """BK-trees over distinct fingerprints, one for each group, in flat arrays."""

    def __init__(self, fps: np.ndarray, groups: np.ndarray):
        """groups: the tree (0, 1, ...) of each fingerprint."""
        self.fps = fps
        n = len(fps)
        parent = np.full(n, -1, dtype=np.int64)
        key = np.zeros(n, dtype=np.int64)
        todo, at = np.arange(n), groups.astype(np.int64)
        self.roots = np.full(int(groups.max()) + 1 if n else 0, -1, dtype=np.int64)
        first_level = True
        while len(todo):
            order = np.argsort(at, kind="stable")
            todo, at = todo[order], at[order]
            head = np.concatenate(([True], at[1:] != at[:-1]))
            node = todo[head]  # the first of each group becomes the node there
            if first_level:
                self.roots[at[head]] = node
                first_level = False
            else:
                parent[node], key[node] = at[head] // (BITS + 1), at[head] % (BITS + 1)
            mine = np.repeat(node, np.diff(np.concatenate((np.flatnonzero(head), [len(at)]))))[~head]
            todo = todo[~head]
            d = np.bitwise_count(fps[todo] ^ fps[mine]).astype(np.int64)
            at = mine * (BITS + 1) + d
        inner = np.flatnonzero(parent >= 0)
        edge = parent[inner] * (BITS + 1) + key[inner]
        order = np.argsort(edge, kind="stable")
        self.edge, self.child = edge[order], inner[order]

    def links(self, queries: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) within the radius, so many that they join the same components as all such pairs."""
        out_q, out_n = [], []
        stack = []
        for a in range(0, len(queries), FRONTIER // 16):
            q = np.arange(a, min(a + FRONTIER // 16, len(queries)))
            stack.append((q, self.roots[groups[q]]))
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            out_q.append(q[near])
            out_n.append(node[near])
            low = np.where(near, radius + 1, np.maximum(d - radius, 1))
            lo = np.searchsorted(self.edge, node * (BITS + 1) + low, side="left")
            hi = np.searchsorted(self.edge, node * (BITS + 1) + np.minimum(d + radius, BITS), side="right")
            n = np.maximum(hi - lo, 0)
            if total := int(n.sum()):
                ends = np.cumsum(n)
                take = np.arange(total) - np.repeat(ends - n, n) + np.repeat(lo, n)
                stack.append((np.repeat(q, n), self.child[take]))
        return np.concatenate(out_q or [np.zeros(0, np.int64)]), np.concatenate(out_n or [np.zeros(0, np.int64)])


def smallest_of_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the smallest node of each one's component (pointer jumping)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def block_masks(radius: int, rows: int, wide: int | None = None) -> list[tuple[int, ...]]:
    """Bit positions of each pigeonhole key. Wider keys for more rows: all choices of j (``wide``) blocks out of radius + j."""
    j = wide or (1 if rows < 1 << 26 else 2 if rows < 1 << 34 else 3)
    cuts = np.linspace(0, BITS, radius + j + 1).astype(int)
    blocks = [tuple(range(x, y)) for x, y in zip(cuts, cuts[1:])]
    return [sum(chosen, ()) for chosen in combinations(blocks, j)]


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, tree, role, fp) sorted by shard, tree, role: role 0 builds a tree, roles 0 and 1 search it."""
    keep_s, keep_r, keep_f = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def solve(shard: np.ndarray, role: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        change = np.concatenate(([0], np.cumsum(shard[1:] != shard[:-1])))
        tree = np.flatnonzero(role == 0)
        forest = BkForest(fp[tree], change[tree])
        q, node = forest.links(fp, change, radius)
        node = tree[node]
        other = q != node
        label = smallest_of_components(q[other], node[other], len(fp))
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], names=["a", "b"])

    for batch in batches:
        s, r, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        keep_s, keep_r, keep_f = np.concatenate((keep_s, s)), np.concatenate((keep_r, r)), np.concatenate((keep_f, f.view(np.uint64)))
        if len(keep_s) < 2 * TREE_ROWS:
            continue
        last = int(np.searchsorted(keep_s, keep_s[-1], side="left"))  # the last shard may go on
        if last:
            yield solve(keep_s[:last], keep_r[:last], keep_f[:last])
            keep_s, keep_r, keep_f = keep_s[last:], keep_r[last:], keep_f[last:]
        elif keep_r[-1] and len(keep_s) > 4 * TREE_ROWS:
            # one large shard: its tree (role 0) is whole; search by what has come and keep the tree alone
            yield solve(keep_s, keep_r, keep_f)
            tree = keep_r == 0
            keep_s, keep_r, keep_f = keep_s[tree], keep_r[tree], keep_f[tree]
    if len(keep_s):
        yield solve(keep_s, keep_r, keep_f)


def links(distinct: DataFrame, radius: int = 4, tree_rows: int = TREE_ROWS, wide: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column fp: enough to join every component.

    Each shard gives a row per fingerprint that is not the first of its local component, never all pairs.
    """
    masks = block_masks(radius, distinct.count(), wide)

    def key(i: int, bits: tuple[int, ...]):
        mask = sum(1 << b for b in bits)
        signed = mask - (1 << 64) if mask >> 63 else mask
        return F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed)))

    keyed = distinct.select("fp", F.explode(F.array(*[key(i, m) for i, m in enumerate(masks)])).alias("shard"))
    large = keyed.groupBy("shard").count().filter(F.col("count") > tree_rows).select("shard", F.ceil(F.col("count") / (tree_rows // 2)).cast("int").alias("trees"))
    dealt = keyed.join(large, "shard", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("trees")).cast("int")
    rows = dealt.withColumn("own", own).withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    rows = rows.select(F.xxhash64("shard", "tree").alias("shard"), F.when(F.col("tree") == F.col("own"), 0).otherwise(1).cast("long").alias("role"), "fp")
    rows = rows.repartition(F.col("shard")).sortWithinPartitions("shard", "role", "fp")
    return rows.mapInArrow(lambda it: _linked(it, radius), "a long, b long")


#: Links that one task joins at most (16 bytes each); more take rounds over all executors.
ONE_TASK_LINKS = 500_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (u, v) of a graph: (node, root) for every node that is not its own root."""
    held = [[batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)] for batch in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*held) if held else ((), ())))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    label = smallest_of_components(at[: len(u)], at[len(u) :], len(nodes))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge but the roots: root is the smallest node reachable (signed order).

    Up to ONE_TASK_LINKS links are joined in one task: rounds of so few rows are only work for the driver. More alternate
    large-star and small-star steps on written tables until the edges no longer change.
    """
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if e.count() <= ONE_TASK_LINKS:
        joined = materialize(e.coalesce(1).mapInArrow(_stars, "node long, root long"), "components")
        forget(e)
        return joined
    seen = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        e, before = materialize(small, "edges"), e
        forget(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


#: A key with more than one row in HOT_SHARE is met by broadcast: there are fewer than HOT_SHARE such keys at any size.
HOT_SHARE = 20_000


def join_by_key(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with one row per key of values, whose column n says how many of the ``total`` rows have the key.

    Keys of many rows are broadcast, so that no key's rows meet in one task; the others are joined by shuffle.
    """
    least = max(2, total // HOT_SHARE)
    hot = F.broadcast(values.filter(F.col("n") > least).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(values.filter(F.col("n") <= least).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def name_groups(nodes: DataFrame, joined: DataFrame, key: str) -> DataFrame:
    """(key, n, root, component_id) for nodes (key, n: rows, least: smallest id): root by components(), component_id the smallest id of its nodes."""
    to_root = joined.select(F.col("node").alias(key), "root").unionByName(joined.select(F.col("root").alias(key), "root").distinct())
    linked = materialize(nodes.join(to_root, key), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    many = linked.withColumnRenamed("n", "rows").drop("least")
    found = join_by_key(many, least, "root", linked.count()).select(key, F.col("rows").alias("n"), "root", "component_id")
    alone = nodes.join(to_root.select(key), key, "left_anti").select(key, "n", F.col(key).alias("root"), F.col("least").alias("component_id"))
    return materialize(found.unionByName(alone), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, body, fp, root, component_id) for every row; component_id is the smallest id reachable over linked fingerprints.

    root names the component itself: rows that share an id may be in several. Null text or no words: fingerprint
    zero, linked like any other. Null ids take part and count as larger than any other (a group of null ids only has a
    null component_id). Repeated rows each give a row. Empty table: no rows. Extra columns play no part.
    """
    fp = materialize(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    distinct = materialize(fp.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    groups = name_groups(distinct, components(links(distinct, radius)), "fp")
    return join_by_key(fp, groups, "fp", fp.count()).select(F.col("id").alias("doc_id"), "body", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """One row of each component of ``groups``, with its columns as they were.

    A row is known by its id and its text's hash, so that rows which share an id but not the text are kept or dropped
    each by its own component. That of the smallest id stays (null ids come last), then that of the smallest hash; of rows
    with one id and one text that of the smallest hash of all columns. Empty table: no rows.
    """
    found = groups(docs, id_col, text_col).groupBy("doc_id", "body").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("n"))
    found = materialize(found, "found")
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "body")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("own_id"), F.col("k.body").alias("own_body"))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("body") == F.col("own_body"))
    gone = materialize(found.join(kept, same, "left_anti").select(F.col("doc_id").alias("own_id"), F.col("body").alias("own_body")), "gone")
    again = materialize(found.filter("n > 1").join(kept, same, "left_semi").select(F.col("doc_id").alias("own_id"), F.col("body").alias("own_body")), "again")
    mine = F.col(id_col).eqNullSafe(F.col("own_id")) & (body_hash(text_col) == F.col("own_body"))
    left = docs.join(broadcast_if_small(gone), mine, "left_anti")
    if again.isEmpty():
        return left
    again = broadcast_if_small(again)
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    once = docs.join(again, mine, "left_semi").select("*", body_hash(text_col).alias("__body"), F.xxhash64(*plain).alias("__row"))
    first = once.groupBy(F.col(id_col).alias("own_id"), F.col("__body").alias("own_body")).agg(F.min("__row").alias("own_row"))
    is_first = F.col(id_col).eqNullSafe(F.col("own_id")) & (F.col("__body") == F.col("own_body")) & (F.col("__row") == F.col("own_row"))
    once = once.join(broadcast_if_small(materialize(first, "first")), is_first, "left_semi").dropDuplicates([id_col, "__body"]).select(*docs.columns)
    return left.join(again, mine, "left_anti").unionByName(once)
