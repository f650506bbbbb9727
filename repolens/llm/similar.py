"""Near-duplicate groups by exact Jaccard similarity of word-shingle sets, for the pipeline's near-dedup stage.

First the SimHash operator's BK-trees link the fingerprints of the sets (five-word shingles) within RADIUS bits, and each
such link is checked on the sets. Fingerprints alone cannot decide a similarity of 0.8: some ten of 64 bits are
expected to differ there, and blocks for so wide a radius hold a large share of all fingerprints. So pairs that are
not in one component by then get a second way, which loses none: if all sets are sorted in one order, two sets with a
Jaccard similarity of t share a shingle among the first |S| - ceil(t |S|) + 1 of each. Shingles that are frequent in a
sample come last in that order; any order is right, the sample only keeps buckets small. Bitmaps of the sets bound what
two can share and drop most candidates without error; the others are compared exactly.

Sets that are equal are one node. In a bucket of more than SMALL nodes only links to a pivot are tried first. What is
still in different components then is settled inside the buckets, a share of them after the other (SHARES): bitmaps
tell which nodes of a bucket may still have a link to another component, only these meet again with their sets, and
each bucket gives the links that join its components, fewer than it has nodes. So a large group of near copies gives
rows in proportion to its size, most of its buckets are settled by the links of the first few, and no link between
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.simhash import body_hash, components, join_by_key, links, name_groups
from repolens.llm.text import give_back, sliced, text_column, words_of
from repolens.llm.xxh import xxh64_spans
from repolens.session import broadcast_if_small, materialize

WIDTH = 5
#: Bits that fingerprints of a first link differ in at most.
RADIUS = 4
#: The least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
#: Rows whose shingles are counted for the order, and shingles that are remembered as frequent.
SAMPLE_ROWS = 20_000
FREQUENT = 100_000
#: Nodes of a bucket that are paired at once.
SMALL = 16
#: Large buckets are settled in this order: one in 16, then of the rest one in 4, then all others.
SHARES = (16, 4, 1)
#: A set of n shingles has a bitmap of 2 n bits, rounded up to a power of two, LEAST_BITS at least.
LEAST_BITS = 256
#: Sets that a task remembers, so as to describe each once.
SEEN = 1_000_000


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (int64, ascending) of all texts, and each text's first place (one more at the end)."""
    n = len(texts)
    ids, offsets, words = words_of(texts, lower=True)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    joined = b" ".join(map(words.__getitem__, ids.tolist()))
    start = np.concatenate(([0], np.cumsum(size[ids] + 1)))
    counts = np.diff(offsets)
    many = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    edges = np.concatenate(([0], np.cumsum(many)))
    doc = np.repeat(np.arange(n), many)
    first = offsets[doc] + (np.arange(edges[-1]) - edges[doc])
    last = np.minimum(first + width, offsets[doc + 1])
    h = xxh64_spans(joined, start[first], start[last] - 1 - start[first], 42).view(np.int64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=n))))


def set_fingerprints(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """SimHash of each set of hashes h: a bit is 1 if set in over half of them."""
    size = np.diff(edges)
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        value = h.view(np.uint64)
        for bit in range(64):
            ones = np.add.reduceat(((value >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), edges[full])
            out[full] |= (2 * ones > size[full]).astype(np.uint64) << np.uint64(bit)
    return out


def _frequent(docs: DataFrame, text_col: str) -> np.ndarray:
    """Shingles that several texts of a sample have, ascending by their count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(text_column(batch))[0])], names=["h"])

    rows = docs.count()
    some = docs.select(F.col(text_col).cast("string").alias("text"))
    if rows > SAMPLE_ROWS:
        some = some.sample(SAMPLE_ROWS / rows, seed=42)
    seen = some.mapInArrow(run, "h long").groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    return np.array([r["h"] for r in reversed(seen)], dtype=np.int64)


def bitmaps(h: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """The bitmap of each set."""
    size = np.diff(edges)
    width = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    ends = np.cumsum(width)
    flags = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    wide = np.repeat(width, size)
    flags[np.repeat(ends - width, size) + (h.view(np.uint64) & (wide - 1).astype(np.uint64)).astype(np.int64)] = 1
    raw = np.packbits(flags).tobytes()
    return [raw[(y - n) // 8 : y // 8] for y, n in zip(ends.tolist(), width.tolist())]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes of hashes, whose sum names a set."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _prefixes(docs: DataFrame, id_col: str, text_col: str, frequent: np.ndarray) -> DataFrame:
    """(id, sig, size, body: the text's hash, fp: the set's fingerprint, prefix, bits) for every row; sig names the set. Of equal sets in a partition the first has the prefix and the bitmap."""
    by_hash = np.argsort(frequent)
    known = frequent[by_hash]
    a, b = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in sliced(batches, "text", 2 << 20):
            h, edges = shingle_sets(text_column(batch))
            n = batch.num_rows
            size = np.diff(edges)
            doc = np.repeat(np.arange(n), size)
            sig = np.zeros(n, np.uint64)
            np.add.at(sig, doc, _mixed(h))
            sig = sig.view(np.int64)
            first = np.zeros(n, dtype=bool)
            for i, name in enumerate(sig.tolist()):
                if name not in seen:
                    seen.add(name)
                    first[i] = True
            if len(seen) > SEEN:
                seen.clear()
            fp = set_fingerprints(h, edges)
            bits = [x if y else None for x, y in zip(bitmaps(h, edges), first.tolist())]
            rank = np.zeros(len(h), np.int64)  # 0: not frequent
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[at] == h, by_hash[at] + 1, 0)
            h = h[np.lexsort((h, rank, doc))]
            take = np.where(first & (size > 0), size + (-size * a) // b + 1, 0)  # (-size * a) // b is -ceil(size * a / b)
            place = np.arange(len(h)) - np.repeat(edges[:-1], size)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))).astype(np.int32)), pa.array(h[place < np.repeat(take, size)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sig), pa.array(size), batch.column(2), pa.array(fp.view(np.int64)), prefix, pa.array(bits, type=pa.binary())],
                names=["id", "sig", "size", "body", "fp", "prefix", "bits"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), body_hash(text_col).alias("body"))
    return rows.mapInArrow(run, f"id {kind}, sig long, size long, body long, fp long, prefix array<long>, bits binary")


def _column(values: pa.Array) -> np.ndarray:
    """Numbers as they are; bitmaps and sets as objects."""
    if pa.types.is_binary(values.type):
        out = np.empty(len(values), dtype=object)
        out[:] = values.to_pylist()
        return out
    if pa.types.is_list(values.type):
        out = np.empty(len(values), dtype=object)
        at = values.offsets.to_numpy()
        flat = values.values.to_numpy()
        for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
            out[i] = flat[a:b].copy()
        return out
    return values.to_numpy(zero_copy_only=False)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Whole buckets of rows sorted by their first column: the columns, and the places where buckets begin (one more at the end)."""
    held: list[np.ndarray] | None = None

    def cut(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        k = columns[0]
        return columns, np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))

    for batch in batches:
        now = [_column(x) for x in batch.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        last = int(np.searchsorted(held[0], held[0][-1], side="left")) if len(held[0]) else 0
        if last:
            yield cut([x[:last] for x in held])
            held = [x[last:] for x in held]
    if held is not None and len(held[0]):
        yield cut(held)


def _near_size(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    return np.minimum(x, y) * LEAST[1] >= np.maximum(x, y) * LEAST[0]


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sig, size, root) sorted by key, sig: (a, b, null) for pairs to try, (sig, size, key) for the rows of large buckets. Pairs of one root need no trial."""
    for columns, _ in _buckets(batches):
        new = np.concatenate(([True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])))  # a set may come from several partitions
        key, sig, size, root = (x[new] for x in columns)
        edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        many = np.diff(edges)
        bucket = np.repeat(np.arange(len(many)), many)
        place = np.arange(len(sig)) - edges[bucket]
        mixed = (np.minimum.reduceat(root, edges[:-1]) != np.maximum.reduceat(root, edges[:-1]))[bucket]
        large = (many[bucket] > SMALL) & mixed
        pairs = []
        for k in range(1, SMALL):  # each row with the k-th before it, in small buckets
            i = np.flatnonzero((place >= k) & (many[bucket] <= SMALL) & mixed)
            pairs.append((i - k, i))
        i = np.flatnonzero((place > 0) & large)
        pairs.append((edges[bucket[i]], i))
        p, q = (np.concatenate(x) for x in zip(*pairs))
        ok = _near_size(size[p], size[q]) & (root[p] != root[q])
        a, b = np.concatenate((sig[p[ok]], sig[large])), np.concatenate((sig[q[ok]], size[large]))
        keys = np.concatenate((np.zeros(int(ok.sum()), np.int64), key[large]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(keys, mask=np.arange(len(a)) < ok.sum())], names=["a", "b", "key"])


def _matrix(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of one length as rows of 64-bit words, folded to ``width`` bytes: bit i stands for all shingles that leave i."""
    m = np.frombuffer(b"".join(bits.tolist()), dtype=np.uint64).reshape(len(bits), -1, width // 8)
    return np.bitwise_or.reduce(m, axis=1)


def _at_least(size: np.ndarray, bits: np.ndarray, size2: np.ndarray | int, bits2: np.ndarray) -> np.ndarray:
    """Whether the similarity can be LEAST: each bit that one bitmap has alone stands for one shingle that its set has alone."""
    most = np.minimum(size - np.bitwise_count(bits & ~bits2).sum(axis=1, dtype=np.int64), size2 - np.bitwise_count(bits2 & ~bits).sum(axis=1, dtype=np.int64))
    return most * LEAST[1] >= (size + size2 - most) * LEAST[0]


def _possible(size: np.ndarray, bits: np.ndarray, size2: np.ndarray, bits2: np.ndarray) -> np.ndarray:
    """Whether each pair's similarity can be LEAST, by bitmaps of any lengths."""
    out = np.zeros(len(size), dtype=bool)
    n, m = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (bits, bits2))
    for x, y in set(zip(n.tolist(), m.tolist())):
        i = np.flatnonzero((n == x) & (m == y))
        for j in np.array_split(i, len(i) * max(x, y) // (32 << 20) + 1):
            out[j] = _at_least(size[j], _matrix(bits[j], min(x, y)), size2[j], _matrix(bits2[j], min(x, y)))
    return out


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sig, size, root, bits) sorted by key, size: those (key, sig, root, sign) that may be similar to one of another root in their bucket; sign names the set of these."""
    for (key, sig, size, root, bits), edges in _buckets(batches):
        marked = np.zeros(len(sig), dtype=bool)
        sign = np.zeros(len(sig), dtype=np.int64)
        for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
            if (root[lo:hi] == root[lo]).all():
                continue
            ends = np.searchsorted(size[lo:hi], size[lo:hi] * LEAST[1] // LEAST[0], side="right") + lo
            # sizes ascend, and so do the bitmaps' lengths
            length = np.fromiter(map(len, bits[lo:hi]), dtype=np.int64, count=hi - lo)
            widths = np.unique(length).tolist()
            cuts = {w: np.searchsorted(length, [w, w + 1]) + lo for w in widths}
            own = {w: _matrix(bits[x:y], w) for w, (x, y) in cuts.items()}
            folded = {w: _matrix(bits[slice(*cuts[2 * w])], w) for w in widths if 2 * w in cuts}
            for i in range(lo, hi - 1):
                w = int(length[i - lo])
                mine = own[w][i - cuts[w][0]][None, :]
                for first, last, maps in ((*cuts[w], own[w]), (*cuts[2 * w], folded[w])) if w in folded else ((*cuts[w], own[w]),):
                    a, b = max(i + 1, first), min(int(ends[i - lo]), last)
                    if a >= b:
                        continue
                    j = np.flatnonzero(root[a:b] != root[i]) + a
                    j = j[_at_least(size[j], maps[j - first], size[i], mine)]
                    if len(j):
                        marked[j] = marked[i] = True
            sign[lo:hi] = _mixed(sig[lo:hi][marked[lo:hi]]).sum(dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x[marked]) for x in (key, sig, root, sign)], names=["key", "sig", "root", "sign"])
    give_back()


def _joining_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, size, sig, root, shingles) sorted by key, size: similar pairs (a, b) that join all components of each bucket which any of its pairs joins."""
    for (_, size, sig, root, sets), edges in _buckets(batches):
        out = []
        for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
            label, n = root[lo:hi].copy(), size[lo:hi]
            ends = np.searchsorted(n, n * LEAST[1] // LEAST[0], side="right")
            maps = np.empty(hi - lo, dtype=object)
            maps[:] = bitmaps(np.concatenate(sets[lo:hi]), np.concatenate(([0], np.cumsum(n))))
            for i in range(hi - lo - 1):
                j = np.flatnonzero(label[i + 1 : ends[i]] != label[i]) + i + 1
                if not len(j):
                    continue
                mine = np.empty(len(j), dtype=object)
                mine[:] = [maps[i]] * len(j)
                j = j[_possible(n[j], maps[j], np.full(len(j), n[i]), mine)]
                for k in j.tolist():
                    if label[k] == label[i]:
                        continue
                    x, y = sets[lo + i], sets[lo + k]  # ascending
                    at = np.searchsorted(y, x)
                    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                    if shared * LEAST[1] >= (len(x) + len(y) - shared) * LEAST[0]:
                        out.append((sig[lo + i], sig[lo + k]))
                        label[label == label[k]] = label[i]
        a, b = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])
    give_back()


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, size and bits of a, size and bits of b): the possible pairs."""
    for batch in batches:
        a, b, n, x, m, y = map(_column, batch.columns)
        ok = _possible(n, x, m, y)
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])
    give_back()


def _sets(wanted: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(sig, shingles) for the rows (sig, body: the hash of a text that has this set) of wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            h, edges = shingle_sets(text_column(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(h))], names=["sig", "shingles"])

    found = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), body_hash(text_col).alias("body")).join(broadcast_if_small(materialize(wanted, "wanted")), "body").select("sig", "text")
    return materialize(found.mapInArrow(run, "sig long, shingles array<long>").dropDuplicates(["sig"]), "sets")


def _similar(possible: DataFrame, named: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The pairs (a, b) whose sets are at least LEAST similar. named: (sig, body) of every set. Only sets of these pairs are made whole."""
    pairs = materialize(possible, "possible")
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(named, "sig"), docs, text_col)
    both = pairs.join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), "a")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("sum"))
    return materialize(shared.filter(F.col("n") * LEAST[1] >= (F.col("sum") - F.col("n")) * LEAST[0]).select("a", "b"), "similar")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body, root, component_id) for every row; component_id is the smallest id reachable over pairs of 0.8 similarity or more.

    root names the component itself: rows that share an id may be in several. Null text or no words: the empty set, like
    any other. Texts of fewer than five words: one shingle of all. Null ids take part and count as larger than any other.
    Repeated rows each give a row. Empty table: no rows. Extra columns play no part.
    """
    rows = materialize(_prefixes(docs, id_col, text_col, _frequent(docs, text_col)), "prefixes")
    nodes = materialize(rows.groupBy("sig").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("body").alias("body"), F.min("fp").alias("fp")), "nodes")
    named = nodes.select("sig", "body")
    # links by fingerprint; equal fingerprints meet the first set that has them
    by_fp = materialize(nodes.groupBy("fp").agg(F.min("sig").alias("first"), F.count(F.lit(1)).alias("n")), "by_fp")
    of = lambda c: by_fp.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_sig"))
    near = links(by_fp.select("fp"), RADIUS).join(of("a"), "a").join(of("b"), "b").select(F.col("a_sig").alias("a"), F.col("b_sig").alias("b"))
    same = join_by_key(nodes.select("fp", "sig"), by_fp.filter("n > 1"), "fp", nodes.count()).filter("sig <> first").select(F.col("first").alias("a"), F.col("sig").alias("b"))
    edges = _similar(near.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), named, docs, text_col)
    joined = components(edges)
    # all other pairs of sets that share a prefix shingle
    to_root = lambda df, joined: df.join(broadcast_if_small(joined.withColumnRenamed("node", "sig")), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    rooted = to_root(rows.filter("bits is not null").select("sig", "size", "prefix"), joined).select(F.explode("prefix").alias("key"), "sig", "size", "root")
    first = materialize(rooted.repartition(F.col("key")).sortWithinPartitions("key", "sig").mapInArrow(_first_pairs, "a long, b long, key long"), "candidates")
    pairs = materialize(first.filter("key is null").select("a", "b").distinct(), "pairs")
    large = first.filter("key is not null").select("key", F.col("a").alias("sig"), F.col("b").alias("size"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).union(large.select("sig")).distinct()
    maps = rows.filter("bits is not null").select("sig", "size", "bits").join(broadcast_if_small(materialize(wanted, "mapped")), "sig", "left_semi")
    maps = materialize(maps.groupBy("sig").agg(F.min("size").alias("size"), F.min("bits").alias("bits")), "maps")
    side = lambda c, n: maps.select(F.col("sig").alias(c), F.col("size").alias(f"size{n}"), F.col("bits").alias(f"bits{n}"))
    possible = pairs.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", "size1", "bits1", "size2", "bits2").mapInArrow(_pruned, "a long, b long")
    more = _similar(possible, named, docs, text_col)
    if not more.isEmpty():
        edges = edges.unionByName(more)
        joined = components(edges)
    done, settled = F.lit(False), None
    for share in SHARES:
        turn = F.pmod(F.xxhash64("key", F.lit(16)), F.lit(share)) == 0
        rooted = to_root(large.filter(turn & ~done), joined).join(maps.select("sig", "bits"), "sig").select("key", "sig", "size", "root", "bits")
        done = done | turn
        still = materialize(rooted.repartition(F.col("key")).sortWithinPartitions("key", "size", "sig").mapInArrow(_open_rows, "key long, sig long, root long, sign long"), "open")
        # buckets with the same open nodes need one to be settled
        signs = still.groupBy("sign").agg(F.min("key").alias("key"))
        signs = materialize(signs if settled is None else signs.join(settled, "sign", "left_anti"), "signs")
        if signs.isEmpty():
            continue
        settled = signs.select("sign") if settled is None else settled.unionByName(signs.select("sign"))
        still = materialize(still.join(signs, ["sign", "key"], "left_semi"), "open")
        sets = _sets(still.select("sig").distinct().join(named, "sig"), docs, text_col)
        whole = still.join(sets, "sig").select("key", F.size("shingles").cast("long").alias("size"), "sig", "root", "shingles")
        found = materialize(whole.repartition(F.col("key")).sortWithinPartitions("key", "size", "sig").mapInArrow(_joining_links, "a long, b long").distinct(), "joining")
        if not found.isEmpty():
            edges = materialize(edges.unionByName(found), "similar")
            joined = components(edges)
    groups = name_groups(nodes.select("sig", "n", "least"), joined, "sig")
    return join_by_key(rows.select("id", "body", "sig"), groups, "sig", rows.count()).select(F.col("id").alias("doc_id"), "body", "root", "component_id")
