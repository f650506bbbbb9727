"""Clone detection without a suffix array: equal windows are grouped by hash, then extended while all members agree.

Input: ``files(repo_id, path, family, syms array<string>, lines array<int>, ends array<boolean>)``, a row per file.
Window hashes are made in Arrow batches in time linear in the tokens (two independent rolling hashes), the groups
by one shuffle of packed hashes and places; token sequences never leave their file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.session import by_shuffle, materialize

SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def window_hashes(tokens: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Hash of each window of ``size`` token hashes, modulo 2**64: one multiply and add for each bit of the size."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        # acc covers ``done`` tokens from each place; power covers 2**k
        power, power_len, power_factor = tokens.copy(), 1, np.uint64(factor)
        acc, done = None, 0
        rest = size
        while rest:
            if rest & 1:
                if acc is None:
                    acc, done = power.copy(), power_len
                else:
                    m = len(tokens) - done - power_len + 1
                    acc = acc[:m] * power_factor + power[done : done + m]
                    done += power_len
            rest >>= 1
            if rest:
                m = len(tokens) - 2 * power_len + 1
                power = power[:m] * power_factor + power[power_len : power_len + m]
                power_len, power_factor = 2 * power_len, power_factor * power_factor
        mixed = acc[:n]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(SALTS[1])
        return mixed ^ (mixed >> np.uint64(29))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of lists (of tokens or their hashes), or of the white-space words of texts, and the number of tokens of each row."""
    if pa.types.is_list(column.type) and pa.types.is_int64(column.type.value_type):  # hashed before
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), size
    if not pa.types.is_list(column.type):
        column = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten(), "")
    if pa.types.is_string(flat.type) and len(flat):
        full = pc.not_equal(pc.binary_length(flat), 0)
        if not pc.all(full).as_py():
            row = np.repeat(np.arange(len(size)), size)[full.to_numpy(zero_copy_only=False)]
            size, flat = np.bincount(row, minlength=len(size)), flat.filter(full)
    coded = flat.dictionary_encode()
    each = np.fromiter((xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return each[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64), size


#: Windows that one task gathers, about, and of how many at a time a task makes its rows.
SHARE, BUFFER = 2_000_000, 1_000_000


def _planes(column: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of each value, all first bytes first: the upper ones are alike and compress."""
    return np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1)[:, :width].T).tobytes()


def _values(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T
    return out.reshape(-1).view(np.uint64)


def repeated(files: DataFrame, size: int, syms: str = "syms", tokens: Column | None = None, by: list[str] | None = None, of: str | None = None, file: str | None = None, leftmost: bool = False) -> DataFrame:
    """Groups of equal windows that occur twice or more: (h1, h2, n, n_prev, at_start), or their places (file, start, h1, h2, n).

    ``syms`` is an array of tokens, or a text whose white-space words are the tokens. Empty tokens do not count. ``tokens``
    is their number, about. Windows of different ``by`` are not equal. n_prev counts the distinct tokens before a group's
    windows, or of another column's values where ``of`` names it, and at_start those without. ``file``, a whole number,
    names each place; ``leftmost`` leaves the places of left-maximal groups.

    Windows are shuffled once, packed by ranges of their hash: 10 bytes of hashes, five of the token before, and for places
    some five more; each task sorts its range. Equal ones of a task's buffer travel as one with their number.
    """
    total = files.agg(F.sum(F.octet_length(syms) / 6 if tokens is None else tokens)).first()[0] or 0
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, min(least, int(total // 100_000)), int(total // SHARE))
    before = not file or leftmost

    def mark(values: np.ndarray, null: np.ndarray) -> np.ndarray:
        """Five bytes of a hash, 0 for none."""
        low = values & np.uint64((1 << 40) - 1)
        return np.where(null, np.uint64(0), np.where(low == 0, np.uint64(1), low))

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h1, *rest = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(h1)
        h1, h2, prev, at, start, known = h1[order], *(c[order] for c in rest)
        n = np.ones(len(h1), dtype=np.uint64)
        if not file:  # equal ones once
            same = h1[1:] == h1[:-1]
            inside = np.concatenate((same, [False])) | np.concatenate(([False], same))
            few = np.flatnonzero(inside)
            few = few[np.lexsort((prev[few], h2[few], h1[few]))]
            if len(few):
                first = np.concatenate(([True], (h1[few][1:] != h1[few][:-1]) | (h2[few][1:] != h2[few][:-1]) | (prev[few][1:] != prev[few][:-1])))
                begins = np.flatnonzero(first)
                n[few[begins]] = np.diff(np.concatenate((begins, [len(few)]))).astype(np.uint64)
                kept = np.sort(np.concatenate((np.flatnonzero(~inside), few[begins])))
                h1, h2, prev, at, start, known, n = (c[kept] for c in (h1, h2, prev, at, start, known, n))
        share = ((h1 >> np.uint64(32)) * np.uint64(shares)) >> np.uint64(32)
        cuts = np.flatnonzero(np.concatenate(([True], share[1:] != share[:-1])))
        columns = [(h1, 8), (h2, 2), *([(prev, 5)] if before else []), *([(at, 8), (start, 4), (known, 1)] if file else [(n, 4)])]
        packs = [[_planes(c[lo:hi], w) for lo, hi in zip(cuts, [*cuts[1:], len(h1)])] for c, w in columns]
        return pa.RecordBatch.from_arrays([pa.array(share[cuts].astype(np.int32)), *(pa.array(x, type=pa.binary()) for x in packs)], names=names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many_held = [], 0
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                t, many = _tokens(batch.column(0))
                ends = np.cumsum(many)
                row = np.repeat(np.arange(batch.num_rows), many)
                at = np.flatnonzero(np.arange(len(t)) + size <= ends[row])
                if not len(at):
                    continue
                row = row[at]
                salt, name, value = (pc.fill_null(batch.column(j), 0).to_numpy(zero_copy_only=False).view(np.uint64)[row] for j in (1, 2, 3))
                start = at - (ends - many)[row]
                if of:
                    prev = mark(value, batch.column(3).is_null().to_numpy(zero_copy_only=False)[row])
                else:
                    prev = mark(t[np.maximum(at - 1, 0)], start == 0)
                h1, h2 = (window_hashes(t, size, f)[at] for f in _FACTORS)
                known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)[row].astype(np.uint64)
                held.append((h1 ^ salt, h2 & np.uint64(0xFFFF), prev, name, start.astype(np.uint64), known))
                many_held += len(at)
                if many_held >= BUFFER:
                    yield packed(held)
                    held, many_held = [], 0
        if held:
            yield packed(held)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = [8, 2, *([5] if before else []), *([8, 4, 1] if file else [4])]
        found = [[] for _ in widths]
        for b in batches:
            for j, w in enumerate(widths):
                found[j] += [_values(x.as_buffer().to_pybytes(), w) for x in b.column(j + 1)]
        if not found[0]:
            return
        h1, h2, *rest = (np.concatenate(c) for c in found)
        order = np.lexsort((h2, h1))
        h1, h2, *rest = h1[order], h2[order], *(c[order] for c in rest)
        prev = rest.pop(0) if before else None
        first = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        begins = np.flatnonzero(first)
        n = np.add.reduceat(np.ones(len(h1), np.int64) if file else rest[0].astype(np.int64), begins)
        group, good = np.cumsum(first) - 1, n >= 2
        if before:
            inside = np.flatnonzero(good[group])
            inside = inside[np.lexsort((prev[inside], group[inside]))]
            g, p = group[inside], prev[inside]
            other = np.concatenate(([True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])))[: len(g)] & (p != 0)
            n_prev = np.bincount(g[other], minlength=len(n))
            times = np.ones(len(g), np.int64) if file else rest[0][inside].astype(np.int64)
            at_start = np.bincount(g[p == 0], weights=times[p == 0], minlength=len(n)).astype(np.int64)
            if leftmost:
                good &= n_prev + at_start > 1
        if file:
            rows = np.flatnonzero(good[group])
            at, start, known = (c[rows] for c in rest)
            columns = [pa.array(at.view(np.int64), mask=known == 0), pa.array(start.astype(np.int32)), *(pa.array(c[rows].view(np.int64)) for c in (h1, h2)), pa.array(n[group[rows]])]
        else:
            columns = [*(pa.array(c[begins][good].view(np.int64)) for c in (h1, h2)), *(pa.array(c[good].astype(np.int64)) for c in (n, n_prev, at_start))]
        out = pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in kinds.split(", ")])
        for begin in range(0, out.num_rows, 65_536):
            yield out.slice(begin, 65_536)

    names = ["share", "h1", "h2", *(["prev"] if before else []), *(["at", "start", "known"] if file else ["n"])]
    kinds = f"{file} long, start int, h1 long, h2 long, n long" if file else "h1 long, h2 long, n long, n_prev long, at_start long"
    none = F.lit(None).cast("long")
    asked = files.select(syms, (F.xxhash64(*by) if by else F.lit(0).cast("long")).alias("_salt"), (F.col(file).cast("long") if file else none).alias("_file"), (F.when(F.col(of).isNotNull(), F.xxhash64(of)) if of else none).alias("_of"))
    dealt = asked.mapInArrow(deal, ", ".join(f"{x} {'int' if x == 'share' else 'binary'}" for x in names))
    return dealt.repartitionById(shares, "share").mapInArrow(gather, kinds)


def left_maximal(groups: DataFrame) -> DataFrame:
    """Groups that cannot be extended to the left: preceding tokens differ, or one stands at a file's start."""
    return groups.filter((F.col("n_prev") + F.col("at_start")) > 1)


def without_overlap(starts: list[int], size: int) -> list[int]:
    """Greedy from the left: each kept block begins after the last one's end."""
    out: list[int] = []
    for x in sorted(starts):
        if not out or x >= out[-1] + size:
            out.append(x)
    return out


def alpha_key(names: list[str]) -> tuple[int, ...]:
    """First place of each identifier: equal for blocks that differ by a consistent renaming."""
    first: dict[str, int] = {}
    return tuple(first.setdefault(x, i) for i, x in enumerate(names))


def renamed_windows(files: DataFrame, size: int, key: list[str], syms: str = "syms") -> DataFrame:
    """key columns, start (from 0), alpha: a row per window of ``size`` tokens, with its alpha_key as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, names in enumerate(b.column(len(key)).to_pylist()):
                if names and len(names) >= size:
                    starts = range(len(names) - size + 1)
                    alpha = [",".join(str(x + 1) for x in alpha_key(names[a : a + size])) for a in starts]
                    same = pa.array([i] * len(alpha))
                    yield pa.RecordBatch.from_arrays([*(b.column(j).take(same) for j in range(len(key))), pa.array(list(starts), type=pa.int32()), pa.array(alpha, type=pa.string())], names=[*key, "start", "alpha"])

    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in key)
    return files.select(*key, syms).mapInArrow(run, f"{kinds}, start int, alpha string")


#: Lengths that one pass over the files tries for every group.
TRIES = 16

class BlockHashes:
    """Hash of any block of a token sequence in constant time, from sums of tokens times powers of an odd factor modulo 2**64."""

    def __init__(self, tokens: np.ndarray):
        self.sums, self.backs = [], []
        n = len(tokens)
        with np.errstate(over="ignore"):
            for factor in _FACTORS:
                powers, back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, f, dtype=np.uint64)))) for f in (factor, pow(factor, -1, 1 << 64)))
                self.sums.append(np.concatenate(([np.uint64(0)], np.cumsum(tokens * powers[:n], dtype=np.uint64))))
                self.backs.append(back)

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            a, b = ((q[start + size] - q[start]) * back[start] for q, back in zip(self.sums, self.backs))
            a = (a ^ (a >> np.uint64(31))) * np.uint64(SALTS[1])
            b = (b ^ (b >> np.uint64(29))) * np.uint64(SALTS[0])
            return (a ^ (a >> np.uint64(32)) ^ b).view(np.int64)


GROUP = ["repo_id", "family", "h1", "h2"]


def _asked(coded: DataFrame, places: DataFrame, columns: list[str]) -> DataFrame:
    """Files with what is asked of them: (h1, h2, start, columns) of their places, which are no more than their tokens."""
    asks = places.groupBy("repo_id", "family", "path").agg(F.collect_list(F.struct("h1", "h2", "start", *columns)).alias("asks"))
    return coded.join(by_shuffle(asks), ["repo_id", "family", "path"])


def common_length(coded: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """(repo_id, family, h1, h2, length): how many tokens all places (GROUP, path, start) of a group share from their starts on.

    Every pass tries TRIES lengths between those known to be shared and not: each file answers with one hash a try for
    its places, so rows are narrow however long the files are, and the range shrinks by TRIES each time. The answers of
    256 files are made together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                # files one after the other: the hash of a block does not depend on its place
                tokens, many = _tokens(batch.column(2))
                asks = batch.column(3)
                row = np.repeat(np.arange(batch.num_rows), asks.value_lengths().to_numpy(zero_copy_only=False))
                a, blocks, first = asks.flatten(), BlockHashes(tokens), (np.cumsum(many) - many)[row]
                start, low, high = (a.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "low", "high"))
                for lo in range(0, len(start), 16_384):
                    part = slice(lo, lo + 16_384)
                    tries = low[part, None] + -(-(high - low)[part, None] * np.arange(1, TRIES + 1)[None, :] // TRIES)
                    got = blocks.of(np.repeat(first[part] + start[part], TRIES), tries.ravel())
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(got), TRIES).cast(pa.list_(pa.int64()))
                    own, at = a.slice(lo, 16_384), pa.array(row[part])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), own.field("h1"), own.field("h2"), lists], names=[*GROUP, "got"])

    ends = places.join(by_shuffle(coded.select("repo_id", "family", "path", "tokens")), ["repo_id", "family", "path"])
    left = materialize(ends.groupBy(*GROUP).agg(F.lit(size).cast("long").alias("low"), F.min(F.col("tokens") - F.col("start")).cast("long").alias("high")), "lengths")
    done = left.filter("low >= high").select(*GROUP, F.col("low").cast("int").alias("length"))
    codes = F.transform("syms", lambda x: F.xxhash64(x))  # narrower than the tokens in a shuffle
    while not (left := left.filter("low < high")).isEmpty():
        answers = _asked(coded.select("repo_id", "family", "path", codes.alias("codes")), places.join(by_shuffle(left), GROUP), ["low", "high"]).select("repo_id", "family", "codes", "asks")
        got = answers.mapInArrow(run, "repo_id string, family string, h1 long, h2 long, got array<long>")
        same = got.groupBy(*GROUP).agg(F.array(*[F.min(F.get("got", F.lit(i))) == F.max(F.get("got", F.lit(i))) for i in range(TRIES)]).alias("same"))
        # how many of the tries all places agree in: the agreement ends once
        agreed = F.coalesce(F.array_position("same", False), F.lit(0))
        agreed = F.when(agreed == 0, TRIES).otherwise(agreed - 1)
        tried = lambda k: F.col("low") + F.ceil((F.col("high") - F.col("low")) * k / TRIES).cast("long")
        now = left.join(by_shuffle(same.select(*GROUP, agreed.alias("k"))), GROUP).select(*GROUP, tried(F.col("k")).alias("low"), F.when(F.col("k") == TRIES, F.col("high")).otherwise(tried(F.col("k") + 1) - 1).alias("high"))
        left = materialize(now, "lengths")
        done = done.unionByName(left.filter("low >= high").select(*GROUP, F.col("low").cast("int").alias("length")))
    return done


def _blocks(coded: DataFrame, kept: DataFrame, semantic: bool) -> DataFrame:
    """Blocks (GROUP, path, start, length) with their first and last line, statement ends, renaming class and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                yield blocks(whole.slice(begin, 256))

    def blocks(b: pa.RecordBatch) -> pa.RecordBatch:
        syms, lines, ends, asks = (b.column(j) for j in range(3, 7))
        names = b.column(7) if semantic else syms  # else all of one renaming class
        many = syms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(b.num_rows), asks.value_lengths().to_numpy(zero_copy_only=False))
        a = asks.flatten()
        start, length = (a.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "length"))
        lo = (np.cumsum(many) - many)[row] + start
        hi = lo + length
        closed = np.concatenate(([0], np.cumsum(ends.flatten().to_numpy(zero_copy_only=False).astype(np.int64))))
        line = lines.flatten().to_numpy(zero_copy_only=False)
        coded = [x.flatten().dictionary_encode() for x in (syms, names)]
        (sym, name), (words, shown) = ([x.indices.to_numpy(zero_copy_only=False) for x in coded], [x.dictionary.to_pylist() for x in coded])
        prints, classes, out = {}, {}, ([], [])
        for x, y in zip(lo.tolist(), hi.tolist()):
            key = sym[x:y].tobytes()
            if (print_ := prints.get(key)) is None:  # members of a group are mostly alike
                print_ = prints[key] = f"{xxhash.xxh64_intdigest('\u0003'.join([words[i] for i in sym[x:y].tolist()]).encode(), 42) & 0xFFFFFFFF:08x}"
            key = name[x:y].tobytes()
            if (renamed := classes.get(key)) is None:
                own = [shown[i] for i in name[x:y].tolist()]
                first = alpha_key([n or i for i, n in enumerate(own)]) if semantic else ()
                renamed = classes[key] = xxhash.xxh64_intdigest(",".join(str(k) if n else "" for k, n in zip(first, own))) >> 1
            out[0].append(renamed)
            out[1].append(print_)
        at = pa.array(row)
        columns = [b.column(0).take(at), b.column(1).take(at), a.field("h1"), a.field("h2"), b.column(2).take(at), a.field("start"), a.field("length"), pa.array(line[lo]), pa.array(line[hi - 1]), pa.array((closed[hi] - closed[lo]).astype(np.int32)), pa.array(out[0], type=pa.int64()), pa.array(out[1], type=pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ddl.split(", ")])

    ddl = "repo_id string, family string, h1 long, h2 long, path string, start int, length int, start_line int, end_line int, statements int, alpha long, fingerprint string"
    return _asked(coded, kept, ["length"]).select("repo_id", "family", "path", "syms", "lines", "ends", "asks", *(["names"] if semantic else [])).mapInArrow(run, ddl)


def clone_groups(files: DataFrame, min_tokens: int = 30, mode: str = "mild", skip_local: bool = False, all_classes: bool = False) -> DataFrame:
    """Clone groups: (repo_id, family, length, members array<struct<path,start,start_line,end_line>>, fingerprint).

    mode: exact, mild (numbers alike), weak (strings too) or semantic (identifiers too, up to consistent renaming).
    files needs ``kinds array<string>`` (ident, num, str, punct) and ``texts array<string>`` beside lines and ends.

    A group is as long as all members agree, which hashes of their blocks tell; token sequences never leave their
    file, rows of a shuffle hold places and hashes alone, and only (path, line) pairs are gathered.
    """
    alike = {"exact": [], "mild": ["num"], "weak": ["num", "str"], "semantic": ["num", "str", "ident"]}[mode]
    plain = lambda t, k: F.concat(k, F.lit("\u0002"), t)
    sym = F.zip_with("texts", "kinds", lambda t, k: F.when(k.isin(alike), F.concat(F.lit("\u0001"), k)).otherwise(plain(t, k)) if alike else plain(t, k))
    names = F.zip_with("texts", "kinds", lambda t, k: F.when(k == "ident", t).otherwise(""))
    coded = materialize(files.select("repo_id", "family", "path", sym.alias("syms"), names.alias("names"), "lines", "ends", F.size("texts").alias("tokens"), F.monotonically_increasing_id().alias("file")), "tokens")
    found = repeated(coded, min_tokens, "syms", F.col("tokens"), ["repo_id", "family"], file="file", leftmost=True)
    places = materialize(found.join(by_shuffle(coded.select("repo_id", "family", "path", "file")), "file").select(*GROUP, "path", "start"), "places")
    cut = places.join(by_shuffle(common_length(coded, places, min_tokens)), GROUP)
    # of one file's overlapping blocks the greedy choice from the left stays
    starts = cut.groupBy(*GROUP, "path", "length").agg(F.array_sort(F.collect_set("start")).alias("s"))
    kept = starts.select(*GROUP, "path", "length", F.explode(greedy_starts(F.col("s"), F.col("length"))).alias("start"))
    kept = _blocks(coded, kept, mode == "semantic").filter("statements >= 2").withColumn("order", F.split("path", "/"))
    member = F.struct("path", "start", "start_line", "end_line")
    classes = kept.groupBy(*GROUP, "length", "alpha", "fingerprint").agg(
        F.array_sort(F.collect_list(F.struct("order", "start", member.alias("member")))).alias("m"), F.count_distinct(F.regexp_replace("path", "[^/]*$", "")).alias("dirs"), F.min(F.struct("order", "start")).alias("head"))
    if not all_classes:  # the class of the group's first member only
        best = F.min_by(F.struct("length", "fingerprint", "m", "dirs"), "head").alias("best")
        classes = classes.groupBy(*GROUP).agg(best).select(*GROUP, "best.*")
    classes = classes.filter(F.size("m") >= 2)
    if skip_local:
        classes = classes.filter("dirs > 1")
    return classes.select("repo_id", "family", "length", F.col("m.member").alias("members"), "fingerprint").dropDuplicates(["repo_id", "family", "fingerprint", "length"])


def greedy_starts(starts: Column, length: Column) -> Column:
    """Of sorted starts of blocks those that begin after the end of the last one kept."""
    return F.aggregate(starts, F.array().cast("array<int>"), lambda acc, x: F.when((F.size(acc) == 0) | (x >= F.try_element_at(acc, F.lit(-1)) + length), F.concat(acc, F.array(x))).otherwise(acc))
