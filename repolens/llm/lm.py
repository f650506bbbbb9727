"""Language-model scoring (operator 7): an Elias-Fano n-gram trie, sharded by context.

Tokens are lower-cased words and one end per text. Four steps, none of which holds the model in one place:

1. Documents are dealt to blocks of about BLOCK_BYTES of text. A block asks for each of its distinct words once, with
   its own training counts; word shards add these up and answer. The answers are a written table: the numbers of all tokens
   and of distinct ones come from it before the next step.
2. A block asks for each of its distinct word pairs once, with its own training counts, the count of the context and the
   quantised probability of the word, so a pair in every document still gives one request per block.
3. Requests go to shards by their context (contexts are salted, so that a frequent one is spread over many shards). A
   shard adds up the training counts, builds its trie, and answers every request from it.
4. Blocks meet their answers and sum over their documents' tokens.

The trie's levels are monotone Elias-Fano sequences in one memory-mapped file: contexts, pointers to their first
successors, successors, and with each successor its smoothed probability (count + MASS * p(word)) / (count of context
+ MASS), as a logarithm quantised to 1/256 bit. A successor is found by a search relative to its context: the level
holds (context rank, word) as one increasing number, and the search runs on the packed form, by an index of one
count for each 64 bits. A pair that the trie does not hold has the context's rest, MASS * p(word) / (count + MASS). Words
are 64-bit hashes (contexts 48 bits within their shard, successors 32 within their context). The file lies in the task's
own temporary folder: only its task reads it, and a task that is run again builds it again.

Defined results: null and empty texts have one token, the end; a null id is not held out; repeated rows are
scored each and count each; very long texts are scored whole; empty tables give none; without training rows every count
is zero; extra columns play no part.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.text import give_back, hashes_of, text_column, unique_sorted, words_of
from repolens.session import materialize

BLOCK_BYTES = 10 << 20
SHARD_BYTES = 13 << 20
#: A context is spread over so many shards at least, and over one in SALT_SHARE of all, so that the share of the pairs
#: that one frequent context may have in a shard stays the same at any size.
LEAST_SALTS = 8
SALT_SHARE = 64
#: Weight of the word's own probability against the context's counts.
MASS = 200.0
WORD_BITS = 32
#: Bits of a context's hash within its shard.
CONTEXT_BITS = 48
END = hashes_of([b"\n"])[0]
START = hashes_of([b"\n\n"])[0]


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Place of the k-th set bit of each byte.
_PLACE = np.argsort(-_BITS.astype(np.int64), axis=1, kind="stable").astype(np.int64)


class EliasFano:
    """A monotone sequence of n numbers below ``universe``: low bits packed, high parts in unary, searched as they are.

    Beside the packed bits only the number of set bits before each 64 of the unary part is held.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low = n, low_bits, low
        self.high = np.concatenate((high, np.zeros(-len(high) % 8, dtype=np.uint8)))
        self.ones = np.concatenate(([0], np.cumsum(np.bitwise_count(self.high.view(np.uint64)), dtype=np.int64)))
        self.buckets = 8 * len(high) - n  # zeros: each ends a high part

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th set (unset) bit of the unary part."""
        before = np.arange(len(self.ones)) * 64 - self.ones if zeros else self.ones
        word = np.searchsorted(before, k, side="right") - 1
        rest = k - before[word]
        at, byte = word * 8, None
        for step in range(8):
            byte = self.high[at] ^ np.uint8(255 if zeros else 0)
            count = np.bitwise_count(byte).astype(np.int64)
            go = (rest >= count) & (step < 7)
            rest -= np.where(go, count, 0)
            at = at + go
        return at * 8 + _PLACE[byte, rest]

    def first_of(self, h: np.ndarray) -> np.ndarray:
        """The first place with a high part of at least h."""
        out = np.full(len(h), self.n, dtype=np.int64)
        out[h <= 0] = 0
        some = np.flatnonzero((h > 0) & (h <= self.buckets))
        out[some] = np.minimum(self._select(h[some] - 1, True) - (h[some] - 1), self.n)
        return out

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(low bits, packed low words, unary high bytes) of increasing values."""
        n = len(values)
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        high = (v >> np.uint64(low_bits)).astype(np.int64)
        unary = np.zeros(n + (universe >> low_bits) + 2, dtype=np.uint8)
        unary[high + np.arange(n)] = 1
        packed = np.zeros(n * low_bits // 64 + 2, dtype=np.uint64)
        if low_bits:
            low = v & np.uint64((1 << low_bits) - 1)
            bit = np.arange(n, dtype=np.int64) * low_bits
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            np.bitwise_or.at(packed, word, low << shift)
            over = (bit & 63) + low_bits > 64
            np.bitwise_or.at(packed, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        return low_bits, packed, np.packbits(unary, bitorder="little")

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        out = self.low[word] >> shift
        over = (bit & 63) + self.low_bits > 64
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, False) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.low_of(i)

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Place of each x, or -1: a successor search, within [lo, hi) where they are given."""
        x = x.astype(np.uint64)
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        a, b = self.first_of(h), self.first_of(h + 1)
        if lo is not None:
            a, b = np.maximum(a, lo), np.minimum(b, hi)
        end = b.copy()
        want = x & np.uint64((1 << self.low_bits) - 1)
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) >> 1
            less = self.low_of(mid) < want[open_]
            a[open_[less]], b[open_[~less]] = mid[less] + 1, mid[~less]
        found = np.full(len(x), -1, dtype=np.int64)
        ok = np.flatnonzero(a < end)
        ok = ok[self.low_of(a[ok]) == want[ok]]
        found[ok] = a[ok]
        return found


class Trie:
    """Two levels (contexts, successors) in one memory-mapped file."""

    def __init__(self, path: str, parts: list[tuple[int, int, str]], heads: list[tuple[int, int]]):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        arrays = [raw[a:b].view(kind) for a, b, kind in parts]
        self.contexts = EliasFano(*heads[0], arrays[0], arrays[1])
        self.pointers = EliasFano(*heads[1], arrays[2], arrays[3])
        self.successors = EliasFano(*heads[2], arrays[4], arrays[5])
        self.codes = arrays[6]

    @staticmethod
    def build(folder: str, context: np.ndarray, word: np.ndarray, codes: np.ndarray) -> Trie:
        """From distinct (48-bit context, 32-bit word) pairs, sorted, with the codes of their probabilities."""
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((first, [len(context)])))
        rank = np.repeat(np.arange(len(first)), size)
        sequences = [
            (context[first], 1 << CONTEXT_BITS),
            (np.concatenate((first, [len(context)])), len(context) + 1),
            ((rank.astype(np.uint64) << np.uint64(WORD_BITS)) | word, max(1, len(first)) << WORD_BITS),
        ]
        arrays, heads = [], []
        for values, universe in sequences:
            low_bits, low, high = EliasFano.encode(values, universe)
            heads.append((len(values), low_bits))
            arrays += [low, high]
        arrays.append(codes)
        path = os.path.join(folder, "trie.bin")
        parts, at = [], 0
        with open(path, "wb") as file:
            for x in arrays:
                raw = x.tobytes()
                parts.append((at, at + len(raw), x.dtype.str))
                at += len(raw) + (-len(raw) % 8)
                file.write(raw + b"\0" * (-len(raw) % 8))
            file.write(b"\0" * 8)
        return Trie(path, parts, heads)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Quantised code of each (context, word); 0 where it is not held."""
        out = np.zeros(len(context), dtype=np.uint16)
        rank = self.contexts.find(context)
        some = np.flatnonzero(rank >= 0)
        r = rank[some]
        lo, hi = self.pointers.access(r).astype(np.int64), self.pointers.access(r + 1).astype(np.int64)
        at = self.successors.find((r.astype(np.uint64) << np.uint64(WORD_BITS)) | word[some], lo, hi)
        hit = at >= 0
        out[some[hit]] = self.codes[at[hit]]
        return out


def code_of(p: np.ndarray) -> np.ndarray:
    """Code of probabilities: steps of 1/256 bit below 1, from 1 on; 0 stands for none."""
    return (np.minimum(np.round(np.log2(p) * -256), 65_000) + 1).astype(np.uint16)


def probability_of(code: np.ndarray) -> np.ndarray:
    return np.exp2((code.astype(float) - 1) / -256)


def _short(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 40 in five bytes each."""
    return (values & 0xFFFFFFFF).astype("<u4").tobytes() + (values >> 32).astype(np.uint8).tobytes()


def _long(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return np.frombuffer(raw, dtype="<u4", count=n).astype(np.int64) | (np.frombuffer(raw, dtype=np.uint8, offset=4 * n).astype(np.int64) << 32)


class Words:
    """Tokens of a block of texts and its distinct words in a fixed order."""

    def __init__(self, texts: pa.Array, shards: int):
        ids, offsets, words = words_of(texts, lower=True)
        n = len(texts)
        self.hash = np.concatenate((hashes_of(words), [END, START]))
        self.tokens = np.insert(ids, offsets[1:], len(words))
        self.first = offsets + np.arange(n + 1)
        # words in the order of shard, hash
        self.word_shard = (self.hash % np.uint64(shards)).astype(np.int64)
        self.word_order = np.lexsort((self.hash, self.word_shard))

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Training occurrences of each word (the start: training texts)."""
        words = np.bincount(self.tokens[np.repeat(train, np.diff(self.first))], minlength=len(self.hash))
        words[-1] = train.sum()
        return words

    def answered(self, answers: pa.Table) -> np.ndarray:
        """The training counts of all, in the order of the words."""
        counts = np.zeros(len(self.hash), dtype=np.int64)
        counts[self.word_order] = np.concatenate([_long(x) for x in answers.sort_by("shard").column("data").to_pylist()])
        return counts


class Block(Words):
    """The distinct pairs too, and every token's place in them."""

    def __init__(self, texts: pa.Array, shards: int):
        super().__init__(texts, shards)
        start, wide = len(self.hash) - 1, len(self.hash)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first[:-1]] = start
        # distinct pairs; their order: shard, context hash, 32-bit word
        self.code = before * wide + self.tokens
        self.pairs, _ = unique_sorted(self.code)
        self.a, self.b = self.pairs // wide, self.pairs % wide
        self.context, self.word = self.hash[self.a], self.hash[self.b] >> np.uint64(64 - WORD_BITS)
        salt = self.hash[self.b] % np.uint64(max(LEAST_SALTS, shards // SALT_SHARE))
        with np.errstate(over="ignore"):
            mixed = (self.context ^ (salt * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        self.pair_shard = ((mixed >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
        self.context >>= np.uint64(64 - CONTEXT_BITS)
        self.pair_order = np.lexsort((self.word, self.context, self.pair_shard))
        self.token_context = before

    def pair_counts(self, train: np.ndarray) -> np.ndarray:
        mine = np.repeat(train, np.diff(self.first))
        return np.bincount(np.searchsorted(self.pairs, self.code[mine]), minlength=len(self.pairs))


def _texts(table: pa.Table) -> pa.Array:
    return text_column(table.select(["text"]).combine_chunks().to_batches()[0]) if table.num_rows else pa.array([], type=pa.string())


def _by_shard(rows: list[tuple], which: int, schema: str) -> pa.Table:
    """Rows (shard, binaries) as a table with the block's number after the shard."""
    columns = list(zip(*rows)) if rows else [()] * (len(schema.split(", ")) - 1)
    return pa.table([pa.array(columns[0], type=pa.int64()), pa.array([which] * len(rows), type=pa.int64()), *(pa.array(c, type=pa.binary()) for c in columns[1:])], names=[x.split()[0] for x in schema.split(", ")])


ASK_WORDS = "shard long, block long, words binary, counts binary"


def _ask_words(table: pa.Table, shards: int) -> pa.Table:
    """A row for each shard: the block's distinct words with their training counts."""
    block = Words(_texts(table), shards)
    counts, order = block.counts(table.column("train").to_numpy()), block.word_order
    cuts = np.searchsorted(block.word_shard[order], np.arange(shards + 1))
    full = np.flatnonzero(np.diff(cuts)).tolist()
    rows = [(s, block.hash[mine].tobytes(), counts[mine].astype("<u4").tobytes()) for s in full for mine in [order[cuts[s] : cuts[s + 1]]]]
    return _by_shard(rows, table.column("block")[0].as_py(), ASK_WORDS)


ANSWER = "block long, shard long, pairs boolean, data binary"
COUNTED = ANSWER + ", tokens long, distinct long"


def _answer_words(table: pa.Table) -> pa.Table:
    """Add up a shard's word counts and answer every block."""
    asks = table.sort_by("block").to_pylist()
    h, c = [np.frombuffer(x["words"], dtype=np.uint64) for x in asks], [np.frombuffer(x["counts"], dtype="<u4") for x in asks]
    known, _ = unique_sorted(np.concatenate(h))
    total = np.zeros(len(known), dtype=np.int64)
    places = [np.searchsorted(known, x) for x in h]
    for at, n in zip(places, c):
        total[at] += n  # distinct within a block
    data = [_short(total[at]) for at in places]
    words = total[known != START]
    once = lambda value: pa.array([int(value)] + [0] * (len(asks) - 1), type=pa.int64())
    columns = [pa.array([x["block"] for x in asks], type=pa.int64()), pa.array([x["shard"] for x in asks], type=pa.int64()), pa.array([False] * len(asks)), pa.array(data, type=pa.binary())]
    return pa.table([*columns, once(words.sum()), once((words > 0).sum())], names=[x.split()[0] for x in COUNTED.split(", ")])


ASK = "shard long, block long, heads binary, tails binary, totals binary, sizes binary, keys binary, codes binary, counts binary, many binary"
#: A pair's training count in a block is sent in a byte; those of MANY or more in a list of their own.
MANY = 255


def _ask(table: pa.Table, answers: pa.Table, shards: int, whole: int) -> pa.Table:
    """A row for each shard: the block's pairs (contexts with their counts, successors of each, words with the codes of their probabilities) with training counts."""
    if not table.num_rows:
        return _by_shard([], 0, ASK)
    block = Block(_texts(table), shards)
    known, pairs = block.answered(answers), block.pair_counts(table.column("train").to_numpy())
    own = code_of((known + 1) / whole)[block.b]
    total = known[block.a]
    order = block.pair_order
    cuts = np.searchsorted(block.pair_shard[order], np.arange(shards + 1))
    rows = []
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        mine = order[cuts[s] : cuts[s + 1]]
        context = block.context[mine]
        head = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        size = np.diff(np.concatenate((head, [len(mine)])))
        w, h, n = block.word[mine], context[head], pairs[mine]
        rows.append((
            s, (h >> np.uint64(16)).astype("<u4").tobytes(), (h & np.uint64(0xFFFF)).astype("<u2").tobytes(), total[mine[head]].astype("<f4").tobytes(), size.astype("<u4").tobytes(), w.astype("<u4").tobytes(),
            own[mine].tobytes(), np.minimum(n, MANY).astype(np.uint8).tobytes(), n[n >= MANY].astype("<u4").tobytes(),
        ))
    which = table.column("block")[0].as_py()
    del block, known, pairs, own, total
    give_back()
    return _by_shard(rows, which, ASK)


def _answer(table: pa.Table) -> pa.Table:
    """Add up a shard's pair counts, build its trie, and answer every block from it."""
    asks = table.sort_by("block").to_pylist()
    heads = [(np.frombuffer(x["heads"], dtype="<u4").astype(np.uint64) << np.uint64(16)) | np.frombuffer(x["tails"], dtype="<u2") for x in asks]
    contexts, _ = unique_sorted(np.concatenate(heads))
    totals = np.zeros(len(contexts))
    keys, counts = [], []
    for x, head in zip(asks, heads):
        at = np.searchsorted(contexts, head)
        totals[at] = np.frombuffer(x["totals"], dtype="<f4")  # the same in every block
        rank = np.repeat(at, np.frombuffer(x["sizes"], dtype="<u4")).astype(np.uint64)
        keys.append((rank << np.uint64(WORD_BITS)) | np.frombuffer(x["keys"], dtype="<u4"))
        n = np.frombuffer(x["counts"], dtype=np.uint8).astype(np.int64)
        n[n == MANY] = np.frombuffer(x["many"], dtype="<u4")
        counts.append(n)
    del heads
    held, _ = unique_sorted(np.concatenate([k[n > 0] for k, n in zip(keys, counts)]))
    sums, own = np.zeros(len(held), dtype=np.int64), np.zeros(len(held), dtype=np.uint16)
    for x, k, n in zip(asks, keys, counts):
        mine = n > 0
        at = np.searchsorted(held, k[mine])
        sums[at] += n[mine]  # distinct within a block
        own[at] = np.frombuffer(x["codes"], dtype=np.uint16)[mine]
    mask = np.uint64((1 << WORD_BITS) - 1)
    rank = (held >> np.uint64(WORD_BITS)).astype(np.int64)
    smoothed = code_of((sums + MASS * probability_of(own)) / (totals[rank] + MASS))
    with tempfile.TemporaryDirectory() as folder:
        trie = Trie.build(folder, contexts[rank], held & mask, smoothed)
        del held, sums, own, rank, smoothed, totals, counts
        data = [trie.lookup(contexts[(k >> np.uint64(WORD_BITS)).astype(np.int64)], k & mask).tobytes() for k in keys]
        del trie
    out = pa.table([pa.array([x["block"] for x in asks], type=pa.int64()), pa.array([x["shard"] for x in asks], type=pa.int64()), pa.array([True] * len(asks)), pa.array(data, type=pa.binary())], names=["block", "shard", "pairs", "data"])
    del keys, data, asks
    give_back()
    return out


def _score(docs: pa.Table, answers: pa.Table, shards: int, tokens: int, vocabulary: int) -> pa.Table:
    """Sum over each document's tokens."""
    texts = _texts(docs)
    block = Block(texts, shards)
    of_pairs = answers.column("pairs").combine_chunks() if answers.num_rows else pa.array([], type=pa.bool_())
    counts = block.answered(answers.filter(pc.invert(of_pairs)))
    codes = np.zeros(len(block.pairs), dtype=np.uint16)
    codes[block.pair_order] = np.frombuffer(b"".join(answers.filter(of_pairs).sort_by("shard").column("data").to_pylist()), dtype=np.uint16)
    own = (counts + 1) / (tokens + vocabulary + 1)
    code = codes[np.searchsorted(block.pairs, block.code)]
    p = np.where(code > 0, probability_of(code), MASS * own[block.tokens] / (counts[block.token_context] + MASS))
    doc = np.repeat(np.arange(len(texts)), np.diff(block.first))
    add = lambda v: np.bincount(doc, weights=v, minlength=len(texts))
    return pa.table(
        [docs.column("doc_id"), docs.column("held"), pa.array(np.diff(block.first)), pa.array(add(counts[block.tokens] > 0).astype(np.int64)), pa.array(np.full(len(texts), tokens)), pa.array(add(np.log10(own)[block.tokens])), pa.array(add(np.log10(p)))],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Rows whose crc32 of the id as text leaves remainder ``fold`` of ``folds`` are held out of training.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held.alias("held"), (~held).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = int(size // BLOCK_BYTES + 1), int(size // SHARD_BYTES + 1)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    counted = dealt.groupBy("block").applyInArrow(lambda t: _ask_words(t, shards), ASK_WORDS).groupBy("shard").applyInArrow(_answer_words, COUNTED)
    counted = materialize(counted, "words")
    tokens, vocabulary = (x or 0 for x in counted.agg(F.sum("tokens"), F.sum("distinct")).first())
    counted = counted.drop("tokens", "distinct")
    asks = dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(lambda t, a: _ask(t, a, shards, tokens + vocabulary + 1), ASK)
    answers = asks.groupBy("shard").applyInArrow(_answer, ANSWER).unionByName(counted)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda d, a: _score(d, a, shards, tokens, vocabulary), schema)
