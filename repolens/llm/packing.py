"""Packing token sequences into windows (operator 8) by Karmarkar-Karp multiway differencing.

Documents are tokenised in Arrow batches (each distinct word once), cut into whole windows and a
remainder, and the remainders of a unit of documents, in parts, are spread over near-equal windows: partial partitions
are merged largest difference first, the fullest window of one with the emptiest of the other. The window
count starts at the least possible and rises while a window exceeds the capacity.

Units are runs of rows within an input partition, so no shuffle is needed and a lost executor's partition
gives the same windows again; where rows have given places, units are runs of these and one shuffle gathers them. Defined results: null and empty texts still give their end id; repeated rows
are packed each; a text of any length is cut into windows; empty tables give none; extra columns play no part.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.text import bytes_list, sliced, text_column

#: Remainders that are differenced together at most, and the longest part that they are cut into (of equal length):
#: smaller parts make windows more alike.
UNIT = 512
PART = 1024
#: Tokens of a unit that are held at once, where units follow given places.
HELD = 4 << 20
#: Bytes of text that are tokenised at once; distinct words are encoded once in each.
SLICE = 4 << 20
#: Pieces in one generation of a worker's memory; it keeps two generations.
CACHE = 400_000

_tokenizers: dict[str, ChunkTokenizer] = {}

#: Classes of bytes in a chunk: 0 others, 1 a-z, 2 punctuation that ends a word (an apostrophe may begin a suffix),
#: 3 the lead byte of two-byte Latin letters, 4 bytes that make a lower-case letter after it.
_BYTE = np.zeros(256, dtype=np.uint8)
_BYTE[97:123] = 1
_BYTE[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_BYTE[0xC3] = 3
_BYTE[[0x9F, *range(0xA0, 0xB7), *range(0xB8, 0xC0)]] = 4


def _byte_alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(shown)]
    return {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(rest)}


class ChunkTokenizer:
    """Ids of texts whose tokenizer lower-cases and never joins over ASCII white space.

    Texts are lower-cased (A-Z) and cut at white space, and chunks before the punctuation that ends them, where the
    letter before it shows that the tokenizer cuts there too. Every distinct piece of a slice is looked up once in two
    generations of remembered pieces; when the younger is full it becomes the older, so that memory is bounded and
    frequent words stay. Pieces of lower-case letters alone go to the model directly, all others through the whole
    tokenizer.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.cache = cache
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.shown = _byte_alphabet()

    @staticmethod
    def of(path: str) -> ChunkTokenizer:
        if path not in _tokenizers:
            _tokenizers[path] = ChunkTokenizer(path)
        return _tokenizers[path]

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece by the whole tokenizer."""
        out = []
        for a in range(0, len(pieces), 2000):
            texts = [x.decode("utf-8", "replace") for x in pieces[a : a + 2000]]
            encoded = self.inner.encode("\n".join(texts), add_special_tokens=False)
            ids = np.array(encoded.ids, dtype="<u4")
            ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
            owner = np.searchsorted(ends, np.fromiter((x for x, _ in encoded.offsets), dtype=np.int64, count=len(ids)), side="right")
            cuts = (np.searchsorted(owner, np.arange(len(texts) + 1)) * 4).tolist()
            raw = ids.tobytes()
            out += [raw[x:y] for x, y in zip(cuts, cuts[1:])]
        return out

    def _of_letters(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece of lower-case letters: one word of the model each."""
        model, shown = self.inner.model, self.shown
        return [array("I", [t.id for t in model.tokenize(x.decode("latin-1").translate(shown))]).tobytes() for x in pieces]

    def piece_ids(self, pieces: list[bytes], letters: np.ndarray) -> list[bytes]:
        """Little-endian ids of each piece; letters: whether it has lower-case letters alone."""
        young, old = self.young, self.old
        got = list(map(young.get, pieces))
        missing = [i for i, x in enumerate(got) if x is None]
        again = [old.get(pieces[i]) for i in missing]
        for i, x in zip(missing, again):
            got[i] = x
        fresh = [i for i, x in zip(missing, again) if x is None]
        plain = letters[fresh].tolist() if fresh else []
        for coder, mine in ((self._of_letters, [i for i, x in zip(fresh, plain) if x]), (self._encoded, [i for i, x in zip(fresh, plain) if not x])):
            for i, x in zip(mine, coder([pieces[i] for i in mine])):
                got[i] = x
        if len(young) + len(missing) > self.cache:
            self.old, self.young = young, {}
        self.young.update((pieces[i], got[i]) for i in missing)
        return got

    @staticmethod
    def _cut(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Length of the word that each chunk's last punctuation ends (the whole chunk where it is no such), and whether that word is of lower-case letters alone."""
        n = len(chunks)
        _, offs, data = chunks.buffers()
        at = np.frombuffer(offs, dtype=np.int32)[chunks.offset : chunks.offset + n + 1].astype(np.int64)
        kind = _BYTE[np.frombuffer(data, dtype=np.uint8)[: at[-1]]] if data is not None and at[-1] else np.zeros(0, np.uint8)
        lead = np.concatenate(([False], kind[:-1] == 3))
        letter = (kind == 1) | ((kind == 4) & lead)
        size = np.diff(at)
        stem = size.copy()
        todo = np.flatnonzero(size > 1)
        while len(todo):  # one byte less while the last is punctuation
            todo = todo[kind[at[todo] + stem[todo] - 1] == 2]
            stem[todo] -= 1
            todo = todo[stem[todo] > 0]
        good = np.flatnonzero((stem > 0) & (stem < size))
        cut = good[letter[at[good] + stem[good] - 1]]
        whole = np.ones(n, dtype=bool)
        whole[cut] = False
        stem[whole] = size[whole]
        part = letter.copy()
        part[:-1] |= (kind[:-1] == 3) & letter[1:]
        bad = np.concatenate(([0], np.cumsum(~part)))
        return stem, (stem > 0) & (bad[at[:-1] + stem] == bad[at[:-1]])

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and the texts' first places (one more at the end)."""
        special = pc.any(pc.match_substring(texts, "<|"), min_count=0).as_py()  # names of special tokens are read as they are
        lists = pc.ascii_split_whitespace(texts if special else pc.ascii_lower(texts))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary
        stem, letters = self._cut(chunks)
        size = pc.binary_length(chunks).to_numpy().astype(np.int64)
        if special:
            marked = pc.match_substring(chunks, "<|").to_numpy(zero_copy_only=False)
            stem = np.where(marked, size, stem)
        raw = bytes_list(chunks)
        words = [x if n == len(x) else x[:n] for x, n in zip(raw, stem.tolist())]
        tailed = np.flatnonzero(stem < size)
        # each distinct word and each distinct tail once
        place: dict[bytes, int] = {}
        head = np.fromiter((place.setdefault(x, len(place)) for x in words), dtype=np.int64, count=len(words))
        alone = np.zeros(len(place), dtype=bool)
        alone[head] = letters
        tails = {}
        tail = np.fromiter((tails.setdefault(raw[i][n:], len(tails)) for i, n in zip(tailed.tolist(), stem[tailed].tolist())), dtype=np.int64, count=len(tailed))
        ids = self.piece_ids([*place, *tails], np.concatenate((alone, np.zeros(len(tails), dtype=bool))))
        ids.append(np.array([end], dtype="<u4").tobytes())
        first_of = np.full((len(raw) + 1, 2), -1, dtype=np.int64)  # the pieces of each chunk; the end id is one more chunk
        first_of[:-1, 0] = head
        first_of[tailed, 1] = tail + len(place)
        first_of[-1, 0] = len(ids) - 1
        index = np.insert(coded.indices.to_numpy().astype(np.int64), offsets[1:], len(raw))
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), dtype="<u4")
        first = np.cumsum(count) - count
        pieces = first_of[index].reshape(-1)
        used = np.concatenate(([0], np.cumsum(pieces >= 0)))  # pieces before each
        pieces = pieces[pieces >= 0]
        n = count[pieces]
        ends = np.concatenate(([0], np.cumsum(n)))
        flat = pool[np.arange(ends[-1]) - np.repeat(ends[:-1] - first[pieces], n)]
        return flat, ends[used[2 * (offsets + np.arange(len(offsets)))]]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of sizes (each at most capacity) in each window."""
    total = sum(sizes)
    windows = max(1, -(-total // capacity))
    while True:
        got = karmarkar_karp(sizes, windows)
        if max(sum(sizes[i] for i in w) for w in got) <= capacity:
            return [w for w in got if w]
        windows += 1


def karmarkar_karp(sizes: list[int], windows: int) -> list[list[int]]:
    """Multiway differencing with numpy rows: each partial partition is ``windows`` sums in descending order.

    The two partitions of largest spread are merged, the fullest window of one with the emptiest of the other.
    Sets are kept as chains: each window names the two windows it was merged from.
    """
    n = len(sizes)
    if windows == 1 or n <= 1:
        return [list(range(n))] + [[] for _ in range(windows - 1)]
    left, right = [], []  # merged windows: node n + 1 + k joins left[k] and right[k]; node 0 is empty, 1..n the items
    heap = []
    for i, x in enumerate(sizes):
        sums = np.zeros(windows, dtype=np.int64)
        sums[0] = x
        node = np.zeros(windows, dtype=np.int64)
        node[0] = i + 1
        heap.append((-x, i, sums, node))
    heapq.heapify(heap)
    tick, made = n, n + 1
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        sums, bn = a + b[::-1], bn[::-1]
        both = (an > 0) & (bn > 0)
        node = np.where(an > 0, an, bn)
        k = int(both.sum())
        if k:
            left.append(an[both])
            right.append(bn[both])
            node[both] = np.arange(made, made + k)
            made += k
        order = np.argsort(-sums, kind="stable")
        sums, node = sums[order], node[order]
        sums -= sums[-1]
        tick += 1
        heapq.heappush(heap, (-int(sums[0]), tick, sums, node))
    lefts = np.concatenate(left).tolist() if left else []
    rights = np.concatenate(right).tolist() if right else []
    out = []
    for root in heap[0][3].tolist():
        stack, mine = [root], []
        while stack:
            x = stack.pop()
            if x > n:
                stack += [lefts[x - n - 1], rights[x - n - 1]]
            elif x:
                mine.append(x - 1)
        out.append(sorted(mine))
    return out


SCHEMA = "start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, unit: int = UNIT, place_col: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start (the document's ids before it), length, ids (ids_crc32 instead, with ``digest``),
    doc_tokens, sequence_id, offset (the piece's place in its sequence, gapless from 0).

    With ``place_col`` (whole numbers from 0) units are ``unit`` consecutive places, and sequence ids follow the places
    of the units and, within a unit, of each window's first document; then nothing depends on files or partitions.
    """

    def as_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        doc, start, ids, n, seq, at = zip(*rows)
        if digest:
            body = pa.array([zlib.crc32(x.tobytes()) for x in ids], type=pa.int64())
        else:
            edges = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            body = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(ids).astype(np.int32)))
        out = [pa.array(doc, type=kind), pa.array(start, type=pa.int64()), pa.array([len(x) for x in ids], type=pa.int64()), body, *(pa.array(x, type=pa.int64()) for x in (n, seq, at))]
        return pa.RecordBatch.from_arrays(out, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ChunkTokenizer.of(tokenizer)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        sequence = 0
        rest: list[tuple] = []  # doc, start, ids, doc_tokens: parts of remainders that wait for their unit
        waiting = 0
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal sequence, waiting
            waiting = 0
            for window in pack([len(x[2]) for x in rest], capacity):
                at = 0
                for i in window:
                    doc, start, ids, n = rest[i]
                    rows.append((doc, start, ids, n, base + sequence, at))
                    at += len(ids)
                sequence += 1
            rest.clear()

        def batch_of() -> pa.RecordBatch:
            out = as_batch(rows, kind)
            rows.clear()
            return out

        kind = None
        for batch in sliced(batches, "text", SLICE):
            kind = batch.column(0).type
            flat, first = tok.encode(text_column(batch), end)
            for doc, a, b in zip(batch.column(0).to_pylist(), first.tolist(), first[1:].tolist()):
                n = b - a
                whole = n // capacity * capacity
                for start in range(0, whole, capacity):
                    rows.append((doc, start, flat[a + start : a + start + capacity], n, base + sequence, 0))
                    sequence += 1
                if n > whole:
                    cuts = np.linspace(whole, n, -(-(n - whole) // PART) + 1).astype(np.int64).tolist()
                    rest += [(doc, x, flat[a + x : a + y], n) for x, y in zip(cuts, cuts[1:])]
                    waiting += 1
                    if waiting == unit:
                        flush()
            if rows:
                yield batch_of()
        if rest:
            flush()
            yield batch_of()

    def run_by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, text, place) of whole units, sorted by place."""
        tok = ChunkTokenizer.of(tokenizer)
        now, sequence, held = -1, 0, 0
        windows: list[tuple] = []  # place, pieces: whole windows that wait for their unit
        rest: list[tuple] = []  # place, piece
        kind = None

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            held = 0
            windows.extend((min(rest[i][0] for i in w), [rest[i][1] for i in w]) for w in (pack([len(x[1][2]) for x in rest], capacity) if rest else []))
            rows = []
            for _, pieces in sorted(windows, key=lambda x: x[0]):
                at = 0
                for doc, start, ids, n in pieces:
                    rows.append((doc, start, ids, n, (now << 36) + sequence, at))
                    at += len(ids)
                sequence += 1
            windows.clear()
            rest.clear()
            return as_batch(rows, kind)

        for batch in sliced(batches, "text", SLICE):
            kind = batch.column(0).type
            flat, first = tok.encode(text_column(batch), end)
            for doc, place, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), first.tolist(), first[1:].tolist()):
                if place // unit != now:
                    if windows or rest:
                        yield flush()
                    now, sequence = place // unit, 0
                n = b - a
                whole = n // capacity * capacity
                windows += [(place, [(doc, x, flat[a + x : a + x + capacity], n)]) for x in range(0, whole, capacity)]
                if n > whole:
                    cuts = np.linspace(whole, n, -(-(n - whole) // PART) + 1).astype(np.int64).tolist()
                    rest += [(place, (doc, x, flat[a + x : a + y], n)) for x, y in zip(cuts, cuts[1:])]
                held += n
                if held > HELD:  # long documents: the unit is packed in several parts
                    yield flush()
        if windows or rest:
            yield flush()

    names = ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + (SCHEMA.replace("ids array<int>", "ids_crc32 long") if digest else SCHEMA)
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if place_col is None:
        return docs.select(*columns).mapInArrow(run, schema)
    dealt = docs.select(*columns, F.col(place_col).cast("long").alias("place")).repartition(F.expr(f"place div {unit}"))
    return dealt.sortWithinPartitions("place").mapInArrow(run_by_place, schema)
