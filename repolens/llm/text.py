"""Shared text helpers for Arrow batches: slicing, ASCII lower-casing, whitespace words, word hashes.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``; lower-casing touches A-Z only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as strings; null becomes the empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "")


def give_back() -> None:
    """Return free memory to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def sliced(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer single text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.maximum(pc.binary_length(text_column(batch, name)).to_numpy(zero_copy_only=False).astype(np.int64), 64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(size[stop - 1])
    give_back()


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word ids of all texts, first position of each text (one more at the end), and the distinct words as bytes."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():
        kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False).astype(np.int64))))
        offsets = kept[offsets]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), offsets, bytes_list(coded.dictionary)


def bytes_list(strings: pa.Array) -> list[bytes]:
    """The strings' UTF-8 bytes, faster than to_pylist."""
    n = len(strings)
    if not n:
        return []
    _, offs, data = strings.buffers()
    at = np.frombuffer(offs, dtype=np.int32)[strings.offset : strings.offset + n + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


def hashes_of(words: list[bytes], seed: int = 0) -> np.ndarray:
    """XXH64 of each word."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def unique_sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and their counts (a plain sort beats np.unique's hashing here)."""
    if not len(values):
        return values, np.zeros(0, dtype=np.int64)
    ordered = np.sort(values)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[first], np.diff(np.concatenate((first, [len(ordered)])))


def ranks_of(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense rank of every value, and how many distinct ones there are."""
    if not len(values):
        return values.astype(np.int64), 0
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    step = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    out = np.empty(len(values), dtype=np.int64)
    out[order] = step
    return out, int(step[-1]) + 1


def sort_index(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of non-negative codes below ``most`` (ties by place), and the sorted codes. Packs both in one sort where they fit."""
    n = len(codes)
    if n and most < (1 << 62) // n:
        packed = np.sort(codes * n + np.arange(n))
        return packed % n, packed // n
    order = np.argsort(codes, kind="stable")
    return order, codes[order]


CLASSES = ("other", "blank", "upper", "digit", "symbol", "pipe", "bang", "comma", "dot", "brace", "slash", "punct", "tail", "lead")


def _class_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    for name, chars in {
        "blank": b" \t\n\x0b\x0c\r", "upper": bytes(range(65, 91)), "digit": b"0123456789", "punct": b"\"'()+-:;=?@[\\]^_`~", "symbol": b"#*$%&<>",
        "pipe": b"|", "bang": b"!", "comma": b",", "dot": b".", "brace": b"{}", "slash": b"/", "tail": bytes(range(128, 192)), "lead": bytes(range(192, 256)),
    }.items():
        table[list(chars)] = CLASSES.index(name)
    return table


_TABLE = _class_table()


def byte_classes(texts: pa.Array) -> dict[str, np.ndarray]:
    """Bytes of each of CLASSES in each text, and ``bytes``. Code points are bytes less ``tail``."""
    n = len(texts)
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    size = np.diff(at)
    k = len(CLASSES)
    cell = _TABLE[raw] + np.repeat(np.arange(n) * k, size)
    counts = np.bincount(cell, minlength=n * k).reshape(n, k)
    return {"bytes": size} | {name: counts[:, i] for i, name in enumerate(CLASSES)}
