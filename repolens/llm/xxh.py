"""XXH64 of many spans of one buffer at once, after the published XXH64 specification."""

from __future__ import annotations

import numpy as np
import xxhash

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Groups of one length with fewer spans are hashed one by one.
FEW = 24


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_spans(data: bytes, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 with ``seed`` of data[start : start + length] for every span. Spans are grouped by length."""
    out = np.zeros(len(start), dtype=np.uint64)
    if not len(start):
        return out
    padded = data + b"\0" * 8
    whole = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    half = np.ndarray((len(padded) - 3,), dtype="<u4", buffer=padded, strides=(1,))
    single = np.frombuffer(padded, dtype=np.uint8)
    order = np.argsort(np.minimum(length, 32767).astype(np.int16), kind="stable")
    ordered = length[order]
    cuts = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(order)]))
    s = np.uint64(seed)
    digest = xxhash.xxh64_intdigest
    with np.errstate(over="ignore"):
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            mine = order[a:b]
            n = int(ordered[a])
            at = start[mine]
            if b - a < FEW or n > 4096:
                out[mine] = np.fromiter((digest(data[x : x + n], seed) for x in at.tolist()), dtype=np.uint64, count=b - a)
                continue
            done = 0
            if n >= 32:
                v = [np.full(b - a, x) for x in (s + P1 + P2, s + P2, s, s - P1)]
                while n - done >= 32:
                    for k in range(4):
                        v[k] = _round(v[k], whole[at + (done + 8 * k)])
                    done += 32
                acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    acc = (acc ^ _round(np.zeros_like(x), x)) * P1 + P4
            else:
                acc = np.full(b - a, s + P5)
            acc = acc + np.uint64(n)
            while n - done >= 8:
                acc = _rotl(acc ^ _round(np.zeros_like(acc), whole[at + done]), 27) * P1 + P4
                done += 8
            if n - done >= 4:
                acc = _rotl(acc ^ (half[at + done].astype(np.uint64) * P1), 23) * P2 + P3
                done += 4
            while done < n:
                acc = _rotl(acc ^ (single[at + done].astype(np.uint64) * P5), 11) * P1
                done += 1
            acc = (acc ^ (acc >> np.uint64(33))) * P2
            acc = (acc ^ (acc >> np.uint64(29))) * P3
            out[mine] = acc ^ (acc >> np.uint64(32))
    return out
