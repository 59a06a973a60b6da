"""XXH64 of many spans of one buffer at once, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of the public XXH64 definition.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Longer spans are few; the library hashes them one by one.
LONG = 192


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _same_length(words: np.ndarray, at: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    """Hashes of the spans of n bytes that start at ``at``; words[i] is the little-endian word at byte i."""
    if n >= 32:
        v = [np.full(len(at), s) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        for stripe in range(n // 32):
            for i in range(4):
                v[i] = _round(v[i], words[at + (32 * stripe + 8 * i)])
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ _round(np.uint64(0), x)) * P1 + P4
        h = h + np.uint64(n)
    else:
        h = np.full(len(at), seed + P5 + np.uint64(n))
    done = n // 32 * 32
    while done + 8 <= n:
        h = _rotl(h ^ _round(np.uint64(0), words[at + done]), 27) * P1 + P4
        done += 8
    if done + 4 <= n:
        h = _rotl(h ^ (words[at + done] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
        done += 4
    while done < n:
        h = _rotl(h ^ (words[at + done] & np.uint64(0xFF)) * P5, 11) * P1
        done += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def xxh64_spans(buffer: bytes, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``buffer[start:start + size]`` as uint64."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    padded = buffer + bytes(8)
    words = np.ndarray((len(buffer) + 1,), "<u8", padded, strides=(1,))
    short = np.minimum(size, LONG).astype(np.uint16)
    order = np.argsort(short, kind="stable")
    edges = np.searchsorted(short[order], np.arange(LONG + 2))
    begin = start[order]
    with np.errstate(over="ignore"):
        for n in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[n], edges[n + 1]
            if n < LONG:
                out[order[a:b]] = _same_length(words, begin[a:b], n, np.uint64(seed))
            else:
                for i in order[a:b].tolist():
                    out[i] = xxhash.xxh64_intdigest(buffer[start[i] : start[i] + size[i]], seed)
    return out
