"""The same phases on one graph of bounded size, inside a single task.

The rules are those of operators.moves; only graphs with a checked number of arcs come here.
"""

from __future__ import annotations

import numpy as np


def cuts(degree: np.ndarray, parts: int) -> list[int]:
    """Edge-balanced bounds, as operators.partition.edge_balanced has them."""
    n, end = len(degree), np.cumsum(degree)
    least, bounds, base = int(degree.sum()) // parts, [0], 0
    while len(bounds) <= parts and bounds[-1] < n:
        i = int(np.searchsorted(end, base + least, side="right"))
        if i >= n:
            break
        bounds.append(i + 1)
        base = int(end[i])
    return bounds + [n] * (parts + 1 - len(bounds))


def even(n: int, parts: int) -> list[int]:
    return [i * (n // parts) for i in range(parts)] + [n]


def windows(degree: np.ndarray, parts: int, devices: int, by: str) -> list[list[tuple[int, int]]]:
    """For each batch its vertex ranges, one of each device."""
    n = len(degree)
    outer = even(n, devices) if by == "vertex" else cuts(degree, devices)
    inner = [[lo + x for x in (even(hi - lo, parts) if by == "vertex" else cuts(degree[lo:hi], parts))] for lo, hi in zip(outer, outer[1:])]
    return [[(b[i], b[i + 1]) for b in inner] for i in range(parts)]


def modularity(src: np.ndarray, dst: np.ndarray, w: np.ndarray, k: np.ndarray, c: np.ndarray) -> float | None:
    """One division of whole numbers, if weights are whole."""
    number = float if w.dtype.kind == "f" else int
    m2 = number(k.sum())
    if not m2:
        return None
    a = np.bincount(c, k, len(k)) if w.dtype.kind == "f" else _sums(c, k, len(k))
    squares = sum(x * x for x in a.tolist() if x)
    top, bottom = m2 * number(w[c[src] == c[dst]].sum()) - squares, m2 * m2
    return float(top) / float(bottom)


def _sums(key: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, value.dtype)
    np.add.at(out, key, value)
    return out


def sizes(c: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
    """The weighted degree of each community; whole ones are below 2 ** 53."""
    return np.bincount(c, k, n).astype(k.dtype)


def numbered(c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The communities in order, and the place of each vertex's among them."""
    labels = np.flatnonzero(np.bincount(c, minlength=n))
    places = np.zeros(n, np.int64)
    places[labels] = np.arange(len(labels))
    return labels, places[c]


def ties(row: np.ndarray, t: np.ndarray, w: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, t, sum of w) in order, for t below width; whole sums are below 2 ** 53."""
    key = row * width + t
    if not len(key):
        return key, key, w
    whole = w.dtype.kind != "f" and w.min() >= 0
    bits = int(w.max()).bit_length() if whole else 64
    if whole and rows * width <= 4 * len(key):  # a cell for each key is no more than the arcs
        key_of = np.flatnonzero(np.bincount(key, minlength=rows * width))
        e = np.bincount(key, w)[key_of].astype(np.int64)
    elif (rows * width).bit_length() + bits < 64:  # keys and weights in one number, as sorting alone is faster than ordering
        both = key << bits | w
        both.sort()
        key = both >> bits
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key_of, e = key[first], np.add.reduceat(both & (1 << bits) - 1, first)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key_of, e = key[first], np.add.reduceat(w[order], first)
    return *np.divmod(key_of, width), e


def choose(v: np.ndarray, com: np.ndarray, e: np.ndarray, k: np.ndarray, a: np.ndarray, c: np.ndarray, m2, tie: str) -> tuple[np.ndarray, np.ndarray]:
    """The vertices that move, and where to; (v, com, e) has the weight of each mover's ties by community, without loops, in order."""
    if not len(v):
        return v, com
    own = com == c[v]
    whole = k.dtype.kind != "f"
    lowest = np.iinfo(np.int64).min if whole else -np.inf
    if whole and int(m2) * int(k.max()) >= 1 << 62:  # wider than 64 bits
        m2, lowest, e, k, a = int(m2), -(int(m2) ** 2) - 1, *(x.astype(object) for x in (e, k, a))
    score = m2 * e - k[v] * (a[com] - np.where(own, k[v], 0))
    change = np.concatenate([[True], v[1:] != v[:-1]])
    begin, group = np.flatnonzero(change), np.cumsum(change) - 1
    mover = v[begin]
    stay = -k[mover] * (a[c[mover]] - k[mover])
    stay[group[own]] = score[own]
    if tie == "lane":
        rank = np.arange(len(v)) - begin[group]
        lane = rank % 8
        second = ((lane % 2) * 4 + lane // 2 % 2 * 2 + lane // 4) * (len(v) + 1) + rank
    else:
        second = com
    other = np.where(own, lowest, score)
    most = np.maximum.reduceat(other, begin)
    best = np.flatnonzero(~own & (other == most[group]) & (other > stay[group]))
    if not len(best):
        return v[best], com[best]
    # Of equal scores the first by the rule of ties.
    start = np.flatnonzero(np.concatenate([[True], v[best][1:] != v[best][:-1]]))
    least = np.minimum.reduceat(second[best], start)
    best = best[second[best] == np.repeat(least, np.diff([*start, len(best)]))]
    return v[best], com[best]


def step(start: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, k: np.ndarray, c: np.ndarray, m2, ranges: list[tuple[int, int]], tie: str) -> np.ndarray:
    """The assignment after the vertices of the ranges have moved; arcs lie in the order of src."""
    n = len(k)
    new = c.copy()
    picks = [np.arange(start[lo], start[hi]) for lo, hi in ranges if hi > lo]
    at = np.concatenate(picks) if picks else np.zeros(0, np.int64)
    labels, dense = numbered(c, n)
    s, t = src[at], dst[at]
    v, com, e = ties(s, dense[t], np.where(s == t, 0, w[at]), n, len(labels))
    v, to = choose(v, labels[com], e, k, sizes(c, k, n), c, m2, tie)
    new[v] = to
    return new


def phase(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, c: np.ndarray, *, batches: int, tol: float, max_iter: int, tie: str, devices: int, by: str) -> tuple[np.ndarray, float | None, float | None, list[tuple]]:
    """Of one phase that starts from assignment c: the last assignment, the modularity before and after, and rows (loop, q, gain, accepted)."""
    order = np.argsort(src, kind="stable")
    src, dst, w = src[order], dst[order], w[order]
    degree = np.bincount(src, minlength=n)
    start = np.concatenate([[0], np.cumsum(degree)])
    k = _sums(src, w, n)
    m2 = k.sum()
    q = before = modularity(src, dst, w, k, c)
    if q is None:
        return c, None, None, [(1, None, None, True)]
    history: list[tuple] = []
    parts, gain = windows(degree, batches, devices, by), np.inf
    while gain > tol and len(history) < max_iter:
        old = c
        for ranges in parts:
            c = step(start, src, dst, w, k, c, m2, ranges, tie)
        now = modularity(src, dst, w, k, c)
        gain = now - q
        history.append((len(history) + 1, now, gain, gain >= 0))
        if gain < 0:
            c = old
        else:
            q = now
    return c, before, q, history
