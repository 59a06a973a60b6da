"""A two-label linear-chain conditional random field over many ragged chains at once, in numpy.

Chains lie one after the other in flat arrays.  With two labels a chain needs only the ratio of the
two forward values and of the two backward values at each place, so that one step is a few vector
operations over all chains that are still running.  Ratios neither underflow nor lose a long chain.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

CLIP = 30.0
#: Places that are looked at together while a field is fitted.
BLOCK = 200_000


@dataclass
class Chain:
    """Weights of the transitions: 2 x 2 by label before and label, of the first and of the last label being 1."""

    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: float = 0.0
    last: float = 0.0

    def ratios(self, score: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emission odds, forward ratios and backward ratios of label 1 to label 0 at each place.

        score: log-odds of label 1 from the features; size: places in each chain, all above zero.
        """
        e = np.exp(np.clip(score, -CLIP, CLIP))
        t = np.exp(self.trans)
        order = np.argsort(-size, kind="stable")
        begin, n = (np.cumsum(size) - size)[order], size[order]
        alive = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")
        fwd, bwd = np.empty_like(e), np.empty_like(e)
        r = np.empty(len(n))
        for step, k in enumerate(alive.tolist()):
            at = begin[:k] + step
            x = r[:k]
            fwd[at] = r[:k] = e[at] * (np.exp(self.first) if step == 0 else (t[0, 1] + t[1, 1] * x) / (t[0, 0] + t[1, 0] * x))
        end = begin + n - 1
        for step, k in enumerate(alive.tolist()):
            at = end[:k] - step
            if step == 0:
                bwd[at] = r[:k] = np.exp(self.last)
            else:
                x = e[at + 1] * r[:k]
                bwd[at] = r[:k] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
        return e, fwd, bwd

    def marginals(self, score: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probability of label 1 at each place."""
        _, fwd, bwd = self.ratios(score, size)
        odds = fwd * bwd
        return odds / (1 + odds)

    def edges(self, e: np.ndarray, fwd: np.ndarray, bwd: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Expected counts, 2 x 2, of the label pairs at the places ``inner`` and those before them."""
        a, x = fwd[inner - 1], e[inner] * bwd[inner]
        t = np.exp(self.trans)
        w = np.stack([t[0, 0] + 0 * a, t[0, 1] * x, t[1, 0] * a, t[1, 1] * a * x])
        return (w / w.sum(0)).sum(1).reshape(2, 2)


class Adam:
    """Ascent of a gradient by the public Adam rule."""

    def __init__(self, rate: float) -> None:
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def step(self, **pairs: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        self.t += 1
        out = {}
        for k, (x, g) in pairs.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            out[k] = x + self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)
        return out


def fit(emit, absorb, weights: np.ndarray, label: np.ndarray, size: np.ndarray, *, steps: int, rate: float = 0.1, l2: float = 1e-3, weight: np.ndarray | None = None) -> tuple[np.ndarray, Chain]:
    """Maximises the conditional likelihood of the labels of whole chains.

    emit(weights): score of each place; absorb(residuals): their gradient by the weights.
    weight: of each chain; 1 if None.
    """
    chain, adam, total = Chain(), Adam(rate), len(label)
    begin = np.cumsum(size) - size
    tail = begin + size - 1
    by = np.ones(len(size)) if weight is None else weight
    # Blocks of whole chains bound what a step holds besides scores and residuals.
    block = begin // BLOCK
    edge = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(size)]])
    parts = [(a, b, begin[a], begin[b - 1] + size[b - 1]) for a, b in zip(edge, edge[1:]) if b > a]
    seen = np.zeros((2, 2))
    rest = np.empty(total)
    for _ in range(steps):
        score, expected, first = emit(weights), np.zeros((2, 2)), not seen.any()
        for a, b, lo, hi in parts:
            n, y, each = size[a:b], label[lo:hi], np.repeat(by[a:b], size[a:b])
            e, fwd, bwd = chain.ratios(score[lo:hi], n)
            odds = fwd * bwd
            rest[lo:hi] = each * (y - odds / (1 + odds))
            inner = np.ones(hi - lo, bool)
            inner[begin[a:b] - lo] = False
            for w in np.unique(by[a:b]):
                at = np.flatnonzero(inner & (each == w))
                expected += w * chain.edges(e, fwd, bwd, at)
                if first:
                    seen += w * np.bincount(2 * y[at - 1] + y[at], minlength=4).reshape(2, 2)
        del score
        moved = adam.step(
            weights=(weights, absorb(rest) / total - l2 * weights),
            trans=(chain.trans, (seen - expected) / total - l2 * chain.trans),
            ends=(np.array([chain.first, chain.last]), np.array([rest[begin].sum(), rest[tail].sum()]) / total),
        )
        weights, chain = moved["weights"], Chain(moved["trans"], *moved["ends"].tolist())
    return weights, chain
