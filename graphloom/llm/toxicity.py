"""Toxic spans by a linear-chain conditional random field over tokens; one chain for each line.

A token's features are its form, its beginnings, its ending and its shape; a place of the chain sees
the features of its own token and of the tokens before and after it.  Documents carry the labels, so
token labels are derived first: in a toxic document a token is labelled toxic if one of its forms or
beginnings occurs in toxic documents far more often than chance allows.  The field is fitted on all
sampled documents, where the same forms in clean documents are labelled clean; its forward-backward marginals
give each token's probability, from which the document's score and the offending offsets follow.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import as_text, give_back, slices, through_arrow
from .labelled import sample

PREFIXES = (3, 4, 5, 6, 7)
PUNCTUATION = ".,;:?!\"'()[]{}<>«»„“”‘’¡¿…*_-"
#: Token types that a worker remembers before it starts afresh.
REMEMBERED = 150_000
#: Tokens of a chain while the field is fitted; longer lines are several chains there, and one when they are tagged.
FITTED = 200
#: Weights below this are no part of a model.
LEAST_WEIGHT = 0.01


def token_features(token: str) -> tuple[list[str], list[str]]:
    """What can tell a token on its own (its form in lower case without punctuation at its ends, and its beginnings), and its ending and shape."""
    t = token.strip(PUNCTUATION).lower()
    if not t:
        return [], ["#mark"]
    telling = ["=" + t, *("^" + t[:k] for k in PREFIXES if len(t) > k)]
    shape = ["#short" if len(t) < 4 else "#middle" if len(t) < 9 else "#long"]
    if len(t) > 3:
        shape.append("$" + t[-3:])
    if token.isupper() and len(t) > 1:
        shape.append("#upper")
    elif token[:1].isupper():
        shape.append("#title")
    if not t.isalpha():
        shape.append("#mixed")
    if token[-1] in PUNCTUATION:
        shape.append("#end" + token[-1])
    return telling, shape


@dataclass
class Model:
    """weights: from a feature to its weights for its own token, for the token after it and for the token before it."""

    weights: dict[str, tuple[float, float, float]]
    bias: float
    chain: crf.Chain
    final: np.ndarray  # bias, weight of log(1 + expected toxic tokens), weight of the largest marginal


class Types(dict):
    """From a token as written to its number; scores() are the sums of the weights of each one's features, as token_features() has them."""

    def __init__(self, weights: dict[str, tuple[float, float, float]]) -> None:
        none = (0.0, 0.0, 0.0)
        self.whole = {f[1:]: w for f, w in weights.items() if f[0] == "="}
        self.ending = {f[1:]: w for f, w in weights.items() if f[0] == "$"}
        self.shape = {f: w for f, w in weights.items() if f[0] == "#"}
        # Beginnings with the sums of theirs; every beginning of a known one is known, so that the first unknown one ends the search.
        self.begins: dict[str, tuple[float, float, float]] = {}
        for f in weights:
            if f[0] == "^":
                total = none
                for k in PREFIXES:
                    if k < len(f):
                        w = weights.get(f[: k + 1], none)
                        total = (total[0] + w[0], total[1] + w[1], total[2] + w[2])
                        self.begins[f[1 : k + 1]] = total
        self.shapes: dict[tuple, tuple[float, float, float]] = {}
        self.sums = (array("d"), array("d"), array("d"))

    def __missing__(self, token: str) -> int:
        t = token.strip(PUNCTUATION).lower()
        n = len(t)
        kind = (n > 3, n > 8, n > 1 and token.isupper(), token[0].isupper(), t.isalpha(), token[-1] if token[-1] in PUNCTUATION else "", n > 0)
        own, after, before = self.shapes.get(kind) or self._shape(kind, token)
        found = [self.whole.get(t), self.ending.get(t[-3:]) if n > 3 else None]
        last = None
        for k in PREFIXES:
            if k >= n or (w := self.begins.get(t[:k])) is None:
                break
            last = w
        found.append(last)
        for w in found:
            if w:
                own, after, before = own + w[0], after + w[1], before + w[2]
        self[token] = at = len(self.sums[0])
        a, b, c = self.sums
        a.append(own)
        b.append(after)
        c.append(before)
        return at

    def _shape(self, kind: tuple, token: str) -> tuple[float, float, float]:
        held = [self.shape.get(f, (0.0, 0.0, 0.0)) for f in token_features(token)[1] if f[0] == "#"]
        self.shapes[kind] = total = tuple(map(sum, zip(*held)))
        return total

    def scores(self) -> list[np.ndarray]:
        return [np.array(x) for x in self.sums]

    def tidy(self) -> None:
        if len(self) >= REMEMBERED:
            self.clear()
            self.sums = (array("d"), array("d"), array("d"))


def _chains(texts: Iterable[str], number) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """number(token) of each token, tokens in each chain (line), tokens in each text."""
    flat: list[int] = []
    size, per = [], []
    for text in texts:
        start = len(flat)
        for line in text.split("\n"):
            if words := line.split():
                flat.extend(map(number, words))
                size.append(len(words))
        per.append(len(flat) - start)
    return np.array(flat, np.int64), np.array(size, np.int64), np.array(per, np.int64)


def _score(x: np.ndarray, begin: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of each token: its own score, what the token before gives to the one after it, and the other way."""
    s = own[x]
    if len(x) > 1:
        left = after[x[:-1]]
        left[begin[1:] - 1] = 0
        right = before[x[1:]]
        right[begin[1:] - 1] = 0
        s[1:] += left
        s[:-1] += right
    return s


def _summary(p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """For each text: log(1 + sum of the marginals of at least a half), and the largest marginal; 0 without tokens."""
    out = np.zeros((len(tokens), 2))
    full = np.flatnonzero(tokens)
    if len(full):
        begin = (np.cumsum(tokens) - tokens)[full]
        out[full, 0] = np.log1p(np.add.reduceat(np.where(p >= 0.5, p, 0), begin))
        out[full, 1] = np.maximum.reduceat(p, begin)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -crf.CLIP, crf.CLIP)))
        h = (a * (p * (1 - p))[:, None]).T @ a + l2 * len(y) * np.eye(len(w))
        w = w + np.linalg.solve(h, a.T @ (y - p) - l2 * len(y) * w)
    return w


def _tail(k: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Bound of the chance that at least k of n draws of probability ``share`` succeed (Chernoff's); 1 where k is no more than expected."""
    q = k / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(k > 0, k * np.log(q / share), 0) + np.where(n > k, (n - k) * np.log((1 - q) / (1 - share)), 0)
    return np.where(q > share, np.exp(-kl), 1.0)


class _Sample:
    """Token types of the sampled texts, the features of each type, and in how many documents of each label a feature is."""

    def __init__(self, texts: list[str], label: np.ndarray) -> None:
        types: dict[str, int] = {}
        x, size, self.tokens = _chains(texts, lambda w: types.setdefault(w, len(types)))
        self.x = x.astype(np.int32)
        pieces = -(-size // FITTED)
        last = np.cumsum(pieces) - 1
        self.size = np.full(pieces.sum(), FITTED)
        self.size[last] = size - FITTED * (pieces - 1)
        self.begin = np.cumsum(self.size) - self.size
        names: dict[str, int] = {}
        entries, telling, count = array("i"), bytearray(), array("i")
        for w in types:
            a, b = token_features(w)
            entries.extend([names.setdefault(f, len(names)) for f in (*a, *b)])
            telling += b"\1" * len(a) + b"\0" * len(b)
            count.append(len(a) + len(b))
        self.label, self.types = label, len(types)
        del types, x
        self.names, self.entry, self.telling = list(names), np.array(entries, np.int32), np.frombuffer(bytes(telling), bool)
        del names
        self.of_type = np.repeat(np.arange(self.types, dtype=np.int32), count)
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        self.docs = np.zeros((2, len(self.names)), np.int64)
        ends = np.cumsum(self.tokens)
        for a, b, y in zip((ends - self.tokens).tolist(), ends.tolist(), label.tolist()):
            if b > a:
                held = np.unique(self.x[a:b])
                self.docs[y, np.unique(self.entry[self._entries(held)])] += 1

    def _entries(self, types: np.ndarray) -> np.ndarray:
        n = self.first[types + 1] - self.first[types]
        return np.repeat(self.first[types] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def telling_features(self, least_docs: int, chance: float) -> np.ndarray:
        """Features that chance would put into so many toxic documents at most ``chance`` times over all features of that frequency.

        What counts is the number of documents, or of places between different neighbours if that is less: copies of a document repeat its words with their neighbours.
        """
        can = np.zeros(len(self.names), bool)
        can[self.entry[self.telling]] = True
        can &= self.docs[1] >= least_docs
        # Toxic tokens with the tokens beside them, each such three once.
        toxic = np.flatnonzero(np.repeat(self.label, self.tokens) == 1)
        pad = np.concatenate([[0], self.x.astype(np.int64) + 1, [0]])
        width = self.types + 1
        three = np.unique((pad[toxic + 1] * width + pad[toxic]) * width + pad[toxic + 2])
        held, n = np.unique(three // width**2 - 1, return_counts=True)
        at = self._entries(held)
        around = np.bincount(self.entry[at], np.repeat(n, self.first[held + 1] - self.first[held]), len(self.names)).astype(np.int64)
        k = np.minimum(self.docs[1], around)
        n = k + self.docs[0]
        tested = np.sort(n[n >= least_docs])
        rivals = len(tested) - np.searchsorted(tested, n)
        share = float(self.label.mean())
        return can & (k >= least_docs) & (_tail(k, n, share) * rivals <= chance) & (k * (1 - share) >= 4 * self.docs[0] * share)


def fit(rows: pd.DataFrame, *, least_docs: int = 4, chance: float = 0.1, steps: int = 40) -> Model:
    """From (text, label): label 1 is toxic.

    A telling feature occurs in least_docs toxic documents, between as many different pairs of neighbours, and
    more often than chance makes any feature of its frequency.  Without rows of both labels, or without telling features, the model scores every text 0.
    """
    empty = Model({}, -crf.CLIP, crf.Chain(), np.array([-crf.CLIP, 0.0, 0.0]))
    y = rows["label"].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    if len(np.unique(y)) < 2:
        return empty
    s = _Sample(rows["text"].tolist(), y)
    strong = s.telling_features(least_docs, chance)
    if not strong.any():
        return empty
    told = np.zeros(s.types, bool)
    told[s.of_type[strong[s.entry]]] = True
    label = (told[s.x] & (np.repeat(y, s.tokens) == 1)).astype(np.int64)
    # Rare features could only learn single documents by heart.
    number = np.full(len(s.names), -1, np.int32)
    kept = np.flatnonzero(s.docs.sum(0) >= least_docs)
    number[kept] = np.arange(len(kept))
    use = number[s.entry] >= 0
    entry, of_type, k = number[s.entry[use]], s.of_type[use], len(kept)
    names = [s.names[i] for i in kept.tolist()]
    strong = number[strong]
    del s.names, s.entry, s.telling, s.of_type, s.first, use, number, told
    give_back()
    inside = np.ones(len(s.x), bool)
    inside[s.begin] = False  # a token with one before it in its chain

    def emit(w: np.ndarray) -> np.ndarray:
        own, after, before = (np.bincount(of_type, w[1 + i * k : 1 + (i + 1) * k][entry], s.types) for i in range(3))
        return w[0] + _score(s.x, s.begin, own, after, before)

    def absorb(rest: np.ndarray) -> np.ndarray:
        own = np.bincount(s.x, rest, s.types)
        after = np.bincount(s.x[:-1], rest[1:] * inside[1:], s.types)
        before = np.bincount(s.x[1:], rest[:-1] * inside[1:], s.types)
        return np.concatenate([[rest.sum()], *(np.bincount(entry, v[of_type], k) for v in (own, after, before))])

    start = np.zeros(1 + 3 * k)
    start[0] = -4.0
    start[1 + strong] = 2.0
    w, chain = crf.fit(emit, absorb, start, label, s.size, steps=steps, l2=1e-6)
    p = chain.marginals(emit(w), s.size)
    parts = w[1:].reshape(3, k).T
    heavy = np.flatnonzero(np.abs(parts).max(1) >= LEAST_WEIGHT)
    weights = {names[i]: tuple(parts[i].tolist()) for i in heavy.tolist()}
    return Model(weights, float(w[0]), chain, _logistic(_summary(p, s.tokens), y))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, fold: int = 0, per_class: tuple[int, int] = (3000, 1000)) -> Model:
    """Fits on whole texts of at most per_class[0] clean and per_class[1] toxic labelled documents (labelled.sample)."""
    model = fit(sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, fold=fold, per_class=per_class))
    give_back()
    return model


class Tagger:
    def __init__(self, model: Model) -> None:
        self.model, self.types = model, Types(model.weights)

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each token's probability to be toxic, and the tokens of each text."""
        self.types.tidy()
        x, size, tokens = _chains(texts, self.types.__getitem__)
        if not len(x):
            return np.zeros(0), np.zeros(len(texts), np.int64)
        score = self.model.bias + _score(x, np.cumsum(size) - size, *self.types.scores())
        return self.model.chain.marginals(score, size), tokens

    def scores(self, p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        z = self.model.final[0] + _summary(p, tokens) @ self.model.final[1:]
        return 1 / (1 + np.exp(-np.clip(z, -crf.CLIP, crf.CLIP)))


def spans(text: str, p: np.ndarray, least: float) -> list[dict]:
    """Offsets, in code points, of the tokens with a probability of ``least`` and up."""
    if not (p >= least).any():
        return []
    return [{"start": m.start(), "end": m.end(), "p": float(q)} for m, q in zip(re.finditer(r"\S+", text), p) if q >= least]


def tag(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, score, spans): whole texts are tagged; spans holds (start, end, p) of offending tokens.

    A null or blank text has no tokens and gets the score of an expectation of none.  Repeated rows
    give repeated rows; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # weights of the features of a bounded sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for b in slices(batches):
            texts = as_text(b.column("text"))
            p, tokens = tagger.marginals(texts)
            begin = np.cumsum(tokens) - tokens
            found = [spans(t, p[a : a + n], least) for t, a, n in zip(texts, begin.tolist(), tokens.tolist())]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tagger.scores(p, tokens)), pa.array(found, kind)], ["doc_id", "score", "spans"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(through_arrow, run, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")


def keep_clean(df: DataFrame, model: Model, *, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of df, all columns as they are, whose text scores below ``most``; one narrow pass."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for b in slices(batches, at):
            yield b.filter(pa.array(tagger.scores(*tagger.marginals(as_text(b.column(at)))) < most))

    return df.transform(through_arrow, run, df.schema)
