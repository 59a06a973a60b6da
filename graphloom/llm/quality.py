"""Document quality from a linear-chain conditional random field over lines.

Every line gets a vector of counts and shares of characters and words; a place of the chain sees its own line's vector and
those of the lines before and after it.  The marginals of label 1 (good), averaged by the lines'
lengths, are the document's quality.  Documents carry the labels: a line has its document's label, unless its
own features say the contrary, and the lines that keep the label are most of the document.  All
features come from one pass of vector operations over code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import as_text, slices, through_arrow
from .labelled import sample

# Classes of code points.
UPPER, LOWER, DIGIT, OTHER, STOP, MARK, SPACE = range(7)  # OTHER: letters without case
PROSE = ".,;:?'\"()-«»“”‘’„¿¡–—。、，；：？「」"  # marks of ordinary prose


def _class(c: str) -> int:
    if c.isspace() or ord(c) < 33:
        return SPACE
    if c in PROSE:
        return STOP
    if c.isalpha():
        return UPPER if c.isupper() else LOWER if c.islower() else OTHER
    # Combining signs belong to the letters that they stand with.
    return DIGIT if c.isdigit() else OTHER if unicodedata.combining(c) else MARK


_kind = np.array([_class(chr(i)) for i in range(1 << 16)], np.uint8)
WIDTH = 14


def kinds(points: np.ndarray) -> np.ndarray:
    """Class of each code point; beyond 16 bits the planes of ideographs are letters and the rest marks."""
    out = _kind[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        out[high] = np.where(points[high] >= 0x20000, OTHER, MARK)
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row for each line, the characters of each line with its end, and the lines of each text.

    Lines end at line feeds; a text has a line at least, maybe an empty one.
    """
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    end = np.flatnonzero(raw == 10)
    begin = np.concatenate([[0], end[:-1] + 1])
    size = end + 1 - begin
    per = np.array([x.count("\n") + 1 for x in texts], np.int64)
    kind = kinds(raw)
    total = lambda mask: np.add.reduceat(mask, begin, dtype=np.int64)
    by = {k: total(kind == k) for k in (UPPER, LOWER, DIGIT, OTHER, STOP, MARK)}
    letters = by[UPPER] + by[LOWER] + by[OTHER]
    seen = letters + by[DIGIT] + by[STOP] + by[MARK]
    blank = kind == SPACE
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    line_of = np.repeat(np.arange(len(begin)), size)
    out = np.zeros((len(begin), WIDTH))
    share = lambda a, b: a / np.maximum(b, 1)
    if len(starts):
        ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]]))
        n, where = ends + 1 - starts, line_of[starts]
        count = lambda mask: np.bincount(where, mask, len(begin))
        # A sum that equal words share wherever they stand: characters weighted by their place in the word.
        inside = np.arange(len(raw)) - np.maximum.accumulate(np.where(~blank & np.concatenate([[True], blank[:-1]]), np.arange(len(raw)), 0))
        name = np.add.reduceat(np.where(blank, 0, raw.astype(np.int64) * (inside * 31 + 7)), starts) * 64 + np.minimum(n, 63)
        again = np.concatenate([[False], (name[1:] == name[:-1]) & (where[1:] == where[:-1])])
        words = count(np.ones(len(starts)))
        out[:, 0] = np.log1p(words)
        out[:, 1] = share(count(n), words) / 10
        out[:, 2] = share(count(again), words)
        out[:, 3] = share(count((n == 1) & (kind[starts] == MARK)), words)
        out[:, 4] = share(count(kind[ends] == MARK), words)
        out[:, 5] = share(count(kind[starts] == UPPER), words)
        out[:, 6] = share(count(n > 20), words)
    out[:, 7] = share(by[UPPER], letters)
    out[:, 8] = share(by[DIGIT], seen)
    out[:, 9] = share(by[STOP], seen)
    out[:, 10] = share(by[MARK], seen)
    out[:, 11] = share(letters, seen)
    out[:, 12] = np.minimum(np.log1p(size) / 10, 1)
    out[:, 13] = seen == 0
    return out, size, per


def with_neighbours(x: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Bias, the line's own features, the last line's and the next line's; no features beyond a text's ends."""
    first = np.zeros(len(x), bool)
    first[np.cumsum(per) - per] = True
    before = np.vstack([np.zeros((1, x.shape[1])), x[:-1]])
    before[first] = 0
    after = np.vstack([x[1:], np.zeros((1, x.shape[1]))])
    after[np.append(first[1:], True)] = 0
    edge = np.stack([first, np.append(first[1:], True)], 1)
    return np.hstack([np.ones((len(x), 1)), x, before, after, edge])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    chain: crf.Chain

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's quality, each line's probability to be good, and the lines of each text."""
        x, size, per = line_features(texts)
        p = self.chain.marginals(((with_neighbours(x, per) - self.mean) / self.scale) @ self.weights, per)
        begin = np.cumsum(per) - per
        return np.add.reduceat(p * size, begin) / np.add.reduceat(size, begin), p, per


def line_labels(x: np.ndarray, size: np.ndarray, per: np.ndarray, label: np.ndarray, weight: np.ndarray, *, steps: int, sure: float) -> np.ndarray:
    """Labels of lines from those of documents.

    A logistic regression on each line's own features, fitted to the documents' labels, turns a line that it
    is ``sure`` of the contrary of, most sure ones first, as long as more than half of the document's characters keep its label.
    """
    y = np.repeat(label, per)
    by = np.repeat(weight, per)
    # Lines of documents weigh by their share of the document, so that long documents do not decide alone.
    by = by * size / np.repeat(np.add.reduceat(size, np.cumsum(per) - per), per)
    a, w, adam = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1), crf.Adam(0.1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -crf.CLIP, crf.CLIP)))
        w = adam.step(w=(w, (by * (y - p)) @ a / by.sum() - 1e-3 * w))["w"]
    p = 1 / (1 + np.exp(-np.clip(a @ w, -crf.CLIP, crf.CLIP)))
    against = np.where(y == 1, 1 - p, p)
    owner = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((-against, owner))
    taken = np.cumsum(size[order])
    begin = np.cumsum(per) - per
    taken -= np.repeat(taken[begin] - size[order][begin], per)  # characters of the document's lines up to this one
    turn = (against[order] >= sure) & (2 * taken < np.repeat(np.add.reduceat(size, begin), per))
    y[order[turn]] = 1 - y[order[turn]]
    return y


def spliced(per: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines, and lines in each chain, of a chain for each document of the more frequent label: the first half of a good document, a bad one, the other half."""
    begin, (bad, good) = np.cumsum(per) - per, (np.flatnonzero(label == y) for y in (0, 1))
    out, size = [np.zeros(0, np.int64)], []
    for i in range(max(len(bad), len(good)) if len(bad) and len(good) else 0):
        a, b = good[i % len(good)], bad[i % len(bad)]
        middle = begin[a] + (per[a] + 1) // 2
        out += [np.arange(begin[a], middle), np.arange(begin[b], begin[b] + per[b]), np.arange(middle, begin[a] + per[a])]
        size.append(per[a] + per[b])
    return np.concatenate(out), np.array(size, np.int64)


def fit(rows: pd.DataFrame, *, steps: int = 100, sure: float = 0.9) -> Model:
    """From (text, label): label 1 is good.

    The rarer label weighs as much as the other.  Without rows the model scores every text 0.5.
    """
    width = 3 * WIDTH + 3
    flat = Model(np.zeros(width), np.ones(width), np.zeros(width), crf.Chain())
    if not len(rows):
        return flat
    x, size, per = line_features(rows["text"].tolist())
    y = rows["label"].to_numpy(np.int64)
    n = np.bincount(y, minlength=2)
    weight = np.where(y == 1, len(y) / max(2 * n[1], 1), len(y) / max(2 * n[0], 1))
    own = (x - x.mean(0)) / (x.std(0) + 1e-3)
    lines = line_labels(own, size, per, y, weight, steps=steps, sure=sure)
    # Documents of one kind cannot teach that a line may differ from those beside it, so good ones with a bad one inside are fitted as well.
    at, mixed = spliced(per, y)
    weight = np.concatenate([weight, np.ones(len(mixed))])
    lines, per, x = np.concatenate([lines, lines[at]]), np.concatenate([per, mixed]), np.vstack([x, x[at]])
    x = with_neighbours(x, per)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    mean[0], scale[0] = 0, 1
    x = (x - mean) / scale
    weights, chain = crf.fit(lambda w: x @ w, lambda rest: rest @ x, np.zeros(width), lines, per, steps=steps, rate=0.1, l2=1e-3, weight=weight)
    return Model(mean, scale, weights, chain)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, fold: int = 2, per_class: tuple[int, int] = (1000, 1000)) -> Model:
    """Fits on whole texts of at most per_class[0] bad and per_class[1] good labelled documents (labelled.sample)."""
    return fit(sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, fold=fold, per_class=per_class))


def classify(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, score, n_lines, bad_lines): bad_lines are the numbers, from 0, of lines likelier bad than ``least``.

    A null or empty text is one empty line and gets that line's probability.  Repeated rows give
    repeated rows; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # some dozens of weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=2 << 20):
            score, p, per = shared.value.scores(as_text(b.column("text")))
            begin = np.cumsum(per) - per
            bad = np.flatnonzero(p < 1 - least)
            owner = np.searchsorted(begin, bad, side="right") - 1
            offsets = np.searchsorted(owner, np.arange(len(per) + 1)).astype(np.int32)
            lines = pa.ListArray.from_arrays(pa.array(offsets), pa.array((bad - begin[owner]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip(score, 0, 1)), pa.array(per), lines], ["doc_id", "score", "n_lines", "bad_lines"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(through_arrow, run, "doc_id long, score double, n_lines long, bad_lines array<int>")
