"""The same phases of a graph whose ties are common groups of its members, without its arcs.

Two members are tied by the products of their counts in each group that holds both, so that the weight between a vertex and a community is a
product of the vertex's counts by group and the community's.  A phase is one stage of tasks that run together, as in held.py: each holds
the counts and the state of all vertices and looks at a share of the communities for all movers of a batch.  Nothing grows with the number of arcs but time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import closing

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import held, small

#: Cells of a table of counts, and of a product of two; pairs of counts that are summed together.
TABLE, CELLS, PAIRS = 1 << 23, 1 << 22, 1 << 20
#: Counts below which one task is as good as more.
TASK = 1 << 14
#: Cells of a product that are multiplied in the time of one pair that is summed alone.
DENSE = 600
#: What a row of the result tells, besides the kinds of held.py: counts of communities, their loops and the number of arcs.
COUNT, LESS, ARCS = range(4, 7)


class Counts:
    """How often each of n vertices lies in each group, in the order of vertices."""

    def __init__(self, group: np.ndarray, member: np.ndarray, count: np.ndarray, n: int) -> None:
        order = np.argsort(member, kind="stable")
        self.names, group = np.unique(group, return_inverse=True)
        self.groups, self.group, self.count = len(self.names), group[order].astype(np.int32), count[order]
        self.size = np.bincount(member, minlength=n)
        self.start = np.cumsum(self.size) - self.size
        self.squares = np.bincount(member[order], self.count.astype(np.float64) ** 2, n).astype(np.int64)
        total = np.bincount(self.group, self.count, self.groups)
        self.most = np.bincount(member[order], self.count * total[self.group], n).astype(np.int64)  # no sum of a vertex's ties is more

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in v, group, count) of these vertices."""
        size = self.size[v]
        at = np.arange(size.sum()) + np.repeat(self.start[v] - (np.cumsum(size) - size), size)
        return np.repeat(np.arange(len(v)), size), self.group[at], self.count[at]

    def table(self, v: np.ndarray, row: np.ndarray, rows: int, kind) -> np.ndarray:
        """The sums of the vertices of each row, by group."""
        i, group, count = self.of(v)
        return np.bincount(row[i] * self.groups + group, count, rows * self.groups).astype(kind).reshape(rows, self.groups)


def degrees(counts: Counts, loops: np.ndarray, rank: int, tasks: int) -> np.ndarray:
    """Of each vertex the arcs that this task finds; loops: vertices that have one, which the first task counts."""
    n = len(loops)
    found = loops.astype(np.int64) if rank == 0 else np.zeros(n, np.int64)
    per = np.bincount(counts.group, minlength=counts.groups).astype(np.float64)
    if float(n) * n * counts.groups / 2 > DENSE * float((per * per).sum()):
        lo, hi = n * rank // tasks, n * (rank + 1) // tasks
        edge = np.unique([*np.searchsorted(counts.start, np.arange(0, len(counts.group), PAIRS)), n]).tolist()
        for a, z in zip(edge, edge[1:]):
            for v, t, _ in alone(counts, np.arange(lo, hi), np.arange(a, z), np.arange(a, z), a, z):
                found += np.bincount(v[v != t], minlength=n)
        return found
    side = max(1, min(2048, TABLE // counts.groups))
    blocks = -(-n // side)
    table = lambda x: counts.table(v := np.arange(x * side, min(n, (x + 1) * side)), v - x * side, len(v), bool).astype(np.float32)
    for i in range(blocks):  # a row of blocks is dealt to all tasks, so that each has one of a length
        mine = range(i + (rank - i) % tasks, blocks, tasks)
        left = table(i) if mine else None
        for j in mine:
            both = np.minimum(left @ (left if i == j else table(j)).T, 1)
            if i == j:
                np.fill_diagonal(both, 0)
            found[i * side : i * side + len(both)] += both.sum(axis=1).astype(np.int64)
            if i != j:
                found[j * side : j * side + both.shape[1]] += both.sum(axis=0).astype(np.int64)
    return found


def alone(counts: Counts, movers: np.ndarray, v: np.ndarray, label: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(mover, label, sum), in order, for ties with the vertices v, whose labels lie from lo to hi: each pair of counts is summed."""
    i, group, count = counts.of(v)
    group, to, sums = small.ties(group.astype(np.int64), label[i] - lo, count.astype(np.int64), counts.groups, hi - lo)
    size = np.bincount(group, minlength=counts.groups)
    start = np.cumsum(size) - size
    j, g, n = counts.of(movers)
    met = np.cumsum(np.bincount(j, size[g], len(movers)))
    edge = np.unique(np.searchsorted(met, np.arange(0, met[-1] if len(met) else 0, PAIRS))).tolist()
    for a, z in zip(edge, [*edge[1:], len(movers)]):
        x, y = np.searchsorted(j, (a, z))
        some, times = g[x:y], size[g[x:y]]
        at = np.arange(times.sum()) + np.repeat(start[some] - (np.cumsum(times) - times), times)
        row, t, e = small.ties(np.repeat(j[x:y] - a, times), to[at], np.repeat(n[x:y].astype(np.int64), times) * sums[at], z - a, hi - lo)
        yield movers[a + row], t + lo, e


def near(counts: Counts, movers: np.ndarray, order: np.ndarray, label: np.ndarray, lo: int, hi: int, k: np.ndarray, a: np.ndarray, m2: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(mover, label, sum) of the own community of each mover and of those others that may be its best among labels from lo to hi, a superset of the best ones.

    order: the vertices by label; label: of each vertex; a: weight of each label.
    """
    first, last = np.searchsorted(label[order], (lo, hi))
    v = order[first:last]
    if not len(v) or not len(movers):
        return []
    met = np.minimum(np.bincount(counts.of(v)[1], minlength=counts.groups), hi - lo).astype(np.float64)
    if float(len(movers)) * counts.groups * (hi - lo) > DENSE * float(met[counts.of(movers)[1]].sum()):
        found = []
        for x, t, e in alone(counts, movers, v, label[v], lo, hi):
            own = t == label[x]
            score = e - k[x] / m2 * a[t]
            begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
            most = np.maximum.reduceat(np.where(own, -np.inf, score), begin) if len(x) else score
            top = np.repeat(most - (counts.most[x[begin]] + k[x[begin]]) * 2.0**-44, np.diff([*begin, len(x)]))
            kept = own | (score >= top)
            x, t, e, own = x[kept], t[kept], e[kept], own[kept]
            found.append((x, t, e - np.where(own, counts.squares[x], 0)))
        return found
    most = int(counts.most.max())
    kind, bits = (np.float32, 20) if most < 1 << 24 else (np.float64, 44)
    found, height = [], max(1, TABLE // counts.groups)
    for i in range(0, len(movers), height):
        some = movers[i : i + height]
        left = counts.table(some, np.arange(len(some)), len(some), kind)
        share = (k[some] / m2).astype(kind)
        slack = ((counts.most[some] + k[some] / m2 * a.max()) * 2.0**-bits).astype(kind)
        best = np.full(len(some), -np.inf, kind)
        width, own, kept = max(1, min(TABLE // counts.groups, CELLS // len(some))), label[some], []
        for x in range(lo, hi, width):
            y = min(hi, x + width)
            p, z = np.searchsorted(label[v], (x, y))
            e = left @ counts.table(v[p:z], label[v[p:z]] - x, y - x, kind).T
            score = e - np.multiply.outer(share, a[x:y].astype(kind))
            row = np.flatnonzero((own >= x) & (own < y))
            found.append((some[row], own[row], e[row, own[row] - x].astype(np.int64) - counts.squares[some[row]]))
            score[row, own[row] - x] = -np.inf
            top = score.max(axis=1)
            # Without ties the score is no more than 0: such cells matter where no tied one is above.
            low = np.flatnonzero(np.maximum(top, best) <= slack)
            if len(low):
                some_low = score[low]
                some_low[e[low] == 0] = -np.inf
                score[low] = some_low
                top[low] = some_low.max(axis=1)
            best = np.maximum(best, top)
            r, t = np.nonzero(score >= np.maximum(best - slack, np.finfo(kind).min)[:, None])
            kept.append((r, t + x, e[r, t], score[r, t]))
        r, t, e, score = (np.concatenate(c) for c in zip(*kept))
        last = (score >= best[r] - slack[r]) & (e > 0)
        found.append((some[r[last]], t[last], e[last].astype(np.int64)))
    return found


def phase(ties: DataFrame, n: int, most: int, less: np.ndarray | None, tasks: int, *, batches: int, tol: float, max_iter: int, devices: int, by: str) -> DataFrame:
    """As held.phase of the ties (group, member, n), members from 0 to n - 1, counts up to ``most``, and tie="min".  In rows of the kinds STATE, LOOP, ENDS, and instead of arcs
    the counts (group, community, n) of communities numbered from 0, what their loops have less than the squares of their counts, and the number of this phase's arcs.

    less: what each vertex's loop has less than the sum of its squared counts; all of it, if None, as between members of groups.
    """
    spark, (name, number) = ties.sparkSession, (held.narrow(0, n, False), held.narrow(0, most, False))
    sent, secret = spark.sparkContext.broadcast(less), held.secrets.token_bytes(32)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.zeros(0, "<i8")], [np.zeros(0, name)], [np.zeros(0, number)]]
        for b in rows:
            for x, column, kind in zip(got, ("group", "member", "n"), ("<i8", name, number)):
                x.append(b.column(column).to_numpy().astype(kind))
        with closing(held.Exchange(BarrierTaskContext.get(), secret)) as others:
            every = lambda x: [np.frombuffer(y, x.dtype) for y in others.gather(np.ascontiguousarray(x).tobytes())]
            counts = Counts(*(np.concatenate(every(np.concatenate(x))) for x in got), n)
            loops = counts.squares if sent.value is None else sent.value
            k = counts.most - loops
            m2 = int(k.sum())
            if not m2:
                if others.rank == 0:
                    yield from held.told(ARCS, np.zeros(1, np.int64), np.zeros(1, np.int64))
                return
            count = sum(every(degrees(counts, counts.squares > loops, others.rank, tasks)))
            c = np.arange(n)

            def share(labels: np.ndarray, dense: np.ndarray, movers: int) -> tuple[np.ndarray, int, int]:
                """The vertices by label and this task's range of labels, which has its share of the work."""
                work = np.bincount(dense, counts.size, len(labels)) + movers * min(counts.groups, 1000) / 400 + 1
                cut = np.searchsorted(np.cumsum(work), work.sum() * np.arange(1, tasks) / tasks)
                edge = [0, *cut.tolist(), len(labels)]
                return np.argsort(dense, kind="stable"), edge[others.rank], edge[others.rank + 1]

            def tables(labels: np.ndarray, dense: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                """(community, group, sum) of this task's communities."""
                order, lo, hi = share(labels, dense, 0)
                if float(hi - lo) * counts.groups > 16 * len(counts.group):  # mostly zeros
                    first, last = np.searchsorted(dense[order], (lo, hi))
                    i, group, some = counts.of(order[first:last])
                    to, group, sums = small.ties(dense[order[first:last]][i] - lo, group.astype(np.int64), some.astype(np.int64), hi - lo, counts.groups)
                    yield to + lo, group, sums
                    return
                width = max(1, TABLE // counts.groups)
                for x in range(lo, hi, width):
                    y = min(hi, x + width)
                    first, last = np.searchsorted(dense[order], (x, y))
                    v = order[first:last]
                    found = counts.table(v, dense[v] - x, y - x, np.int64)
                    to, group = np.nonzero(found)
                    yield to + x, group, found[to, group]

            def modularity() -> float:
                labels, dense = small.numbered(c, n)
                inner = sum(int(np.dot(s, s)) for _, _, s in tables(labels, dense))
                s_in = sum(int(x[0]) for x in every(np.array([inner], "<i8"))) - int(loops.sum())
                return float(m2 * s_in - sum(x * x for x in small.sizes(c, k, n).tolist() if x)) / float(m2 * m2)

            q = before = modularity()
            history: list[tuple] = []
            gain = np.inf
            parts = small.windows(count, batches, devices, by)
            while gain > tol and len(history) < max_iter:
                old = c
                for ranges in parts:
                    movers = np.concatenate([np.arange(lo, hi) for lo, hi in ranges])
                    a, (labels, dense) = small.sizes(c, k, n), small.numbered(c, n)
                    order, lo, hi = share(labels, dense, len(movers))
                    found = near(counts, movers, order, dense, lo, hi, k, a[labels], m2)
                    mine = [np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in range(3)]
                    v, to, e = (np.concatenate(every(x)) for x in mine)
                    order = np.argsort(v * len(labels) + to)
                    v, to = small.choose(v[order], labels[to[order]], e[order], k, a, c, m2, "min")
                    c = c.copy()
                    c[v] = to
                now = modularity()
                gain = now - q
                history.append((len(history) + 1, now, gain))
                if gain < 0:
                    c = old
                else:
                    q = now
            labels, dense = small.numbered(c, n)
            for to, group, s in tables(labels, dense):
                yield from held.told(COUNT, counts.names[group], to, s)
        if others.rank == 0:
            rest = np.zeros(len(labels), np.int64)
            np.add.at(rest, dense, loops)
            yield from held.told(LESS, np.arange(len(labels)), rest)
            yield from held.told(held.STATE, np.arange(n), c)
            yield from held.told(held.LOOP, *(np.array([h[0] for h in history], np.int64),) * 2, q=[h[1] for h in history], gain=[h[2] for h in history])
            yield from held.told(held.ENDS, np.zeros(1, np.int64), np.zeros(1, np.int64), q=[before], gain=[q])
            yield from held.told(ARCS, np.full(1, count.sum()), np.zeros(1, np.int64))

    dealt = ties.select("group", "member", "n").repartitionById(tasks, F.pmod("member", F.lit(tasks)).cast("int"))
    return dealt.mapInArrow(run, "kind int, a long, b long, w long, q double, gain double", barrier=True)
