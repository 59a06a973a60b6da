"""Multi-phase batched modularity optimisation.

A phase starts from singletons.  In each iteration the batches move one after the other; an iteration
that lowers the modularity is undone.  When an iteration gains no more than ``tol``, the communities
become the vertices of the next phase, if the phase as a whole gained more than that.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..graph import Graph, Shared
from ..lineage import written as cut
from ..operators import contract, degree, moves, partition
from ..sources import text
from . import held, shared, small


@dataclass(frozen=True)
class Result:
    """communities (v, community); hierarchy, the same after each contraction; history of iterations; phases; timings of phases.

    q_final: modularity when the last phase ended; communities may be short of it by ``tol``, as moves
    of a last phase that gained no more than that are not composed.  seconds: of the whole run.
    """

    communities: DataFrame
    hierarchy: DataFrame
    history: DataFrame
    phases: DataFrame
    timings: DataFrame
    q_final: float | None
    seconds: float

    def write_text(self, path: str) -> None:
        text.write_communities(self.communities, path)


@dataclass(frozen=True)
class Louvain:
    """batches: vertex ranges that move one after the other (8 to 32 give better results than the default).

    tol: gain in modularity below which iterations end; phase_tol: below which phases end, tol if None.  tie: see operators.moves.best_moves.
    devices: ranges whose batches move together.  partition_by: ``edge`` or ``vertex`` balanced ranges.
    coloring: renumbers vertices by color first.  A phase works by DataFrame supersteps.  Once contraction has left no more than
    small_arcs arcs (counted first), which one task can hold, a phase runs the same rules inside one task; with more arcs but no more than
    held_vertices vertices, whose state the driver and each task can hold, by tasks over blocks of arcs, and of whole weights as soon as each has
    held.TASK arcs.  Whole weights give the same results to the bit, real ones but for the order in which sums are rounded.  small_arcs=0 never does either.
    A graph of common groups works without arcs (plans/shared.py), if it has no more than held_vertices vertices and held_counts pairs of a group and a member, singletons to start from and tie="min".
    """

    batches: int = 2
    tol: float = 1e-6
    phase_tol: float | None = None
    max_iter: int = 500
    max_phases: int = 200
    tie: str = "min"
    devices: int = 1
    partition_by: str = "edge"
    coloring: bool = False
    small_arcs: int = 4_000_000
    held_vertices: int = 2_000_000
    held_counts: int = 12_000_000

    def fit(self, graph: Graph | Shared, init: DataFrame | None = None) -> Result:
        """Isolated vertices stay communities of their own; a graph without weight gives singletons and q null.

        init: (v, c), the communities that the first phase starts from, by names from 0 to n - 1; a vertex that it lacks is in that of its own number.
        """
        begun = time.time()
        vertices, edges, ties = cut(graph.vertices), None, None
        if isinstance(graph, Shared):
            ties = self._ties(graph, vertices) if init is None else None
        if ties is None:
            edges = cut(graph.arcs() if isinstance(graph, Shared) else graph.edges)
        places = None
        if self.coloring:
            places = cut(Graph(vertices, edges).coloring())
            edges = cut(Graph(vertices, edges).reorder(places).edges)
            if init is not None:
                at = places.select("v", "position")
                init = init.join(at, "v").select(F.col("position").alias("v"), "c")
        n, arcs = vertices.count(), 0 if edges is None else edges.count()
        state = vertices.select("v", F.col("v").alias("c"))
        if init is not None:
            state = state.select("v").join(init.select("v", "c"), "v", "left").select("v", F.coalesce("c", "v").alias("c"))
        history: list[tuple] = []
        phases: list[tuple] = []
        timings: list[tuple] = []
        levels: list[DataFrame] = []
        composed = vertices.select("v", F.col("v").alias("community"))
        least = self.tol if self.phase_tol is None else self.phase_tol
        original, given = vertices, init is not None
        for phase in range(self.max_phases):
            clock = time.time()
            if ties is not None:
                state, before, q, rows, arcs, *shrunk = self._shared(ties, state, n)
            else:
                mass = edges.agg(F.sum("w")).first()[0] or 0
                short = isinstance(mass, float) or mass <= moves.LONG_MASS
                fits = short and arcs <= self.small_arcs and n <= self.small_arcs
                near = short and self.small_arcs and n <= self.held_vertices and held.slots(vertices.sparkSession)
                if near and not isinstance(mass, float):  # equal results either way, sooner by several tasks
                    fits = fits and arcs <= near * held.TASK
                state, before, q, rows, *shrunk = (self._small if fits else self._held if near else self._large)(vertices, edges, state, n, arcs, mass)
            moved = time.time() - clock
            history += [(phase, *r, n, arcs) for r in rows]
            if q is None:
                phases.append((phase, 1, None, n, arcs, n))
                timings.append((phase, 1, moved, 0.0))
                break
            names = cut(contract.relabel(state))
            count = names.count()
            phases.append((phase, len(rows), q, n, arcs, count))
            # Communities from outside are a result of the first phase even if nothing moved.
            ended = not q - before > least and not (given and phase == 0)
            clock = time.time()
            if not ended:
                composed = cut(contract.compose(composed, state, names))
                levels.append(composed.select(F.lit(len(levels)).alias("level"), "v", "community"))
                ended = count in (n, 1)
            if not ended:
                vertices, n = names.select(F.col("id").alias("v")), count
                if ties is not None:
                    ties = shrunk[0]
                else:
                    edges = cut(shrunk[0] if shrunk else contract.contract(edges, state, names))
                    arcs = edges.count()
                state = vertices.select("v", F.col("v").alias("c"))
            timings.append((phase, len(rows), moved, time.time() - clock))
            if ended:
                break
        spark = original.sparkSession
        hierarchy = levels[0] if levels else spark.createDataFrame([], schema.HIERARCHY)
        for x in levels[1:]:
            hierarchy = hierarchy.unionByName(x)
        if places is not None:
            hierarchy = cut(hierarchy.join(places.select(F.col("v").alias("old"), F.col("position").alias("v")), "v").select("level", F.col("old").alias("v"), "community"))
        last = hierarchy.where(F.col("level") == len(levels) - 1).select("v", "community") if levels else original.select("v", F.col("v").alias("community"))
        frames = (spark.createDataFrame(rows, layout) for rows, layout in ((history, schema.HISTORY), (phases, schema.PHASES), (timings, schema.TIMINGS)))
        return Result(last, hierarchy, *frames, phases[-1][2] if phases else None, time.time() - begun)

    def _ties(self, graph: Shared, vertices: DataFrame) -> tuple | None:
        """(table, rows, largest count, loops' lack) of ties that tasks can hold; None if they can't or if options need arcs."""
        if self.tie != "min" or self.coloring or not self.small_arcs or not held.slots(vertices.sparkSession):
            return None
        table = cut(graph.ties)
        one, n = F.col("n").cast("double"), vertices.count()
        each = table.groupBy("group").agg(F.sum(one).alias("n"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("most"), F.min("member").alias("lo"), F.max("member").alias("hi"))
        told = each.agg(F.sum(F.col("n") * F.col("n")).alias("mass"), F.sum("rows").alias("rows"), F.max("most").alias("most"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
        if not told["rows"] or n > self.held_vertices or told["rows"] > self.held_counts or told["lo"] < 0 or told["hi"] >= n or told["mass"] >= 1 << 52:
            return None
        return table, told["rows"], told["most"], None

    def _shared(self, ties: tuple, state: DataFrame, n: int) -> tuple[DataFrame, float | None, float | None, list, int, tuple | None]:
        """One phase by tasks that run together and hold the counts of all vertices, without arcs; last, the number of arcs and the ties of communities."""
        table, size, most, less = ties
        tasks = min(held.slots(table.sparkSession), max(1, -(-size // shared.TASK)))
        found = cut(shared.phase(table, n, most, less, tasks, batches=self.batches, tol=self.tol, max_iter=self.max_iter, devices=self.devices, by=self.partition_by))
        kind = lambda x: found.where(F.col("kind") == x)
        arcs = kind(shared.ARCS).first()["a"]
        if not arcs:
            return state, None, None, [(1, None, None, True)], 0, None
        ends = kind(held.ENDS).first()
        rows = [(r["a"], r["q"], r["gain"], r["gain"] >= 0) for r in kind(held.LOOP).orderBy("a").collect()]
        counts = kind(shared.COUNT).select(F.col("a").alias("group"), F.col("b").alias("member"), F.col("w").alias("n"))
        told, lack = counts.agg(F.count(F.lit(1)), F.max("n")).first(), kind(shared.LESS).orderBy("a").toArrow().column("b").to_numpy()
        return kind(held.STATE).select(F.col("a").alias("v"), F.col("b").alias("c")), ends["q"], ends["gain"], rows, arcs, (counts, *told, lack)

    def _small(self, vertices: DataFrame, edges: DataFrame, state: DataFrame, n: int, arcs: int, mass) -> tuple[DataFrame, float | None, float | None, list]:
        """One phase inside one task; its bounded input was counted."""
        options = {"batches": self.batches, "tol": self.tol, "max_iter": self.max_iter, "tie": self.tie, "devices": self.devices, "by": self.partition_by}

        def run(rows):
            import pandas as pd

            pick = lambda x, y: x[y].to_numpy()
            arcs, at = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
            weights = pick(arcs, "w")
            c = np.arange(n)
            c[pick(at, "src")] = pick(at, "dst")
            c, before, q, history = small.phase(n, pick(arcs, "src"), pick(arcs, "dst"), weights if weights.dtype.kind == "f" else weights.astype(np.int64), c, **options)
            parts = [pd.DataFrame({"kind": "state", "a": np.arange(n), "b": c}), pd.DataFrame([{"kind": "q", "x": before, "y": q}])]
            parts.append(pd.DataFrame([{"kind": "history", "a": h[0], "x": h[1], "y": h[2], "z": h[3]} for h in history]))
            return pd.concat(parts).reindex(columns=["kind", "a", "b", "x", "y", "z"]).astype({"a": "Int64", "b": "Int64", "x": "float64", "y": "float64", "z": "boolean"})

        kind = dict(edges.dtypes)["w"]
        both = edges.select(F.lit(0).alias("kind"), "src", "dst", "w").unionByName(state.select(F.lit(1).alias("kind"), F.col("v").alias("src"), F.col("c").alias("dst"), F.lit(0).cast(kind).alias("w")))
        both = both.unionByName(edges.sparkSession.createDataFrame([(2, 0, 0, 0.0 if kind == "double" else 0)], f"kind int, src bigint, dst bigint, w {kind}"))  # so that there is a group
        found = cut(both.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda rows: run(rows), "kind string, a bigint, b bigint, x double, y double, z boolean"))
        null = lambda x: None if x is None or x != x else x
        q = found.where("kind = 'q'").first()
        rows = [(r["a"], null(r["x"]), null(r["y"]), r["z"]) for r in found.where("kind = 'history'").orderBy("a").collect()]
        return found.where("kind = 'state'").select(F.col("a").alias("v"), F.col("b").alias("c")), null(q["x"]), null(q["y"]), rows

    def _held(self, vertices: DataFrame, edges: DataFrame, state: DataFrame, n: int, arcs: int, mass) -> tuple[DataFrame, float | None, float | None, list, DataFrame]:
        """One phase by tasks that run together and hold the state of all vertices, which were counted, and each some of the arcs; last, the arcs between communities."""
        spark = edges.sparkSession
        sums = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("k"), F.min("w").alias("least"), F.max("w").alias("most")).toArrow()
        src, kind = sums.column("src").to_numpy(), np.float64 if dict(edges.dtypes)["w"] == "double" else np.int64
        count, k, c = np.zeros(n, np.int64), np.zeros(n, kind), np.arange(n)
        count[src], k[src] = sums.column("n").to_numpy(), sums.column("k").to_numpy()
        given = state.select("v", "c").toArrow()
        c[given.column("v").to_numpy()] = given.column("c").to_numpy()
        if not k.sum():
            return state, None, None, [(1, None, None, True)]
        windows = small.windows(count, self.batches, self.devices, self.partition_by)
        weights = min(sums.column("least").to_pylist()), max(sums.column("most").to_pylist())
        tasks = min(held.slots(spark), max(1, -(-arcs // held.TASK)))
        found = cut(held.phase(edges, windows, count, k, c, weights, tasks, tol=self.tol, max_iter=self.max_iter, tie=self.tie))
        ends = found.where(F.col("kind") == held.ENDS).first()
        rows = [(r["a"], r["q"], r["gain"], r["gain"] >= 0) for r in found.where(F.col("kind") == held.LOOP).orderBy("a").collect()]
        pairs = found.where(F.col("kind") == held.ARC).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
        return found.where(F.col("kind") == held.STATE).select(F.col("a").alias("v"), F.col("b").alias("c")), ends["q"], ends["gain"], rows, pairs

    def _large(self, vertices: DataFrame, edges: DataFrame, state: DataFrame, n: int, arcs: int, mass) -> tuple[DataFrame, float | None, float | None, list]:
        """One phase by supersteps.  The arcs of each batch are written once, so that an iteration reads every arc once."""
        state = cut(degree.weighted_degrees(vertices, edges).join(state.select("v", "c"), "v"))
        q = before = moves.modularity(edges, state).first()["q"]
        if q is None:
            return state, None, None, [(1, None, None, True)]
        batches = []
        for ranges in partition.batches(cut(degree.csr_offsets(vertices, edges)), n, arcs, self.batches, self.devices, self.partition_by):
            full = [r for r in ranges if r[0] < r[1]]
            if full:
                inside = lambda x, full=full: F.array_max(F.array(*[F.col(x).between(lo, hi - 1) for lo, hi in full]))
                batches.append((cut(edges.where(inside("src")).repartition("src")), inside("v")))
        rows: list[tuple] = []
        gain = float("inf")
        while gain > self.tol and len(rows) < self.max_iter:
            old = state
            for own, movers in batches:
                state = cut(moves.superstep(own, state, mass, movers, self.tie))
            now = moves.modularity(edges, state).first()["q"]
            gain = now - q
            rows.append((len(rows) + 1, now, gain, gain >= 0))
            if gain < 0:
                state = old
            else:
                q = now
        return state, before, q, rows
