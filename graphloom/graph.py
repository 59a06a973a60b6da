"""The graph: a vertex table and a table of arcs, both directions of every tie."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .operators import coloring, degree
from .sources import binary, generate, text


@dataclass(frozen=True)
class Graph:
    """vertices (v) are 0 to n - 1, each once; edges (src, dst, w) hold both arcs of a tie and a loop once.

    Parallel arcs add up.  Whole weights (bigint) make scores exact; real ones (double) are scored in doubles.
    """

    vertices: DataFrame
    edges: DataFrame

    # Construction

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None, *, weight: str | None = "w", symmetric: bool = True) -> Graph:
        """From (src, dst[, weight]); weight None counts every arc as 1; symmetric=False adds the reverse arcs."""
        w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
        kept = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), w.alias("w"))
        kind = dict(kept.dtypes)["w"]
        kept = kept.withColumn("w", F.col("w").cast("double" if kind in ("double", "float") or kind.startswith("decimal") else "bigint"))
        if not symmetric:
            kept = symmetrize(kept)
        if vertices is None:
            top = kept.agg(F.max(F.greatest("src", "dst"))).first()[0]
            vertices = edges.sparkSession.range(0 if top is None else top + 1).select(F.col("id").alias("v"))
        return Graph(vertices.select(F.col("v").cast("bigint").alias("v")), kept)

    @staticmethod
    def from_csr(spark: SparkSession, offsets: Sequence[int], indices: Sequence[int], data: Sequence[float] | None = None) -> Graph:
        """From compressed rows in memory."""
        import pandas as pd

        import numpy as np

        counts = np.diff(np.asarray(offsets, np.int64))
        frame = pd.DataFrame({"src": np.repeat(np.arange(len(counts)), counts), "dst": np.asarray(indices, np.int64), "w": np.ones(len(indices), np.int64) if data is None else np.asarray(data)})
        kind = schema.EDGES if frame["w"].dtype.kind in "iu" else schema.EDGES_REAL
        return Graph(spark.range(len(counts)).select(F.col("id").alias("v")), spark.createDataFrame(frame, kind))

    @staticmethod
    def read_binary(spark: SparkSession, path: str, *, whole: bool = False) -> Graph:
        """From the binary format; whole=True casts weights to bigint."""
        vertices, edges = binary.read(spark, path)
        return Graph(vertices, edges.withColumn("w", F.col("w").cast("bigint")) if whole else edges)

    @staticmethod
    def read_mtx(spark: SparkSession, path: str) -> Graph:
        return Graph(*text.read_mtx(spark, path))

    @staticmethod
    def read_tsv(spark: SparkSession, path: str, **options) -> Graph:
        return Graph.from_edges(text.read_tsv(spark, path), **options)

    @staticmethod
    def random_ba(spark: SparkSession, nv: int, m0: int, seed: int = 1) -> Graph:
        return Graph(*generate.random_ba(spark, nv, m0, seed))

    # Properties

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        """Arcs."""
        return self.edges.count()

    def neighbors(self, v: int) -> DataFrame:
        """(dst, w) of the arcs from v."""
        return self.edges.where(F.col("src") == v).select("dst", "w")

    def degrees(self) -> DataFrame:
        return degree.degrees(self.vertices, self.edges)

    def weighted_degrees(self) -> DataFrame:
        return degree.weighted_degrees(self.vertices, self.edges)

    def max_incident_weights(self) -> DataFrame:
        return degree.max_incident_weights(self.vertices, self.edges)

    def max_degree(self) -> int:
        return degree.max_degree(self.vertices, self.edges).first()[0]

    def total_mass(self) -> float:
        return degree.total_mass(self.edges).first()["mass"]

    def stats(self) -> DataFrame:
        return degree.stats(self.vertices, self.edges)

    def csr_offsets(self) -> DataFrame:
        return degree.csr_offsets(self.vertices, self.edges)

    # Changes

    def dedupe(self) -> Graph:
        return Graph(self.vertices, self.edges.groupBy("src", "dst").agg(F.sum("w").alias("w")))

    def randomize_weights(self, seed: int = 1) -> Graph:
        """Weights in (0, 1) by a hash of the pair, so that both arcs of a tie agree."""
        h = F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"), F.lit(seed))
        return Graph(self.vertices, self.edges.select("src", "dst", ((F.pmod(h, F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))).alias("w")))

    def validate(self) -> Graph:
        """Raises ValueError with what is wrong, else returns the graph."""
        bad = [f"{r['n']} x {r['problem']}" for r in schema.problems(self.vertices, self.edges).where("n > 0").collect()]  # five rows at most
        if bad:
            raise ValueError("; ".join(bad))
        return self

    def coloring(self, seed: int = 1) -> DataFrame:
        """(v, color, position)."""
        return coloring.positions(coloring.coloring(self.vertices, self.edges, seed))

    def reorder(self, positions: DataFrame) -> Graph:
        """The graph with position for v."""
        at = positions.select("v", "position")
        ends = self.edges.join(at.select(F.col("v").alias("src"), F.col("position").alias("s")), "src").join(at.select(F.col("v").alias("dst"), F.col("position").alias("d")), "dst")
        return Graph(self.vertices, ends.select(F.col("s").alias("src"), F.col("d").alias("dst"), "w"))

    def write_binary(self, path: str) -> None:
        binary.write(self.vertices, self.edges, path)

    def write_tsv(self, path: str) -> None:
        text.write_tsv(self.edges, path)


@dataclass(frozen=True)
class Shared:
    """Vertices that are tied by common groups: ties (group, member, n), longs without nulls and each pair once, tell how often; two vertices are tied by the sum of the products of both counts in each group.

    arcs: makes the table of arcs, for runs that need it.
    """

    vertices: DataFrame
    ties: DataFrame
    arcs: Callable[[], DataFrame]


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each arc and its reverse; a loop once."""
    return edges.unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def mask_loops(edges: DataFrame) -> DataFrame:
    """Loops keep their row, with weight zero."""
    return edges.withColumn("w", F.when(F.col("src") == F.col("dst"), F.lit(0)).otherwise(F.col("w")))
