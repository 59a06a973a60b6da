"""Synthetic graphs: (vertices, edges)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _both(half: DataFrame) -> DataFrame:
    return half.unionByName(half.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def _vertices(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("v"))


def random_ba(spark: SparkSession, nv: int, m0: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Preferential attachment: a star of m0 + 1 vertices, then every vertex draws m0 ends of earlier edges, with replacement.

    Weights are \\|N(1, 1)\\|, the same both ways; 2 * m0 * (nv - m0) arcs.  Every draw follows a hash of
    the seed and the edge: a draw that points into the part that is not drawn yet is followed back to
    a fixed end, so each edge is found on its own and in parallel.
    """
    if not 1 <= m0 < nv:
        raise ValueError("m0 must be at least 1 and below nv")

    def run(batches):
        import pandas as pd

        mix = lambda x, salt: _hash(x.astype(np.uint64), np.uint64(seed * 1_000_003 + salt))
        for ids in batches:
            e = ids["id"].to_numpy()
            src = np.where(e < m0, e + 1, m0 + 1 + (e - m0) // m0)
            # Place 2i + 1 of the list of ends is edge i's source, place 2i its target.
            at = np.where(e < m0, -1, (mix(e, 1) % np.maximum(2 * np.where(e < m0, 1, m0 + (src - m0 - 1) * m0), 1).astype(np.uint64)).astype(np.int64))
            while True:
                edge = at // 2
                open_ = (at >= 0) & (at % 2 == 0) & (edge >= m0)
                if not open_.any():
                    break
                s = m0 + 1 + (edge[open_] - m0) // m0
                at[open_] = (mix(edge[open_], 1) % (2 * (m0 + (s - m0 - 1) * m0)).astype(np.uint64)).astype(np.int64)
            edge = at // 2
            dst = np.where(at < 0, 0, np.where(at % 2 == 0, 0, np.where(edge < m0, edge + 1, m0 + 1 + (edge - m0) // m0)))
            u1, u2 = (((mix(e, k) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53 for k in (2, 3))
            w = np.abs(1 + np.sqrt(-2 * np.log(np.minimum(u1, 1))) * np.cos(2 * np.pi * u2))
            yield pd.DataFrame({"src": src, "dst": dst, "w": w})

    half = spark.range(m0 * (nv - m0)).mapInPandas(run, "src bigint, dst bigint, w double")
    # The star's edges come first; every later vertex has m0 edges.
    return _vertices(spark, nv), _both(half)


def _hash(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (x + salt) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def ring_of_cliques(spark: SparkSession, cliques: int = 8, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Cliques in a ring; the first vertex of each is tied to the second of the next."""
    pairs = spark.range(cliques).select(F.col("id").alias("q")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    inner = pairs.where("i < j").select((F.col("q") * size + F.col("i")).alias("src"), (F.col("q") * size + F.col("j")).alias("dst"))
    ties = spark.range(cliques).select((F.col("id") * size).alias("src"), ((F.col("id") + 1) % cliques * size + 1).alias("dst"))
    return _vertices(spark, cliques * size), _both(inner.unionByName(ties).withColumn("w", F.lit(1).cast("bigint")))


def planted_partition(spark: SparkSession, blocks: int = 6, size: int = 20, inside: int = 600, across: int = 30) -> tuple[DataFrame, DataFrame]:
    """Blocks with dense ties inside and few across, by a hash of the pair in thousandths."""
    n = blocks * size
    pairs = spark.range(1, n).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("i") - 1)))
    h = (F.col("i") * 7919 + F.col("j") * 104729) % 1000
    near = F.floor(F.col("i") / size) == F.floor(F.col("j") / size)
    half = pairs.where(h < F.when(near, F.lit(inside)).otherwise(F.lit(across))).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1).cast("bigint").alias("w"))
    return _vertices(spark, n), _both(half)
