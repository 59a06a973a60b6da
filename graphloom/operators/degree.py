"""Degrees, masses and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import prefix_sum


def _per_vertex(vertices: DataFrame, edges: DataFrame, name: str, value) -> DataFrame:
    found = edges.groupBy(F.col("src").alias("v")).agg(value.alias(name))
    return vertices.join(found, "v", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, degree): arcs from v, parallel ones counted."""
    return _per_vertex(vertices, edges, "degree", F.count(F.lit(1)))


def weighted_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, k): weight of the arcs from v."""
    return _per_vertex(vertices, edges, "k", F.sum("w"))


def max_incident_weights(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, max_w): the largest weight of an arc from v, zero at least."""
    return _per_vertex(vertices, edges, "max_w", F.greatest(F.max("w"), F.lit(0)))


def max_degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(vertices, edges).agg(F.max("degree").alias("max_degree"))


def total_mass(edges: DataFrame) -> DataFrame:
    """(m2, mass): the sum of all arcs' weights and half of it."""
    return edges.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("m2")).withColumn("mass", F.col("m2") / F.lit(2.0))


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row on the distribution of degrees; variance and standard deviation are of the population."""
    d = degrees(vertices, edges)
    n, s, q = F.count(F.lit(1)), F.sum("degree"), F.sum(F.col("degree") * F.col("degree"))
    row = d.agg(n.alias("n_vertices"), F.coalesce(s, F.lit(0)).alias("n_arcs"), F.max("degree").alias("max_degree"), F.percentile("degree", F.lit(0.5)).alias("median_degree"), q.alias("q"))
    n, s, q = F.col("n_vertices"), F.col("n_arcs"), F.col("q")
    # Whole numbers up to one division: the same bits in every engine.
    variance = F.try_divide((n * q - s * s).cast("double"), (n * n).cast("double"))
    return row.select("n_vertices", "n_arcs", "max_degree", "median_degree", F.try_divide(q.cast("double"), n.cast("double")).alias("mean_sq_degree"), variance.alias("variance"), F.sqrt(variance).alias("stddev"))


def csr_offsets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, begin, end): the places of v's arcs in a compressed row layout."""
    placed = prefix_sum(degrees(vertices, edges), "v", "degree", "begin")
    return placed.select("v", "begin", (F.col("begin") + F.col("degree")).alias("end"))
