"""Table layouts and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERTICES = "v bigint"
EDGES = "src bigint, dst bigint, w bigint"
EDGES_REAL = "src bigint, dst bigint, w double"
COMMUNITIES = "v bigint, community bigint"
HIERARCHY = "level int, v bigint, community bigint"
HISTORY = "phase int, loop int, q double, dq double, accepted boolean, n_vertices bigint, n_arcs bigint"
TIMINGS = "phase int, loops int, move_seconds double, contract_seconds double"
PHASES = "phase int, loops int, q double, n_vertices bigint, n_arcs bigint, n_communities bigint"


def check_columns(df: DataFrame, layout: str) -> None:
    """Raises ValueError unless df has exactly the columns of a layout, in order and type."""
    want = [tuple(x.split()) for x in layout.split(", ")]
    if df.dtypes != want:
        raise ValueError(f"expected {layout}, got {', '.join(map(' '.join, df.dtypes))}")


def problems(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, n): null ids, negative or missing weights, arcs without a vertex, arcs without their reverse."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    ends = edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v"))).where("v IS NOT NULL")
    both = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    lacking = both.join(both.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("back")), ["src", "dst"], "left").where(~F.col("w").eqNullSafe(F.col("back")))
    found = one(vertices.where("v IS NULL"), "null vertex").unionByName(one(edges.where("src IS NULL OR dst IS NULL"), "null end"))
    found = found.unionByName(one(edges.where("w IS NULL OR w < 0"), "bad weight")).unionByName(one(ends.join(vertices, "v", "left_anti"), "unknown vertex"))
    return found.unionByName(one(lacking.where("src IS NOT NULL AND dst IS NOT NULL"), "asymmetric arc"))
