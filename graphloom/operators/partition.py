"""Contiguous vertex ranges for the batches of an iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_balanced(offsets: DataFrame, n_vertices: int, n_arcs: int, parts: int, v_lo: int = 0, v_hi: int | None = None) -> list[int]:
    """Bounds of ``parts`` ranges in [v_lo, v_hi), from (v, begin, end).

    A range ends at the first vertex with which it holds more than floor(arcs / parts) arcs; what is
    left over is the last range, and ranges after the end are empty.
    """
    v_hi = n_vertices if v_hi is None else v_hi
    least = n_arcs // parts
    bounds, base = [v_lo], None
    own = offsets.where(F.col("v").between(v_lo, v_hi - 1))
    if v_lo < v_hi:
        base = own.where(F.col("v") == v_lo).first()["begin"]
    while len(bounds) <= parts and bounds[-1] < v_hi:
        row = own.where((F.col("v") >= bounds[-1]) & (F.col("end") - base > least)).agg(F.min(F.struct("v", "end")).alias("at")).first()["at"]
        if row is None:
            break
        bounds.append(row["v"] + 1)
        base = row["end"]
    return bounds + [v_hi] * (parts + 1 - len(bounds))


def vertex_balanced(n_vertices: int, parts: int, v_lo: int = 0) -> list[int]:
    """Bounds of ranges of floor(n_vertices / parts) vertices; the last takes the rest."""
    return [v_lo + i * (n_vertices // parts) for i in range(parts)] + [v_lo + n_vertices]


def batches(offsets: DataFrame, n_vertices: int, n_arcs: int, parts: int, devices: int = 1, by: str = "edge") -> list[list[tuple[int, int]]]:
    """For each batch, the vertex ranges that move together: one of each device."""
    if by == "vertex":
        outer = vertex_balanced(n_vertices, devices)
    else:
        outer = [0, n_vertices] if devices == 1 else edge_balanced(offsets, n_vertices, n_arcs, devices)
    inner = []
    for lo, hi in zip(outer, outer[1:]):
        if by == "vertex":
            inner.append(vertex_balanced(hi - lo, parts, lo))
        else:
            held = n_arcs if devices == 1 else offsets.where(F.col("v").between(lo, hi - 1)).agg(F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0)).alias("n")).first()["n"]
            inner.append(edge_balanced(offsets, n_vertices, held, parts, lo, hi))
    return [[(b[i], b[i + 1]) for b in inner] for i in range(parts)]


def two_way(vertices: DataFrame, step: int = 7919, offset: int = 13) -> DataFrame:
    """(v, c): a fixed assignment of vertices to communities 0 and 1, to check what takes an assignment from outside."""
    return vertices.select("v", ((F.col("v") * step + offset) % 2).alias("c"))


def table(spark, bounds: list[int]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))], "b int, v_lo bigint, v_hi bigint")
