"""Contraction of communities to vertices and composition of levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import dense_numbers


def relabel(state: DataFrame) -> DataFrame:
    """(c, id): communities numbered from 0 in ascending order."""
    return dense_numbers(state, "c", "id")


def contract(edges: DataFrame, state: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, w): weight between communities; what lies inside one is its loop, both directions counted."""
    new = state.join(names, "c").select("v", "id")
    ends = edges.join(new.select(F.col("v").alias("src"), F.col("id").alias("s")), "src").join(new.select(F.col("v").alias("dst"), F.col("id").alias("d")), "dst")
    return ends.groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w"))


def compose(communities: DataFrame, state: DataFrame, names: DataFrame) -> DataFrame:
    """(v, community) of original vertices, one level further up."""
    new = state.join(names, "c").select(F.col("v").alias("community"), "id")
    return communities.join(new, "community").select("v", F.col("id").alias("community"))
