"""Proper vertex coloring with hashed priorities, and the order that it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import written as cut
from .ranking import prefix_sum


def coloring(vertices: DataFrame, edges: DataFrame, seed: int = 1) -> DataFrame:
    """(v, color): no two neighbours share one.

    In each round the vertices whose uncolored neighbours all have a lower priority take the smallest
    color that no neighbour has.  The priority is a hash of the vertex, ties go to the smaller id, so
    the result depends on the graph and the seed alone.
    """
    priority = lambda v: F.struct(F.xxhash64(v, F.lit(seed)).alias("h"), (-F.col(v)).alias("n"))
    arcs = cut(edges.where("src <> dst").select("src", "dst").distinct())
    now = cut(vertices.select("v", F.lit(None).cast("bigint").alias("color")))
    while not now.where("color IS NULL").isEmpty():
        near = arcs.join(now.select(F.col("v").alias("dst"), F.col("color").alias("near")), "dst").join(now.where("color IS NULL").select(F.col("v").alias("src")), "src", "left_semi")
        waits = F.max(F.col("near").isNull() & (priority("dst") > priority("src")))
        seen = near.groupBy(F.col("src").alias("v")).agg(waits.alias("waits"), F.collect_set("near").alias("used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.transform("used", lambda x: x.cast("int")))).cast("bigint")
        chosen = seen.select("v", F.when(~F.col("waits"), free).alias("new"), F.lit(True).alias("seen"))
        now = cut(now.join(chosen, "v", "left").select("v", F.coalesce("color", F.when(F.col("seen").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("new"))).alias("color")))
    return now


def color_count(colors: DataFrame) -> DataFrame:
    """(n_colors, largest): how many colors there are, and how many vertices share the most frequent one."""
    sizes = colors.groupBy("color").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_colors"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def positions(colors: DataFrame) -> DataFrame:
    """(v, color, position): places in the order of color, then id."""
    sizes = colors.groupBy("color").agg(F.count(F.lit(1)).alias("n"))
    base = prefix_sum(sizes, "color", "n", "base").select("color", "base")
    # Within a color, a prefix sum over blocks of ids, so that one large color is not one task.
    block = F.floor(F.col("v") / F.lit(1 << 16))
    keyed = colors.withColumn("block", block)
    counts = keyed.groupBy("color", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("color").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("color", "block").orderBy("v")) - 1
    return keyed.join(before, ["color", "block"]).join(base, "color").select("v", "color", (F.col("base") + F.col("before") + inside).alias("position"))
