"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


#: Edges of a node beyond which they are dealt over several keys.
HOT = 100_000


def _nearest(edges: DataFrame, most: int, hot: int) -> DataFrame:
    """(u, v, m): each neighbour v of u with the least m of u and all its neighbours; most: edges that a node has at most."""
    if most <= hot:
        return edges.select("u", "v", F.least("u", F.min("v").over(Window.partitionBy("u"))).alias("m"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.floor(F.count(F.lit(1)) / hot).alias("more"))
    many = least.where("more > 0").select("u", F.col("more").alias("salts"))  # one row for every ``hot`` edges at most
    salted = edges.join(F.broadcast(many), "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(0)) + 1).alias("salt"))
    spread = least.select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), "more")).alias("salt"))
    return salted.join(spread, ["u", "salt"]).drop("salt")


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """Of distinct (u, v) with v below u: the edges of the node that has most, and whether all are stars around their least nodes."""
    end = lambda x, above: F.struct(F.col(x).alias("node"), F.lit(above).alias("above"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("above").alias("above"))
    most, outer = nodes.agg(F.max("n"), F.max(F.when(F.col("above") > 0, F.col("n")))).first()
    return most or 0, (outer or 1) == 1


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """From undirected edges (u, v), longs without nulls, to (node, component).

    component is the least node that can be reached.  Loops and repeated edges change nothing; a node
    of loops alone has no row.  No edges: no rows.  An iteration deals the edges three times, and the nodes once to see
    whether it was the last; where a node has more than ``hot`` edges, its least neighbour is found by min(), which is
    aggregated before the shuffle, and meets them under several keys.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        most, stars = _shape(now)
        if stars:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A node has no more edges here than in both; what repeats goes at the end.
        large = _nearest(both, most, hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = _nearest(large, most, hot)
        small = down.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.where("u <> v").distinct())
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
