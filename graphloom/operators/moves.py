"""One superstep of batched moves between communities.

state is (v, k, c): weighted degree and community of each vertex.  Scores are whole numbers,
2m * e - k * a, in 64 bits where 2m allows it and in decimals otherwise, so that ties are exact and
do not depend on how Spark partitions the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 2m up to which products of two masses fit a long.
LONG_MASS = 3_000_000_000


def wide(x: Column, m2: int | float) -> Column:
    return x if isinstance(m2, float) or m2 <= LONG_MASS else x.cast("decimal(38,0)")


def singletons(degrees: DataFrame) -> DataFrame:
    """Each vertex a community of its own, from (v, k)."""
    return degrees.select("v", "k", F.col("v").alias("c"))


def community_weights(state: DataFrame) -> DataFrame:
    """(c, a): weight of all vertices of each community."""
    return state.groupBy("c").agg(F.sum("k").alias("a"))


def gather(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(src, c, w): each arc with its target's community; a loop keeps its row with weight zero."""
    target = state.select(F.col("v").alias("dst"), "c")
    return edges.join(target, "dst").select("src", "c", F.when(F.col("src") == F.col("dst"), F.lit(0)).otherwise(F.col("w")).alias("w"))


def neighbour_sums(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(src, c, e): weight between each vertex and each community around it."""
    return gather(edges, state).groupBy("src", "c").agg(F.sum("w").alias("e"))


def distinct_communities(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(src, n): number of communities around each vertex."""
    return neighbour_sums(edges, state).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


def move_scores(edges: DataFrame, state: DataFrame, m2: int | float, batch: Column | None = None) -> DataFrame:
    """(v, c, own, s, stay): score of each community around v; of its own one as if v had left it.

    stay is the score of the own community for a vertex without an arc to it.  batch: condition on the
    vertices that are scored, all if None.  The mover's own columns travel with its arcs, so that
    the sums need one aggregation and one look-up of the communities' weights.
    """
    weights = community_weights(state)
    movers = (state if batch is None else state.where(batch)).join(weights.withColumnRenamed("a", "a_own"), "c")
    movers = movers.select(F.col("v").alias("src"), "k", F.col("c").alias("own"), "a_own")
    arcs = edges.join(movers, "src").join(state.select(F.col("v").alias("dst"), "c"), "dst")
    weight = F.when(F.col("src") == F.col("dst"), F.lit(0)).otherwise(F.col("w"))
    near = arcs.groupBy("src", "k", "own", "a_own", "c").agg(F.sum(weight).alias("e")).join(weights, "c")
    k, a, e, a_own = (wide(F.col(x), m2) for x in ("k", "a", "e", "a_own"))
    s = F.lit(m2) * e - k * F.when(F.col("c") == F.col("own"), a - k).otherwise(a)
    return near.select(F.col("src").alias("v"), "c", "own", s.alias("s"), (-k * (a_own - k)).alias("stay"))


def best_moves(scores: DataFrame, tie: str = "min") -> DataFrame:
    """(v, best_c, best_s, own_s) from move_scores(); the first two are null without another community.

    tie: ``min`` takes the smallest community of equal scores; ``lane`` the first in the order of an
    eight-lane reduction tree over the vertex's sorted communities.
    """
    if tie == "lane":
        rank = F.row_number().over(Window.partitionBy("v").orderBy("c")) - 1
        scores = scores.withColumn("rank", rank)
        lane = F.col("rank") % 8
        turned = (lane % 2) * 4 + F.floor(lane / 2) % 2 * 2 + F.floor(lane / 4)
        order = F.struct("s", (-turned).alias("t"), (-F.col("rank")).alias("r"))
    else:
        order = F.struct("s", (-F.col("c")).alias("t"))
    other = F.col("c") != F.col("own")
    return scores.groupBy("v").agg(
        F.max_by(F.when(other, F.col("c")), F.when(other, order)).alias("best_c"),
        F.max(F.when(other, F.col("s"))).alias("best_s"),
        F.coalesce(F.max(F.when(~other, F.col("s"))), F.max("stay")).alias("own_s"),
    )


def moves(edges: DataFrame, state: DataFrame, m2: int | float, batch: Column, tie: str = "min") -> DataFrame:
    """(v, c_new) of the vertices of the batch that move: those whose best score beats staying."""
    chosen = best_moves(move_scores(edges, state, m2, batch), tie)
    return chosen.where(F.col("best_s") > F.col("own_s")).select("v", F.col("best_c").alias("c_new"))


def weight_deltas(state: DataFrame, moved: DataFrame) -> DataFrame:
    """(c, delta): what the moves take from and give to the communities' weights."""
    changed = moved.join(state, "v")
    both = changed.select("c", (-F.col("k")).alias("d")).unionByName(changed.select(F.col("c_new").alias("c"), F.col("k").alias("d")))
    return both.groupBy("c").agg(F.sum("d").alias("delta"))


def apply_moves(state: DataFrame, moved: DataFrame) -> DataFrame:
    return state.join(moved, "v", "left").select("v", "k", F.coalesce("c_new", "c").alias("c"))


def superstep(edges: DataFrame, state: DataFrame, m2: int | float, batch: Column, tie: str = "min") -> DataFrame:
    """The state after all vertices of the batch have moved, each having seen the same state before."""
    return apply_moves(state, moves(edges, state, m2, batch, tie))


def modularity(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(q): one row; null if the graph has no weight."""
    near = edges.join(state.select(F.col("v").alias("src"), F.col("c").alias("c_src")), "src").join(state.select(F.col("v").alias("dst"), F.col("c").alias("c_dst")), "dst")
    inner = near.agg(F.coalesce(F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("w"))), F.lit(0)).alias("s_in"), F.coalesce(F.sum("w"), F.lit(0)).alias("m2"))
    exact = dict(state.dtypes)["k"] == "bigint"
    number = (lambda x: x.cast("decimal(38,0)")) if exact else (lambda x: x)
    squares = community_weights(state).agg(F.coalesce(F.sum(number(F.col("a")) * number(F.col("a"))), F.lit(0)).alias("s_sq"))
    three = inner.withColumn("s_sq", F.lit(None)).unionByName(squares.select(F.lit(None).alias("s_in"), F.lit(None).alias("m2"), "s_sq")).agg(*[F.max(c).alias(c) for c in ("s_in", "m2", "s_sq")])
    m2 = number(F.col("m2"))
    return three.select(F.try_divide((m2 * number(F.col("s_in")) - F.col("s_sq")).cast("double"), (m2 * m2).cast("double")).alias("q"))
