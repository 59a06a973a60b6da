"""Graphs with whole-number weights from the relational tables: (vertices, edges)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of a block, and groups that a task looks at together, where ties are counted by products of blocks.
BLOCK, SLAB = 2_048, 2_048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w): one arc of weight 1 from the customer's nation to the supplier's, for each line item."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    buyers = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("src"))
    sellers = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("dst"))
    pairs = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    return pairs.select("src", "dst", F.lit(1).cast("bigint").alias("w"))


def nation_trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations tied by their trade, both ways."""
    pairs = trade_pairs(spark, sf_dir).groupBy("src", "dst").agg(F.sum("w").alias("w"))  # before the copy
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("v")), both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _shared(df: DataFrame, group: str, member: str) -> DataFrame:
    counted = df.groupBy(group, member).agg(F.count(F.lit(1)).alias("n"))
    left, right = counted.select(group, F.col(member).alias("src"), F.col("n").alias("a")), counted.select(group, F.col(member).alias("dst"), F.col("n").alias("b"))
    half = left.join(right, group).where("src < dst").groupBy("src", "dst").agg(F.sum(F.col("a") * F.col("b")).alias("w"))
    return half.select(F.inline(F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))))


def _shared_blocks(seen: DataFrame, members: int, block: int = BLOCK) -> DataFrame:
    """(src, dst, w) as _shared() of distinct (group, member), both longs without nulls, where nearly all pairs are tied: no pair is shuffled.

    Members are dealt to blocks; a pair of blocks meets in one task, which multiplies their 0-1 matrices and gives its ties both ways.
    """
    parts = max(1, -(-members // block))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        group, member = (table.column(c).to_numpy() for c in ("group", "member"))
        names, at = np.unique(member, return_inverse=True)
        order = np.argsort(group, kind="stable")
        columns = {"names": names, "at": at[order].astype("<i4"), "groups": group[order]}
        return pa.table({"me": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in columns.items()}})

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from ties([{k: np.frombuffer(x[k], d) for k, d in (("names", "<i8"), ("at", "<i4"), ("groups", "<i8"))} for x in b.column("rows")[i].as_py()])

    def ties(sides: list[dict]) -> Iterator[pa.RecordBatch]:
        left, right = sides[0], sides[-1]
        both = np.intersect1d(left["groups"], right["groups"])
        found = np.zeros((len(left["names"]), len(right["names"])), np.float32)  # whole numbers below 2 ** 24
        for k in range(0, len(both), SLAB):
            some, ones = both[k : k + SLAB], []
            for x in (left, right):
                a, z = np.searchsorted(x["groups"], some[0]), np.searchsorted(x["groups"], some[-1], side="right")
                where = np.searchsorted(some, x["groups"][a:z])
                known = some[where] == x["groups"][a:z]
                ones.append(np.zeros((len(x["names"]), len(some)), np.float32))
                ones[-1][x["at"][a:z][known], where[known]] = 1
            found += ones[0] @ ones[1].T
        if len(sides) == 1:
            np.fill_diagonal(found, 0)
        for k in range(0, len(found), 32):
            r, c = np.nonzero(found[k : k + 32])
            src, dst, w = left["names"][r + k], right["names"][c], found[k : k + 32][r, c].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (src, dst, w)], ["src", "dst", "w"])
            if len(sides) == 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (dst, src, w)], ["src", "dst", "w"])

    dealt = seen.withColumn("me", F.pmod(F.xxhash64("member"), F.lit(parts)).cast("int"))
    packed = dealt.groupBy("me").applyInArrow(pack, "me int, names binary, at binary, groups binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    pairs = packed.withColumn("other", other).select(F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b"), F.struct("names", "at", "groups").alias("x"))
    cores = seen.sparkSession.sparkContext.defaultParallelism
    met = pairs.repartition(max(cores, parts * (parts + 1) // 2), "a", "b").groupBy("a", "b").agg(F.collect_list("x").alias("rows"))
    return met.where((F.col("a") == F.col("b")) | (F.size("rows") == 2)).select("rows").mapInArrow(multiply, "src long, dst long, w long")


def part_co_order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts tied by the orders that hold both."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("v")), _shared(items, "l_orderkey", "l_partkey")


def supp_co_order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers tied by the orders that hold both."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("v")), _shared(items, "l_orderkey", "l_suppkey")


def users_by_hour(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users, and (group, member, n): the hours in which each was active, once."""
    seen = _table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").alias("hour")).distinct()
    told = seen.where("user_id IS NOT NULL AND hour IS NOT NULL").select(F.unix_micros("hour").alias("group"), F.col("user_id").cast("long").alias("member"), F.lit(1).cast("long").alias("n"))
    return seen.select(F.col("user_id").alias("v")).distinct(), told


def user_hour(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users tied by the hours in which both were active."""
    seen = _table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").alias("hour")).distinct()
    vertices = seen.select(F.col("user_id").alias("v")).distinct()
    told = seen.where("user_id IS NOT NULL AND hour IS NOT NULL").select(F.unix_micros("hour").alias("group"), F.col("user_id").cast("long").alias("member"))
    pairs = told.groupBy("group").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))).first()[0]
    members = told.select("member").distinct().count()
    if pairs <= members * members:  # most users share no hour
        return vertices, _shared(seen, "hour", "user_id")
    return vertices, _shared_blocks(told, members)
