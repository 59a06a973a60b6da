"""Text formats: Matrix Market, tab-separated edges, and one community a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_mtx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a coordinate file; ids from 0, weight 1 in a pattern, a symmetric matrix expanded to both arcs."""
    lines = spark.read.text(path)
    banner = lines.where(F.col("value").startswith("%%MatrixMarket")).first()
    symmetric = banner is not None and "symmetric" in banner[0].lower()
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    # The first line of the body of the first file has the counts.
    placed = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    first = placed.agg(F.min("file")).first()[0]
    size = placed.where((F.col("file") == first) & (F.col("start") == 0) & ~F.col("value").startswith("%") & (F.trim("value") != "")).first()[0].split()
    part = F.split(F.trim("value"), r"\s+")
    entries = body.where(F.trim("value") != " ".join(size)) if len(size) == 3 else body
    same = body.count() - entries.count()
    if same > 1:  # an entry that reads like the counts
        again = spark.range(same - 1).select(F.lit(" ".join(size)).alias("value"))
        entries = entries.unionByName(again)
    edges = entries.select((part[0].cast("bigint") - 1).alias("src"), (part[1].cast("bigint") - 1).alias("dst"), F.coalesce(F.get(part, 2).cast("double"), F.lit(1.0)).alias("w"))
    if symmetric:
        edges = edges.unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return spark.range(max(int(size[0]), int(size[1]))).select(F.col("id").alias("v")), edges


def write_mtx(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A general coordinate file with every arc; its first part is the head."""
    spark = edges.sparkSession
    n, ne = vertices.count(), edges.count()
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, f"{n} {n} {ne}")], "o bigint, value string")
    rows = edges.select(F.lit(2).cast("bigint").alias("o"), F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, "w").alias("value"))
    head.coalesce(1).sortWithinPartitions("o").unionByName(rows).select("value").write.mode("overwrite").text(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src bigint, dst bigint, w double").csv(path, sep="\t")


def write_tsv(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst", F.col("w").cast("double")).write.mode("overwrite").csv(path, sep="\t")


def write_communities(communities: DataFrame, path: str) -> None:
    """Line i is vertex i's community; parts follow each other in that order."""
    communities.orderBy("v").select(F.col("community").cast("string")).write.mode("overwrite").text(path)


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """(v, community) of write_communities(): a line's place in its block of a file, after the lines of the blocks before."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    block = Window.partitionBy("file", "start")
    placed = lines.withColumn("at", F.monotonically_increasing_id()).withColumn("i", F.row_number().over(block.orderBy("at")) - 1)
    sizes = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a block
    numbered = placed.where("value <> ''").join(sizes.withColumn("before", before), ["file", "start"])
    return numbered.select((F.col("before") + F.col("i")).alias("v"), F.col("value").cast("bigint").alias("community"))
