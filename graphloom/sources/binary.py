"""The binary compressed-row format: vertex count, arc count, offsets, then (target, weight) records, all 8 bytes little-endian."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..lineage import written
from ..operators.ranking import prefix_sum

RECORD = np.dtype([("dst", "<i8"), ("w", "<f8")])


#: Offsets that are read at a time.
CHUNK = 1 << 18


class _Block(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    """Reads blocks of arcs, or of vertices: a block of arcs may begin and end within a vertex, so that hubs are cut as well.

    The path must be mounted at the same place on the driver and the executors.
    """

    def __init__(self, path: str, kind: str, block: int) -> None:
        self.path, self.kind, self.block = path.removeprefix("file://"), kind, block

    def _numbers(self, f, at: int, n: int) -> np.ndarray:
        f.seek(8 * at)
        return np.frombuffer(f.read(8 * n), "<i8")

    def partitions(self) -> list[_Block]:
        with open(self.path, "rb") as f:
            nv, ne = self._numbers(f, 0, 2).tolist()
        n = nv if self.kind == "vertices" else ne
        return [_Block(a, min(a + self.block, n)) for a in range(0, n, self.block)] or [_Block(0, 0)]

    def read(self, part: _Block) -> Iterator[pa.RecordBatch]:
        if self.kind == "vertices":
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.lo, part.hi))], ["v"])
            return
        if part.lo == part.hi:
            return
        with open(self.path, "rb") as f:
            nv = int(self._numbers(f, 0, 1)[0])
            first = int(self._numbers(f, 2, 1)[0])  # a slice of a larger file starts above zero
            lo, hi = 0, nv  # the last vertex that begins at or before the block's first arc
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if int(self._numbers(f, 2 + mid, 1)[0]) - first <= part.lo else (lo, mid)
            at = part.lo
            while at < part.hi:
                offsets = self._numbers(f, 2 + lo, min(CHUNK, nv - lo) + 1) - first
                end = min(part.hi, int(offsets[-1]), at + CHUNK)
                f.seek(8 * (3 + nv) + RECORD.itemsize * at)
                arcs = np.frombuffer(f.read(RECORD.itemsize * (end - at)), RECORD)
                if len(arcs) != end - at:
                    raise ValueError(f"{self.path} is cut short")
                src = lo + np.searchsorted(offsets, np.arange(at, end), "right") - 1
                if len(arcs):
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(arcs["dst"].astype(np.int64)), pa.array(arcs["w"].astype(np.float64))], ["src", "dst", "w"])
                lo = int(src[-1]) if len(src) and end < int(offsets[-1]) else lo + len(offsets) - 1
                at = end


class CsrSource(DataSource):
    """spark.read.format("csr_graph").option("kind", "edges" or "vertices").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "csr_graph"

    def schema(self) -> str:
        return "v bigint" if self.options.get("kind") == "vertices" else "src bigint, dst bigint, w double"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("kind", "edges"), int(self.options.get("block", 1 << 20)))


def read(spark: SparkSession, path: str, block: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a file; a missing one raises FileNotFoundError."""
    with open(path.removeprefix("file://"), "rb"):
        pass
    spark.dataSource.register(CsrSource)
    load = lambda kind: spark.read.format("csr_graph").option("kind", kind).option("block", str(block)).load(path)
    return load("vertices"), load("edges")


def write(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes one file; ids are 0 to n - 1.  Each task writes its vertices' offsets and its arcs to their places in the file.

    The path must be mounted at the same place on the driver and the executors.  A task that runs again writes the same bytes again.
    """
    path = path.removeprefix("file://")
    nv, ne = vertices.count(), edges.count()
    degree = vertices.join(edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("n")), "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n"))
    offsets = prefix_sum(degree, "v", "n", "begin")
    with open(path, "wb") as f:
        f.write(np.array([nv, ne], "<i8").tobytes())
        f.truncate(8 * (3 + nv) + RECORD.itemsize * ne)
        f.seek(8 * (2 + nv))
        f.write(np.array([ne], "<i8").tobytes())

    def put_offsets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "r+b") as f:
            for b in batches:
                v, begin = b.column("v").to_numpy(), b.column("begin").to_numpy().astype("<i8")
                cuts = np.flatnonzero(np.diff(v) != 1) + 1  # runs of consecutive vertices are written at once
                for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(v)]):
                    if z > a:
                        f.seek(8 * (2 + int(v[a])))
                        f.write(begin[a:z].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    offsets.select("v", "begin").sortWithinPartitions("v").mapInArrow(put_offsets, "n long").agg(F.sum("n")).collect()
    placed = written(edges.select("src", "dst", F.col("w").cast("double").alias("w")).orderBy("src", "dst", "w").withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())  # one row a task
    starts = dict(zip((p for p, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist()))

    def put_arcs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(path, "r+b") as f:
            f.seek(8 * (3 + nv) + RECORD.itemsize * starts[key[0].as_py()])
            for b in batches:
                out = np.empty(b.num_rows, RECORD)
                out["dst"], out["w"] = b.column("dst").to_numpy(), b.column("w").to_numpy()
                f.write(out.tobytes())
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    # The order within a part is that of the sort, whatever the shuffle does.
    ordered = placed.repartition("part").sortWithinPartitions("part", "src", "dst", "w")
    ordered.mapInArrow(_by_part(put_arcs), "n long").agg(F.sum("n")).collect()


def _by_part(put):
    """Calls put(part, batches) for each run of rows with one part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for b in batches:
                part = b.column("part").to_numpy()
                cuts = np.flatnonzero(np.diff(part)) + 1
                for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                    if z > a:
                        yield int(part[a]), b.slice(a, z - a)

        for part, group in groupby(pieces(), key=lambda x: x[0]):
            yield from put((pa.scalar(part),), (b for _, b in group))

    return run
