"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..lineage import cut  # noqa: F401  (for the operators)

#: Bytes of text that a Python worker holds at a time, besides the Arrow batch itself.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and its Python workers.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def through_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches that few long texts cannot make large."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def whole(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Returns freed memory to the machine, as workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with this C library
        pass


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that a slice holds about ``limit`` bytes of text, or one longer row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
