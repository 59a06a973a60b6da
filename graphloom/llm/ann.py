"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector, less the mean of all, is filled up with zeros to WIDEN times its length, rotated by one
fixed random orthogonal matrix and kept as its signs, packed into bits, with two correction scalars:
its length, and the inner product of its unit vector with its own code.  A query is rotated, quantised
to a few bits and split into bit planes; the inner product with a code is then a sum of bit counts.
Divided by the correction it estimates the true inner product without bias, and an error bound, which
falls with the root of the number of bits, says how far off it can be.  Only vectors whose upper bound
reaches the k-th best exact score of the likeliest ones are computed exactly, from the original components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, through_arrow

#: Rows of a block of candidates, and of a block of queries.
BLOCK, QUERIES = 16_384, 16_384
#: Bits of a code for each component of a vector.
WIDEN = 8
#: Standard deviations within which an estimate is taken to lie; recall is about the normal distribution's share below it.
EPSILON = 3.5
#: The estimates' best, so many times k, are computed exactly first and set the floor for the others.
FIRST = 3
#: Bits of a quantised query component.
PLANES = 4


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """dim rows of a random orthogonal matrix of WIDEN * dim columns, that depend on dim and seed alone."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((WIDEN * dim, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Of each row, without overflow of its squares."""
    scale = np.abs(vectors).max(1)
    scale[scale == 0] = 1
    return np.linalg.norm(vectors / scale[:, None], axis=1) * scale


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths and fits of vectors (rows) less the centre; fit: the unit vector's inner product with its code."""
    away = vectors - centre
    length = lengths(away)
    turned = (away / np.where(length > 0, length, 1)[:, None]) @ turn
    wide = np.zeros((len(turned), -(-turned.shape[1] // 64) * 64), np.uint8)
    wide[:, : turned.shape[1]] = turned > 0
    fit = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])  # a code's components are +-1 / sqrt(bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u8"), length, np.where(length > 0, fit, 1)


class Codes:
    """A block of packed codes, which estimates inner products with queries."""

    def __init__(self, bits: np.ndarray, length: np.ndarray, fit: np.ndarray, width: int) -> None:
        self.bits, self.length, self.fit, self.width = np.ascontiguousarray(bits.T), length, fit, width
        self.ones = np.bitwise_count(self.bits).sum(0, dtype=np.int64)
        #: For a unit query: deviation of the estimate, from the part of the vector that its code does not show.
        self.spread = np.sqrt(np.maximum(0, 1 - fit**2)) / fit / np.sqrt(max(width - 1, 1))

    def estimate(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of a rotated unit query with all vectors less the centre, and their error bounds."""
        low = float(query.min())
        step = (float(query.max()) - low) / (2**PLANES - 1) or 1.0
        level = np.rint((query - low) / step).astype(np.int64)
        planes = np.zeros((PLANES, len(self.bits) * 64), np.uint8)
        planes[:, : self.width] = (level >> np.arange(PLANES)[:, None]) & 1
        total = np.zeros(self.bits.shape[1], np.int64)
        for j, plane in enumerate(np.packbits(planes, axis=1, bitorder="little").view("<u8")):
            total += np.bitwise_count(self.bits & plane[:, None]).sum(0, dtype=np.int64) << j
        # sum of component * sign over the places: twice the sum over the set bits less the sum of all
        signed = 2 * (step * total + low * self.ones) - (step * level.sum() + low * self.width)
        value = signed / np.sqrt(self.width) / self.fit * self.length
        rounding = step / np.sqrt(12)  # deviation of a unit code with the query's quantisation
        return value, EPSILON * self.length * np.hypot(self.spread, rounding / self.fit)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last, as for any other rows."""
    return np.cumsum(vectors.astype(np.float64) * query, axis=1)[:, -1]


def block_top(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: Codes, centre: np.ndarray, own: int, query: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The places and scores of the block's k nearest by (score descending, id, row), row ``own`` left out, and how many were computed exactly."""
    norm = float(lengths(query[None])[0])
    value, bound = codes.estimate((query / norm) @ turn)
    value += float((query / norm) @ centre)
    other = rows != own
    value[~other] = bound[~other] = -np.inf
    first, m = np.flatnonzero(other), FIRST * k
    if len(value) > m:
        first = np.argpartition(value, len(value) - m)[len(value) - m :]
        first = first[other[first]]
    size = float(np.abs(centre).max(initial=0)) * len(query) + float(codes.length.max())
    slack = 1e-12 * norm * size * len(query)  # above what the order of a sum can change
    sure = vectors[first].astype(np.float64) @ query
    floor = np.partition(sure, len(sure) - k)[len(sure) - k] - slack if len(sure) > k else -np.inf
    near = np.flatnonzero(other & (value + bound >= floor / norm))  # estimates are for the unit query
    near = np.union1d(near, first)
    looked = len(near)
    if len(near) > k:
        fast = vectors[near].astype(np.float64) @ query
        near = near[fast >= np.partition(fast, len(fast) - k)[len(fast) - k] - slack]
    score = exact(vectors[near], query)
    order = np.lexsort((rows[near], ids[near], -score))[:k]
    return near[order], score[order], looked


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal lengths as rows."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _bytes(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the vectors of each length; zero where it is not finite.  A task sends one sum a length it has seen."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for dim, _, part in _by_dim(b):
                total = sums.setdefault(dim, [0, np.zeros(dim)])
                total[0] += len(part)
                total[1] += _matrix(part.column("vector")).sum(0, dtype=np.float64)
        rows = [(d, i, n, float(x)) for d, (n, s) in sums.items() for i, x in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.float64()))], ["dim", "place", "n", "total"])

    found = through_arrow(vectors, run, "dim int, place int, n long, total double").groupBy("dim", "place").agg((F.sum("total") / F.sum("n")).alias("mean")).collect()  # one row a component
    out: dict[int, np.ndarray] = {}
    for r in found:
        out.setdefault(r["dim"], np.zeros(r["dim"]))[r["place"]] = np.float32(r["mean"])
    return {d: x if np.isfinite(x).all() else np.zeros(d) for d, x in out.items()}


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    import pyarrow.compute as pc

    dims = np.asarray(pc.list_value_length(batch.column("vector")))
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, batch.take(pa.array(at))


def coded(df: DataFrame, *, id_col: str, vector_col: str, query: Column) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(row, id, q, dim, vector, bits, length, fit) of the usable rows, written once, and the centres; row tells repeated rows apart."""
    single = dict(df.dtypes)[vector_col] == "array<float>"
    kept = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("q"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    kept = kept.where(F.col("id").isNotNull() & usable(F.col("vector")))
    centre = centres(kept.select("vector"))
    shared = df.sparkSession.sparkContext.broadcast(centre)
    names = ["row", "id", "q", "dim", "vector", "bits", "length", "fit"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, part in _by_dim(b):
                if dim not in turns:
                    turns[dim] = rotation(dim)
                bits, length, fit = encode(_matrix(part.column("vector")).astype(np.float64), shared.value.get(dim, np.zeros(dim)), turns[dim])
                packed = pa.array([x.tobytes() for x in bits], pa.binary())
                columns = [part.column("row"), part.column("id"), part.column("q"), pa.array(np.full(len(part), dim, np.int32)), part.column("vector"), packed, pa.array(length), pa.array(fit)]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = "float" if single else "double"
    rows = kept.withColumn("row", F.monotonically_increasing_id())
    return cut(through_arrow(rows, run, f"row long, id long, q boolean, dim int, vector array<{kind}>, bits binary, length double, fit double")), centre


def search(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score, n_exact): each query row's k nearest other rows by inner product.

    query: which rows are queries.  Nearest first, ties to the smaller id; all candidates if there are
    fewer.  n_exact: how many rows were computed exactly for the query.  Rows whose vector is null, empty, zero or has null or non-finite components, or whose id is
    null, take no part; vectors of different lengths are not compared.  Rows that repeat an id are rows
    of their own, as candidates and as queries; other columns are ignored.  Codes are built once.  Blocks of queries meet blocks of
    candidates (codes, and the components that survivors are reranked by: a block of queries reaches nearly
    all of them); each pair gives at most k rows a query, and a window merges them.
    """
    spark = df.sparkSession
    rows, centre = coded(df, id_col=id_col, vector_col=vector_col, query=query)
    counts = {(r["dim"], r["q"]): r["count"] for r in rows.groupBy("dim", "q").count().collect()}  # two rows a vector length
    dims = {d for d, q in counts if q}
    schema = "query_id long, rank int, vec_id long, score double, n_exact long"
    if not dims:
        return spark.createDataFrame([], schema)
    cores = spark.sparkContext.defaultParallelism
    total = {d: counts.get((d, True), 0) + counts.get((d, False), 0) for d in dims}
    blocks = {d: (-(-counts[d, True] // QUERIES), max(-(-n // BLOCK), min(cores, -(-n // 4096)))) for d, n in total.items()}
    q_of, c_of = (F.create_map(*[F.lit(x) for d, n in blocks.items() for x in (d, n[i])]) for i in (0, 1))
    dim = F.col("dim")
    held = rows.where(dim.isin(*dims)).select("*", F.pmod(F.xxhash64("row"), c_of[dim]).cast("int").alias("c_own"), F.pmod(F.xxhash64("row", F.lit(1)), q_of[dim]).cast("int").alias("q_own"))
    # Blocks of bounded size are made once and copied to where they meet.
    queries = held.where("q").groupBy("dim", "q_own").agg(F.collect_list(F.struct("row", "id", "vector")).alias("queries")).withColumn("c_own", F.explode(F.sequence(F.lit(0), c_of[dim] - 1)))
    candidates = held.groupBy("dim", "c_own").agg(F.collect_list(F.struct("row", "id", "vector", "bits", "length", "fit")).alias("rows")).withColumn("q_own", F.explode(F.sequence(F.lit(0), q_of[dim] - 1)))
    met = queries.select("dim", "q_own", "c_own", "queries").unionByName(candidates.select("dim", "q_own", "c_own", "rows"), allowMissingColumns=True)
    shared = spark.sparkContext.broadcast(centre)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        parts = {name: next((x.values for x in table.column(name) if x.is_valid), None) for name in ("queries", "rows")}
        out: list[list] = [[] for _ in range(6)]
        if None not in parts.values():
            turn, mean = rotation(dim), shared.value.get(dim, np.zeros(dim))
            numbers = lambda part, name: part.field(name).to_numpy(zero_copy_only=False)
            q, c = parts["queries"], parts["rows"]
            at, ids, vectors = numbers(c, "row"), numbers(c, "id"), _matrix(c.field("vector"))
            codes = Codes(_bytes(c.field("bits"), "<u8"), numbers(c, "length"), numbers(c, "fit"), WIDEN * dim)
            for row, name, vector in zip(numbers(q, "row").tolist(), numbers(q, "id").tolist(), _matrix(q.field("vector")).astype(np.float64)):
                near, score, looked = block_top(at, ids, vectors, codes, mean, row, vector, turn, k)
                for column, x in zip(out, (np.full(len(near), row), np.full(len(near), name), ids[near], at[near], score, np.where(np.arange(len(near)) == 0, looked, 0))):
                    column.append(x)
        kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64()]
        return pa.table({n: pa.array(np.concatenate(x) if x else [], t) for n, x, t in zip(("query", "query_id", "vec_id", "row", "score", "looked"), out, kinds)})

    found = met.groupBy("dim", "q_own", "c_own").applyInArrow(run, "query long, query_id long, vec_id long, row long, score double, looked long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")).cast("int")
    ranked = found.withColumn("n_exact", F.sum("looked").over(Window.partitionBy("query"))).withColumn("rank", place)
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_exact")
