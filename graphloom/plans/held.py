"""The same phases over blocks of arcs, with the state of all vertices in every task.

For graphs whose vertices fit a task but whose arcs do not: a phase is one stage of tasks that run together.  Each keeps its share
of the arcs in blocks of whole vertices in a file of its own, scores its movers by the rules of small.py, and tells the others
moves and sums, so that all tasks carry the same state and no iteration waits for new jobs.
"""

from __future__ import annotations

import os
import secrets
import socket
import struct
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import closing

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import small

#: Arcs of a block, unless a vertex has more.
BLOCK = 1 << 19
#: Arcs that a task gathers before it deals them to blocks, and rows of a batch that it returns.
GATHERED = 1 << 20
#: Arcs below which one task is as good as more.
TASK = 1 << 16
#: What a row of the result tells.
ARC, STATE, LOOP, ENDS = range(4)


class Exchange:
    """What each task of a stage says to all, by way of the first one's socket: the barrier's own messages take a second each."""

    def __init__(self, context: BarrierTaskContext, secret: bytes) -> None:
        self.rank, infos = context.partitionId(), context.getTaskInfos()
        host = infos[0].address.rpartition(":")[0].strip("[]")
        self.peers: dict[int, socket.socket] = {}
        if self.rank == 0:
            with socket.create_server((host, 0), backlog=len(infos)) as server:
                context.allGather(str(server.getsockname()[1]))
                while len(self.peers) < len(infos) - 1:
                    peer, _ = server.accept()
                    try:
                        peer.settimeout(30)
                        hello = self._read(peer, len(secret) + 4)
                    except OSError:
                        hello = b""
                    if secrets.compare_digest(hello[:-4], secret):
                        peer.settimeout(None)
                        self.peers[struct.unpack("<i", hello[-4:])[0]] = peer
                    else:
                        peer.close()
        else:
            hub = socket.create_connection((host, int(context.allGather("")[0])))
            hub.sendall(secret + struct.pack("<i", self.rank))
            self.peers[0] = hub
        for x in self.peers.values():
            x.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _read(peer: socket.socket, size: int) -> bytes:
        parts = []
        while size:
            parts.append(peer.recv(min(size, 1 << 20)))
            if not parts[-1]:
                raise ConnectionError("another task of the phase has ended")
            size -= len(parts[-1])
        return b"".join(parts)

    def _hear(self, peer: socket.socket) -> bytes:
        return self._read(peer, struct.unpack("<q", self._read(peer, 8))[0])

    def gather(self, mine: bytes) -> list[bytes]:
        """What each task said, in the order of tasks."""
        if self.rank == 0:
            said = [mine, *(self._hear(self.peers[r]) for r in sorted(self.peers))]
            every = b"".join(struct.pack("<q", len(x)) + x for x in said)
            for x in self.peers.values():
                x.sendall(struct.pack("<q", len(every)) + every)
            return said
        self.peers[0].sendall(struct.pack("<q", len(mine)) + mine)
        every, said, at = self._hear(self.peers[0]), [], 0
        while at < len(every):
            size = struct.unpack_from("<q", every, at)[0]
            said.append(every[at + 8 : at + 8 + size])
            at += 8 + size
        return said

    def close(self) -> None:
        for x in self.peers.values():
            x.close()


def slots(spark: SparkSession) -> int:
    """Tasks that can run together now; none where executors come and go, as Spark has no barrier there."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    inner = sc._jsc.sc()
    return inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile())


def narrow(least, most, real: bool) -> str:
    """The smallest type of numpy that holds whole numbers between these."""
    if real:
        return "<f8"
    return next((x for x in ("<u1", "<u2", "<u4") if 0 <= least and most <= np.iinfo(x).max), "<i8")


def homes(count: np.ndarray, windows: list[list[tuple[int, int]]], tasks: int) -> tuple[np.ndarray, int]:
    """The block of each vertex, numbered batch * parts + part, and the parts of a batch, a multiple of the tasks; parts have like numbers of arcs."""
    most = max((sum(int(count[lo:hi].sum()) for lo, hi in ranges) for ranges in windows), default=0)
    parts, at = tasks * max(1, -(-most // (tasks * BLOCK))), np.zeros(len(count), np.int32)
    for b, ranges in enumerate(windows):
        v = np.concatenate([np.arange(lo, hi) for lo, hi in ranges])
        before = np.cumsum(count[v]) - count[v]
        at[v] = b * parts + before * parts // max(1, int(count[v].sum()))
    return at, parts


def told(kind: int, a: np.ndarray, b: np.ndarray, w=None, q=None, gain=None, real: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of a phase's result."""
    for i in range(0, len(a), GATHERED):
        some = slice(i, i + GATHERED)
        size = len(a[some])
        column = lambda x, type: pa.nulls(size, type) if x is None else pa.array(x[some], type)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, kind), pa.int32()), pa.array(a[some], pa.int64()), pa.array(b[some], pa.int64()), column(w, pa.float64() if real else pa.int64()), column(q, pa.float64()), column(gain, pa.float64())],
            ["kind", "a", "b", "w", "q", "gain"],
        )


def phase(edges: DataFrame, windows: list[list[tuple[int, int]]], count: np.ndarray, k: np.ndarray, c: np.ndarray, weights: tuple, tasks: int, *, tol: float, max_iter: int, tie: str) -> DataFrame:
    """As small.phase, in rows (kind, a, b, w, q, gain): arcs between the last communities, numbered from 0, of each block; (v, c); (loop, q, gain); q before and after.

    count, k: arcs and weighted degree of each vertex; weights: the least and the largest.
    """
    spark, n, batches = edges.sparkSession, len(k), len(windows)
    real = k.dtype.kind == "f"
    number, whole = (float, "<f8") if real else (int, "<i8")
    name, weight = narrow(0, n, False), narrow(*weights, real)
    m2 = k.sum()
    at, parts = homes(count, windows, tasks)
    sent, secret = spark.sparkContext.broadcast((at, k, c)), secrets.token_bytes(32)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= GATHERED:
                yield from split(held)
                held, n = [], 0
        yield from split(held)

    def split(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(b.num_rows for b in held):
            return
        src, dst, w = (np.concatenate([b.column(x).to_numpy() for b in held]) for x in ("src", "dst", "w"))
        home = sent.value[0][src]
        order = np.argsort(home.astype("<u2") if home.max() < 1 << 16 else home, kind="stable")
        home = home[order]
        edge = [*np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])).tolist(), len(home)]
        columns = [src[order].astype(name), dst[order].astype(name), w[order].astype(weight)]
        for i in range(0, len(edge) - 1, 64):
            cut = list(zip(edge[i : i + 64], edge[i + 1 : i + 65]))
            first = home[[a for a, _ in cut]]
            packed = [pa.array([x[a:z].tobytes() for a, z in cut], pa.binary()) for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(first % parts % tasks), pa.array(first), *packed], ["task", "at", "src", "dst", "w"])

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value[2].astype(np.int64)
        with tempfile.TemporaryFile() as file, closing(Exchange(BarrierTaskContext.get(), secret)) as others:
            gather = lambda x: others.gather(x.tobytes())
            blocks = [[] for _ in range(batches)]
            for b, block in stored(rows, file):
                blocks[b].append(block)
            file.flush()
            every = [x for own in blocks for x in own]

            def modularity() -> float:
                inner = sum(number(w[np.repeat(c[v], m) == c[dst]].sum()) for v, m, _, dst, w in map(lambda x: read(file, x), every))
                s_in = sum(number(np.frombuffer(x, whole)[0]) for x in gather(np.array([inner], whole)))
                a = small.sizes(c, k, n)
                squares = sum(x * x for x in a.tolist() if x) if real else int(np.dot(a, a))
                return float(number(m2) * s_in - squares) / float(number(m2) * number(m2))

            k = sent.value[1]
            q = before = modularity()
            history: list[tuple] = []
            gain = np.inf
            while gain > tol and len(history) < max_iter:
                old = c
                for own in blocks:
                    a, (labels, dense) = small.sizes(c, k, n), small.numbered(c, n)
                    moved = [np.zeros((2, 0), "<i4")]
                    for v, m, loops, dst, w in map(lambda x: read(file, x), own):
                        row, com, e = small.ties(np.repeat(np.arange(len(v)), m), dense[dst], without(w, loops), len(v), len(labels))
                        moved.append(np.stack(small.choose(v[row], labels[com], e, k, a, c, m2, tie)).astype("<i4"))
                    c = c.copy()
                    for x in gather(np.concatenate(moved, axis=1)):
                        to = np.frombuffer(x, "<i4").reshape(2, -1)
                        c[to[0]] = to[1]
                now = modularity()
                gain = now - q
                history.append((len(history) + 1, now, gain))
                if gain < 0:
                    c = old
                else:
                    q = now
            labels, dense = small.numbered(c, n)
            for v, m, _, dst, w in map(lambda x: read(file, x), every):
                to = dense[v]
                some = np.unique(to)  # in order, so that a block of few communities has few keys
                src, dst, e = small.ties(np.repeat(np.searchsorted(some, to), m), dense[dst], without(w, ()), len(some), len(labels))
                yield from told(ARC, some[src], dst, e, real=real)
        if others.rank == 0:
            yield from told(STATE, np.arange(n), c, real=real)
            yield from told(LOOP, *(np.array([h[0] for h in history], np.int64),) * 2, q=[h[1] for h in history], gain=[h[2] for h in history], real=real)
            yield from told(ENDS, np.zeros(1, np.int64), np.zeros(1, np.int64), q=[before], gain=[q], real=real)

    def stored(rows: Iterable[pa.RecordBatch], file) -> Iterator[tuple[int, tuple]]:
        """Each block, written, with its batch: (offset, vertices, arcs of each, places of loops); rows lie in the order of blocks."""
        pieces, last, offset = [], None, 0

        def store() -> tuple[int, tuple]:
            nonlocal offset
            src, dst, w = (np.frombuffer(b"".join(p[i] for p in pieces), d) for i, d in enumerate((name, name, weight)))
            order = np.argsort(src, kind="stable")
            src, dst, w = src[order], dst[order], w[order]
            v, m = np.unique(src, return_counts=True)
            file.write(dst.tobytes())
            file.write(w.tobytes())
            found = offset, v.astype(np.int64), m, np.flatnonzero(src == dst)
            offset += dst.nbytes + w.nbytes
            return last // parts, found

        for b in rows:
            for i in range(b.num_rows):
                home = b.column("at")[i].as_py()
                if pieces and home != last:
                    yield store()
                    pieces = []
                last = home
                pieces.append([b.column(x)[i].as_py() for x in ("src", "dst", "w")])
        if pieces:
            yield store()

    def read(file, block: tuple) -> tuple:
        offset, v, m, loops = block
        arcs, size = int(m.sum()), np.dtype(name).itemsize
        dst, w = (np.frombuffer(os.pread(file.fileno(), length, start), d) for start, length, d in ((offset, arcs * size, name), (offset + arcs * size, arcs * np.dtype(weight).itemsize, weight)))
        return v, m, loops, dst, w if real else w.astype(np.int64)

    def without(w: np.ndarray, loops) -> np.ndarray:
        if len(loops):
            w = w.copy()
            w[loops] = 0
        return w

    dealt = edges.select("src", "dst", "w").mapInArrow(deal, "task int, at int, src binary, dst binary, w binary")
    mine = dealt.repartitionById(tasks, F.col("task")).sortWithinPartitions("at").select("at", "src", "dst", "w")
    return mine.mapInArrow(run, f"kind int, a long, b long, w {'double' if real else 'long'}, q double, gain double", barrier=True)
