"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints come from one narrow pass.  Equal fingerprints collapse to one representative before
anything is compared (if sets are checked, equal fingerprints of equal sets).  Representatives are dealt into tiles by their population count; tile pairs
whose counts differ by more than the radius cannot hold a link and are never formed.  Each remaining
pair of tiles is compared exactly with exclusive-or and bit counts, and gives back a spanning forest
of its links, never all its pairs.

Links can be checked exactly: with ``similarity`` the fingerprints' links only bring candidates
together.  A second pass takes the shingle sets of the candidates alone, and pairs are compared by
these whole sets.  Fingerprints are then compared only where prefixes meet: in any one order of all shingles, two sets
that reach the similarity share one of the first few of each, so that no such pair is lost.  Shingles that many
texts have come last in that order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, give_back, slices, through_arrow
from .components import components
from .xxh import xxh64_spans

#: Most fingerprints in a tile; a pair of tiles is what one task holds (16 bytes each and up).  Tiles are smaller where there are cores for more, down to LEAST_TILE.
TILE, LEAST_TILE = 49_152, 2_048
#: Most bytes of shingle sets in a tile of candidates.
SET_BYTES = 16 << 20
#: Rows of a tile of those that share a shingle of their prefixes.
MEETING_TILE = 1_024
#: Rows that a task gathers by shingle, unless one shingle has more (16 bytes each).
GATHERED = 1_000_000
#: One text of so many tells which shingles are frequent, and so many at most are held to be; the order of shingles changes work, never results.
TOLD_BY, MOST_FREQUENT = 32, 200_000
#: Most candidates whose ids are sent to all workers; the texts of more are found by a join.
MOST_SENT = 1_000_000
GOLDEN = 0x9E3779B97F4A7C15
LANES = np.uint64(0x0101010101010101)


def _more(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64-bit hash derived from h (the finaliser of the public SplitMix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(GOLDEN * k & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, repeats included, and how many each text has."""
    split = [x.lower().split() for x in texts]  # both follow ASCII alone, as bytes do
    flat = [w for s in split for w in s]
    n = np.fromiter(map(len, split), np.int64, len(split))
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    start = np.cumsum(size + 1) - size - 1
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    first = np.repeat(np.cumsum(n) - n - (np.cumsum(count) - count), count) + np.arange(count.sum())
    last = first + np.repeat(np.minimum(n, words) - 1, count)
    return xxh64_spans(b" ".join(flat), start[first], start[last] + size[last] - start[first]), count


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text the 64 bits that are set in over half of its hashes; zero if it has none."""
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    n = count[full]
    parts = -(-n // 255)  # byte-wide counters hold 255
    begin = np.cumsum(n) - n
    base = np.cumsum(parts) - parts
    cuts = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(base, parts))
    ones = np.empty((len(full), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, cuts).view(np.uint8).reshape(-1, 8)
        ones[:, :, k] = np.add.reduceat(lanes, base, axis=0, dtype=np.int64)
    bits = (2 * ones.reshape(len(full), 64) > n[:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, width: int = 1, distinct: bool = False, shingles: bool = False, prefix: float | None = None, last: Broadcast | None = None) -> DataFrame:
    """(doc_id, code, pop[, key][, shingles][, prefix]): code is 8 * width bytes, most significant first; pop counts its set bits.

    The first 64 bits follow XXH64 with seed 42 over shingles of lower-cased words; further ones hash
    that hash again.  A null or blank text has code zero.  distinct: each shingle of a text counts once,
    so that near codes are near sets, and key is a 128-bit hash of the set.  shingles: the distinct hashes, ascending, 64 bits each.  prefix: with distinct, so many
    of them that two sets of this Jaccard similarity share one; those in last, ascending, come after all others.  A
    repeated row gives a repeated row; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, count = shingle_hashes(as_bytes(b.column("text")), words)
            if distinct or shingles:
                sets = [np.unique(h[e - n : e]) for e, n in zip(np.cumsum(count).tolist(), count.tolist())]
            if distinct:
                h, count = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))
            codes = np.stack([majority(_more(h, k) if k else h, count) for k in range(width)], axis=1)
            pop = np.bitwise_count(codes).sum(1, dtype=np.int32)
            raw = codes.astype(">u8").tobytes()
            columns = [b.column("doc_id"), pa.array([raw[i : i + 8 * width] for i in range(0, len(raw), 8 * width)], pa.binary()), pa.array(pop)]
            if distinct:
                columns.append(pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()))
            if shingles:
                columns.append(pa.array([x.tobytes() for x in sets], pa.binary()))
            if prefix is not None:
                heads = prefixes(sets, prefix, last.value if last else np.zeros(0, np.uint64))
                ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads).view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "code", "pop", *["key"] * distinct, *["shingles"] * shingles, *["prefix"] * (prefix is not None)]
    schema = "doc_id long, code binary, pop int" + ", key binary" * distinct + ", shingles binary" * shingles + ", prefix array<long>" * (prefix is not None)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(through_arrow, run, schema)


def prefixes(sets: list[np.ndarray], similarity: float, last: np.ndarray) -> list[np.ndarray]:
    """Of each ascending set as many elements as it can lack in a set that reaches the similarity, and one more; those in last come after all others."""
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    late = last[np.minimum(np.searchsorted(last, flat), len(last) - 1)] == flat if len(last) else np.zeros(len(flat), bool)
    out, end = [], 0
    for x in sets:
        end += len(x)
        some = late[end - len(x) : end]
        most = len(x) - int(np.ceil(similarity * len(x) - 1e-6)) + 1 if len(x) else 0
        out.append((np.concatenate([x[~some], x[some]]) if some.any() else x)[:most])
    return out


def frequent(texts: DataFrame, words: int, told_by: int = TOLD_BY) -> Broadcast:
    """Hashes of shingles that more than one of a few texts have, ascending; texts: (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, count = shingle_hashes(as_bytes(b.column("text")), words)
            for e, n in zip(np.cumsum(count).tolist(), count.tolist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[e - n : e]).view(np.int64))], ["s"])

    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(told_by)) == 0).transform(through_arrow, run, "s long")
    found = some.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).select("s").toArrow()
    return texts.sparkSession.sparkContext.broadcast(np.sort(found.column("s").to_numpy().view(np.uint64)))


class Forest:
    """Union-find over 0..n-1 whose labels stay flat, so that known links are skipped in numpy."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        a, b = label[a], label[b]
        new = a != b
        if not new.any():
            return
        pairs = np.unique(np.stack([np.minimum(a[new], b[new]), np.maximum(a[new], b[new])], 1), axis=0)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        for x, y in pairs.tolist():
            if (x := root(x)) != (y := root(y)):
                parent[max(x, y)] = min(x, y)
        to = np.arange(len(label))
        for x in parent:
            to[x] = root(x)
        self.label = to[label]


def reach(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether the Jaccard similarity of each pair of ascending sets reaches ``similarity``, by all their elements."""
    size = np.array([[len(x) for x in a], [len(x) for x in b]], np.int64).reshape(2, -1)
    ok = (size.min(0) > 0) & (size.min(0) / np.maximum(size.max(0), 1) >= similarity)
    for i in np.flatnonzero(ok).tolist():
        both = np.concatenate([a[i], b[i]])
        both.sort()
        shared = np.count_nonzero(both[1:] == both[:-1])
        ok[i] = shared / (len(both) - shared) >= similarity
    return ok


def compare(codes: np.ndarray, split: int, radius: int, sets: list[np.ndarray] | None = None, similarity: float = 0.0) -> Forest:
    """Links at radius or fewer differing bits between the first ``split`` codes and the rest, or, if there is no rest, within all.

    With sets, of these only those whose sets reach the similarity; nearest first, so that few pairs of one group are left to look at.
    """
    forest, n = Forest(len(codes)), len(codes)
    own = split == n
    left, right = np.ascontiguousarray(codes[:split].T), np.ascontiguousarray(codes[0 if own else split :].T)
    kind = np.uint8 if codes.shape[1] < 4 else np.uint16
    for i in range(0, split, 64):
        for j in range(i if own else 0, right.shape[1], 8192):
            d = np.bitwise_count(left[0, i : i + 64, None] ^ right[0, None, j : j + 8192]).astype(kind, copy=False)
            for w in range(1, len(left)):
                d += np.bitwise_count(left[w, i : i + 64, None] ^ right[w, None, j : j + 8192])
            near = d <= radius
            if near.any():
                a, b = np.nonzero(near)
                far = d[a, b]
                a, b = a + i, b + j + (0 if own else split)
                if sets is None:
                    forest.link(a, b)
                    continue
                order = np.argsort(far, kind="stable")
                a, b = a[order], b[order]
                while len(a):
                    apart = forest.label[a] != forest.label[b]
                    a, b = a[apart], b[apart]
                    ok = reach([sets[i] for i in a[:512]], [sets[i] for i in b[:512]], similarity)
                    forest.link(a[:512][ok], b[:512][ok])
                    a, b = a[512:], b[512:]
    return forest


def _tile_links(tiles: DataFrame, partners: Column, radius: int, similarity: float = 0.0) -> DataFrame:
    """Spanning edges over the pairs of tiles (me, rows) and (one of partners, rows); rows: (code, rep[, shingles])."""
    pairs = tiles.withColumn("other", F.explode(partners)).select(F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b"), "me", "rows")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, b = (k.as_py() for k in key)
        rows = table.column("rows").combine_chunks()
        held = {me: rows[i].values for i, me in enumerate(table.column("me").to_pylist())}
        out: tuple = ([], [])
        if a in held and b in held:
            parts = [held[a]] if a == b else [held[a], held[b]]
            field = lambda name: [x for p in parts for x in p.field(name).to_pylist()]
            rep = np.array(field("rep"), np.int64)
            codes = np.frombuffer(b"".join(field("code")), ">u8").astype(np.uint64).reshape(len(rep), -1)
            sets = [np.frombuffer(x, np.uint64) for x in field("shingles")] if similarity else None
            label = compare(codes, len(held[a]), radius, sets, similarity).label
            moved = np.flatnonzero(label != np.arange(len(label)))
            out = (rep[moved], rep[label[moved]])
            del parts, codes, sets
        del rows, held, table
        give_back()
        return pa.table({"u": pa.array(out[0], pa.int64()), "v": pa.array(out[1], pa.int64())})

    return pairs.groupBy("a", "b").applyInArrow(run, "u long, v long")


def links(codes: DataFrame, *, radius: int, tile: int = TILE) -> DataFrame:
    """Spanning edges (u, v) of rep over all pairs of (code, pop, rep) at radius or fewer differing bits.

    Codes are distinct and rep is a distinct long; joining the edges gives the same components as joining all links.
    """
    band = max(1, (radius + 1) // 2)  # of population counts
    codes = codes.withColumn("band", F.floor(F.col("pop") / band).cast("int"))
    counted = {r["band"]: r["count"] for r in codes.groupBy("band").count().collect()}  # at most 64 * width + 1 rows
    cores = codes.sparkSession.sparkContext.defaultParallelism
    tile = min(tile, max(LEAST_TILE, -(-sum(counted.values()) // (4 * cores))))
    if not counted:
        return codes.select(F.col("rep").alias("u"), F.col("rep").alias("v")).limit(0)
    far = (radius - 1) // band + 1  # the gap between bands that are d apart is band * (d - 1) + 1
    parts = F.array(*[F.lit(-(-counted.get(x, 0) // tile)) for x in range(max(counted) + far + 1)])
    name = lambda band, part: band.cast("long") * F.lit(1 << 32) + part
    tiles = (
        codes.withColumn("part", F.pmod(F.xxhash64("code"), F.greatest(parts[F.col("band")], F.lit(1))).cast("int"))
        .groupBy("band", "part")
        .agg(F.collect_list(F.struct("code", "rep")).alias("rows"))
        .withColumn("me", name(F.col("band"), F.col("part")))
    )
    bands = F.filter(F.sequence(F.greatest(F.col("band") - far, F.lit(0)), F.col("band") + far), lambda x: parts[x] > 0)
    partners = F.flatten(F.transform(bands, lambda x: F.transform(F.sequence(F.lit(0), parts[x] - 1), lambda k: name(x, k))))
    return _tile_links(tiles, partners, radius)


def _class_tiles(members: DataFrame, tile: int, *held: str) -> tuple[DataFrame, Column]:
    """Tiles of (class, code, rep, ...) and their partners, for pairs within a class: small classes share tiles; a large class has tiles of its own,
    so that no task holds more than a pair of tiles."""
    bytes_of = F.coalesce(F.sum(F.length("shingles").cast("long")), F.lit(0)) if "shingles" in held else F.lit(0)
    count = F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(bytes_of / SET_BYTES))
    sizes = members.groupBy("class").agg(count.cast("int").alias("parts"))
    shared = max(1, int(members.agg(count).first()[0]))
    placed = members.join(sizes, "class")
    group = F.when(F.col("parts") > 1, F.concat(F.lit("c"), F.col("class").cast("string"))).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("class"), F.lit(shared)).cast("string")))
    name = lambda part: F.concat("group", F.lit("/"), F.lpad(part.cast("string"), 9, "0"))
    tiles = (
        placed.withColumn("group", group)
        .withColumn("me", name(F.pmod(F.xxhash64("code", "rep"), F.col("parts"))))
        .groupBy("group", "parts", "me")
        .agg(F.collect_list(F.struct("code", "rep", *held)).alias("rows"))
    )
    return tiles, F.transform(F.sequence(F.lit(0), F.col("parts") - 1), name)


def checked_links(members: DataFrame, *, radius: int, similarity: float, tile: int = 2048) -> DataFrame:
    """As links(), of (class, code, rep, shingles), within a class only, and only pairs whose shingles reach the similarity."""
    return _tile_links(*_class_tiles(members, tile, "shingles"), radius, similarity)


def meetings(kinds: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """(class, rep) of (rep, prefix): those whose prefixes share a shingle are together in a class, but for classes of one.

    A class is named by a hash of its members, so that the many shingles that the same texts share give one class; what an equal name of others adds
    costs comparisons only.
    """
    rows = kinds.agg(F.coalesce(F.sum(F.size("prefix").cast("long")), F.lit(0))).first()[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("s").to_numpy(), b.column("rep").to_numpy()) for b in batches]
        if not held:
            return
        s, rep = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(s, kind="stable")
        s, rep = s[order], rep[order]
        del held, order
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))[: len(s)]
        name = np.bitwise_xor.reduceat(_more(rep.view(np.uint64), 1), first).view(np.int64) if len(s) else s
        count = np.diff(np.append(first, len(s)))
        often = np.repeat(count > 1, count)
        names, rep = np.repeat(name, count)[often], rep[often]
        order = np.lexsort((rep, names))
        names, rep = names[order], rep[order]
        new = np.concatenate([[True], (names[1:] != names[:-1]) | (rep[1:] != rep[:-1])])[: len(names)]
        names, rep = names[new], rep[new]
        for i in range(0, len(rep), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 65_536]), pa.array(rep[i : i + 65_536])], ["class", "rep"])

    cores = kinds.sparkSession.sparkContext.defaultParallelism
    each = kinds.select("rep", F.explode("prefix").alias("s")).repartition(max(cores, -(-rows // gathered)), "s")
    return each.transform(through_arrow, run, "class long, rep long").distinct()


def near_duplicates(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, width: int = 1, radius: int = 4, similarity: float | None = None, tile: int = TILE
) -> DataFrame:
    """One row per row of df: (doc_id, fingerprint, component_id).

    fingerprint: code in lower-case hexadecimal, of distinct shingles if ``similarity`` is given.  Documents link at ``radius`` or fewer differing bits
    and, if ``similarity`` is given, at that Jaccard similarity of their shingles or more; equal
    fingerprints, then those of equal sets of shingles, always do.  component_id: the least doc_id that links reach, a document alone has its
    own.  Texts without words share code zero and so one component.  A null doc_id takes no part in
    links and has a null component_id.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    last = None if similarity is None else frequent(texts, words)
    found = cut(fingerprints(texts, words=words, width=width, distinct=similarity is not None, prefix=similarity, last=last))
    kind = ["code"] if similarity is None else ["code", "key"]
    kinds = cut(found.where("doc_id IS NOT NULL").groupBy(*kind, "pop").agg(F.min("doc_id").alias("rep")))
    if similarity is None:
        joined = components(links(kinds, radius=radius, tile=tile))
    else:
        # Of repeated rows one prefix would do; a text's own ones are equal, and meet as one member.
        heads = found.where("doc_id IS NOT NULL").select("doc_id", *kind, "prefix").join(kinds.withColumnRenamed("rep", "doc_id").select("doc_id", *kind), ["doc_id", *kind])
        met = cut(meetings(heads.select(F.col("doc_id").alias("rep"), "prefix")))
        together = _class_tiles(cut(met.join(kinds.select("rep", "code"), "rep")), min(tile, MEETING_TILE))
        classes = components(_tile_links(*together, radius))
        near = cut(kinds.join(classes, kinds.rep == classes.node).select(*kind, "rep", F.col("component").alias("class")))
        ids = near.select("rep").distinct()
        texts = texts.join(F.broadcast(ids) if near.count() <= MOST_SENT else ids, F.col("doc_id") == F.col("rep"), "left_semi")
        sets = fingerprints(texts, words=words, width=width, distinct=True, shingles=True).groupBy(F.col("doc_id").alias("rep"), *kind).agg(F.min("shingles").alias("shingles"))
        members = cut(near.join(sets, ["rep", *kind]))
        joined = components(checked_links(members, radius=radius, similarity=similarity))
    class_of = kinds.join(joined, kinds.rep == joined.node, "left").select(*kind, F.coalesce("component", "rep").alias("component_id"))
    return found.join(class_of, kind, "left").select(
        "doc_id", F.lower(F.hex("code")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, width: int = 4, radius: int = 72, similarity: float | None = 0.8, tile: int = TILE) -> DataFrame:
    """The rows of df, all columns as they are, but of each component only that of the least id.

    Rows without id stay.  Of rows that repeat an id one stays.
    """
    classes = near_duplicates(df, id_col=id_col, text_col=text_col, words=words, width=width, radius=radius, similarity=similarity, tile=tile)
    classes = cut(classes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n")))
    gone = classes.where("doc_id <> c").select("doc_id")
    kept = df.join(gone, df[id_col] == gone["doc_id"], "left_anti")
    if classes.where("n > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))
