"""Benchmark decontamination by typed templates, so that re-parameterised questions are caught as well.

Words become their lower-case forms without punctuation and possessive endings, and numbers, names and
units become typed placeholders; a name or number of several words is one placeholder.  Names are given names,
and words that are capitalised but no function words.  As that says little of texts in lower case or in titles, every text
has a second view in which only given names are names.  Windows of template words are hashed; benchmark windows and
document windows meet in a hash join.  Where enough of an item's windows meet one place of a document,
slot consistency decides: one value of the text stands for each value of the item, and different ones for different ones.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, as_text, cut, slices, through_arrow

# Words that are numbers, units, given names, or capitalised only where a sentence starts.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split())
UNITS = frozenset("km kilometers kilometres miles mile meters metres cm centimeters mm inches feet yards kg kilograms grams mg pounds lbs ounces liters litres ml gallons hours hour minutes minute seconds days weeks months years mph kmh degrees celsius fahrenheit percent dollars cents euros usd eur gb mb kb".split())
NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark steven paul andrew kevin brian george edward ronald timothy jason jeffrey ryan jacob gary eric peter frank alex sam tom tim ben jack henry adam noah liam lucas "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley emily donna michelle carol amanda melissa deborah stephanie rebecca laura helen amy anna emma olivia sophia natalia julia alice kate jane maria carlos juan jose luis ana".split()
)
FUNCTION = frozenset(
    "a after all also an and are as at because before both but by can could did do does during each every find first for from had has have he her his how i if in into is it its last let many more most "
    "no not now of on one or our she should since so some suppose than that the their then there these they this those though to total under until was we were what when where which while who whose why will with would you your "
    "der die das ein eine und in den dem des mit von zu für auf ist im nicht wie was wenn el la los las un una de en que y del por con para se su como le les une et du des dans est pour par ce il elle au aux si".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?$")
_unit = "|".join(sorted(UNITS, key=len, reverse=True))
UNIT_WORD = re.compile(rf"(?:{_unit})(?:(?:/|-per-)(?:{_unit}|h|s|m|g|l))?$")
NUMBER_UNIT = re.compile(rf"[+-]?\d[\d.,]*-?(?:{_unit})(?:/(?:{_unit}|h|s))?$")
PUNCTUATION = ".,;:?!\"'()[]{}<>«»„“”‘’¡¿…*_-"
LITERAL, NUM, NAME, UNIT = range(4)
KNOWN = {**dict.fromkeys(NUMBER_WORDS, NUM), **dict.fromkeys(NAMES, NAME), **dict.fromkeys(UNITS, UNIT)}
_PLACE = [xxhash.xxh64_intdigest(f"{kind}", 42) & ~3 | kind for kind in range(4)]
REMEMBERED = 150_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Most bits of the filter that documents' windows pass before the join, 16 MB.
FILTER_BITS = 27
#: Keys that each window hash is dealt over, so that no common window is one task's alone.
SALTS = 16


def bare(word: str) -> str:
    """Without punctuation at its ends and a possessive ending; punctuation alone stays."""
    w = word.strip(PUNCTUATION) or word
    return w[:-2] if w[-1] in "sS" and len(w) > 2 and w[-2] in "'’" else w


def typed(word: str) -> tuple[int, int, str]:
    """The types of a word in the two views, and its template word."""
    w = bare(word)
    low = w.lower()
    if (kind := KNOWN.get(low)) is not None:
        return kind, kind, ""
    if not low.isalpha():
        if NUMBER.match(low) or NUMBER_UNIT.match(low) or ("-" in low and all(x in NUMBER_WORDS for x in low.split("-"))):
            return NUM, NUM, ""
        if UNIT_WORD.match(low):
            return UNIT, UNIT, ""
    if w != low and w[0].isupper() and len(w) > 1 and not w.isupper() and low not in FUNCTION:
        return NAME, LITERAL, low
    return LITERAL, LITERAL, low


class Words(dict):
    """From a word as written to its place in ``views``: for each view, 64 bits whose two lowest are the type."""

    def __init__(self) -> None:
        self.views = (array("Q"), array("Q"))

    def __missing__(self, word: str) -> int:
        shaped, plain, w = typed(word)
        h = xxhash.xxh64_intdigest(w, 42) & ~3 if plain == LITERAL else _PLACE[plain]
        self[word] = n = len(self.views[0])
        self.views[0].append(h if shaped == plain else _PLACE[shaped])
        self.views[1].append(h)
        return n

    def hashes(self) -> list[np.ndarray]:
        return [np.array(x, np.uint64) for x in self.views]

    def tidy(self) -> None:
        if len(self) >= REMEMBERED:
            self.clear()
            self.views = (array("Q"), array("Q"))


class Windows:
    """All windows with a literal word of both views: hash, text, view, and their template words as places of words of the text.

    A text of fewer template words is one window; a text without words has none.
    """

    def __init__(self, texts: list[str], memory: Words, words: int) -> None:
        memory.tidy()
        self.split = [t.split() for t in texts]
        n = np.fromiter(map(len, self.split), np.int64, len(self.split))
        flat = np.fromiter((v for s in self.split for v in map(memory.__getitem__, s)), np.int64, int(n.sum()))
        text = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        found = [self._view(v, h[flat], text, place, len(n), words) for v, h in enumerate(memory.hashes())]
        self.h, self.text, self.first, self.view, self.at = (np.concatenate(x) for x in zip(*found))
        self.found, self.words = found, words

    def _view(self, view: int, hashes: np.ndarray, text: np.ndarray, place: np.ndarray, texts: int, words: int):
        kind = (hashes & np.uint64(3)).astype(np.int8)
        # Runs: names and numbers of several words, and a unit after its number.
        joined = np.zeros(len(kind), bool)
        joined[1:] = (text[1:] == text[:-1]) & (((kind[1:] == kind[:-1]) & ((kind[1:] == NAME) | (kind[1:] == NUM))) | ((kind[1:] == UNIT) & (kind[:-1] == NUM)))
        head = np.flatnonzero(~joined)
        hashes, kind, text, place = hashes[head], kind[head], text[head], place[head]
        n = np.bincount(text, minlength=texts)
        self.heads = getattr(self, "heads", [])
        self.heads.append((place, kind, np.cumsum(n) - n, n))
        count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
        owner = np.repeat(np.arange(texts), count)
        first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = first + np.repeat(np.cumsum(n) - n, count)
        size = np.minimum(n, words)[owner]
        h = size.astype(np.uint64) + np.uint64(1000 * view)
        literal = np.zeros(len(at), bool)
        with np.errstate(over="ignore"):
            for k in range(words):
                on = k < size
                here = np.minimum(at + k, max(len(hashes) - 1, 0))
                h = np.where(on, (h + hashes[here]) * _STEP, h)
                h ^= h >> np.uint64(29)
                literal |= on & (kind[here] == LITERAL)
            h = h * _MIX
            h ^= h >> np.uint64(32)
        at, owner = at[literal], owner[literal]
        return h[literal], owner, place[at] if len(place) else at, np.full(len(at), view, np.int8), at

    def slots(self, i: int) -> list[str]:
        """Values, as written in lower case, of the placeholders of window i."""
        t, (place, kind, begin, n) = self.text[i], self.heads[self.view[i]]
        end, a = begin[t] + n[t], self.at[i]
        split, out = self.split[t], []
        for k in range(a, min(a + self.words, end)):
            if kind[k] != LITERAL:
                last = place[k + 1] if k + 1 < end else len(split)
                out.append(f"{kind[k]}{' '.join(map(bare, split[place[k] : last])).lower()}")
        return out


_SLOTS = pa.list_(pa.string())


def item_windows(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(h, item_id, view, ipos, islots, n_windows) of all windows of all items.  A null text has none.

    Rows with the same id are one item each, told apart by ``part``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Words()
        for b in slices(batches):
            w = Windows(as_text(b.column("text")), memory, words)
            n = np.zeros((len(w.split), 2), np.int32)
            np.add.at(n, (w.text, w.view), 1)
            take = pa.array(w.text)
            columns = [pa.array(w.h.view(np.int64)), b.column("item_id").take(take), b.column("ipart").take(take), pa.array(w.view), pa.array(w.first.astype(np.int32)), pa.array([w.slots(i) for i in range(len(w.h))], _SLOTS), pa.array(n[w.text, w.view])]
            yield pa.RecordBatch.from_arrays(columns, ["h", "item_id", "ipart", "view", "ipos", "islots", "n_windows"])

    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.xxhash64(text_col).alias("ipart"), F.col(text_col).alias("text")).where("item_id IS NOT NULL").dropDuplicates(["item_id", "ipart"])
    return rows.transform(through_arrow, run, "h long, item_id long, ipart long, view byte, ipos int, islots array<string>, n_windows int")


def _filter(items: DataFrame) -> tuple[bytes, int]:
    """A bitmap of the items' window hashes and the bits of its index; its size is bounded by FILTER_BITS."""
    n = items.select("h").distinct().count()
    bits = min(FILTER_BITS, max(16, int(n * 1024).bit_length()))
    shift = 64 - bits
    places = items.select(F.shiftrightunsigned("h", shift).alias("p")).distinct()
    words = places.groupBy(F.shiftright("p", 13).alias("page")).agg(F.collect_list((F.col("p") % 8192).cast("int")).alias("at"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in words.toLocalIterator():
        p = (r["page"] << 13) + np.array(r["at"])
        np.bitwise_or.at(out, p >> 3, (1 << (p & 7)).astype(np.uint8))
    return out.tobytes(), bits


def hits(docs: DataFrame, items: DataFrame, *, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, part, view, dpos, h, dslots): windows of documents whose hash is in the filter of the items' windows; part is a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(items))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Words()
        raw, bits = shared.value
        bitmap, shift = np.frombuffer(raw, np.uint8), np.uint64(64 - bits)
        for b in slices(batches, limit=SLICE_BYTES // 4):  # windows take many times the bytes of their texts
            w = Windows(as_text(b.column("text")), memory, words)
            p = w.h >> shift
            on = np.flatnonzero((bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1)
            take = pa.array(w.text[on])
            columns = [b.column("doc_id").take(take), b.column("part").take(take), pa.array(w.view[on]), pa.array(w.first[on].astype(np.int32)), pa.array(w.h[on].view(np.int64)), pa.array([w.slots(i) for i in on.tolist()], _SLOTS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "view", "dpos", "h", "dslots"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("part"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    return rows.transform(through_arrow, run, "doc_id long, part long, view byte, dpos int, h long, dslots array<string>")


def consistent(view: list[int], dpos: list[int], ipos: list[int], islots: list[list[str]], dslots: list[list[str]], sizes: dict[int, int]) -> tuple[float, bool, int]:
    """From the windows where an item meets a document: the share of a view's windows (sizes) that agree with one injective map of the item's values at one place; whether the values are equal; the number of values.

    A place is a run of shifts (position in the text less position in the item) with gaps of at most half the item's windows, as
    words that were put in or left out move a shift.  Pairs of values are taken by the number of windows that hold them.  Where other
    values stand for the item's, a window of the place, in either view, that contradicts the map makes it no copy; where the values are the item's own, it only does not count.
    """
    best, most = (0.0, False, 0), max(1, max(sizes.values()) // 2)
    order = sorted(range(len(dpos)), key=lambda i: dpos[i] - ipos[i])
    begin = 0
    for end in range(1, len(order) + 1):
        if end < len(order) and (dpos[order[end]] - ipos[order[end]]) - (dpos[order[end - 1]] - ipos[order[end - 1]]) <= most:
            continue
        place, begin = order[begin:end], end
        votes = Counter(pair for i in place for pair in set(zip(islots[i], dslots[i])))
        value: dict[str, str] = {}
        used: set[str] = set()
        for (a, b), _ in sorted(votes.items(), key=lambda x: (-x[1], x[0][0] != x[0][1], x[0])):
            if a not in value and b not in used:
                value[a] = b
                used.add(b)
        good = {(view[i], ipos[i]) for i in place if all(value.get(a) == b for a, b in zip(islots[i], dslots[i]))}
        told = {a for i in place if (view[i], ipos[i]) in good for a in islots[i] if a in value}
        same = all(value[a] == a for a in told)
        if same or good == {(view[i], ipos[i]) for i in place}:
            best = max(best, *((sum(v == x for v, _ in good) / n, same, len(told)) for x, n in sizes.items()))
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, coverage, kind, n_slots) for each document that holds an item.

    coverage: the share of the item's windows that one place of the document has with consistent
    slots, in the better of the two views; rows reach ``least``.  kind: ``exact`` if the text's values are the item's, else
    ``reparameterised``.  An item or text of fewer than ``words`` template words is one window of all its words, so that such an item is
    found only as a whole document.  Windows of placeholders alone say nothing and are left out on both sides.  Null ids and null or
    blank texts give no rows; rows with the same id are looked at one by one and give one row; other columns are ignored.
    """
    items = cut(item_windows(benchmark, item_col=item_col, text_col=item_text_col, words=words))
    found = hits(docs, items, id_col=id_col, text_col=text_col, words=words).distinct().withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(SALTS)).cast("int"))
    salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    group = ["doc_id", "part", "item_id", "ipart"]
    met = cut(found.join(salted.drop("view"), ["h", "salt"]).select(*group, "view", "dpos", "ipos", "islots", "dslots", "n_windows"))
    enough = met.groupBy(*group, "view", "n_windows").agg(F.countDistinct("ipos").alias("n")).where(F.col("n") >= F.lit(least) * F.col("n_windows")).select(*group).distinct()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        doc_id, _, item_id, _ = (k.as_py() for k in key)
        held = {c: table.column(c).to_pylist() for c in ("view", "dpos", "ipos", "islots", "dslots", "n_windows")}
        share, same, values = consistent(*(held[c] for c in ("view", "dpos", "ipos", "islots", "dslots")), dict(zip(held["view"], held["n_windows"])))
        return pa.table({"doc_id": pa.array([doc_id], pa.int64()), "item_id": pa.array([item_id], pa.int64()), "coverage": pa.array([share]), "same": pa.array([same]), "n_slots": pa.array([values], pa.int32())})

    checked = met.join(enough, group, "left_semi").groupBy(*group).applyInArrow(run, "doc_id long, item_id long, coverage double, same boolean, n_slots int").where(F.col("coverage") >= least)
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "same", "n_slots")).alias("b"))
    return best.select("doc_id", "item_id", "b.coverage", F.when(F.col("b.same"), "exact").otherwise("reparameterised").alias("kind"), "b.n_slots")


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no benchmark item; rows without id stay."""
    bad = contaminated(docs, benchmark, id_col=id_col, **options).select("doc_id").distinct()
    return docs.join(bad, docs[id_col] == bad["doc_id"], "left_anti")
