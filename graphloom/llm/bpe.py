"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over bytes cuts texts where the same passage is cut in every document.  Chunks are counted by their hashes over
the whole corpus; those whose repeats would cost most are encoded once for all documents and sent to all workers, as many as
SHARED tells.  Other chunks that the documents of a task share are encoded once in the task.  A cut may fall inside what the tokenizer treats as
one word, so every join is repaired: the stretch between the nearest places where no token can cross
is encoded again, and the chunks' own tokens must end exactly at its two ends; where they do not, the
whole stretch of text is encoded again.
"""

from __future__ import annotations

import json
import struct
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, through_arrow

#: The words that byte-level BPE with use_regex splits a text into.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of chunks and their ids that a worker remembers before it starts afresh.
REMEMBERED = 16 << 20
#: Most chunks of the corpus' dictionary, and most bytes of one of them: some 10 MB with their ids.
SHARED, SHARED_BYTES = 8_192, 4_096
#: A chunk has 2 ** CUT_BITS bytes on average, and LEAST at least.
CUT_BITS, LEAST = 9, 64
_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)
_GRAPH = np.zeros(256, bool)
_GRAPH[33:127] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True


class Tokenizer:
    """What a tokenizer file in the public JSON form says, as far as it is byte-level BPE without normaliser."""

    def __init__(self, source: str) -> None:
        import tiktoken

        spec = json.loads(source)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model["type"] != "BPE":
            raise ValueError("only byte-level BPE without normaliser or prefix space is supported")
        # The file writes bytes as printable characters: those that print stand for themselves, the others follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in k): v for k, v in model["vocab"].items() if k not in self.special}
        self.bytes = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for k, v in ranks.items():
            self.bytes[v] = k
        for k, v in self.special.items():
            self.bytes[v] = k.encode()
        self.encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.shared: dict[bytes, array] = {}
        self.seen: dict[bytes, array] = {}
        self.held = 0

    def plain(self, text: bytes) -> list[int]:
        return self.encoding.encode_ordinary(text.decode())

    def chunk(self, text: bytes) -> array:
        ids = self.shared.get(text)
        if ids is None:
            ids = self.seen.get(text)
        if ids is None:
            ids = array("I", self.plain(text))
            if self.held > REMEMBERED:
                self.seen.clear()
                self.held = 0
            self.seen[text] = ids
            self.held += 250 + len(text) + 4 * len(ids)
        return ids

    def trimmed(self, ids: array, head: int, tail: int) -> array | None:
        """ids without the tokens of the first head and last tail bytes; None if these are not whole tokens."""
        a, b = 0, len(ids)
        while head > 0 and a < b:
            head -= len(self.bytes[ids[a]])
            a += 1
        while tail > 0 and b > a:
            b -= 1
            tail -= len(self.bytes[ids[b]])
        return None if head or tail else ids[a:b]

    def encode_all(self, texts: list[bytes]) -> list[list[int]]:
        """The ids of each text, which holds no special token."""
        return [self._joined(text, ends, spans) if ends else self.chunk(text).tolist() if text else [] for text, (ends, spans) in zip(texts, cut_up(texts))]

    def _joined(self, text: bytes, ends: list[int], spans: list[list[int]]) -> list[int]:
        """Tokens of the chunks outside the spans, and of each span encoded again."""
        ids: list[int] = []
        k, a = 0, 0
        for b in [*ends, len(text)]:
            while k < len(spans) and spans[k][1] <= a:
                k += 1
            head, tail = 0, 0
            here = k
            if here < len(spans) and spans[here][0] < a:  # a span reaches in from the chunk before
                head = min(spans[here][1], b) - a
                here += 1 if spans[here][1] <= b else 0
            if a + head < b and here < len(spans) and spans[here][0] < b:
                tail = b - max(spans[here][0], a + head)
            if a + head < b - tail:
                own = self.trimmed(self.chunk(text[a:b]), head, tail)
                if own is None:
                    return self.plain(text)
                ids += own
            if here < len(spans) and a <= spans[here][0] < b:
                ids += self.plain(text[spans[here][0] : spans[here][1]])
            a = b
        return ids

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """As the library does without adding special tokens: their strings in a text become their ids."""
        if not any(s.encode() in t for s in self.special for t in texts):
            return self.encode_all(texts)
        return [self.encode_all([t])[0] if not any(s.encode() in t for s in self.special) else self.encoding.encode(t.decode(), allowed_special="all") for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def boundaries(raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts by a rolling hash of 32 bytes, and for each the nearest places at its left and right that no token crosses.

    begin: where each text starts, and the end; a byte stands between two texts.  Such a place stands
    before a blank and after a graphic character, or at an end of a text: tokens have blanks only in front.
    """
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):  # doubles the window of sum(gear[byte i back] << i)
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    cuts = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    cuts = cuts[cuts < len(raw)]
    cuts = cuts[(raw[cuts] & 0xC0) != 0x80]
    safe = np.zeros(len(raw) + 1, bool)
    safe[1:-1] = _GRAPH[raw[:-1]] & _BLANK[raw[1:]]
    safe[begin] = safe[begin[1:] - 1] = True
    safe = np.flatnonzero(safe)
    return cuts, safe[np.searchsorted(safe, cuts, "right") - 1], safe[np.minimum(np.searchsorted(safe, cuts, "left"), len(safe) - 1)]


def cut_up(texts: list[bytes]) -> Iterator[tuple[list[int], list[list[int]]]]:
    """For each text the ends of its chunks but the last, and the stretches around them that are encoded again."""
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    begin = [0, *accumulate(len(t) + 1 for t in texts)]
    cuts, left, right = boundaries(raw, np.array(begin))
    where = np.searchsorted(cuts, np.array(begin)).tolist()
    for i, text in enumerate(texts):
        start, size = begin[i], len(text)
        at = (cuts[where[i] : where[i + 1]] - start).tolist()
        last, ends, spans = 0, [], []
        for c, s, e in zip(at, (left[where[i] : where[i + 1]] - start).tolist(), (right[where[i] : where[i + 1]] - start).tolist()):
            if c - last < LEAST or size - c < LEAST:
                continue
            s, e = max(s, 0), min(e, size)
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([s, e])
            ends.append(c)
            last = c
        yield ends, spans


def chunks(texts: list[bytes]) -> Iterator[bytes]:
    for text, (ends, _) in zip(texts, cut_up(texts)):
        if text:
            yield from (text[a:b] for a, b in zip([0, *ends], [*ends, len(text)]))


@lru_cache(maxsize=2)
def _tokenizer(source: str) -> Tokenizer:
    return Tokenizer(source)


def vocabulary(df: DataFrame, path: str) -> Broadcast:
    """The tokenizer file at ``path`` on the driver, a few MB, for all executors."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def dictionary(df: DataFrame, tokenizer: Broadcast, *, text_col: str = "text", most: int = SHARED) -> Broadcast:
    """The chunks of the corpus whose repeats have most bytes, ``most`` at most, each encoded once: {chunk: ids} for all workers.

    Two passes: one counts hashes, the other fetches the chosen chunks.  Chunks that are not chosen are encoded where they stand.
    """
    texts = df.select(F.col(text_col).alias("text"))
    key = lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=2 << 20):
            seen: Counter[tuple[int, int]] = Counter((key(x), len(x)) for x in chunks(as_bytes(b.column("text"))) if len(x) <= SHARED_BYTES)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int64()), pa.array([n for _, n in seen], pa.int32()), pa.array(seen.values(), pa.int64())], ["h", "size", "n"])

    counted = texts.transform(through_arrow, count, "h long, size int, n long").groupBy("h", "size").agg(F.sum("n").alias("n")).where("n > 1")
    chosen = {r["h"] for r in counted.orderBy(F.desc((F.col("n") - 1) * F.col("size")), "h").limit(most).select("h").collect()}
    shared = df.sparkSession.sparkContext.broadcast(chosen)

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        left = set(known)
        for b in slices(batches, limit=2 << 20):
            if not left:
                continue
            held = {h: x for x in chunks(as_bytes(b.column("text"))) if (h := key(x)) in left}
            left -= held.keys()
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.binary())], ["h", "chunk"])

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer.value)
        for b in batches:
            held = b.column("chunk").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(_packed([tok.plain(x) for x in held]), pa.binary())], ["chunk", "ids"])

    if not chosen:
        return df.sparkSession.sparkContext.broadcast({})
    once = texts.transform(through_arrow, fetch, "h long, chunk binary").groupBy("h").agg(F.min("chunk").alias("chunk")).select("chunk")
    rows = once.transform(through_arrow, encoded, "chunk binary, ids binary").collect()  # ``most`` rows
    return df.sparkSession.sparkContext.broadcast({bytes(r["chunk"]): array("I", bytes(r["ids"])) for r in rows})


def _packed(ids: list[list[int]]) -> list[bytes]:
    return [struct.pack(f"<{len(x)}I", *x) for x in ids]


def encode(df: DataFrame, tokenizer: Broadcast, *, id_col: str = "doc_id", text_col: str = "text", shared: Broadcast | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit integers.

    Whole texts are encoded.  A null or empty text has no ids.  Repeated rows give repeated rows;
    other columns are ignored.  shared: from dictionary(), which makes it if there is none.
    """
    shared = shared or dictionary(df, tokenizer, text_col=text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer.value)
        tok.shared = shared.value
        for b in slices(batches, limit=2 << 20):
            raw = _packed(tok.encode(as_bytes(b.column("text"))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(through_arrow, run, "doc_id long, n_tokens long, ids binary")


def decode(df: DataFrame, tokenizer: Broadcast) -> DataFrame:
    """The rows of encode() with the decoded text, special tokens kept; bytes that are not UTF-8 become U+FFFD.

    Null ids have an empty text; repeated rows stay; ids beyond the vocabulary raise an error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer.value)
        for b in slices(batches, "ids", 8 << 20):
            texts = [tok.decode(np.frombuffer(x, "<u4")) for x in as_bytes(b.column("ids"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return df.transform(through_arrow, run, "doc_id long, n_tokens long, ids binary, text string")


def round_trip(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, text): each text encoded, and decoded again from its ids; nulls and repeated rows as in encode()."""
    tokenizer = vocabulary(df, path)
    shared = dictionary(df, tokenizer, text_col=text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer.value)
        tok.shared = shared.value
        for b in slices(batches, limit=2 << 20):
            raw = _packed(tok.encode(as_bytes(b.column("text"))))
            texts = [tok.decode(np.frombuffer(x, "<u4")) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(raw, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    # One pass, so that a task has one worker's vocabulary in memory.
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(through_arrow, run, "doc_id long, n_tokens long, ids binary, text string")
