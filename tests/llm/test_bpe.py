import hashlib
import random
import struct

import numpy as np
import pytest

from graphloom.llm import bpe, queries

PIECES = [" ", "  ", "\n", "\n\n", "a", "it's", "'ll", "é", "中", "ñ1", "12", "\t", "!", "...", "\u00a0", "\u3000", "x" * 70, "word", "Word", "😀", "\r\n", "\x00"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def own():
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        return bpe.Tokenizer(f.read())


def made(n, pieces, seed):
    r = random.Random(seed)
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 2500))) for _ in range(n)]


def test_ids_are_the_librarys(own, library):
    texts = made(60, PIECES, 1) + ["", "y" * 3000, "é" * 2000, " " * 3000, "a b" * 2000]
    got = own.encode([t.encode() for t in texts])
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [own.decode(np.array(x, np.uint32)) for x in got] == [library.decode(x, skip_special_tokens=False) for x in got]


def test_special_tokens_in_texts(own, library):
    texts = made(20, [*PIECES, "<|endoftext|>"], 2)
    assert own.encode([t.encode() for t in texts]) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_shared_chunks_are_encoded_once(own):
    r = random.Random(4)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3000)).encode()
    own.seen.clear()
    own.encode([text])
    before = len(own.seen)
    own.encode([b"another start " + text, text])
    assert before > 20 and len(own.seen) <= before + 3


def test_chunks_of_the_corpus_are_shared(spark, library):
    r = random.Random(6)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    rows = [(i, f"{' '.join(str(r.random()) for _ in range(i))} {passage} end {i}") for i in range(12)] + [(20, None), (21, ""), (22, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    tokenizer = bpe.vocabulary(df, queries.tokenizer_path())
    shared = bpe.dictionary(df, tokenizer).value
    assert len(shared) > 15 and all(k.decode() in passage and list(v) == library.encode(k.decode(), add_special_tokens=False).ids for k, v in list(shared.items())[:30])
    assert len(bpe.dictionary(df, tokenizer, most=3).value) == 3 and not bpe.dictionary(df.where("doc_id = 22"), tokenizer).value
    got = {x["doc_id"]: list(struct.unpack(f"<{x['n_tokens']}I", x["ids"])) for x in bpe.encode(df, tokenizer).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert [x["text"] for x in bpe.decode(spark.createDataFrame([(1, 0, None)], "doc_id long, n_tokens long, ids binary"), tokenizer).collect()] == [""]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Tokenizer('{"pre_tokenizer": null, "normalizer": null, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}')


def test_round_trip(spark, library):
    rows = [(1, "Some words, 12 of them.", 0), (2, None, 0), (3, "", 0), (None, "x" * 200_000, 0), (1, "Some words, 12 of them.", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.round_trip(df, queries.tokenizer_path()).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((i or 0, t or "") for i, t, _ in rows)
    first = next(r for r in got if r["doc_id"] == 1)
    ids = library.encode(rows[0][1], add_special_tokens=False).ids
    assert bytes(first["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and first["n_tokens"] == len(ids)
    apart = bpe.decode(bpe.encode(df, v := bpe.vocabulary(df, queries.tokenizer_path())), v).collect()
    assert sorted(map(str, apart)) == sorted(map(str, got))
    assert bpe.round_trip(df.limit(0), queries.tokenizer_path()).count() == 0


def test_query_digests(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.op4_bpe(spark, d).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
