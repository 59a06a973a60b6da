import random

import numpy as np
import pytest
import xxhash

from graphloom.llm import simhash
from graphloom.llm.components import components
from graphloom.llm.xxh import xxh64_spans


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if h and 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, codes, radius):
    label = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, x in zip(ids, codes):
            for b, y in zip(ids, codes):
                if (x ^ y).bit_count() <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_spans_are_xxh64():
    buffer = bytes(random.Random(1).randrange(256) for _ in range(5000))
    start, size = np.arange(0, 4000, 13), np.arange(len(range(0, 4000, 13))) % 260
    assert xxh64_spans(buffer, start, size).tolist() == [xxhash.xxh64_intdigest(buffer[s : s + n], 42) for s, n in zip(start.tolist(), size.tolist())]


def texts():
    base = [words(n, n) for n in (1, 2, 3, 4, 5, 60, 300)] + [words(9000, 7)]
    near = [t.replace(" ", "  ", 3).upper() for t in base] + [base[6] + " zz", base[7] + " yy", base[7][4:]]
    return [*base, *near, None, "", " \n\t ", "ÉTÉ à la Plage ici encore", "été à la plage ici encore", base[6], base[6]]


def test_against_brute_force(spark):
    rows = [(i, t, 0, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, code int, component_id string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df, tile=4).collect()}
    codes = [brute_fingerprint(t) for _, t, *_ in rows]
    assert [got[i]["fingerprint"] for i, *_ in rows] == [f"{c:016x}" for c in codes]
    want = brute_components([r[0] for r in rows], codes, 4)
    assert {i: got[i]["component_id"] for i in want} == want
    blank = [i for i, t, *_ in rows if not (t or "").split()]
    assert len({got[i]["component_id"] for i in blank}) == 1 and got[blank[0]]["fingerprint"] == "0" * 16


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "a b c d e")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, None), (5, 5), (5, 5), (7, 5)]
    kept = simhash.keep_one(df).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 5]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def test_links_keep_the_components_of_a_large_group(spark):
    r = random.Random(3)
    center = r.getrandbits(64)
    codes = {center ^ sum(1 << k for k in r.sample(range(64), 2)) for _ in range(150)} | {r.getrandbits(64) for _ in range(100)}
    rows = [(c.to_bytes(8, "big"), c.bit_count(), i) for i, c in enumerate(sorted(codes))]
    edges = simhash.links(spark.createDataFrame(rows, "code binary, pop int, rep long"), radius=4, tile=16)
    assert edges.count() < 20 * len(rows)
    got = {x["node"]: x["component"] for x in components(edges).collect()}
    want = brute_components(range(len(rows)), sorted(codes), 4)
    assert {i: got.get(i, i) for i in range(len(rows))} == want


def test_hot_nodes_are_dealt_over_keys(spark):
    edges = [(0, i) for i in range(1, 60)] + [(59, 60), (60, 61), (100, 101), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in components(df, hot=5).collect()}
    assert got == {**dict.fromkeys(range(62), 0), 100: 100, 101: 100}


def test_few_stages_join_edges(spark):
    r = random.Random(5)
    chain = [(i, i + 1) for i in range(40)]
    others = [(100 + i, 100 + r.randrange(40)) for i in range(60)] + [(200 + i, 200) for i in range(1, 30)]
    for edges in ([(200 + i, 200) for i in range(1, 30)], chain + others):
        df = spark.createDataFrame(r.sample(edges, len(edges)), "u long, v long").localCheckpoint()
        want = {}
        nodes = sorted({x for e in edges for x in e})
        for x in nodes:
            reached, rest = {x}, edges
            while new := {b for e in rest for b in e if set(e) & reached} - reached:
                reached |= new
            want[x] = min(reached)
        spark.sparkContext.setJobGroup(group := f"components-{len(edges)}", group)
        got = components(df)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        tracker = spark.sparkContext.statusTracker()
        ran = sum(tracker.getStageInfo(s) is not None and tracker.getStageInfo(s).numCompletedTasks > 0 for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds)
        assert {x["node"]: x["component"] for x in got.collect()} == want
        assert ran <= (8 if edges[0] == (201, 200) else 60), ran


def test_keep_one_takes_near_copies_and_leaves_others(spark):
    base = [words(200, s) for s in range(12)]
    rows = [(i, t, "en") for i, t in enumerate(base)]
    rows += [(100 + i, t + " one more", "en") for i, t in enumerate(base)]  # nearly all shingles shared
    rows += [(200 + i, t[: len(t) // 3] + " " + words(150, 500 + i), "en") for i, t in enumerate(base)]  # few shared
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(12), *range(200, 212)]


def test_similarity_of_long_texts_is_exact(spark):
    rows, alike = [], {}
    for s in range(24):  # similarities of 0.806 and 0.785
        base, other = words(600, 1000 + s).split(), words(72, 2000 + s).split()
        near = base[: -64 if s % 2 else -72] + other[: 64 if s % 2 else 72]
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (base, near))
        alike[s] = len(a & b) / len(a | b)
        rows += [(s, " ".join(base)), (100 + s, " ".join(near))]
    assert sum(0.8 <= x < 0.81 for x in alike.values()) == sum(0.78 < x < 0.8 for x in alike.values()) == 12
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {s for s in alike if 100 + s not in kept} == {s for s, x in alike.items() if x >= 0.8}


def test_repeated_lines_leave_a_copy_near(spark):
    rows = []
    for s in range(4):  # repeated 20 and 80 times, the line turns most bits of a majority over occurrences
        base, line = words(300, 70 + s), words(10, 80 + s)
        rows += [(s, base), (10 + s, f"{base}\n" + f"{line}\n" * (20 if s % 2 else 80))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3]


def test_a_word_repeated_over_half_the_text_joins_nothing(spark):
    rows = [(s, "same " * 400 + words(300, 90 + s)) for s in range(2)] + [(2, "- " * 400 + words(300, 92)), (3, "- " * 400 + words(300, 92) + " end")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2]


def test_equal_codes_of_other_sets_are_compared():
    codes = np.zeros((3, 3), np.uint64)
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 5, 5000)]
    assert simhash.compare(codes, 3, 44, sets, 0.8).label.tolist() == [0, 0, 2]


def test_alike_sets_share_a_shingle_of_their_prefixes():
    r = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 9, 10, 37, 200):
        for _ in range(20):
            gone = n // 9 + int(r.integers(0, 2))
            x = np.unique(r.integers(0, 1 << 60, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[r.permutation(len(x))[: max(1, len(x) - gone)]], r.integers(0, 1 << 60, gone // 2, dtype=np.uint64)]))
            last = np.unique(np.concatenate([x[::2], y[::3]]))
            alike = len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8
            for late in (last, last[:0]):
                a, b = simhash.prefixes([x, y], 0.8, late)
                assert not alike or len(np.intersect1d(a, b))
    assert [len(p) for p in simhash.prefixes([np.arange(k, dtype=np.uint64) for k in (0, 1, 5, 10)], 0.8, np.zeros(0, np.uint64))] == [0, 1, 2, 3]


def test_only_texts_that_share_shingles_are_compared(spark):
    """Else comparisons grow with the square of the corpus."""
    sets = [np.unique(np.random.default_rng(s // 2).integers(-(1 << 60), 1 << 60, 40 + s % 2)) for s in range(60)]  # pairs share 40 of 41
    rows = [(s, x[:9].tolist()) for s, x in enumerate(sets)] + [(60, [])]
    got = simhash.meetings(spark.createDataFrame(rows, "rep long, prefix array<long>"), gathered=50).collect()
    assert len(got) == 60 and len({r["class"] for r in got}) == 30
    assert {tuple(sorted(r["rep"] for r in got if r["class"] == c)) for c in {r["class"] for r in got}} == {(s, s + 1) for s in range(0, 60, 2)}
