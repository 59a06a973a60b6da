import itertools
import zlib

import numpy as np
import pandas as pd
import pytest

from graphloom.llm import crf, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def test_marginals_against_enumeration():
    r = np.random.default_rng(1)
    chain = crf.Chain(r.normal(size=(2, 2)), 0.3, -0.7)
    size = np.array([1, 5, 3])
    score = r.normal(size=9)
    got, at = chain.marginals(score, size), 0
    for n in size:
        total, one = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            s = sum(score[at + i] for i in range(n) if y[i]) + sum(chain.trans[a, b] for a, b in zip(y, y[1:])) + chain.first * y[0] + chain.last * y[-1]
            total += np.exp(s)
            one += np.exp(s) * np.array(y)
        assert np.allclose(got[at : at + n], one / total)
        at += n


def test_long_and_extreme_chains_stay_finite():
    p = crf.Chain(np.array([[3.0, -3.0], [-3.0, 3.0]])).marginals(np.tile([500.0, -500.0], 20_000), np.array([40_000]))
    assert np.isfinite(p).all() and ((p >= 0) & (p <= 1)).all()


def held(ids, folds, fold):
    return [zlib.crc32(str(i).encode()) % folds == fold for i in ids]


@pytest.mark.parametrize(("name", "label", "folds", "fold"), [("op8_quality", "quality", 4, 2), ("op10_toxicity", "toxic", 5, 0)])
def test_held_out_accuracy(spark, name, label, folds, fold):
    got = queries.QUERIES[name](spark, SF).select("doc_id", "held_out", "score", "predicted").toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").toPandas()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"]) and got["score"].between(0, 1).all()
    assert got["held_out"].tolist() == held(got["doc_id"], folds, fold)
    both = got[got["held_out"]].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert len(both) > 300
    rare = int(label == "toxic")  # the label that is hard to find
    hit = ((both["predicted"] == rare) & (both[label] == rare)).sum()
    assert hit / (both[label] == rare).sum() > 0.9 and hit / (both["predicted"] == rare).sum() > 0.95


def test_toxic_spans(spark):
    rows = pd.DataFrame([(f"plain words {i} go on here {i + 1} and some more", 0) for i in range(60)] + [(f"w{i} idiot{'!' * (i % 3)} v{i * 3} and so on u{i * 7}", 1) for i in range(60)], columns=["text", "label"])
    model = toxicity.fit(rows)
    df = spark.createDataFrame([(1, "Hello\nyou total IDIOT, really"), (2, None), (3, ""), (4, "plain words"), (4, "plain words"), (None, "idiot then " * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.tag(df, model).collect()}
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(16, 22)] and got[1]["score"] > 0.5
    assert all(got[i]["score"] < 0.5 and not got[i]["spans"] for i in (2, 3, 4)) and len(got[None]["spans"]) == 30_000
    kept = toxicity.keep_clean(df.selectExpr("text", "doc_id", "1 AS score"), model).collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 3, 4, 4]


def test_tags_are_no_lookup():
    """A token's probability depends on the tokens beside it, and forms that were never seen follow from their parts."""
    r = np.random.default_rng(0)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    rows = [(" ".join(word() for _ in range(12)), 0) for _ in range(300)]
    rows += [(" ".join([*(word() for _ in range(5)), "you", f"vilest{word()}", *(word() for _ in range(5))]), 1) for _ in range(80)]
    tagger = toxicity.Tagger(toxicity.fit(pd.DataFrame(rows, columns=["text", "label"])))
    p, _ = tagger.marginals(["abcde you vilestzzz abcde", "abcde fghab vilestzzz abcde", "abcde you abcde"])
    assert p[2] > p[6] > 0.5 and p[2] > 0.9 and p[8:].max() < 0.5
    s = toxicity._Sample([t for t, _ in rows], np.array([y for _, y in rows]))
    told = {s.names[i] for i in np.flatnonzero(s.telling_features(4, 0.1))}
    assert "^vilest" in told and all(f[1:].startswith("vil") or f == "=you" for f in told), told


def test_types_sum_the_weights_of_their_features():
    r = np.random.default_rng(3)
    tokens = [*"a The THE, (idiot) idiots! IDIOT ... -- naïve x1y2 Ünder été's 12".split(), "abcdefghij", "abcdefghik.", "abc", "abcd"]
    features = {f for t in tokens for part in toxicity.token_features(t) for f in part}
    weights = {f: tuple(r.normal(size=3).tolist()) for f in sorted(features) if r.random() < 0.7}
    types = toxicity.Types(weights)
    for t in [*tokens, "abcde", "idiotic", "Éa"]:
        want = np.sum([weights.get(f, (0, 0, 0)) for part in toxicity.token_features(t) for f in part], axis=0)
        n = types[t]
        assert np.allclose([x[n] for x in types.scores()], want), t


def test_copies_of_a_document_tell_nothing():
    rows = [(f"plain words {i} go on here {i + 1} and some more", 0) for i in range(60)] + [("the same strange text in all copies", 1)] * 40
    model = toxicity.fit(pd.DataFrame(rows, columns=["text", "label"]))
    assert not model.weights


def test_models_without_rows(spark):
    none = pd.DataFrame({"text": [], "label": []})
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert all(r["score"] == 0.5 for r in quality.classify(df, quality.fit(none)).collect())
    assert all(r["score"] < 0.5 for r in toxicity.tag(df, toxicity.fit(none)).collect())
    empty = spark.createDataFrame([], "doc_id long, toxic int, quality int, text string")
    assert quality.classify(empty, quality.train(empty, empty)).count() == 0
    assert toxicity.tag(empty, toxicity.train(empty, empty)).count() == 0


def test_line_features_and_lines(spark):
    x, size, per = quality.line_features(["one two two\n\nTHREE!!", ""])
    assert per.tolist() == [3, 1] and size.tolist() == [12, 1, 8, 1]
    assert x[0, 2] == pytest.approx(1 / 3) and x[1, 13] == 1 and x[2, 7] == 1
    good = [("Some words stand in this line, and more follow it.\nA second line is as good.", 1)] * 30
    bad = [("BUY!! NOW!! CHEAP!! BUY!! NOW!!\nCHEAP!! CHEAP!! BUY!!", 0)] * 30
    model = quality.fit(pd.DataFrame(good + bad, columns=["text", "label"]))
    df = spark.createDataFrame([(1, good[0][0]), (2, bad[0][0]), (3, "x" * 300_000), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.classify(df, model).collect()}
    assert got[1]["score"] > 0.7 > got[2]["score"] and got[2]["bad_lines"] == [0, 1] and got[1]["n_lines"] == 2
    mixed = f"{good[0][0]}\n{bad[0][0]}\n{good[0][0]}"
    assert quality.classify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()["bad_lines"] == [2, 3]


def test_characters_count_in_any_script():
    latin, cyrillic, han = "Plain words, some more.", "Обычн слова, ещё длинн.", "一些普通的文字，还有更多。"
    x, size, _ = quality.line_features([latin, cyrillic, han])
    assert size.tolist() == [len(t) + 1 for t in (latin, cyrillic, han)]
    assert np.allclose(x[0, [1, 6, 11]], x[1, [1, 6, 11]], atol=0.1) and x[2, 10] == 0
    assert quality.line_features(["\ud800 😀 𠀀", "a\u0301"])[0].shape == (2, quality.WIDTH)


def test_lines_of_the_other_label_turn():
    size, per = np.array([50, 50, 10] * 20 + [60, 50] * 20), np.array([3] * 20 + [2] * 20)
    x = np.array([[1.0], [1.0], [-1.0]] * 20 + [[-1.0], [-1.0]] * 20)
    y = quality.line_labels(x, size, per, np.array([1] * 20 + [0] * 20), np.ones(40), steps=100, sure=0.8)
    assert y.tolist() == [1, 1, 0] * 20 + [0, 0] * 20
    at, chains = quality.spliced(np.array([2, 3, 1]), np.array([1, 0, 1]))
    assert at.tolist() == [0, 2, 3, 4, 1, 5, 2, 3, 4] and chains.tolist() == [5, 4]
