import corpus_pipeline
from graphloom.llm import decontaminate, pii, queries

SF = "/root/testdata/sf0.01"


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, seen = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert done.columns == first.columns
        done.write.parquet(f"{tmp_path}/{k}")
        seen.append((name, docs, spark.read.parquet(f"{tmp_path}/{k}")))
        docs = seen[-1][2]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    gone, kept = ids(a) - ids(b), ids(b)
    toxic = [i for i in ids(a) if labels.get(i) == 1]
    assert sum(labels.get(i) == 0 for i in gone) <= 3 and sum(i in gone for i in toxic) >= 0.6 * len(toxic)  # few labels at this size
    left = [set() for _ in range(2)]
    texts = {r["doc_id"]: r["text"].lower().split() for r in b.collect()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items()}
    alike = lambda x, y: len(shingles[x] & shingles[y]) / max(1, len(shingles[x] | shingles[y]))
    for i in ids(b) - ids(c):
        left[0].add(max(alike(i, j) for j in texts if j != i) >= 0.7)
    assert left[0] == {True}
    assert ids(c) - ids(d) == {r["doc_id"] for r in decontaminate.contaminated(c, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(d) == ids(e) == ids(f)
    before = [(r["doc_id"], c) for r in d.collect() for *_, c in pii.detect(r["text"])]
    after = {r["doc_id"]: r["text"] for r in e.collect()}
    assert before and not any(len(c) > 5 and c in after[i] for i, c in before)
    assert {r["doc_id"]: r["n_tokens"] for r in f.collect()} == {r["doc_id"]: r["n_tokens"] for r in queries.bpe.encode(e, queries.bpe.vocabulary(e, queries.tokenizer_path())).collect()}


def test_run_without_rows(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
