"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Toxic documents go, then all but one of each group of near copies, then documents that hold benchmark
items; personal data is replaced; what is left is encoded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lineage import shared_folder
from graphloom.llm import bpe, decontaminate, pii, simhash, toxicity
from graphloom.llm.common import table
from graphloom.llm.queries import PII_KEY, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model is fitted on labelled rows of the corpus as it came."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, fold=0)
    return toxicity.keep_clean(docs, model, most=0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its 5-word shingles."""
    return simhash.keep_one(docs, words=5, width=4, radius=72, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 0.8 of any benchmark item's 5-word template windows."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), words=5, least=0.8)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the new text."""
    done = pii.pseudonymise(docs, key=PII_KEY)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids little-endian, 32 bits each; the hash is of the text decoded from them."""
    done = bpe.round_trip(docs, tokenizer_path())
    return done.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", replace_private),
    ("bpe", encode),
]

#: No stage can be written in SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's output is a table in the cluster's shared folder."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
