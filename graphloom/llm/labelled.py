"""Bounded samples of labelled documents for fitting a model on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id's text leaves ``fold`` on division by ``folds``; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, folds: int, fold: int, per_class: tuple[int, int]) -> pd.DataFrame:
    """(text, label) of at most per_class[label] documents of the labels 0 and 1, outside the held-out fold.

    Chosen by a hash of the id, so that the choice neither depends on the order of rows nor on their
    number; whole texts, whatever their length.  An id with rows of both labels is passed over, and so are a null id and a null or empty text.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).where(~held_out(F.col(id_col), folds, fold))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"), (F.max(label_col) == F.min(label_col)).alias("one")).where("one")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.char_length("text") > 0)
    usable = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = [usable.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "label").limit(per_class[y]) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])  # sum(per_class) rows at most, so it can be broadcast
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows.toPandas().sort_values(["doc_id"]).reset_index(drop=True)
