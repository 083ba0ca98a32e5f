"""Bounded samples of labelled rows, as the classifiers learn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """(id, text, y): about `rows` labelled rows that `learn` admits, chosen by a hash of doc_id.

    The labels of the sample are joined by broadcast: their number is bounded by `rows`. A label that is
    null is no label; of several labels for one document the largest counts; of a doc_id that occurs more than once
    one row does (the one with the least text).
    """
    known = labels.where(F.col(label).isin(0, 1) & learn & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    chosen = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_000)) < int(share * 1_000_000) if share < 1 else F.lit(True)
    # the hash keeps about `rows` rows; the limit makes that bound hold for certain
    small = known.where(chosen).limit(rows + rows // 5).withColumnRenamed("doc_id", "label_id")
    joined = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(small), F.col("id") == F.col("label_id"))
    one = joined.groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").cast("int").alias("y"))
    return one.select("id", "text", "y")
