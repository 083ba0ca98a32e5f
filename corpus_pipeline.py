"""Corpus pipeline: quality, near duplicates, repeated passages, mixing, tokens.

STAGES lists (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs; all but the last return the columns of documents. A
stage works on all that the one before it kept. Null and empty texts pass the first stage only if the
classifier lets them, are near nothing, hold no passages and no tokens. A very long text is handled as one row like
others. Of equal candidates the smallest doc_id stays; rows that share a doc_id are told apart by their texts, and equal rows of
one doc_id are one. Rows without a doc_id are neither near duplicates nor sources of passages. Other columns, whatever
their names, pass through the stages unchanged. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidspark.llm.bpe import bpe_digests
from bidspark.llm.common import cut, fold, table
from bidspark.llm.minhash import drop_near_duplicates
from bidspark.llm.mixing import mix_rows
from bidspark.llm.quality import keep_quality, train_quality
from bidspark.llm.queries import tokenizer_path
from bidspark.llm.substrings import substring_dedup

LEAST_QUALITY, NEAR, SHARE, SEED = 0.5, 0.8, 0.8, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that op7 learns from."""
    model = train_quality(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return keep_quality(docs, model, LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id."""
    return drop_near_duplicates(docs, NEAR)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of earlier documents; texts that hold none stay as they are."""
    cleaned = substring_dedup(docs)
    kept, _, removed = (F.col(f"`{c}`") for c in cleaned.columns[-3:])
    text = F.when(removed > 0, kept).otherwise(F.col("text"))
    chars = {"n_chars": F.when(removed > 0, F.length(kept).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return cleaned.withColumns({"text": text, **chars}).select([F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a mix by target weights with SHARE of all tokens, each at most once."""
    return mix_rows(docs, F.floor(F.col("total") * SHARE), seed=SEED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's token ids and of what they decode to."""
    return bpe_digests(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passages", passages), ("mixing", mixing), ("tokens", tokens)]

#: SQL can't express the classifier, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
