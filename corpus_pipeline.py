"""Corpus pipeline: the stages of one training-data job, each over all rows its predecessor kept.

1. language ID: documents without any letter go, and those of which no learnt language explains a quarter (if
   nothing could be learnt, all with a letter stay);
2. n-gram Jaccard join: of each group of near copies (five-word shingles, similarity 0.8) the document
   with the smallest id stays;
3. benchmark decontamination: documents that leak a benchmark item go;
4. PII: every span is replaced by its kind in brackets, and n_chars follows;
5. byte-level BPE: the token digests of what is left.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sftlens.llm import bpe, decontam, jaccard, langid, pii
from sftlens.llm.common import Scratch, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Column expressions on documents decide none of these stages, so no SQL gives run()'s rows.
ORACLE_SQL: str | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).select(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(RANKS, "rb") as f:
        return bpe.digests(docs, f.read(), public_tokenizers.PATTERN, memo=60_000)  # the join before it leaves little memory


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs, keep, last = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep.write(docs, str(i))
            if last is not None:
                keep.drop(last)
            last = str(i)
    return docs
