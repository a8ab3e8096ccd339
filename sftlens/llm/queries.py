"""Registered queries of this package: each applies one operator, with production
parameters, to the whole of its table."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, exactdedup, fillmiddle, filteraudit, htmlextract, jaccard, langid, neardup, oracles, pii, substring, toxicity, urlfilter
from .common import table


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_windows(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85)


def op7_byte_bpe(spark: SparkSession, sf_dir: str, rank_path: str | None = None) -> DataFrame:
    with open(rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang") \
        .withColumn("held_out", langid.remainder("doc_id", 4) == 2)
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "langs", "shares")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = langid.remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, labels, ~held_out)
    return toxicity.scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fillmiddle.transform(table(spark, sf_dir, "documents"))
    return fillmiddle.restore(moved).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.deduplicate(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_neardup": op1_embedding_neardup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_html_text": op4_html_text,
    "op5_decontamination": op5_decontamination,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_exact_dedup": op13_exact_dedup,
}

# The others rest on a learnt model or a tokenizer, which SQL cannot express; tests/llm has brute force versions.
ORACLES: dict[str, str] = {
    "op1_embedding_neardup": oracles.OP1,
    "op2_substring_dedup": oracles.OP2,
    "op6_ngram_jaccard": oracles.OP6,
    "op11_filter_interactions": oracles.OP11,
    "op12_fill_in_middle": oracles.OP12,
    "op13_exact_dedup": oracles.OP13,
}
