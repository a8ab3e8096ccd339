"""Encode-stage queries (E1-E6) on the prepared ``conversations`` stand-in.

The default offline tokenizer is one id per code point (EOS = U+0003, pad =
EOS), so every figure is checkable in SQL: sizes, masked counts and a hash of
the id / label sequences.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sql_py_strip
from ..functions.tokenize import CodePointTokenizer
from ..operators.encode import collate_batches, encode_records, encode_stats
from .sft_queries import _PAIRS_SQL, _unified

BATCH_SIZE = 4
MAX_LENGTH = 512  # low enough that some records are too long
N_SHARDS = 4
TOKENIZER = CodePointTokenizer()


def _ids_hash(col: str):
    return F.substring(F.sha2(F.array_join(F.col(col), ","), 256), 1, 16)


def _encoded(spark: SparkSession, sf_dir: str, keep_all: bool) -> DataFrame:
    """Records of index % 11 = 4 lose their completion, which the encoder must skip."""
    u = _unified(spark, sf_dir, keep_skipped=False)
    u = u.withColumn("completion", F.when(F.col("metadata.raw_index") % 11 == 4, "").otherwise(F.col("completion")))
    return encode_records(u, TOKENIZER, MAX_LENGTH, keep_all=keep_all)


def q_sft_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _encoded(spark, sf_dir, keep_all=False)
    return e.select(
        "id",
        F.size("input_ids").cast("bigint").alias("n_input"),
        F.size(F.filter("labels", lambda x: x == -100)).cast("bigint").alias("n_masked"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
        _ids_hash("input_ids").alias("ids_hash"),
        _ids_hash("labels").alias("labels_hash"),
    )


def q_sft_encode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_stats(_encoded(spark, sf_dir, keep_all=True))


def q_sft_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _encoded(spark, sf_dir, keep_all=False).withColumn(
        "raw_index", F.col("metadata.raw_index")).withColumn("shard", F.col("raw_index") % N_SHARDS)
    c = collate_batches(e, BATCH_SIZE, "raw_index", "shard", TOKENIZER.pad_or_eos)
    return c.select("id", "shard", "batch", F.col("padded_len").cast("bigint").alias("padded_len"),
                    F.col("n_pad").cast("bigint").alias("n_pad"),
                    _ids_hash("input_ids").alias("ids_hash"), _ids_hash("labels").alias("labels_hash"))


_ENC_SQL = "WITH " + _PAIRS_SQL.format(strip_u=sql_py_strip("user_text"),
                                       strip_a=sql_py_strip("assistant_text")) + f""",
unified AS (
  SELECT '{'convs'}_' || CAST(raw_index AS VARCHAR) AS id, raw_index,
    '### Problem:' || chr(10) || problem || chr(10) || chr(10) || '### Solution:' || chr(10) AS prompt,
    raw_index % 11 = 4 AS empty,
    CASE WHEN suffix(completion, chr(3)) THEN completion ELSE completion || chr(3) END AS comp
  FROM rec WHERE problem <> '' AND completion <> ''),
enc AS (
  SELECT id, raw_index, empty, length(prompt) AS np, length(prompt) + length(comp) AS n_input,
    list_transform(string_split(prompt || comp, ''), lambda ch: unicode(ch)) AS ids,
    list_concat(list_transform(range(length(prompt)), lambda i: -100),
                list_transform(string_split(comp, ''), lambda ch: unicode(ch))) AS labels
  FROM unified)
"""

SQL_SFT_ENCODE = _ENC_SQL + f"""
SELECT id, CAST(n_input AS BIGINT) AS n_input, CAST(np AS BIGINT) AS n_masked,
  CAST(n_input AS BIGINT) AS mask_sum,
  substr(sha256(array_to_string(ids, ',')), 1, 16) AS ids_hash,
  substr(sha256(array_to_string(labels, ',')), 1, 16) AS labels_hash
FROM enc WHERE NOT empty AND n_input <= {MAX_LENGTH}
"""

SQL_SFT_ENCODE_STATS = _ENC_SQL + f"""
SELECT CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE NOT empty AND n_input <= {MAX_LENGTH}) AS BIGINT) AS kept,
  CAST(count(*) FILTER (WHERE empty) AS BIGINT) AS skipped_empty,
  CAST(count(*) FILTER (WHERE NOT empty AND n_input > {MAX_LENGTH}) AS BIGINT) AS skipped_too_long
FROM enc
"""

SQL_SFT_COLLATE = _ENC_SQL + f""",
kept AS (SELECT *, raw_index % {N_SHARDS} AS shard FROM enc WHERE NOT empty AND n_input <= {MAX_LENGTH}),
b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY shard ORDER BY raw_index) - 1) / {BATCH_SIZE}) AS BIGINT) AS batch
      FROM kept),
p AS (SELECT *, max(n_input) OVER (PARTITION BY shard, batch) AS padded_len FROM b)
SELECT id, shard, batch, CAST(padded_len AS BIGINT) AS padded_len, CAST(padded_len - n_input AS BIGINT) AS n_pad,
  substr(sha256(array_to_string(list_concat(ids, list_transform(range(padded_len - n_input), lambda i: {TOKENIZER.pad_or_eos})), ',')), 1, 16) AS ids_hash,
  substr(sha256(array_to_string(list_concat(labels, list_transform(range(padded_len - n_input), lambda i: -100)), ',')), 1, 16) AS labels_hash
FROM p
"""

QUERIES = {"sft_encode": q_sft_encode, "sft_encode_stats": q_sft_encode_stats, "sft_collate": q_sft_collate}
ORACLES = {"sft_encode": SQL_SFT_ENCODE, "sft_encode_stats": SQL_SFT_ENCODE_STATS, "sft_collate": SQL_SFT_COLLATE}
