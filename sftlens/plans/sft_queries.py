"""Prepare-stage queries (P1-P6, L1, A14) over ``conversations`` / ``documents``.

Stand-in for a raw SFT JSONL file: every user turn followed by an assistant
turn becomes one raw JSON line (built by Spark from the table, so it grows
with it).  The problem sits under one of the six problem field names and
the completion under one of the six completion names, chosen by
``(conv_id + turn) % 6`` and ``(conv_id + 3*turn + 1) % 6``; every
higher-priority name carries a falsy decoy (``"" 0 null [] {} false``) that
must fall through.  When ``(conv_id + turn) % 17 = 0`` the top name
``question`` holds ``"   "``: truthy, so it is chosen, and the row is then
dropped as empty.  ``answer`` is an integer (turn % 3 = 0), JSON null (= 1)
or absent.  The line number is the pair's dense position in (conv_id, turn).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, sql_py_strip
from ..functions.variant import COMPLETION_FIELDS, PROBLEM_FIELDS, is_none, py_str
from ..operators.indexing import dense_index
from ..operators.prepare import prepare_counters, sample_exact, unify_records
from .common import json_string_literal, standin_file, table

DATASET = "convs"
SAMPLE_N = 500
SAMPLE_SEED = 42
# Falsy JSON decoys, rotated by (conv_id + field position) % 6.
FALSY_JSON = ('""', "0", "null", "[]", "{}", "false")


def _json_string(col: str):
    """The column as a JSON string literal (``["..."]`` without the brackets)."""
    return json_string_literal(F.col(col))


def user_assistant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant reply right after it: equi-join on (conv_id, turn + 1),
    so a long conversation is not gathered into one task (as a ``lead`` window would)."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user_text"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_text"))
    return u.join(a, ["conv_id", "turn"])


def raw_sft_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_index, line`` -- the stand-in raw JSONL file (derived once per application)."""
    return standin_file(spark, ("sft-lines", sf_dir), lambda: _raw_sft_lines(spark, sf_dir), "sft-lines")


def _raw_sft_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = user_assistant_pairs(spark, sf_dir)
    p = (p.withColumn("_pj", _json_string("user_text"))
          .withColumn("_cj", _json_string("assistant_text"))
          .withColumn("_pk", (F.col("conv_id") + F.col("turn")) % 6)
          .withColumn("_ck", (F.col("conv_id") + 3 * F.col("turn") + 1) % 6)
          .withColumn("_ws", (F.col("conv_id") + F.col("turn")) % 17 == 0))
    falsy = F.array(*[F.lit(x) for x in FALSY_JSON])

    def entries(names, key_col, text_col, ws_first):
        out = []
        for i, name in enumerate(names):
            decoy = F.element_at(falsy, ((F.col("conv_id") + i) % 6 + 1).cast("int"))
            val = F.when(F.col(key_col) == i, F.col(text_col)).when(F.col(key_col) > i, decoy)
            if ws_first and i == 0:
                val = F.when(F.col("_ws"), F.lit('"   "')).otherwise(val)
            out.append(F.concat(F.lit(f'"{name}":'), val))
        return out

    answer = (F.when(F.col("turn") % 3 == 0, F.concat(F.lit('"answer":'), F.col("turn").cast("string")))
               .when(F.col("turn") % 3 == 1, F.lit('"answer":null')))
    line = F.concat(F.lit("{"), F.concat_ws(",", *entries(PROBLEM_FIELDS, "_pk", "_pj", True),
                                           *entries(COMPLETION_FIELDS, "_ck", "_cj", False), answer),
                    F.lit("}"))
    lines = p.select("conv_id", "turn", line.alias("line"))
    return dense_index(lines, ["conv_id", "turn"], out="raw_index").select("raw_index", "line")


def _unified(spark: SparkSession, sf_dir: str, keep_skipped: bool) -> DataFrame:
    raw = raw_sft_lines(spark, sf_dir).withColumn("v", F.parse_json("line"))
    return unify_records(raw, DATASET, keep_skipped=keep_skipped)


def q_sft_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _unified(spark, sf_dir, keep_skipped=False)
    return u.select("id", "source", "prompt", "completion",
                    F.when(~is_none(F.col("metadata.answer")), py_str(F.col("metadata.answer"))).alias("answer"), F.col("metadata.raw_index").alias("raw_index"))


def q_sft_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_counters(_unified(spark, sf_dir, keep_skipped=True))


def q_sft_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    s = sample_exact(d, SAMPLE_N, SAMPLE_SEED, "doc_id")
    return s.select("doc_id", "lang", "source", "n_chars", content_hash("text").alias("text_hash"))


_PAIRS_SQL = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS user_text, a.text AS assistant_text,
         row_number() OVER (ORDER BY u.conv_id, u.turn) - 1 AS raw_index
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
rec AS (
  SELECT raw_index, turn,
    CASE WHEN (conv_id + turn) % 17 = 0 THEN '' ELSE {strip_u} END AS problem,
    {strip_a} AS completion
  FROM pairs)
"""

SQL_SFT_PREPARE = "WITH " + _PAIRS_SQL.format(strip_u=sql_py_strip("user_text"),
                                              strip_a=sql_py_strip("assistant_text")) + f"""
SELECT '{DATASET}_' || CAST(raw_index AS VARCHAR) AS id, 'local_{DATASET}' AS source,
  '### Problem:' || chr(10) || problem || chr(10) || chr(10) || '### Solution:' || chr(10) AS prompt,
  completion,
  CASE WHEN turn % 3 = 0 THEN CAST(turn AS VARCHAR) WHEN turn % 3 = 1 THEN NULL ELSE '' END AS answer,
  CAST(raw_index AS BIGINT) AS raw_index
FROM rec WHERE problem <> '' AND completion <> ''
"""

SQL_SFT_COUNTERS = "WITH " + _PAIRS_SQL.format(strip_u=sql_py_strip("user_text"),
                                               strip_a=sql_py_strip("assistant_text")) + """
SELECT CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE problem <> '' AND completion <> '') AS BIGINT) AS kept,
  CAST(count(*) FILTER (WHERE NOT (problem <> '' AND completion <> '')) AS BIGINT) AS skipped
FROM rec
"""

SQL_SFT_SAMPLE = f"""
SELECT doc_id, lang, source, n_chars, substr(sha256(text), 1, 16) AS text_hash
FROM documents ORDER BY md5('{SAMPLE_SEED}:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT {SAMPLE_N}
"""

QUERIES = {"sft_prepare": q_sft_prepare, "sft_counters": q_sft_counters, "sft_sample": q_sft_sample}
ORACLES = {"sft_prepare": SQL_SFT_PREPARE, "sft_counters": SQL_SFT_COUNTERS, "sft_sample": SQL_SFT_SAMPLE}
