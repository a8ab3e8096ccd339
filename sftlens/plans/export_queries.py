"""Flatten/export and validation queries (P7-P13, P17, J1, J2, V1-V3) over ``documents``.

Stand-in generation samples: each document becomes one sample line of task
``doc_id % 4`` (the three catalog tasks, or -- for 3 -- its ``source``, an
unknown task that takes the catalog defaults), in one of six shapes chosen by
``doc_id % 6``:

0. dict ``arguments.gen_args_0.arg_0``, ``resps [[x]]``, ``filtered_resps [[x]]``
1. list ``arguments [[p, {...}]]``, ``resps [x]``, no filtered
2. ``id`` instead of ``doc_id``, top-level ``prompt``, only ``filtered_resps``
3. ``gen_args_0.arg_0`` null, prompt under ``gen_args_1``; ``filtered_resps [[""]]``
4. ``arguments [p]``, ``resps [[x, "logprob"]]``, ``filtered_resps [["F<id>"]]``
5. ``resps []`` falls through to ``filtered_resps``

The doc holds the question / answer / solution under the task's own field
names (``Problem`` / ``Answer`` / ``Solution`` for AIME24).  The answer is
JSON null (id % 7 = 0), an integer (id % 5 = 0) or a string.  The line number
of a sample is ``doc_id + 1`` (missing numbers are blank lines).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokenize import CodePointTokenizer
from ..functions.variant import py_str
from ..operators.export import EXPORT_COLUMNS, flatten_samples, manifest_settings, publication_violations
from ..operators.validate import validate_export_file, validate_samples
from ..sources.catalog import TASK_CATALOG, task_catalog
from ..sources.jsonl import parse_jsonl
from .common import json_string_literal, standin_file, table

TOKENIZER = CodePointTokenizer()
GIT_COMMIT = "unknown"
CREATED_AT = "2024-01-01T00:00:00+00:00"


def _js(c):
    """A string column as a JSON string literal."""
    return json_string_literal(c)


def _task_cols(d: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(t[0]) for t in TASK_CATALOG])
    qf = F.array(*[F.lit(t[4]) for t in TASK_CATALOG])
    af = F.array(*[F.lit(t[5]) for t in TASK_CATALOG])
    sf = F.array(*[F.lit(t[6]) for t in TASK_CATALOG])
    ti = (F.col("doc_id") % 4).cast("int")
    pick = lambda arr, default: F.when(ti < 3, F.element_at(arr, ti + 1)).otherwise(F.lit(default))
    return d.select("*", F.when(ti < 3, F.element_at(names, ti + 1)).otherwise(F.col("source")).alias("task"),
                    pick(qf, "problem").alias("_qf"), pick(af, "answer").alias("_af"),
                    pick(sf, "solution").alias("_sf"))


def sample_lines(spark: SparkSession, sf_dir: str, faults: bool = False, write: bool = True) -> DataFrame:
    return standin_file(spark, ("samples", sf_dir, faults), lambda: _sample_lines(spark, sf_dir, faults), "samples", write)


def _sample_lines(spark: SparkSession, sf_dir: str, faults: bool = False) -> DataFrame:
    """``task, line, text, model`` -- one raw sample line per document.

    With ``faults``: id % 11 = 5 corrupt line; id % 13 = 7 reuses id - 4
    (a repeat within the task); id % 29 = 3 writes the id as a string (no
    repeat: typed ids); id % 17 = 9 ``resps [[""]]`` only; id % 19 = 11 no
    outputs at all; id % 23 = 13 no arguments, prompt or doc.
    """
    d = _task_cols(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    did = F.col("doc_id")
    q = F.concat(F.lit("Problem "), did.cast("string"))
    ans = (F.when(did % 7 == 0, F.lit("null"))
            .when(did % 5 == 0, (did % 1000).cast("string"))
            .otherwise(F.concat(F.lit('"'), (F.col("n_chars") % 100).cast("string"), F.lit('"'))))
    sol = F.when(did % 2 == 0, F.concat(F.lit(r',"'), F.col("_sf"), F.lit(r'":"The answer is $\\boxed{'),
                                        (F.col("n_chars") % 100).cast("string"), F.lit(r'}$"')))
    doc = F.concat(F.lit('{"'), F.col("_qf"), F.lit('":'), _js(q), F.lit(',"'), F.col("_af"), F.lit('":'), ans,
                   F.coalesce(sol, F.lit("")), F.lit("}"))
    p = _js(F.concat(F.lit("Problem: "), q, F.lit("\nAnswer:")))
    x = _js(F.col("text"))
    idv = did.cast("string")
    if faults:
        idv = (F.when(did % 13 == 7, (did - 4).cast("string"))
                .when(did % 29 == 3, F.concat(F.lit('"'), did.cast("string"), F.lit('"'))).otherwise(idv))
    shape = (did % 6).cast("int")
    ga = lambda inner: F.concat(F.lit('"arguments":'), inner)
    args = (F.when(shape == 0, ga(F.concat(F.lit('{"gen_args_0":{"arg_0":'), p,
                                           F.lit(',"arg_1":{"max_gen_toks":32768}}}'))))
             .when(shape == 1, ga(F.concat(F.lit("[["), p, F.lit(',{"max_gen_toks":32768}]]'))))
             .when(shape == 2, F.concat(F.lit('"prompt":'), p))
             .when(shape == 3, ga(F.concat(F.lit('{"gen_args_1":{"arg_0":'), p,
                                           F.lit('},"gen_args_0":{"arg_0":null}}'))))
             .when(shape == 4, ga(F.concat(F.lit("["), p, F.lit("]"))))
             .otherwise(ga(F.concat(F.lit('{"gen_args_0":{"arg_0":'), p, F.lit("}}")))))
    outs = (F.when(shape == 0, F.concat(F.lit('"resps":[['), x, F.lit(']],"filtered_resps":[['), x, F.lit("]]")))
             .when(shape == 1, F.concat(F.lit('"resps":['), x, F.lit("]")))
             .when(shape == 2, F.concat(F.lit('"filtered_resps":[['), x, F.lit("]]")))
             .when(shape == 3, F.concat(F.lit('"resps":[['), x, F.lit(']],"filtered_resps":[[""]]')))
             .when(shape == 4, F.concat(F.lit('"resps":[['), x, F.lit(',"logprob"]],"filtered_resps":[["F'),
                                        did.cast("string"), F.lit('"]]')))
             .otherwise(F.concat(F.lit('"resps":[],"filtered_resps":[['), x, F.lit("]]"))))
    id_key = F.when(shape == 2, F.lit('"id":')).otherwise(F.lit('"doc_id":'))
    docpart = F.concat(F.lit(',"doc":'), doc)
    if faults:
        outs = (F.when(did % 17 == 9, F.lit('"resps":[[""]]'))
                 .when(did % 19 == 11, F.lit('"note":"no outputs"')).otherwise(outs))
        missing = did % 23 == 13
        args = F.when(missing, F.lit('"note2":"no prompt"')).otherwise(args)
        docpart = F.when(missing, F.lit("")).otherwise(docpart)
    line = F.concat(F.lit("{"), id_key, idv, docpart, F.lit(","), args, F.lit(","), outs, F.lit("}"))
    if faults:
        line = F.when(did % 11 == 5, F.lit("{ broken json")).otherwise(line)
    return d.select("task", (did + 1).alias("line"), line.alias("text"), F.col("lang").alias("model"))


def task_manifests(spark: SparkSession) -> DataFrame:
    """One task manifest per catalog task (the unknown tasks have none -> defaults)."""
    rows = [(t[0], '{"task":"%s","status":"complete","max_gen_toks":32768,"max_model_len":40960,'
                   '"run_id":"run_%s","max_num_batched_tokens":8192,"max_num_seqs":32,'
                   '"gpu_memory_utilization":0.9,"enable_prefix_caching":true}' % (t[0], t[0]))
            for t in TASK_CATALOG]
    return spark.createDataFrame(rows, "task string, js string").select("task", F.parse_json("js").alias("m"))


def exported(spark: SparkSession, sf_dir: str, write: bool = True) -> DataFrame:
    return _export(spark, parse_jsonl(sample_lines(spark, sf_dir, write=write), on_error="fail"))


def _export(spark: SparkSession, parsed: DataFrame) -> DataFrame:
    return flatten_samples(parsed, task_catalog(spark), manifest_settings(task_manifests(spark)),
                           model_name=F.col("model"), model_path=F.concat(F.lit("/models/"), F.col("model")),
                           git_commit=GIT_COMMIT, created_at=CREATED_AT, tokenizer=TOKENIZER)


def q_export_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exported(spark, sf_dir).select(*EXPORT_COLUMNS, "line").withColumn("doc_id", py_str(F.col("doc_id")))


def q_export_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17 on the export of the faulty samples, whose corrupt lines the ``drop`` policy skips."""
    parsed = parse_jsonl(sample_lines(spark, sf_dir, faults=True), on_error="drop")
    return publication_violations(_export(spark, parsed))


def _expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected samples per task: the documents of the task, one more for MATH500."""
    d = _task_cols(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return d.groupBy("task").agg(F.count(F.lit(1)).alias("expected")).withColumn(
        "expected", F.col("expected") + F.when(F.col("task") == TASK_CATALOG[0][0], 1).otherwise(0))


def q_validate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_jsonl(sample_lines(spark, sf_dir, faults=True), on_error="collect")
    return validate_samples(parsed, _expected_counts(spark, sf_dir))


def export_lines_with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin_file(spark, ("export-lines", sf_dir), lambda: _export_lines_with_faults(spark, sf_dir),
                        "export-lines")


def _export_lines_with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported records as JSON lines with injected faults: id % 9 = 4 blank ``run_id``;
    id % 10 = 3 ``max_gen_toks`` 4096; null gold on even ids loses its key; id % 8 = 5
    method ``split_estimate``; id % 31 = 7 repeats the sample id of id - 4;
    id % 37 = 2 ``output_token_count`` 0."""
    e = exported(spark, sf_dir)
    did = F.col("doc_id").cast("bigint")
    e = (e.withColumn("run_id", F.when(did % 9 == 4, F.lit("")).otherwise(F.col("run_id")))
          .withColumn("max_gen_toks", F.when(did % 10 == 3, F.lit(4096)).otherwise(F.col("max_gen_toks")))
          .withColumn("output_token_count_method", F.when(did % 8 == 5, F.lit("split_estimate"))
                      .otherwise(F.col("output_token_count_method")))
          .withColumn("sample_id", F.when(did % 31 == 7, F.concat_ws(":", "task", (did - 4).cast("string")))
                      .otherwise(F.col("sample_id")))
          .withColumn("output_token_count", F.when(did % 37 == 2, F.lit(0)).otherwise(F.col("output_token_count"))))
    rec = F.struct(*EXPORT_COLUMNS)
    drop_gold = F.col("gold_answer").isNull() & (did % 2 == 0)
    text = F.when(drop_gold, F.to_json(rec, {"ignoreNullFields": "true"})) \
            .otherwise(F.to_json(rec, {"ignoreNullFields": "false"}))
    return e.select("task", "line", text.alias("text"))


def q_validate_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_jsonl(export_lines_with_faults(spark, sf_dir), on_error="collect")
    expected = _expected_counts(spark, sf_dir).withColumn(
        "expected", F.col("expected") - F.when(F.col("task") == TASK_CATALOG[0][0], 1).otherwise(0))
    return validate_export_file(parsed, expected, expected_method=TOKENIZER.name)


# --------------------------------------------------------------------------- oracles

_TASK_SQL = """
d AS (
  SELECT doc_id, text, lang, source, n_chars, doc_id % 6 AS shape,
    CASE doc_id % 4 WHEN 0 THEN 'local_math500_32k' WHEN 1 THEN 'local_aime24_32k'
                    WHEN 2 THEN 'local_aime25_32k' ELSE source END AS task,
    doc_id % 4 AS ti
  FROM documents)"""

SQL_EXPORT_FLATTEN = "WITH" + _TASK_SQL + """,
e AS (
  SELECT *, 'Problem: Problem ' || CAST(doc_id AS VARCHAR) || chr(10) || 'Answer:' AS prompt FROM d)
SELECT lang AS model_name, '/models/' || lang AS model_path, 'meta-llama/Llama-3.1-8B' AS base_model, task,
  CASE ti WHEN 0 THEN 'MATH500' WHEN 1 THEN 'AIME24' WHEN 2 THEN 'AIME25' ELSE upper(task) END AS benchmark,
  CAST(doc_id AS VARCHAR) AS doc_id, task || ':' || CAST(doc_id AS VARCHAR) AS sample_id,
  'Problem ' || CAST(doc_id AS VARCHAR) AS question,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN CAST(doc_id % 1000 AS VARCHAR)
       ELSE CAST(n_chars % 100 AS VARCHAR) END AS gold_answer,
  CASE WHEN doc_id % 2 = 0 THEN 'The answer is $\\boxed{' || CAST(n_chars % 100 AS VARCHAR) || '}$' END AS gold_solution,
  prompt, text AS raw_output,
  CASE WHEN shape = 4 THEN 'F' || CAST(doc_id AS VARCHAR) ELSE text END AS filtered_output,
  CAST(length(prompt) AS INTEGER) AS prompt_token_count, CAST(length(text) AS INTEGER) AS output_token_count,
  'codepoint' AS output_token_count_method, CAST(32768 AS INTEGER) AS max_gen_toks,
  CAST(40960 AS INTEGER) AS max_model_len, length(text) >= 32760 AS possibly_truncated,
  CAST(0.0 AS DOUBLE) AS temperature, false AS do_sample, CAST(1 AS INTEGER) AS tensor_parallel_size,
  CAST(CASE WHEN ti < 3 THEN 8192 ELSE 0 END AS INTEGER) AS max_num_batched_tokens,
  CAST(CASE WHEN ti < 3 THEN 32 ELSE 0 END AS INTEGER) AS max_num_seqs,
  CAST(CASE WHEN ti < 3 THEN 0.9 ELSE 0.0 END AS DOUBLE) AS gpu_memory_utilization,
  ti < 3 AS enable_prefix_caching, true AS enable_chunked_prefill,
  CASE ti WHEN 0 THEN 'HuggingFaceH4/MATH-500' WHEN 1 THEN 'Maxwell-Jia/AIME_2024' WHEN 2 THEN 'math-ai/aime25'
          ELSE 'unknown' END AS dataset_path,
  CASE ti WHEN 0 THEN 'test' WHEN 1 THEN 'train' WHEN 2 THEN 'test' ELSE 'unknown' END AS dataset_split,
  substr(sha256(prompt), 1, 16) AS prompt_hash, substr(sha256(text), 1, 16) AS output_hash,
  CASE WHEN ti < 3 THEN 'run_' || task ELSE 'unknown' END AS run_id,
  'unknown' AS git_commit, '2024-01-01T00:00:00+00:00' AS created_at, CAST(doc_id + 1 AS BIGINT) AS line
FROM e
"""

SQL_EXPORT_VIOLATIONS = "WITH" + _TASK_SQL + """,
s AS (
  SELECT task, CAST(doc_id + 1 AS BIGINT) AS line, doc_id % 17 = 9 OR doc_id % 19 = 11 AS no_out, doc_id % 23 = 13 AS no_prompt,
    task || ':' || CAST(CASE WHEN doc_id % 13 = 7 THEN doc_id - 4 ELSE doc_id END AS VARCHAR) AS sample_id
  FROM d WHERE doc_id % 11 <> 5)
SELECT task, line, sample_id, CASE WHEN no_out THEN 'empty_raw_output' ELSE 'empty_prompt' END AS code
FROM s WHERE no_out OR no_prompt
UNION ALL
SELECT task, line, sample_id, 'duplicate_sample_id' FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY line) AS rn FROM s) WHERE rn > 1
"""

SQL_VALIDATE_SAMPLES = "WITH" + _TASK_SQL + """,
s AS (
  SELECT *, doc_id % 11 = 5 AS corrupt,
    CASE WHEN doc_id % 13 = 7 THEN 'n:' || CAST(CAST(doc_id - 4 AS DOUBLE) AS VARCHAR)
         WHEN doc_id % 29 = 3 THEN 's:' || CAST(doc_id AS VARCHAR)
         ELSE 'n:' || CAST(CAST(doc_id AS DOUBLE) AS VARCHAR) END AS k,
    CASE WHEN doc_id % 13 = 7 THEN CAST(doc_id - 4 AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS disp,
    doc_id % 17 = 9 AS empty_out, doc_id % 19 = 11 AS no_out, doc_id % 23 = 13 AS no_prompt,
    doc_id + 1 AS line
  FROM d),
e AS (
  SELECT task, line, 'parse_error' AS code, CAST(NULL AS VARCHAR) AS detail FROM s WHERE corrupt
  UNION ALL SELECT task, line, 'empty_output', NULL FROM s WHERE NOT corrupt AND (empty_out OR no_out)
  UNION ALL SELECT task, line, 'missing_resps', NULL FROM s WHERE NOT corrupt AND NOT empty_out AND no_out
  UNION ALL SELECT task, line, 'missing_prompt', NULL FROM s WHERE NOT corrupt AND no_prompt
  UNION ALL
  SELECT task, line, 'duplicate_doc_id', 'doc_id=' || disp FROM (
    SELECT *, row_number() OVER (PARTITION BY task, k ORDER BY line) AS rn FROM s WHERE NOT corrupt) WHERE rn > 1
  UNION ALL
  SELECT c.task, NULL, 'count_mismatch', 'actual=' || CAST(c.n AS VARCHAR) || ', expected=' || CAST(c.n + 1 AS VARCHAR)
  FROM (SELECT task, count(*) AS n FROM s GROUP BY task) c WHERE c.task = 'local_math500_32k')
SELECT task, CAST(line AS BIGINT) AS line, code, detail FROM e
"""

SQL_VALIDATE_EXPORT = "WITH" + _TASK_SQL + """,
s AS (
  SELECT *, doc_id + 1 AS line,
    CASE WHEN doc_id % 31 = 7 THEN task || ':' || CAST(doc_id - 4 AS VARCHAR)
         ELSE task || ':' || CAST(doc_id AS VARCHAR) END AS sid
  FROM d),
e AS (
  SELECT task, line, 'empty_field' AS code, 'run_id' AS detail FROM s WHERE ti < 3 AND doc_id % 9 = 4
  UNION ALL SELECT task, line, 'empty_field', 'run_id' FROM s WHERE ti = 3 AND doc_id % 9 = 4
  UNION ALL SELECT task, line, 'missing_gold_answer', NULL FROM s WHERE doc_id % 7 = 0 AND doc_id % 2 = 0
  UNION ALL SELECT task, line, 'bad_max_gen_toks', '4096' FROM s WHERE doc_id % 10 = 3
  UNION ALL SELECT task, line, 'bad_token_method', 'split_estimate' FROM s WHERE doc_id % 8 = 5
  UNION ALL SELECT task, line, 'bad_output_token_count', NULL FROM s WHERE doc_id % 37 = 2
  UNION ALL
  SELECT task, line, 'duplicate_sample_id', 'sample_id=' || sid FROM (
    SELECT *, row_number() OVER (PARTITION BY task, sid ORDER BY line) AS rn FROM s) WHERE rn > 1)
SELECT task, CAST(line AS BIGINT) AS line, code, detail FROM e
"""

QUERIES = {"export_flatten": q_export_flatten, "export_violations": q_export_violations,
           "validate_samples": q_validate_samples, "validate_export": q_validate_export}
ORACLES = {"export_flatten": SQL_EXPORT_FLATTEN, "export_violations": SQL_EXPORT_VIOLATIONS,
           "validate_samples": SQL_VALIDATE_SAMPLES, "validate_export": SQL_VALIDATE_EXPORT}


def q_publish_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK2: publish the export through staging -> read back -> V3 -> row count -> rename,
    then read the published records (a few columns) back."""
    from ..session import scratch_dir
    from ..sinks.writers import publish_validated

    e = exported(spark, sf_dir, write=False).select(*EXPORT_COLUMNS)
    dest = scratch_dir(spark, "published") + "/export"
    publish_validated(e, dest, lambda parsed, expected: validate_export_file(parsed, expected,
                                                                             expected_method=TOKENIZER.name))
    return spark.read.schema("sample_id string, task string, output_hash string, output_token_count bigint, "
                             "possibly_truncated boolean, gold_answer string").json(dest)


SQL_PUBLISH_EXPORT = ("SELECT sample_id, task, output_hash, CAST(output_token_count AS BIGINT) AS output_token_count, "
                      "possibly_truncated, gold_answer FROM (" + SQL_EXPORT_FLATTEN + ")")

QUERIES["publish_export"] = q_publish_export
ORACLES["publish_export"] = SQL_PUBLISH_EXPORT
