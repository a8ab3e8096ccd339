"""Flatten/export: nested generation samples -> flat 34-field records.

Input rows carry ``task``, ``line`` and the parsed sample ``v VARIANT``.
The catalog (a few rows) and the task manifests (one row per task) are
broadcast dimensions; every other step is a column expression, so the
export is a single narrow stage plus the two broadcast joins.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, is_blank, possibly_truncated
from ..functions.tokenize import CodePointTokenizer
from ..functions.variant import (doc_field, extract_doc_id, extract_filtered, extract_output,
                                 extract_prompt, is_none, py_str, typed_key)
from ..sources.catalog import with_catalog
from ..session import materialize
from .quality import later_rows

# Manifest fields stamped on every record, with the default used
# when the manifest lacks them.
MANIFEST_DEFAULTS = {
    "max_gen_toks": 32768,
    "max_model_len": 40960,
    "temperature": 0.0,
    "do_sample": False,
    "tensor_parallel_size": 1,
    "max_num_batched_tokens": 0,
    "max_num_seqs": 0,
    "gpu_memory_utilization": 0.0,
    "enable_prefix_caching": False,
    "enable_chunked_prefill": True,
    "run_id": "unknown",
    "base_model": "meta-llama/Llama-3.1-8B",
}
MANIFEST_TYPES = {
    "max_gen_toks": "int", "max_model_len": "int", "temperature": "double", "do_sample": "boolean",
    "tensor_parallel_size": "int", "max_num_batched_tokens": "int", "max_num_seqs": "int",
    "gpu_memory_utilization": "double", "enable_prefix_caching": "boolean",
    "enable_chunked_prefill": "boolean", "run_id": "string", "base_model": "string",
}

EXPORT_COLUMNS = (
    "model_name", "model_path", "base_model", "task", "benchmark", "doc_id", "sample_id",
    "question", "gold_answer", "gold_solution", "prompt", "raw_output", "filtered_output",
    "prompt_token_count", "output_token_count", "output_token_count_method", "max_gen_toks",
    "max_model_len", "possibly_truncated", "temperature", "do_sample", "tensor_parallel_size",
    "max_num_batched_tokens", "max_num_seqs", "gpu_memory_utilization", "enable_prefix_caching",
    "enable_chunked_prefill", "dataset_path", "dataset_split", "prompt_hash", "output_hash",
    "run_id", "git_commit", "created_at",
)


def manifest_settings(manifests: DataFrame, task_col: str = "task") -> DataFrame:
    """Task manifests (``task, m VARIANT``, and ``model`` if they come from several) -> one typed
    column per stamped field, defaults filled."""
    cols = [F.col(task_col), *([F.col("model")] if "model" in manifests.columns else [])]
    for name, default in MANIFEST_DEFAULTS.items():
        typ = MANIFEST_TYPES[name]
        val = F.try_variant_get(F.col("m"), f"$['{name}']", typ)
        cols.append(F.coalesce(val, F.lit(default).cast(typ)).alias(name))
    return manifests.select(*cols)


def flatten_samples(samples: DataFrame, catalog: DataFrame, settings: DataFrame,
                    model_name: str | Column, model_path: str | Column,
                    git_commit: str, created_at: str, tokenizer=None,
                    v_col: str = "v", task_col: str = "task", line_col: str = "line") -> DataFrame:
    """P7-P13 + J1/J2: the 34 exported fields plus ``doc_id_key`` (typed) and ``line``.

    ``settings`` is :func:`manifest_settings` output (one row per task, or per model and task if
    it has a column ``model``: then samples join on both, so manifests of several models
    never multiply rows).
    ``question`` defaults to ``""`` (JSON null gives ``"None"``, as ``str(None)``);
    ``gold_answer`` / ``gold_solution`` stay NULL when absent, ``0`` becomes ``"0"``.
    ``filtered_output`` is the filtered text when present and non-empty, else the raw output.
    """
    tok = tokenizer or CodePointTokenizer()
    v = F.col(v_col)
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    s = with_catalog(samples, catalog, task_col)
    st = settings.withColumnRenamed(task_col, "_st_task")
    on = F.col(task_col) == F.col("_st_task")
    if "model" in settings.columns:
        st = st.withColumnRenamed("model", "_st_model")
        on = on & (F.col("model") == F.col("_st_model"))
    s = s.join(F.broadcast(st), on, "left").drop("_st_task", "_st_model")  # unhinted, rows of unknown size would shuffle the samples by task
    for name, default in MANIFEST_DEFAULTS.items():
        s = s.withColumn(name, F.coalesce(F.col(name), F.lit(default).cast(MANIFEST_TYPES[name])))
    did = extract_doc_id(v, F.col(line_col))
    q = doc_field(v, F.col("question_field"))
    a = doc_field(v, F.col("answer_field"))
    sol = doc_field(v, F.col("solution_field"))
    s = (s.withColumn("_did", did)
          .withColumn("doc_id", F.col("_did"))  # keeps its JSON type
          .withColumn("doc_id_key", typed_key(F.col("_did")))
          .withColumn("sample_id", F.concat_ws(":", F.col(task_col), py_str(F.col("_did"))))
          .withColumn("question", F.coalesce(py_str(q), F.lit("")))
          .withColumn("gold_answer", F.when(~is_none(a), py_str(a)))
          .withColumn("gold_solution", F.when(~is_none(sol), py_str(sol)))
          .withColumn("prompt", extract_prompt(v))
          .withColumn("raw_output", extract_output(v))
          .withColumn("_filt", extract_filtered(v))
          .withColumn("filtered_output", F.when(F.coalesce(F.length("_filt"), F.lit(0)) > 0, F.col("_filt"))
                      .otherwise(F.col("raw_output")))
          .withColumn("prompt_token_count", tok.count(F.col("prompt")).cast("int"))
          .withColumn("output_token_count", tok.count(F.col("raw_output")).cast("int"))
          .withColumn("output_token_count_method", F.lit(tok.name))
          .withColumn("possibly_truncated", possibly_truncated("output_token_count", F.col("max_gen_toks")))
          .withColumn("prompt_hash", content_hash("prompt"))
          .withColumn("output_hash", content_hash("raw_output"))
          .withColumn("model_name", lit(model_name))
          .withColumn("model_path", lit(model_path))
          .withColumn("git_commit", F.lit(git_commit))
          .withColumn("created_at", F.lit(created_at)))
    return s.select(*EXPORT_COLUMNS, "doc_id_key", F.col(line_col).alias("line"))


def publication_violations(exported: DataFrame, order_cols: Sequence[str] = ("line",)) -> DataFrame:
    """The rows the exporter refuses to publish -- blank raw output, prompt or question
    (in that order; one row per offending record) and repeated ``sample_id`` (every row
    after the first in ``order_cols``, equal positions included).  ``exported`` is read once:
    one narrow row per record is written and both rules read it.
    """
    code = (F.when(is_blank("raw_output"), F.lit("empty_raw_output"))
             .when(is_blank("prompt"), F.lit("empty_prompt"))
             .when(is_blank("question"), F.lit("empty_question")))
    cols = list(dict.fromkeys(["task", "line", "sample_id", *order_cols]))
    rows = materialize(exported.select(*cols, code.alias("code")), "publish-facts")
    blank = rows.where(F.col("code").isNotNull()).select("task", "line", "sample_id", "code")
    dup = later_rows(rows.where(F.col("sample_id").isNotNull()), ["sample_id"], order_cols)
    return blank.unionByName(dup.select("task", "line", "sample_id", F.lit("duplicate_sample_id").alias("code")))


def export_counters(exported: DataFrame) -> DataFrame:
    """Total records and unique sample ids per task."""
    return exported.groupBy("task").agg(F.count(F.lit(1)).alias("total_records"),
                                        F.count_distinct("sample_id").alias("unique_sample_ids"))
