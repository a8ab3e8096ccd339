"""Validation rule sets as error relations.

Each validator returns a DataFrame ``task, line, code, detail`` -- one row per
violation, empty when the input passes.  Row rules are evaluated as
``explode(array_compact(array(when(rule, struct(code, detail)), ...)))`` in
the stage that reads the row; file rules (repeats, counts) are aggregates
joined back, never windows keyed by a possibly hot id.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import materialize
from ..sources.filestatus import path_status
from .quality import later_rows
from ..functions.variant import extract_doc_id, extract_output, extract_prompt, field, is_none, py_str, typed_key

ERROR_SCHEMA = "task string, line bigint, code string, detail string"

# Fields every exported record must carry as non-blank strings.
REQUIRED_NONEMPTY = ("sample_id", "task", "benchmark", "question", "prompt", "raw_output",
                     "prompt_hash", "output_hash", "run_id")
REQUIRED_MAX_GEN_TOKS = 32768
MIN_MAX_MODEL_LEN = 32768


_NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _is_number(v: Column, name: str, value: float) -> Column:
    """``obj.get(name) == value`` with Python typing: a JSON number equal to ``value``
    (a string such as ``"32768"`` is not equal)."""
    f = field(v, name)
    return F.coalesce(F.schema_of_variant(f).rlike(_NUMERIC)
                      & (F.try_variant_get(v, f"$['{name}']", "double") == value), F.lit(False))


def _rule(cond: Column, code: str, detail: Column | None = None) -> Column:
    d = detail if detail is not None else F.lit(None).cast("string")
    return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), d.alias("detail")))


def _explode_rules(df: DataFrame, rules: Sequence[Column], task_col: str, line_col: str) -> DataFrame:
    e = df.select(F.col(task_col).alias("task"), F.col(line_col).cast("bigint").alias("line"),
                  F.explode(F.array_compact(F.array(*rules))).alias("_e"))
    return e.select("task", "line", F.col("_e.code").alias("code"), F.col("_e.detail").alias("detail"))


def repeats(df: DataFrame, group_cols: Sequence[str], key_col: str, order_cols: str | Sequence[str],
            code: str, detail: Column) -> DataFrame:
    """Every occurrence of a key after its first (in ``order_cols``) within ``group_cols``:
    ``group_cols, line, code, detail``; rows that tie with the first count as repeats too."""
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    rep = later_rows(df, [*group_cols, key_col], order)
    return rep.select(*group_cols, F.col(order[-1]).cast("bigint").alias("line"), F.lit(code).alias("code"), detail.alias("detail"))


def count_mismatches(actual: DataFrame, expected: DataFrame | None, scope: str | Sequence[str] = "task") -> DataFrame:
    """Count rule: ``expected > 0 and actual != expected`` (missing actual = 0)."""
    cols = [scope] if isinstance(scope, str) else list(scope)
    e, a = F.col("expected").cast("bigint"), F.coalesce(F.col("actual"), F.lit(0)).cast("bigint")
    if expected is None:
        return actual.limit(0).select(*cols, F.lit(None).cast("bigint").alias("line"), F.lit("").alias("code"), F.lit("").alias("detail"))
    return (expected.join(actual, cols, "left").where((e > 0) & (a != e))
            .select(*cols, F.lit(None).cast("bigint").alias("line"), F.lit("count_mismatch").alias("code"),
                    F.format_string("actual=%d, expected=%d", a, e).alias("detail")))


def _facts(parsed: DataFrame, rules: Sequence[Column], key: Column, disp: Column, has_key: Column,
           scope: Sequence[str], line_col: str) -> DataFrame:
    """One pass over the wide parsed rows -> a narrow per-row table (rule hits, typed key),
    written once to the shared checkpoint folder; every file-level rule reads that instead
    of re-parsing the JSON."""
    ok = ~F.col("parse_error")
    file = F.col("file") if "file" in parsed.columns else F.lit("")
    facts = parsed.select(
        *scope, file.alias("_file"), F.col(line_col).cast("bigint").alias("line"), F.col("parse_error"),
        F.when(ok, F.array_compact(F.array(*rules))).alias("_rules"),
        F.when(ok & has_key, key).alias("_key"), F.when(ok & has_key, disp).alias("_disp"))
    return materialize(facts, "validate-facts")


def _file_errors(facts: DataFrame, expected: DataFrame | None, dup_code: str, dup_prefix: str, scope: Sequence[str]) -> DataFrame:
    errs = facts.where(~F.col("parse_error")).select(*scope, "line", F.explode("_rules").alias("_e")).select(
        *scope, "line", F.col("_e.code").alias("code"), F.col("_e.detail").alias("detail"))
    bad = facts.where(F.col("parse_error")).select(
        *scope, "line", F.lit("parse_error").alias("code"), F.lit(None).cast("string").alias("detail"))
    keyed = facts.where(F.col("_key").isNotNull()).select(*scope, "_file", "line", "_key", "_disp")
    dups = repeats(keyed, scope, "_key", ["_file", "line"], dup_code, F.concat(F.lit(dup_prefix), F.col("_disp")))
    actual = facts.groupBy(*scope).agg(F.count(F.lit(1)).alias("actual"))
    return errs.unionByName(bad).unionByName(dups).unionByName(count_mismatches(actual, expected, scope))


def _with_files(errors: DataFrame, files: DataFrame | None, scope: Sequence[str]) -> DataFrame:
    """``errors`` and those of the named files (scope columns, ``path``) that are not there or have no bytes."""
    return errors if files is None else errors.unionByName(file_rules(files, path_status(files), "path", "file", scope))


def validate_samples(parsed: DataFrame, expected: DataFrame | None = None, scope: Sequence[str] = ("task",),
                     line_col: str = "line", files: DataFrame | None = None) -> DataFrame:
    """V1 over ``parse_jsonl(..., on_error='collect')`` output (scope columns, ``line, v,
    parse_error`` and, for rows from files, ``file``): ``scope, line, code, detail``.

    ``scope`` names what is one samples file in the reference: ``("task",)`` for the rows of
    one run, ``("model", "task", "file")`` for a folder of many.  Ids repeat within a scope,
    in the order (file, line); ``expected`` has the scope columns and ``expected``.  Missing and
    empty files have no rows in ``parsed``: ``files`` (scope columns, ``path``) names those that should be
    there, and tasks ask the file system for them (codes as in :func:`missing_files`).
    Corrupt lines count toward ``actual`` (as in the reference) and produce
    ``parse_error``; ids compare by typed value, so ``0`` and ``"0"`` differ.
    Runs one job eagerly (the narrow facts table); the result is lazy.
    """
    v = F.col("v")
    out = extract_output(v)
    row_rules = [
        _rule(is_blank(out), "empty_output"),
        _rule(is_none(field(v, "resps")) & is_none(field(v, "filtered_resps")), "missing_resps"),
        _rule((extract_prompt(v) == "") & is_none(field(v, "doc")), "missing_prompt"),
    ]
    did = extract_doc_id(v, F.col(line_col))
    facts = _facts(parsed, row_rules, typed_key(did), py_str(did), F.lit(True), scope, line_col)
    return _with_files(_file_errors(facts, expected, "duplicate_doc_id", "doc_id=", scope), files, scope)


def missing_files(files: DataFrame, listing: DataFrame, path_col: str = "path", task_col: str = "task") -> DataFrame:
    """V1/V3: a samples or export file that is not there or has no bytes: ``task, line, code,
    detail`` with codes ``file_missing`` (no name), ``file_not_found`` and ``file_empty``."""
    return file_rules(files, listing, path_col, "file", task_col)


def export_record_rules(v: Column, expected_method: str = "llama_tokenizer") -> list[Column]:
    """V2 row rules on an exported record held as VARIANT (key presence is checkable)."""
    rules = []
    for name in REQUIRED_NONEMPTY:
        f = field(v, name)
        rules.append(_rule(is_none(f) | is_blank(py_str(f)), "empty_field", F.lit(name)))
    rules.append(_rule(is_none(field(v, "doc_id")), "missing_doc_id"))
    gold_present = F.array_contains(F.map_keys(v.try_cast("map<string,variant>")), F.lit("gold_answer"))
    rules.append(_rule(~gold_present, "missing_gold_answer"))
    rules.append(_rule(~_is_number(v, "max_gen_toks", REQUIRED_MAX_GEN_TOKS), "bad_max_gen_toks",
                       py_str(field(v, "max_gen_toks"))))
    mml = F.coalesce(F.try_variant_get(v, "$['max_model_len']", "double"), F.lit(0.0))
    rules.append(_rule(F.floor(mml) < MIN_MAX_MODEL_LEN, "short_max_model_len"))
    otc = F.coalesce(F.try_variant_get(v, "$['output_token_count']", "double"), F.lit(0.0))
    rules.append(_rule(F.floor(otc) <= 0, "bad_output_token_count"))
    method = F.coalesce(F.try_variant_get(v, "$['output_token_count_method']", "string"), F.lit(""))
    rules.append(_rule(method != expected_method, "bad_token_method", method))
    return rules


def validate_export_file(parsed: DataFrame, expected: DataFrame | None = None,
                         expected_method: str = "llama_tokenizer", scope: Sequence[str] = ("task",),
                         line_col: str = "line", files: DataFrame | None = None) -> DataFrame:
    """V3 (+V2 per row) over ``parse_jsonl(..., on_error='collect')`` of exported files;
    ``sample_id`` repeats within a scope (in the order file, line) are errors, NULL ids are
    ignored.  ``scope`` and ``files`` as in :func:`validate_samples`."""
    v = F.col("v")
    sid = field(v, "sample_id")
    facts = _facts(parsed, export_record_rules(v, expected_method), typed_key(sid), py_str(sid),
                   ~is_none(sid), scope, line_col)
    return _with_files(_file_errors(facts, expected, "duplicate_sample_id", "sample_id=", scope), files, scope)


def file_rules(files: DataFrame, listing: DataFrame, path_col: str, code_prefix: str,
               task_col: str | Sequence[str] = "task") -> DataFrame:
    """A named file must exist and be non-empty: ``files`` (task or scope columns, path) left-joined to
    ``path, length`` of what exists (``sources.filestatus``; content is never read)."""
    j = files.join(listing.select(F.col("path").alias("_p"), F.col("length").alias("_len")),
                   F.col(path_col) == F.col("_p"), "left")
    code = (F.when(F.coalesce(F.length(F.col(path_col)), F.lit(0)) == 0, F.lit(f"{code_prefix}_missing"))
             .when(F.col("_p").isNull(), F.lit(f"{code_prefix}_not_found"))
             .when(F.col("_len") == 0, F.lit(f"{code_prefix}_empty")))
    who = [F.col(task_col).alias("task")] if isinstance(task_col, str) else [F.col(c) for c in task_col]
    return j.where(code.isNotNull()).select(*who, F.lit(None).cast("bigint").alias("line"),
                                            code.alias("code"), F.col(path_col).cast("string").alias("detail"))


def validate_task_manifests(manifests: DataFrame, listing: DataFrame, task_col: str = "task") -> DataFrame:
    """V4 over ``task, m VARIANT`` (m NULL = unreadable manifest)."""
    m = F.col("m")
    g = lambda k, t="string": F.try_variant_get(m, f"$['{k}']", t)
    exp = F.coalesce(g("expected_sample_count", "bigint"), F.lit(0))
    rules = [
        _rule(m.isNull(), "manifest_unreadable"),
        _rule(m.isNotNull() & F.coalesce(g("status") != "complete", F.lit(True)), "status", g("status")),
        _rule(m.isNotNull() & ~_is_number(m, "max_gen_toks", REQUIRED_MAX_GEN_TOKS), "bad_max_gen_toks"),
        _rule(m.isNotNull() & (F.floor(F.coalesce(g("max_model_len", "double"), F.lit(0.0))) < MIN_MAX_MODEL_LEN),
              "short_max_model_len"),
        _rule(m.isNotNull() & F.coalesce(g("export_status") != "complete", F.lit(True)), "export_status",
              g("export_status")),
        _rule((exp > 0) & (F.coalesce(g("actual_sample_count", "bigint"), F.lit(0)) != exp), "actual_count"),
        _rule((exp > 0) & (F.coalesce(g("exported_sample_count", "bigint"), F.lit(0)) != exp), "exported_count"),
    ]
    errs = _explode_rules(manifests.withColumn("_line", F.lit(None).cast("bigint")), rules, task_col, "_line")
    files = manifests.where(m.isNotNull()).select(task_col, g("exported_generation_file").alias("_f"))
    return errs.unionByName(file_rules(files, listing, "_f", "export_file", task_col))


def validate_run_manifests(runs: DataFrame, listing: DataFrame, run_col: str = "run_id") -> DataFrame:
    """V5 over ``run_id, m VARIANT``; ``task`` in the output is ``run_id`` for run-level rules
    and ``run_id/task`` for per-task rules."""
    m = F.col("m")
    g = lambda k, t="string": F.try_variant_get(m, f"$['{k}']", t)
    rules = [
        _rule(m.isNull(), "manifest_unreadable"),
        _rule(m.isNotNull() & F.coalesce(g("status") != "complete", F.lit(True)), "status", g("status")),
        _rule(m.isNotNull() & F.coalesce(g("evaluation_mode") != "generation_only", F.lit(True)),
              "evaluation_mode", g("evaluation_mode")),
        _rule(m.isNotNull() & ~F.coalesce(g("predict_only", "boolean") & (F.schema_of_variant(field(m, "predict_only"))
                                                                          == "BOOLEAN"), F.lit(False)),
              "predict_only"),
        _rule(m.isNotNull() & F.coalesce(g("judging_status") != "pending_local", F.lit(True)), "judging_status"),
        _rule(m.isNotNull() & ~_is_number(m, "max_gen_toks", REQUIRED_MAX_GEN_TOKS), "bad_max_gen_toks"),
        _rule(m.isNotNull() & (F.floor(F.coalesce(g("gpu_peak_memory_mib", "double"), F.lit(0.0))) <= 0),
              "gpu_peak_memory"),
        _rule(m.isNotNull() & ~F.coalesce(g("enable_chunked_prefill", "boolean")
                                          & (F.schema_of_variant(field(m, "enable_chunked_prefill")) == "BOOLEAN"),
                                          F.lit(False)), "chunked_prefill"),
    ]
    errs = _explode_rules(runs.withColumn("_line", F.lit(None).cast("bigint")), rules, run_col, "_line")
    per_task = runs.where(m.isNotNull()).select(
        run_col, F.explode(F.coalesce(g("tasks", "array<string>"), F.array().cast("array<string>"))).alias("_t"),
        m)
    per_task = per_task.select(
        F.concat_ws("/", run_col, "_t").alias("task"),
        F.try_element_at(F.try_variant_get(m, "$['exported_generation_files']", "map<string,string>"),
                         F.col("_t")).alias("_f"),
        F.coalesce(F.try_element_at(F.try_variant_get(m, "$['expected_sample_counts']", "map<string,bigint>"),
                                     F.col("_t")), F.lit(0)).alias("_e"),
        F.coalesce(F.try_element_at(F.try_variant_get(m, "$['actual_sample_counts']", "map<string,bigint>"),
                                     F.col("_t")), F.lit(0)).alias("_a"))
    counts = per_task.where((F.col("_e") > 0) & (F.col("_a") != F.col("_e"))).select(
        "task", F.lit(None).cast("bigint").alias("line"), F.lit("task_count").alias("code"),
        F.format_string("actual=%d, expected=%d", "_a", "_e").alias("detail"))
    files = file_rules(per_task.select("task", "_f"), listing, "_f", "export_file")
    return errs.unionByName(counts).unionByName(files)
