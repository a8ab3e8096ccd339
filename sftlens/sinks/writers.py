"""Sinks (SK1-SK4).

* ``write_jsonl``       -- UTF-8 JSON lines, null fields kept (key presence matters)
* ``publish_validated`` -- write to a staging folder, read back, validate, count,
  then rename into place; nothing is published on a violation
* ``write_comparison``  -- the metric x model matrix as JSON, CSV and Markdown
* ``output_name``       -- model / benchmark short names and the smoke suffix
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class PublishError(RuntimeError):
    """The staged export failed validation; nothing was published."""


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    """SK1: one JSON object per line; NULL fields are written as ``null`` (Spark drops
    them by default, which would lose the ``gold_answer`` key).  ``partition_by``
    writes one folder per value (e.g. per model and task)."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def rewrite_partitions(df: DataFrame, path: str, pending: DataFrame, partition_by: tuple[str, ...]) -> None:
    """SK1 for the partitions named by the rows of ``pending`` (J4's table) alone: they are replaced by the rows of ``df``,
    the files of all others stay as they are.  A pending partition without rows keeps its old files.

    ``pending`` has a row per task, so the semi-join is a filter where ``df`` is read."""
    chosen = df.join(pending.select(*partition_by).distinct(), list(partition_by), "left_semi")
    (chosen.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false")
     .partitionBy(*partition_by).json(path))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def publish_validated(df: DataFrame, path: str, validate, expected_count: int | None = None,
                      task: str = "export") -> int:
    """SK2: stage -> read back -> validate (rules + row count) -> rename.

    The number of rows written is observed during the write itself
    (``df.observe``), so no extra pass is needed; it becomes the expected count
    of the read-back validation, whose count rule then catches any loss.  An export
    without rows, records that P17 refuses (blank fields, a sample id that repeats in any of the
    part files) and violations of ``validate(parsed_df, expected_df) -> errors_df`` (e.g.
    :func:`sftlens.operators.validate.validate_export_file`) stop the publication; only
    the first few reach the driver, for the message.  Besides the export itself nothing as large is
    written: lines are numbered by a second scan of the staged files, and the narrow tables of the rules are
    deleted when their violations are known.  Returns the row count.
    """
    from pyspark.sql import Observation

    from ..functions.variant import as_string, key
    from ..operators.export import publication_violations
    from ..session import scratch_scope
    from ..sources.jsonl import read_jsonl

    spark = df.sparkSession
    staging = f"{path.rstrip('/')}._staging-{uuid.uuid4().hex[:8]}"
    obs = Observation("published")
    write_jsonl(df.observe(obs, F.count(F.lit(1)).alias("rows")), staging)
    written = int(obs.get["rows"])
    fs, sp, jvm = _fs(spark, staging)
    try:
        if not written:
            raise PublishError("no rows to publish")
        if expected_count is not None and written != expected_count:
            raise PublishError(f"expected {expected_count} rows but wrote {written}")
        with scratch_scope(spark):
            parsed = read_jsonl(spark, staging + "/*.json", on_error="collect", write=False).withColumn("task", F.lit(task)).drop("text")
            fields = [as_string("v", key(c)).alias(c) for c in ("sample_id", "raw_output", "prompt", "question")]
            bad = publication_violations(parsed.select("task", "file", "line", *fields), ["file", "line"]).limit(5).collect()
            if not bad:
                expected = spark.createDataFrame([(task, written)], "task string, expected long")
                bad = validate(parsed, expected).limit(5).collect()
        if bad:
            raise PublishError(f"validation failed: {[tuple(r) for r in bad]}")
        dest = jvm.org.apache.hadoop.fs.Path(path)
        if fs.exists(dest):
            raise PublishError(f"destination exists: {path}")
        if not fs.rename(sp, dest):
            raise PublishError(f"rename failed: {staging} -> {path}")
        return written
    except BaseException:
        if fs.exists(sp):
            fs.delete(sp, True)
        raise


# The configuration rows of the comparison, in order.
CONFIG_ROWS = ("max_gen_toks", "max_model_len", "max_num_batched_tokens", "max_num_seqs", "gpu_memory_utilization",
               "enable_prefix_caching", "enable_chunked_prefill", "dtype", "vllm_version", "lm_eval_version")


def _ordered(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Rows in the order of ``key`` in ``order`` (others after them, by name), as one partition:
    there is a row per metric."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(key)), F.lit(0)), F.lit(len(order) + 1))
    return rows.coalesce(1).sortWithinPartitions(at, key)


def write_comparison(matrix: DataFrame, out_dir: str, models: list[str], stats: DataFrame | None = None,
                     model_col: str = "model_name") -> None:
    """SK3: the (<= 40-row) matrix as ``json/``, ``csv/`` and ``comparison.md``, metrics in the
    reference's order.

    With ``stats`` (one record per run) there is also ``document/``, one JSON object with all
    records under their names and the two verdicts, and a configuration section in the
    Markdown.  All writes are single-partition Spark writes of a row per metric or run;
    the Markdown is rendered from those few rows and written through the cluster file system.
    """
    from ..operators.compare import MATRIX_METRICS

    m = _ordered(matrix, "metric", MATRIX_METRICS)
    m.write.mode("overwrite").json(f"{out_dir}/json")
    m.write.mode("overwrite").option("header", "true").csv(f"{out_dir}/csv")
    lines = ["# Generation comparison", "", "## Overall", "", "| Metric | " + " | ".join(models) + " |", "|---|" + "---|" * len(models)]
    rows = m.collect()
    for r in rows:
        lines.append(f"| {r['metric']} | " + " | ".join(str(r[x]) for x in models) + " |")
    if stats is not None:
        verdicts = {r["metric"]: bool(r[models[0]]) for r in rows if r["metric"] in ("config_comparable", "throughput_comparable")}
        runs = stats.where(F.col(model_col).isin(*models))
        record = F.map_from_entries(F.collect_list(F.struct(F.col(model_col), F.struct(*runs.columns))))
        runs.agg(F.lit("generation_only").alias("generation_mode"), F.lit(False).alias("accuracy_reported"), record.alias("runs"),
                 *[F.lit(x).alias(name) for name, x in verdicts.items()]).write.mode("overwrite").json(f"{out_dir}/document")
        by_name = {r[model_col]: r for r in runs.collect()}
        lines += ["", "## Configuration", "", "| Parameter | " + " | ".join(models) + " |", "|---|" + "---|" * len(models)]
        for name in CONFIG_ROWS:
            if name in stats.columns:
                lines.append(f"| {name} | " + " | ".join(str(by_name[x][name]) if x in by_name else "None" for x in models) + " |")
    fs, p, jvm = _fs(matrix.sparkSession, f"{out_dir}/comparison.md")
    out = fs.create(p, True)
    try:
        out.write(bytearray(("\n".join(lines) + "\n").encode("utf-8")))
    finally:
        out.close()


# Model-name substrings (case-sensitive) and the short name they map to.
MODEL_SHORT_NAMES = [(("LIMO", "limo"), "limo"), (("OpenR1", "openr1"), "openr1")]
# Task-name substrings and the benchmark short name they map to.
BENCH_SHORT_NAMES = [("math500", "math500"), ("aime24", "aime24"), ("aime25", "aime25")]


def model_short(model: Column) -> Column:
    """SK4: the short name of the first matching pattern, else lower-case alphanumerics."""
    out = F.regexp_replace(F.lower(model), "[^a-z0-9]", "")
    for subs, short in reversed(MODEL_SHORT_NAMES):
        cond = model.contains(subs[0])
        for x in subs[1:]:
            cond = cond | model.contains(x)
        out = F.when(cond, F.lit(short)).otherwise(out)
    return out


def bench_short(task: Column) -> Column:
    out = task
    for sub, short in reversed(BENCH_SHORT_NAMES):
        out = F.when(task.contains(sub), F.lit(short)).otherwise(out)
    return out


def output_name(model: Column, task: Column, limit: int | None = None) -> Column:
    """SK4: ``<model>_<benchmark>[_smoke<limit>]`` (use as a partition value or file stem)."""
    suffix = f"_smoke{limit}" if limit is not None else ""
    return F.concat(model_short(model), F.lit("_"), bench_short(task), F.lit(suffix))


def write_files(df: DataFrame, path_col: str = "path", content_col: str = "content") -> int:
    """One file per row, written by the tasks: a result tree of many small documents.  Returns the number of files.

    A file is written under its final name in one go, so a task that runs again writes the same bytes; an empty content gives a
    file without bytes.  Folders are made as needed, paths are what ``sources.filestatus`` can reach.
    """
    import pyarrow as pa

    from ..sources.filestatus import resolve

    def run(batches):
        made, n = set(), 0
        for batch in batches:
            for uri, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, path = resolve(uri)
                folder = path.rsplit("/", 1)[0]
                if folder not in made:
                    where.create_dir(folder, recursive=True)
                    made.add(folder)
                with where.open_output_stream(path, compression=None) as f:
                    f.write((content or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.select(path_col, content_col).mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
