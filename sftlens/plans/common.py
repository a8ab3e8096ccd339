"""Shared pieces of the registered queries: table access and the stand-in mappings.

The driver tables stand in for the reference's files (see FIXTURES.md §B):
``documents`` rows are generation samples (``text`` = raw model output,
``source`` = task, ``lang`` = model).  Each mapping is written once here and
once, in DuckDB SQL, next to every oracle that needs it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import whitespace_token_count
from ..sources.tables import read_table

DEFAULT_MAX_GEN_TOKS = 32768
DEFAULT_MAX_MODEL_LEN = 40960


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (model, task, doc_id, sample_id, output, tokens)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("lang").alias("model"),
        F.col("source").alias("task"),
        F.col("doc_id"),
        F.concat_ws(":", F.col("source"), F.col("doc_id").cast("string")).alias("sample_id"),
        F.col("text").alias("output"),
        whitespace_token_count("text").alias("tokens"),
    )


def json_string_literal(c):
    """A string column as a JSON string literal: ``to_json(array(c))`` minus the brackets
    (a substring, not a regex pass over the whole text)."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


_STANDIN_FILES: dict[tuple, str] = {}


def standin_file(spark: SparkSession, key: tuple, build, name: str, write: bool = True) -> DataFrame:
    """A derived stand-in "file": built by Spark from the driver tables and written once
    per Spark application and data folder (in the shared checkpoint folder), like the
    file it models; every query then runs its full work over it.  Re-derived if the
    folder has gone.  Without ``write``, a file that is not there yet stays unwritten and its rows are derived where
    they are read: for queries that read them once and need the disk for what they write."""
    from ..session import scratch_dir

    k = (spark.sparkContext.applicationId, *key)
    path = _STANDIN_FILES.get(k)
    if path is not None:
        jvm = spark.sparkContext._jvm
        hp = jvm.org.apache.hadoop.fs.Path(path)
        if not hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp):
            path = None
    if path is None and not write:
        return build()
    if path is None:
        path = scratch_dir(spark, name)
        build().write.parquet(path)
        _STANDIN_FILES[k] = path
    return spark.read.parquet(path)
