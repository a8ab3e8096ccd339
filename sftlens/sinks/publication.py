"""Publication by pointer (SK2, SC4): immutable version folders and one small file that names the current one.

    <root>/versions/<version>/...     written once, never renamed or changed
    <root>/current.json               {"version": ..., "rows": ..., "previous": ...}

``publish`` writes a new version where it will stay, reads it back, validates and counts it, and only then replaces the
pointer.  Nothing is moved, so the cost on an object store is that of the write, and readers, who resolve the
pointer first, see the old version or the new one, never a mixture.  A crash at any point before the replacement leaves
the old version current and an unnamed folder that ``remove_unused`` deletes.  The pointer is replaced by a rename over
it where the file system's rename replaces atomically (HDFS, local and shared folders), else by writing the one small object,
which object stores make visible at once.  ``expected_version`` refuses to replace a pointer that someone else has moved.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_scope
from ..sources.jsonl import read_jsonl
from .writers import PublishError, write_jsonl

POINTER = "current.json"
RENAME_REPLACES = ("file", "hdfs", "viewfs")


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p, conf = sc._jvm.org.apache.hadoop.fs.Path(path), sc._jsc.hadoopConfiguration()
    return p, p.getFileSystem(conf), conf


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs, _ = _hadoop(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def current(spark: SparkSession, root: str) -> dict | None:
    """What the pointer says: version, rows, previous; None before the first publication."""
    p, fs, _ = _hadoop(spark, f"{root}/{POINTER}")
    if not fs.exists(p):
        return None
    return json.loads(spark.read.text(str(p), wholetext=True).first()[0])


def version_path(root: str, version: str) -> str:
    return f"{root}/versions/{version}"


def replace_pointer(spark: SparkSession, root: str, pointer: dict) -> None:
    """The one step that makes a version current."""
    target, fs, conf = _hadoop(spark, f"{root}/{POINTER}")
    if target.toUri().getScheme() not in (None, *RENAME_REPLACES) and fs.getScheme() not in RENAME_REPLACES:
        _write_text(spark, str(target), json.dumps(pointer))
        return
    fresh = f"{root}/.{POINTER}.{uuid.uuid4().hex}"
    _write_text(spark, fresh, json.dumps(pointer))
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf)
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(jvm.org.apache.hadoop.fs.Path(fresh), target, rename)


def publish(df: DataFrame, root: str, validate: Callable[[DataFrame, DataFrame], DataFrame], expected_count: int | None = None,
            expected_version: str | None = "", task: str = "export") -> str:
    """Publish ``df`` as JSON lines; returns the new version.  PublishError, and the old version stays, on any violation.

    ``validate(parsed, expected)`` is a rule set of ``operators.validate`` (violations as rows) over the lines read back;
    ``expected`` has ``task, expected``.  An empty export, and one of another size than ``expected_count``, is
    refused.  ``expected_version``: the version that must still be current (None: nothing published yet).

    Besides the version itself nothing as large is written: the lines are numbered by a second scan of the version's files,
    and what the rule set writes is deleted when its violations are known.
    """
    spark = df.sparkSession
    before = current(spark, root)
    if expected_version != "" and (before or {}).get("version") != expected_version:
        raise PublishError(f"{root} is at {(before or {}).get('version')}, not {expected_version}")
    version = f"{0 if before is None else int(before['version'].split('-')[0]) + 1:08d}-{uuid.uuid4().hex[:8]}"
    path, seen = version_path(root, version), Observation()
    write_jsonl(df.observe(seen, F.count(F.lit(1)).alias("rows")), path)
    rows = seen.get["rows"]
    found = [] if rows else [f"{task}: no rows"]
    if expected_count is not None and rows != expected_count:
        found.append(f"{task}: {rows} rows, expected {expected_count}")
    if not found:
        with scratch_scope(spark):
            parsed = read_jsonl(spark, path, on_error="collect", base=1, write=False).withColumn("task", F.lit(task))
            expected = spark.createDataFrame([(task, rows)], "task string, expected long")
            found = [f"{r['code']} (line {r['line']}): {r['detail']}" for r in validate(parsed, expected).limit(20).collect()]
    now = (current(spark, root) or {}).get("version")
    if not found and now != (before or {}).get("version"):
        found = [f"{root} moved to {now} meanwhile"]
    if found:
        p, fs, _ = _hadoop(spark, path)
        fs.delete(p, True)
        raise PublishError("; ".join(found))
    replace_pointer(spark, root, {"version": version, "rows": rows, "previous": (before or {}).get("version")})
    return version


def read_current(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The published records: the pointer is resolved once, so a reader stays on its version while another is published."""
    pointer = current(spark, root)
    if pointer is None:
        raise PublishError(f"nothing published in {root}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(version_path(root, pointer["version"]))


def remove_unused(spark: SparkSession, root: str) -> list[str]:
    """Delete the versions that are neither current nor the one before; returns their names.  For times without a publisher."""
    pointer = current(spark, root) or {}
    p, fs, _ = _hadoop(spark, f"{root}/versions")
    gone = []
    for status in fs.listStatus(p) if fs.exists(p) else ():  # one entry per version
        name = status.getPath().getName()
        if name not in (pointer.get("version"), pointer.get("previous")):
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
