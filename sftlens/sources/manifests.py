"""Result-tree scans: manifests, the active-run pointer and file discovery (SC3, SC4, SC8).

Layout per model result directory::

    <root>/active_run.json                               {"active_run_id": ..., "status": ...}
    <root>/runs/<run_id>/run_manifest.json
    <root>/runs/<run_id>/tasks/<task>/task_manifest.json

One recursive ``*.json`` scan reads every small JSON document of many result
trees at once (``wholetext``; ``.jsonl`` sample files are not matched), and
the file path tells what each document is.  File existence and size come from
a ``binaryFile`` listing whose content column is never selected (so never read).
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip
from .filestatus import path_status


def scan_json_tree(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``file, kind, root, run_id, task, v`` for every ``*.json`` under the roots
    (``v`` NULL when the document does not parse)."""
    raw = (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", "*.json").text(roots))
    f = F.col("_metadata.file_path")
    d = raw.select(f.alias("file"), F.try_parse_json(py_strip("value")).alias("v"))
    run_m = r"^(.*)/runs/([^/]+)/run_manifest\.json$"
    task_m = r"^(.*)/runs/([^/]+)/tasks/([^/]+)/task_manifest\.json$"
    ptr = r"^(.*)/active_run\.json$"
    kind = (F.when(F.col("file").rlike(task_m), F.lit("task_manifest"))
             .when(F.col("file").rlike(run_m), F.lit("run_manifest"))
             .when(F.col("file").rlike(ptr), F.lit("pointer")).otherwise(F.lit("other")))
    root = (F.when(F.col("file").rlike(task_m), F.regexp_extract("file", task_m, 1))
             .when(F.col("file").rlike(run_m), F.regexp_extract("file", run_m, 1))
             .when(F.col("file").rlike(ptr), F.regexp_extract("file", ptr, 1)))
    run_id = (F.when(F.col("file").rlike(task_m), F.regexp_extract("file", task_m, 2))
               .when(F.col("file").rlike(run_m), F.regexp_extract("file", run_m, 2)))
    task = F.when(F.col("file").rlike(task_m), F.regexp_extract("file", task_m, 3))
    return d.select("file", kind.alias("kind"), root.alias("root"), run_id.alias("run_id"),
                    task.alias("task"), "v")


def active_runs(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """SC4: per result root, the run named by its pointer: ``root, run_id, m, error``.

    ``roots`` (one column ``root``) lists the expected result directories, so a
    missing pointer still yields a row.  ``error`` is set (and ``m`` NULL) when
    the pointer is missing, has no id, or the run manifest is missing/unreadable
    -- the reference turns that into an error stats row.
    """
    ptr = tree.where(F.col("kind") == "pointer").select(
        "root", F.try_variant_get("v", "$['active_run_id']", "string").alias("run_id"))
    runs = tree.where(F.col("kind") == "run_manifest").select("root", "run_id", F.col("v").alias("m"))
    j = roots.join(ptr, "root", "left").join(runs, ["root", "run_id"], "left")
    err = (F.when(F.col("run_id").isNull(), F.lit("active_run.json missing or without active_run_id"))
             .when(F.col("run_id") == "", F.lit("active_run.json has an empty active_run_id"))
             .when(F.col("m").isNull(), F.concat(F.lit("run_manifest.json missing or unreadable for "),
                                                 F.col("run_id"))))
    return j.select("root", "run_id", F.when(err.isNull(), F.col("m")).alias("m"), err.alias("error"))


def task_manifests_of(tree: DataFrame, runs: DataFrame) -> DataFrame:
    """SC3: task manifests of the active runs only; unreadable ones are skipped."""
    tm = tree.where((F.col("kind") == "task_manifest") & F.col("v").isNotNull()) \
             .select("root", "run_id", "task", F.col("v").alias("m"), F.col("file").alias("manifest_file"))
    return tm.join(runs.where(F.col("error").isNull()).select("root", "run_id"), ["root", "run_id"], "left_semi")


def list_files(spark: SparkSession, roots: list[str], glob: str = "*") -> DataFrame:
    """``path, length`` of every file under the roots matching ``glob`` (content not read)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(roots).select("path", "length"))


def _glob_part(g: str) -> str:
    """Glob text -> regex: ``*`` and ``?`` stay within one path segment."""
    return "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in g)


def discover_first(listing: DataFrame, tasks: DataFrame, patterns: list[str]) -> DataFrame:
    """SC8: per task, the first (sorted) path matching any of the glob patterns
    (``{task}`` is substituted, once); a pattern without ``/`` is matched against the
    file name, one with ``/`` against the end of the path (like ``**/pattern``).

    ``tasks`` (column ``task``) and ``listing`` stay distributed: the path segment that holds the task's name gives
    candidates -- its parts after the pattern's literal start (after any letter if a wildcard stands before the name), of the
    lengths that task names have -- which are joined to the tasks; the whole pattern is then checked on
    the joined rows, and one aggregate keeps the minimum path.  Tasks with no match get a NULL path.
    ``listing`` may be ``list_files`` or, with files of no bytes, ``filestatus.list_tree``.
    """
    tasks = tasks.select("task").distinct()
    # at most as many lengths as a path segment is long
    lengths = F.array(*[F.lit(r[0]) for r in tasks.select(F.length("task")).distinct().collect() if r[0]]).cast("array<int>")
    found = None
    for p in patterns:
        head, sep, tail = p.partition("{task}")
        subject = F.regexp_extract("path", r"((?:[^/]+/){%d}[^/]+)$" % p.count("/"), 1)
        start = "^" + _glob_part(head)
        if not sep:
            hit = listing.where(subject.rlike(start + "$")).agg(F.min("path").alias("path")).where("path is not null")
            hit = tasks.crossJoin(F.broadcast(hit))  # one row
        else:
            before = head.rsplit("/", 1)[-1]
            segment = F.element_at(F.split(subject, "/"), head.count("/") + 1)
            files = listing.select("path", subject.alias("_subject"), segment.alias("_segment")).where("_segment <> ''")
            first = F.sequence(F.lit(1), F.length("_segment")) if set("*?") & set(before) else F.array(F.lit(len(before) + 1))
            names = F.flatten(F.transform(first, lambda i: F.transform(F.filter(lengths, lambda n: i + n - 1 <= F.length("_segment")),
                                                                       lambda n: F.col("_segment").substr(i, n))))
            files = files.withColumn("task", F.explode(F.array_distinct(names)))
            quoted = F.concat(F.lit("\\Q"), F.col("task"), F.lit("\\E"))
            rx = F.concat(F.lit(start), quoted, F.lit(_glob_part(tail) + "$"))
            hit = files.join(tasks, "task").where(F.regexp_like("_subject", rx)).select("task", "path")
        found = hit if found is None else found.unionByName(hit)
    return tasks.join(found.groupBy("task").agg(F.min("path").alias("path")), "task", "left")


def file_status(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, length`` of a few literal paths; :func:`filestatus.path_status` takes a table of them."""
    return path_status(spark.createDataFrame([(p,) for p in paths], "path string"))


def scan_partitioned_tree(spark: SparkSession, path: str) -> DataFrame:
    """The result tree as one table partitioned by ``root / run_id / task`` (written in a
    single Spark job), each row one document with its ``kind`` -- the same columns as
    :func:`scan_json_tree`, so :func:`active_runs` and :func:`task_manifests_of` apply."""
    t = spark.read.schema("kind string, doc string, root string, run_id string, task string").json(path)
    return t.select(F.col("_metadata.file_path").alias("file"), "kind", "root", "run_id", "task",
                    F.try_parse_json("doc").alias("v"))
