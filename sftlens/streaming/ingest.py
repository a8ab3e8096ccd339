"""ST1: ingest new generation-sample files incrementally, never reprocessing finished ones.

A file-source stream over the landing folder, ``trigger(availableNow=True)``
and a checkpoint: each run picks up only files not yet committed in the
checkpoint, then stops.  Every micro-batch is validated (V1) and flattened
(export) as ordinary DataFrame jobs inside ``foreachBatch``; outputs are
written to ``.../batch_id=<n>`` with overwrite, so a retried batch replaces
its own output instead of duplicating it (exactly-once at the sink).  The scratch
tables of a micro-batch are deleted when it is done.

With ``state`` the stream also remembers, over all its runs, which ids of a (model, task) it has met and how
many samples came.  The state is a table of increments, one folder per micro-batch: ``ids`` has one row per id
(its first position), ``counts`` one per (model, task).  A micro-batch joins its ids with the increments
before it, so a repeat in a later file or run is an error like one in the same file, and a retried batch
ignores and replaces its own increment.  The ids of a micro-batch are the small side of that join: what was met
before is filtered by them where it is read.  (A keyed streaming state would hold the same rows, but hands
them to Python one id at a time.)  ``short_counts`` compares the counts with the expected ones at the end.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variant import extract_doc_id, py_str, typed_key
from ..operators.quality import reconcile_counts
from ..operators.validate import validate_samples
from ..session import materialize, scratch_scope
from ..sources.jsonl import number_and_parse, text_with_blocks

# The landing layout: <landing>/<stage>/model=<model>/task=<task>/<file>.
PATH_MODEL = r"/model=([^/]+)/"
PATH_TASK = r"/task=([^/]+)/"
SEEN = "model string, task string, key string, file string, line bigint"
REPEAT = "model string, task string, file string, line bigint, detail string, first_file string, first_line bigint"


def ingest_samples(spark: SparkSession, landing_glob: str, sink: str, checkpoint: str,
                   flatten: Callable[[DataFrame], DataFrame], max_files_per_trigger: int | None = None,
                   state: str | None = None) -> int:
    """Run the ingest stream until the landing folder is drained; return the number of
    micro-batches run.  ``flatten(parsed)`` turns parsed sample rows (``task, model,
    line, v``) into export rows.  ``state``: folder of the state that runs share (see above); repeats
    over files and runs then go to ``<sink>/repeats`` (:data:`REPEAT`)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = text_with_blocks(reader.load(landing_glob))
    batches: list[int] = []

    def process(df: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):
            # read and parsed once, written once: validation, flattening and state read that table
            parsed = number_and_parse(df).withColumn("task", F.regexp_extract("file", PATH_TASK, 1)) \
                                         .withColumn("model", F.regexp_extract("file", PATH_MODEL, 1))
            validate_samples(parsed, scope=("model", "task", "file")).write.mode("overwrite").parquet(f"{sink}/errors/batch_id={batch_id}")
            good = parsed.where(~F.col("parse_error"))
            flatten(good).write.mode("overwrite").parquet(f"{sink}/exported/batch_id={batch_id}")
            if state:
                remember(spark, parsed, state, f"{sink}/repeats", batch_id)
        batches.append(batch_id)

    q = (stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return len(batches)


def remember(spark: SparkSession, parsed: DataFrame, state: str, repeats: str, batch_id: int) -> None:
    """One micro-batch against the state: writes its repeats, then its increments."""
    did = extract_doc_id(F.col("v"), F.col("line"))
    ids = materialize(parsed.where(~F.col("parse_error")).select("model", "task", typed_key(did).alias("key"), py_str(did).alias("shown"), "file", "line"), "ingest-ids")
    keys = ["model", "task", "key"]
    firsts = materialize(ids.groupBy(*keys).agg(F.min(F.struct("file", "line")).alias("at")).select(*keys, "at.file", "at.line"), "ingest-firsts")
    increments = [f"{state}/ids/batch_id={n}" for n in earlier(spark, f"{state}/ids", batch_id)]
    met = spark.read.schema(SEEN).parquet(*increments) if increments else spark.createDataFrame([], SEEN)
    before = materialize(met.join(firsts.select(*keys), keys, "left_semi"), "ingest-before")  # as many rows as the batch has ids, at most
    origin = before.unionByName(firsts.join(before, keys, "left_anti")).select(*keys, F.col("file").alias("first_file"), F.col("line").alias("first_line"))
    again = ids.join(origin, keys).where(~((F.col("file") == F.col("first_file")) & (F.col("line") == F.col("first_line"))))
    again.select("model", "task", "file", "line", F.concat(F.lit("doc_id="), "shown").alias("detail"), "first_file", "first_line") \
        .write.mode("overwrite").parquet(f"{repeats}/batch_id={batch_id}")
    firsts.join(before, keys, "left_anti").write.mode("overwrite").parquet(f"{state}/ids/batch_id={batch_id}")
    parsed.groupBy("model", "task").agg(F.count(F.lit(1)).alias("actual")).write.mode("overwrite").parquet(f"{state}/counts/batch_id={batch_id}")


def earlier(spark: SparkSession, path: str, batch_id: int) -> list[int]:
    """Numbers of the micro-batches before ``batch_id`` that left an increment (one folder each)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in (int(x.partition("=")[2]) for x in names if x.startswith("batch_id=")) if n < batch_id)


def short_counts(spark: SparkSession, state: str, expected: DataFrame) -> DataFrame:
    """J3 over all runs: (model, task) of ``expected`` (model, task, expected) whose samples so far are not as many."""
    key = F.struct("model", "task").alias("key")
    actual = spark.read.schema("model string, task string, actual bigint").parquet(f"{state}/counts").groupBy(key).agg(F.sum("actual").alias("actual"))
    off = reconcile_counts(expected.select(key, "expected"), actual, "key")
    return off.select("key.model", "key.task", "expected", "actual")


def read_ingested(spark: SparkSession, sink: str, what: str = "exported") -> DataFrame:
    return spark.read.parquet(f"{sink}/{what}")
