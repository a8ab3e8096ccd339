"""Work that does not start over: merged token statistics (A1, A2, ST1) and the rewrite of pending tasks (J4, SK1, SK4)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.increments import add_increment, merge_increments, stats_of_histogram
from ..operators.quality import resume_pending
from ..session import materialize, scratch_dir
from ..sinks.writers import rewrite_partitions, write_jsonl
from ..sources.filestatus import list_tree
from .common import DEFAULT_MAX_GEN_TOKS, generations
from .stats_queries import SQL_TOKEN_STATS


def q_token_stats_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three increments (by ``doc_id % 3``; the second is written twice, as after a failure) equal a full computation."""
    path, g = scratch_dir(spark, "token-increments"), generations(spark, sf_dir)
    for n in (0, 1, 1, 2):
        add_increment(g.where(F.col("doc_id") % 3 == n), path, n)
    return stats_of_histogram(merge_increments(spark, path), DEFAULT_MAX_GEN_TOKS)


def q_rewrite_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tasks are exported, those of which documents with ``doc_id % 50 = 7`` were lost are pending and exported again.
    Per (model, task): rows now, and whether its files are other ones than before; no other task's may be."""
    base = scratch_dir(spark, "pending")
    g = generations(spark, sf_dir).select("model", "task", "doc_id", "sample_id")
    write_jsonl(g.where("doc_id % 50 <> 7").select("model", "task", "sample_id"), base, partition_by=("model", "task"))
    expected = g.groupBy("model", "task").agg(F.count(F.lit(1)).alias("expected"))
    written = "model string, task string, sample_id string"
    there = spark.read.schema(written).json(base).groupBy("model", "task").agg(F.count(F.lit(1)).alias("actual"))
    pending = materialize(resume_pending(expected.join(there, ["model", "task"], "left"), [("incomplete", F.col("actual") == F.col("expected"))]), "pending")
    names = lambda: list_tree(spark, base, depth=2).where("is_file and name like 'part-%'").select("folder", "name")
    before = materialize(names(), "files-before")
    rewrite_partitions(g.select("model", "task", "sample_id"), base, pending, ("model", "task"))
    new = names().join(before, ["folder", "name"], "left_anti").select(
        F.regexp_extract("folder", "model=([^/]+)/", 1).alias("model"), F.regexp_extract("folder", "task=([^/]+)$", 1).alias("task")).distinct().withColumn("new", F.lit(True))
    now = spark.read.schema(written).json(base).groupBy("model", "task").agg(F.count(F.lit(1)).alias("n"))
    return now.join(new, ["model", "task"], "left").select("model", "task", "n", F.coalesce("new", F.lit(False)).alias("rewritten"))


SQL_TOKEN_STATS_MERGED = f"SELECT * EXCLUDE (duplicate_count) FROM ({SQL_TOKEN_STATS})"

SQL_REWRITE_PENDING = "SELECT lang AS model, source AS task, count(*) AS n, bool_or(doc_id % 50 = 7) AS rewritten FROM documents GROUP BY 1, 2"

QUERIES = {"token_stats_merged": q_token_stats_merged, "rewrite_pending": q_rewrite_pending}
ORACLES = {"token_stats_merged": SQL_TOKEN_STATS_MERGED, "rewrite_pending": SQL_REWRITE_PENDING}
