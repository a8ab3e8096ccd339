"""Session helpers: a local session for tests/bench and a shared checkpoint folder."""
from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings the jobs are designed around on a large cluster (apply in spark-submit or
# the session builder; nothing here is required for correctness: the parsers set the one
# setting that they depend on).
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",                       # runtime re-planning
    "spark.sql.adaptive.coalescePartitions.enabled": "true",    # start high, merge small
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",              # split hot join keys
    "spark.sql.shuffle.partitions": "20000",                    # upper bound; AQE coalesces
    "spark.sql.files.maxPartitionBytes": "256m",                # scan split size
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.variant.allowDuplicateKeys": "true",             # last key wins, as in Python json
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "sftlens") -> SparkSession:
    """A local session configured the way the cluster jobs expect (AQE on, UTC, no UI)."""
    parts = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a local
    master gets a folder of its own; any other raises, since executors would each
    write to a disk of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="sftlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, for job-owned intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    import uuid

    path = f"{base.rstrip('/')}/sftlens-{name}-{uuid.uuid4().hex[:12]}"
    made = _SCOPE.get()
    if made is not None:
        made.append(path)
    return path


_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch folders named inside are deleted at the end, for work whose results are all written by then
    (a micro-batch, say).  DataFrames over them must not be used afterwards."""
    made: list[str] = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def materialize(df, name: str, compression: str | None = None):
    """Write ``df`` once as parquet into a fresh folder under the shared checkpoint folder
    and return a DataFrame reading it: the lineage is cut (executor loss re-reads the
    table instead of recomputing upstream), and unlike ``Dataset.checkpoint`` the
    input is computed only once.  ``compression``: the codec, if not the session's."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)
