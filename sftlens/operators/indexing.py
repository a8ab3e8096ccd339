"""Distributed dense row numbering (``row_number`` without funnelling a group into one task).

``row_number() OVER (PARTITION BY g ORDER BY k)`` puts every row of ``g`` in
one task; with ``g`` empty it puts the whole table there.  Instead:

1. range-partition on ``(g, k)`` and sort within partitions -- a hot ``g``
   is split over many partitions by the range bounds;
2. tag rows with ``monotonically_increasing_id`` (partition id in the high
   bits, position in the low 33) and write the result once as a table in the
   cluster's ``spark.checkpoint.dir`` -- the sampled range bounds and the ids
   are then fixed even if an executor is lost and a stage re-runs, and the
   ids travel as a column, so how the table is split on read does not matter;
3. per (partition, g): first id, last id and row count -- at most ``#partitions +
   #groups`` rows -- turned into running offsets by a window over that small table;
4. join the offsets back on partition and id range (four numbers a row: a broadcast
   join while that table is under the broadcast threshold in bytes) and add the
   position inside the range.  ``g`` itself is not a join key, so NULL groups count.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def dense_index(df: DataFrame, order: Sequence[str | Column], partition_by: Sequence[str] = (),
                base: int = 0, out: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0/1-based dense position of each row in ``order`` within ``partition_by``.

    ``order`` must be a total order (include a unique tie-breaker).
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in (*partition_by, *order)]
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ck = materialize(ranged.withColumn("_mid", F.monotonically_increasing_id()), "dense-index")
    ck = ck.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
    pcols = list(partition_by)
    blocks = ck.groupBy(*pcols, "_pid").agg(F.min("_mid").alias("_from"), F.max("_mid").alias("_to"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*pcols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_pid").alias("_bpid"), "_from", "_to", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    blocks = materialize(blocks, "dense-index-blocks")
    joined = ck.join(blocks, (F.col("_pid") == F.col("_bpid")) & F.col("_mid").between(F.col("_from"), F.col("_to")))
    return joined.withColumn(out, F.col("_off") + F.col("_mid") - F.col("_from") + F.lit(base)) \
                 .drop("_mid", "_pid", "_bpid", "_from", "_to", "_off")
