"""ST2: rolling peak memory from the telemetry sampler, as an event-time stream.

``withWatermark`` bounds the state (windows older than the watermark are
finalised and dropped; samples later than that are ignored), the aggregate
is a tumbling ``window``, and the query runs in ``update`` mode: each
micro-batch writes the windows it changed to ``.../batch_id=<n>``; readers
take the maximum per window over all batches.  That equals the batch result as
long as no window gets a sample after the watermark has passed its end; rows dropped
for that reason are counted and returned.

Sampler timestamps are wall-clock strings parsed in the session time zone
(watermarks need a zoned TIMESTAMP); hourly windows align with wall-clock
hours in zones with whole-hour offsets, e.g. UTC.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..operators.attempts import parse_telemetry

TS_FORMAT = "yyyy/MM/dd HH:mm:ss"


def telemetry_peaks(spark: SparkSession, landing_glob: str, sink: str, checkpoint: str, window: str = "1 hour",
                    watermark: str = "10 minutes", max_files_per_trigger: int | None = None) -> dict[str, int]:
    """Run until the landing folder is drained: ``batches`` run and rows ``dropped`` by the watermark
    (partial maxima per window and micro-batch count as a row each)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(landing_glob)
    t = parse_telemetry(lines).withColumn(
        "ts", F.to_timestamp(py_strip(F.split(F.col("value"), ",", -1)[0]), TS_FORMAT))
    agg = (t.where(F.col("ts").isNotNull()).withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w")).agg(F.max("mem_used").alias("peak")))
    batches: list[int] = []
    running: list = []
    dropped: dict[tuple, int] = {}

    def note() -> None:
        """A query keeps its last 100 progress reports only, so they are gathered with every micro-batch."""
        for q in running:
            for p in q.recentProgress:
                dropped[p.runId, p.batchId, p.timestamp] = sum(int(op.numRowsDroppedByWatermark) for op in p.stateOperators)

    def process(df: DataFrame, batch_id: int) -> None:
        note()
        df.select(F.col("w.start").alias("window_start"), "peak") \
          .write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        batches.append(batch_id)

    q = (agg.writeStream.outputMode("update").foreachBatch(process)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    running.append(q)
    q.awaitTermination()
    note()
    return {"batches": len(batches), "dropped": sum(dropped.values())}


def read_peaks(spark: SparkSession, sink: str) -> DataFrame:
    """Final peak per window: the maximum over the per-batch updates."""
    return (spark.read.parquet(sink).groupBy("window_start")
            .agg(F.max("peak").cast("bigint").alias("peak")))
