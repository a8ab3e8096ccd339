import os

from pyspark.sql import functions as F

from sftlens.operators.compare import generation_complete, tokens_per_s
from sftlens.streaming.telemetry import read_peaks, telemetry_peaks


def test_tokens_per_s_and_completeness(spark):
    df = spark.createDataFrame([(3000, 300, "complete", 6, 6, 0), (3000, 0, "complete", 6, 6, 0),
                                (10, 3, "running", 6, 6, 0), (10, 3, "complete", 5, 6, 0),
                                (10, 3, "complete", 6, 6, 1)],
                               "tok long, secs long, status string, actual long, expected long, empty long")
    got = df.select(tokens_per_s(F.col("tok"), F.col("secs")).alias("tps"),
                    generation_complete(F.col("status"), F.col("actual"), F.col("expected"), F.col("empty"))
                    .alias("done")).collect()
    assert [r["tps"] for r in got] == [10.0, 0.0, 3.3, 3.3, 3.3]
    assert [r["done"] for r in got] == [True, True, False, False, False]


def test_telemetry_stream_drops_late_samples(spark, tmp_dir):
    landing, sink, ck = (os.path.join(tmp_dir, x) for x in ("landing", "sink", "ck"))

    def stage(name, lines):
        d = os.path.join(landing, name)
        os.makedirs(d)
        with open(os.path.join(d, "gpu.log"), "w") as f:
            f.write("\n".join(lines) + "\n")

    stage("b1", ["2026/07/19 10:00:05, 30000, 46068, 90", "2026/07/19 12:30:00, 45000, 46068, 99"])
    assert telemetry_peaks(spark, f"{landing}/*", sink, ck)["dropped"] == 0
    # 10:00 is far behind the watermark (12:30 - 10 min): its window is closed
    stage("b2", ["2026/07/19 10:00:10, 46000, 46068, 99", "2026/07/19 12:40:00, 41000, 46068, 99"])
    assert telemetry_peaks(spark, f"{landing}/*", sink, ck)["dropped"] == 1
    peaks = {r["window_start"].hour: r["peak"] for r in read_peaks(spark, sink).collect()}
    assert peaks == {10: 30000, 12: 45000}


def test_late_samples_are_counted_beyond_the_kept_reports(spark, tmp_dir):
    landing, sink, ck = (os.path.join(tmp_dir, x) for x in ("landing", "sink", "ck"))
    os.makedirs(landing)
    lines = ["2026/07/19 12:30:00, 1, 46068, 99"] + [f"2026/07/19 0{h}:00:10, 5, 46068, 99" for h in range(1, 7)]
    for n, line in enumerate(lines):
        path = os.path.join(landing, f"{n}.log")
        with open(path, "w") as f:
            f.write(line + "\n")
        os.utime(path, (1_700_000_000 + 60 * n,) * 2)  # files are taken in this order
    setting = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(setting, "2")
    try:
        got = telemetry_peaks(spark, landing, sink, ck, max_files_per_trigger=1)
    finally:
        spark.conf.unset(setting)
    kept = {r["window_start"].hour for r in read_peaks(spark, sink).collect()}
    assert kept == {1, 12}  # a micro-batch drops by the watermark that was known when the one before began
    assert got["batches"] >= len(lines) and got["dropped"] == 5
