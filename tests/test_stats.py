from pyspark.sql import functions as F

from sftlens.operators.stats import fill_missing, percentile_linear, token_stats


def test_percentile_vector(spark):
    df = spark.createDataFrame([(float(x),) for x in range(10, 101, 10)], "v double")
    r = percentile_linear(df, "v", [50, 90, 95]).first()
    # bit-for-bit the reference rule: k = (p/100)*(n-1); s[f] + (s[f+1]-s[f])*(k-f)
    k = (95 / 100) * 9
    assert (r["p50"], r["p90"], r["p95"]) == (55.0, 91.0, 90 + 10 * (k - 8))
    assert abs(r["p95"] - 95.5) < 0.01
    one = percentile_linear(spark.createDataFrame([(42.0,)], "v double"), "v", [50]).first()
    assert one["p50"] == 42.0


def _gens(spark, data):
    return spark.createDataFrame(data, "model string, task string, tokens long, output string, key string")


def test_token_stats_task_and_pooled(spark):
    data = [("m", "a", 10, "x", "1"), ("m", "a", 20, "y", "2"), ("m", "a", 30, " ", "2"),
            ("m", "b", 32760, "z", "1"), ("m", "b", 5, "w", "9")]
    s = {(r["task"], r["level"]): r for r in token_stats(_gens(spark, data)).collect()}
    a = s[("a", "task")]
    assert (a["actual_samples"], a["total_output_tokens"], a["p50"], a["empty_output_count"],
            a["duplicate_count"], a["possibly_truncated_count"]) == (3, 60, 20, 1, 1, 0)
    b = s[("b", "task")]
    assert b["possibly_truncated_count"] == 1 and b["duplicate_count"] == 0
    o = s[(None, "overall")]
    # pooled statistics, and the key "1" in two tasks is not a duplicate
    assert (o["actual_samples"], o["max_output_tokens"], o["duplicate_count"], o["p50"]) == (5, 32760, 1, 20)
    assert o["avg_output_tokens"] == round((60 + 32765) / 5, 1)


def test_fill_missing_gives_zero_stats(spark):
    st = token_stats(_gens(spark, [("m", "a", 1, "x", "1")])).where(F.col("level") == "task")
    expected = spark.createDataFrame([("m", "a"), ("m", "missing")], "model string, task string")
    r = {x["task"]: x for x in fill_missing(st, expected, ["model", "task"]).collect()}
    assert r["missing"]["actual_samples"] == 0 and r["missing"]["p95"] == 0
