"""Percentiles by selection and the exact sample's cut key against sorting."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sftlens.operators import order_stats
from sftlens.operators.order_stats import percentiles_by_selection
from sftlens.operators.prepare import cut_key, sample_exact


def linear(values, p):
    s, k = sorted(values), p / 100.0 * (len(values) - 1)
    f = int(k)
    return float(s[f] if f + 1 >= len(s) else s[f] + (s[f + 1] - s[f]) * (k - f))


def check(spark, rows, pcts, kind, **options):
    df = spark.createDataFrame(rows, f"g string, h int, v {kind}").repartition(5)
    got = {(r["g"], r["h"]): tuple(r)[2:] for r in percentiles_by_selection(df, "v", pcts, ["g", "h"], **options).collect()}
    groups = {}
    for g, h, v in rows:
        if v is not None:
            groups.setdefault((g, h), []).append(v)
    assert got == {k: tuple(linear(vs, p) for p in pcts) for k, vs in groups.items()}


@pytest.mark.parametrize("splits,small", [(10, 20), (50, 200), (1000, 100_000)])
def test_percentiles_of_skewed_tied_and_null_groups(spark, splits, small):
    rng = random.Random(splits)
    rows = [("hot", 1, rng.uniform(-1e9, 1e9)) for _ in range(4000)] + [("hot", None, float(rng.choice([1, 2, 2, 2, 3]))) for _ in range(900)]
    rows += [(None, 1, rng.random() if rng.random() < 0.5 else 0.5) for _ in range(700)] + [(None, None, 7.0), ("one", 2, -0.5), ("none", 3, None), ("two", 0, 1.0), ("two", 0, 2.0)]
    check(spark, rows, (0, 50, 90, 99.5, 100), "double", splits=splits, small=small)


def test_percentiles_of_integers_beyond_doubles(spark):
    rng = random.Random(2)
    rows = [("a", 0, 2**60 + rng.randint(0, 5000) * 2**10) for _ in range(1500)]
    check(spark, rows, (25,), "long", splits=20, small=50)


def test_percentiles_without_groups_or_rows(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("v"))
    vs = [i * 7919 % 20_011 for i in range(20_000)]
    assert tuple(percentiles_by_selection(df, "v", (50, 90), splits=40, small=100).first()) == (linear(vs, 50), linear(vs, 90))
    assert percentiles_by_selection(df.where("v < 0"), "v", (50,)).count() == 0


def test_a_sketch_that_is_wrong_only_costs_a_sort(spark, monkeypatch):
    real = order_stats._brackets

    def wrong(*args):
        return real(*args).withColumn("want", F.transform("want", lambda w: w.withField("lo", w["hi"] + 1).withField("hi", w["hi"] + 2)))

    monkeypatch.setattr(order_stats, "_brackets", wrong)
    df = spark.range(5000).select((F.col("id") * 37 % 5003).cast("double").alias("v"))
    assert percentiles_by_selection(df, "v", (50, 99), splits=20, small=50).first()[0] == linear([i * 37 % 5003 for i in range(5000)], 50)


def test_no_window_and_no_shuffle_of_the_column(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    plan = percentiles_by_selection(df, "v", (50,), ["g"], splits=20, small=10)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def keys_of(ids, seed):
    return sorted((hashlib.md5(f"{seed}:{i}".encode()).digest(), i) for i in ids)


@pytest.mark.parametrize("fetch", [1, 4096])
def test_cut_key_by_levels(spark, monkeypatch, fetch):
    monkeypatch.setattr("sftlens.operators.prepare.FETCH", fetch)
    wanted = keys_of(range(500), 3)
    df = spark.range(500)
    keys = df.select(F.unhex(F.md5(F.concat(F.lit("3:"), F.col("id").cast("string")))).alias("k"))
    for n in (1, 250, 499):
        assert cut_key(keys, n) == wanted[n - 1][0] == cut_key(keys, n, distinct_keys=True)
        for write in (False, True):
            assert sorted(r[0] for r in sample_exact(df, n, 3, "id", write_keys=write).collect()) == sorted(i for _, i in wanted[:n])
    assert cut_key(keys, 500) is None and sample_exact(df, 0, 3, "id").count() == 0


def test_cut_key_among_keys_that_share_a_prefix(spark, monkeypatch):
    monkeypatch.setattr("sftlens.operators.prepare.FETCH", 10)
    rows = sorted(bytes([7] * 13) + i.to_bytes(3, "big") for i in range(300))
    keys = spark.createDataFrame([(bytearray(k),) for k in rows], "k binary")
    assert cut_key(keys, 123) == rows[122]


def test_sample_is_a_filter(spark):
    df = spark.range(1000).withColumn("text", F.lit("x"))
    plan = sample_exact(df, 10, 1, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_missing_ids_are_refused(spark):
    with pytest.raises(ValueError):
        sample_exact(spark.createDataFrame([(1,), (None,), (3,)], "id long"), 1, 1, "id")
