"""Order statistics of columns with (nearly) as many values as rows (A3)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order_stats import percentiles_by_selection
from .common import table

PCTS = (0, 5, 50, 90, 95, 99.9, 100)


def q_order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the discounted price by return flag, and of the discount (11 values) as one group.

    The splitters are few here so that several rounds of selection run on small tables too."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"), "l_discount")
    by_flag = percentiles_by_selection(li, "price", PCTS, ["l_returnflag"], splits=100, small=1000)
    discount = percentiles_by_selection(li, "l_discount", PCTS, splits=100, small=1000)
    return by_flag.withColumnRenamed("l_returnflag", "part").unionByName(discount.select(F.lit("all discounts").alias("part"), *discount.columns))


def _sql_percentile(p: float) -> str:
    k = f"(CAST({p / 100.0!r} AS DOUBLE) * (n - 1))"
    f = f"CAST(floor({k}) AS BIGINT)"
    return (f"CASE WHEN n = 1 OR {f} + 1 >= n THEN v[n] ELSE v[{f} + 1] + (v[{f} + 2] - v[{f} + 1]) * ({k} - {f}) END AS p{p:g}").replace("p99.9", "p99_9")


SQL_ORDER_STATISTICS = f"""
WITH x AS (SELECT l_returnflag AS part, l_extendedprice * (1 - l_discount) AS v FROM lineitem
           UNION ALL SELECT 'all discounts', l_discount FROM lineitem),
s AS (SELECT part, count(*) AS n, list_sort(list(v)) AS v FROM x GROUP BY part)
SELECT part, {", ".join(_sql_percentile(p) for p in PCTS)} FROM s
"""

QUERIES = {"order_statistics": q_order_statistics}
ORACLES = {"order_statistics": SQL_ORDER_STATISTICS}
