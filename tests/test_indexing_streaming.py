import os

from pyspark.sql import functions as F

from sftlens.operators.indexing import dense_index
from sftlens.streaming.ingest import ingest_samples, read_ingested


def test_dense_index_with_hot_group(spark):
    # one group holds a third of the rows; positions must be dense and ordered per group
    df = spark.range(0, 3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0))
                                     .otherwise(F.col("id") % 7 + 1).alias("g"))
    out = dense_index(df, ["id"], partition_by=["g"], out="pos", num_partitions=16)
    rows = out.select("g", "id", "pos", F.spark_partition_id().alias("p")).collect()
    by_group = {}
    for r in rows:
        by_group.setdefault(r["g"], []).append((r["id"], r["pos"]))
    for g, items in by_group.items():
        items.sort()
        assert [p for _, p in items] == list(range(len(items))), g
    assert len(by_group[0]) == 1000


def test_dense_index_global(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 500).alias("k"))
    got = sorted((r["k"], r["i"]) for r in dense_index(df, ["k"], base=1, out="i").collect())
    assert got == [(k, k + 1) for k in range(500)]


def test_ingest_reads_only_new_files(spark, tmp_dir):
    landing = os.path.join(tmp_dir, "landing")

    def stage(name, n0, n1):
        d = os.path.join(landing, name, "model=m", "task=t")
        os.makedirs(d)
        with open(os.path.join(d, "part-0.jsonl"), "w") as f:
            for i in range(n0, n1):
                f.write('{"doc_id": %d, "resps": [["x%d"]], "doc": {"problem": "p"}}\n' % (i, i))

    def flatten(parsed):
        return parsed.select("task", "model", "line", F.try_variant_get("v", "$.doc_id", "bigint").alias("doc_id"))

    sink, ck = os.path.join(tmp_dir, "sink"), os.path.join(tmp_dir, "ck")
    stage("s1", 0, 5)
    assert ingest_samples(spark, f"{landing}/*/*/*", sink, ck, flatten) >= 1
    stage("s2", 5, 8)
    ingest_samples(spark, f"{landing}/*/*/*", sink, ck, flatten)
    assert ingest_samples(spark, f"{landing}/*/*/*", sink, ck, flatten) == 0  # nothing new
    got = sorted(r["doc_id"] for r in read_ingested(spark, sink).collect())
    assert got == list(range(8))
    lines = sorted(r["line"] for r in read_ingested(spark, sink).where("doc_id >= 5").collect())
    assert lines == [1, 2, 3]
