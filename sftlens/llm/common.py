"""Helpers shared by the operators of this subpackage: word hashing, bounded bitmaps,
column selection and distributed connected components."""
from __future__ import annotations

import sys
import types

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources.tables import read_table

# Entries kept by a word-hash memo (about 40 MB).
MEMO_WORDS = 150_000
BITMAP_BLOCK = 32768  # bits in one bitmap_construct_agg result


def per_worker(key, make):
    """``make()`` once per Python worker process: tasks that run there later get the same
    object.  One object is held at a time; the last one goes before the next is made."""
    store = sys.modules.setdefault("_sftlens_per_worker", types.ModuleType("_sftlens_per_worker")).__dict__
    if "value" not in store or store["key"] != key:
        store.pop("value", None)
        store.update(key=key, value=make())
    return store["value"]


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Whole texts travel to Python in batches of at most so many rows: a batch, and what is made
    of it, then takes tens of MB."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(conf)) > rows:
        spark.conf.set(conf, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return read_table(spark, sf_dir, name)


class WordHash(dict):
    """bytes -> 64-bit hash, memoised; the memo is bounded.  Starting one lets go of what an
    earlier job left in the worker (``per_worker``)."""

    def __init__(self):
        super().__init__()
        per_worker(None, lambda: None)

    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = h
        return h

    def array(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)


def bitmap_rows(df: DataFrame, bit: Column) -> DataFrame:
    """``bit`` (0-based positions) as bitmap blocks: (block, bits binary of 4096 bytes).  Bits
    are shuffled before they are gathered, else every task would send every block."""
    return (df.select(bit.alias("_bit")).withColumn("block", F.expr(f"_bit div {BITMAP_BLOCK}")).repartition("block")
            .groupBy("block").agg(F.expr(f"bitmap_construct_agg(_bit % {BITMAP_BLOCK})").alias("bits")))


def collect_bitmap(df: DataFrame, bit: Column, log2_bits: int) -> np.ndarray:
    """The bitmap as ``2**log2_bits / 8`` bytes: its size is a parameter, whatever the input."""
    out = np.zeros((1 << log2_bits) // 8, dtype=np.uint8)
    step = BITMAP_BLOCK // 8
    for block, bits in bitmap_rows(df, bit).collect():  # as many bytes as the bitmap
        out[block * step:(block + 1) * step] = np.frombuffer(bytes(bits), np.uint8)
    return out


def test_bits(bitmap: np.ndarray, pos: np.ndarray) -> np.ndarray:
    pos = pos.astype(np.int64)
    return (bitmap[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1


def split_by_keys(df: DataFrame, keys: DataFrame, key: str, key_in_keys: str | None = None, log2_bits: int = 23) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``key`` is certainly not in ``keys`` (null keys too), and the others.

    A bitmap of hashed keys (1 MB whatever the input) is broadcast as rows of 4 KB, so no row of
    ``df`` is shuffled.  ``keys`` must be cheap to read; both columns must be of one type.
    """
    n = 1 << log2_bits
    bit = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(n))
    maps = bitmap_rows(keys, bit(key_in_keys or key)).withColumnsRenamed({"block": "_block", "bits": "_bits"})
    byte = F.conv(F.hex(F.expr("substring(_bits, cast((_pos % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    cols = [F.col(f"`{c}`") for c in df.columns]
    marked = (df.withColumn("_pos", bit(key)).withColumn("_block", F.expr(f"_pos div {BITMAP_BLOCK}"))
              .join(F.broadcast(maps), "_block", "left").withColumn("_byte", byte)
              .withColumn("_hit", F.col(key).isNotNull() & F.coalesce(F.expr("shiftright(_byte, cast(_pos % 8 as int)) & 1") == 1, F.lit(False))))
    return marked.where(~F.col("_hit")).select(*cols), marked.where("_hit").select(*cols)


def semi_join_prefiltered(df: DataFrame, keys: DataFrame, key: str, log2_bits: int = 23) -> DataFrame:
    """``df`` left-semi ``keys`` without shuffling most non-matching rows of ``df``."""
    return split_by_keys(df, keys, key, log2_bits=log2_bits)[1].join(keys.select(key).distinct(), key, "left_semi")


class Scratch:
    """Tables of one job in the shared checkpoint folder.  Writing one cuts the lineage: a lost
    executor re-reads it.  ``drop`` removes a table once nothing reads it any more.  Shuffle
    files of a finished write are removed at once, so disk use is that of the current step."""

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.job, self.paths = spark, job, {}
        spark.conf.set(self.CLEANUP, "true")
        small_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_dir(self.spark, f"{self.job}-{name}")
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst longs): component is the
    smallest node reachable.  Alternating large-star and small-star rounds; each round is
    written to the checkpoint folder, so a lost executor never recomputes the chain.
    Hubs: minima are partial aggregates, and the join back is one AQE can split."""
    keep = Scratch(edges.sparkSession, name)
    cur = keep.write(edges.where("src <> dst")
                     .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "0")
    for i in range(max_rounds + 1):
        # stars: every node points at one head, and no head points anywhere
        n, nodes = cur.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
        if n == nodes and cur.select("v").join(cur.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        if i == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = keep.write(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        cur = keep.write(small, str(i + 1))
        keep.drop("large", str(i))
    heads = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads.distinct())
