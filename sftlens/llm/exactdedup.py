"""Exact deduplication against a persistent digest index.

Texts are equal when they are identical after every run of white space (space, tab to carriage return) is
replaced by one space; null counts as the empty text.  A text is known by the SHA-256 of that form.

The index is a Parquet table bucketed and sorted by digest, one row for each text ever seen.  New documents
come in as batches: the batch is reduced to one row per digest (partial aggregates, so a text that makes up a third of the
rows is one row per task before the shuffle), those rows meet the index in a sort-merge anti-join, and what
the index lacks is appended.  The index is read bucket by bucket and never shuffled; only the batch's
digests are, which are a few dozen bytes a document.  Decisions join the documents' digests with one row per text, a
join whose hot keys AQE can split.  Everything is DataFrame code; no text leaves the JVM.

Results of the edge cases: the smallest id stays, whatever the order of rows; null ids come after all
others; of rows that are equal in id and text exactly one stays; an empty table gives an empty result;
extra columns are ignored, whatever their names.  A batch that is added again after a failure
finds its own digests and changes nothing.
"""
from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import Scratch

SPACE = r"[\x20\x09-\x0D]+"
BATCHES = 4  # a whole table enters the index in so many batches of ascending ids


def digest(text: str) -> Column:
    """32 bytes: SHA-256 of the normalised text."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " "), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, digest) of every document; ``row`` tells repeated ids apart once the table is written."""
    return docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), digest(text_col).alias("digest"))


class DigestIndex:
    """The index in the folder ``path``, which is created if need be; a later session that opens it goes on with it.

    ``buckets`` is fixed when the folder is created (the session's shuffle partitions unless given).
    ``rows()`` is (digest, id, row): the first occurrence of each text.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), Scratch(spark, "digestindex")
        self.table = f"sftlens_digests_{xxhash.xxh3_64_hexdigest(self.path)}"
        jvm = spark.sparkContext._jvm
        spec = jvm.org.apache.hadoop.fs.Path(f"{self.path}/spec")
        if not spec.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spec):
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.sql(f"SELECT {buckets} AS buckets, '{id_type}' AS id_type").coalesce(1).write.parquet(f"{self.path}/spec")
        self.buckets, id_type = spark.read.parquet(f"{self.path}/spec").first()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, id {id_type}, row BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def firsts(self, batch: DataFrame) -> DataFrame:
        """First occurrence (digest, id, row) of each text of ``batch`` (id, row, digest), written once."""
        first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")
        return self.keep.write(batch.groupBy("digest").agg(first).select("digest", "first.id", "first.row"), "firsts")

    def new(self, firsts: DataFrame) -> DataFrame:
        """Rows of ``firsts`` whose text the index lacks: they are dealt as its buckets are, the index stays where it is."""
        return firsts.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, batch: DataFrame) -> None:
        """Append the texts that the index lacks: one sorted file for each bucket that gets rows."""
        self.new(self.firsts(batch)).write.insertInto(self.table)
        self.keep.drop("firsts")
        self.spark.catalog.refreshTable(self.table)

    def groups(self, batch: DataFrame) -> DataFrame:
        """Per text of ``batch`` (all of it added before): digest, keep_id, keep_row, group_size (its rows in the batch)."""
        sizes = batch.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")).repartition(self.buckets, "digest")
        first = self.rows().select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"))
        return sizes.join(first.hint("merge"), "digest")

    def close(self) -> None:
        """Forget the table in this session; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """All documents: doc_id, keep_id, group_size, kept, text_sha256, through an index that starts empty.

    The texts are read once.  Their digests enter in batches of ascending ids, so the
    first occurrence that the index keeps is that of the smallest id.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "exactdedup")
    rows = keep.write(digests(docs, id_col, text_col), "digests")
    cuts = rows.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    path = scratch_dir(spark, "exactdedup-index")
    index = DigestIndex(spark, path, id_type=dict(rows.dtypes)["id"])
    part = sum((F.coalesce(F.col("id") > c, F.lit(True)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    for i in range(len(set(cuts)) + 1):
        index.add(rows.where(part == i))
    groups = keep.write(index.groups(rows), "groups")  # both sides of the next join are then shuffled, so hot texts are split
    index.close()
    out = keep.write(rows.join(groups, "digest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256")), "decisions")
    keep.paths["index"] = path
    keep.drop("index", "digests", "groups")
    return out
