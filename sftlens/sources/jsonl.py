"""SC1/SC2: JSON-lines scan with a dense per-file line number and three error policies.

Line numbers: ``spark.read.text`` splits a file into blocks; within one block
rows keep file order.  The files are scanned once: every row is tagged with
``monotonically_increasing_id`` (partition in the high bits, position in the low
33) and written to a table in the shared checkpoint folder.  From that table come
the rows per (partition, file) -- a few numbers per file split -- and their running
offsets per file, which are added back by a join on the partition number: a
broadcast join as long as that narrow table is under the broadcast threshold in
bytes.  How the table is split when it is read again does not matter, since the tag
travels as a column.  Blank lines keep their number, as in the reference.

Where the lines are as large as the disk that they may take (a publication that is read back), ``write=False`` scans the
files twice instead, over partitions that are planned once: no table of lines is written.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, py_strip
from ..session import materialize
from .filestatus import path_kinds, resolve

POLICIES = ("fail", "collect", "drop")
# A repeated key in an object is not an error: the last one wins, as in Python.
LAST_KEY_WINS = "spark.sql.variant.allowDuplicateKeys"


def planned_once(df: DataFrame) -> DataFrame:
    """``df`` as the partitions that it has now: every pass over it reads the same rows in the same partitions, whatever
    becomes of split sizes and cores meanwhile.  Nothing is written; each pass computes the rows again."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def number_lines(raw: DataFrame, base: int = 1, write: bool = True) -> DataFrame:
    """Add ``line`` to rows ``text, file, _blk`` read from text files (batch or micro-batch).

    One pass over the files; rows come back exactly once, whatever the split sizes or cores
    of the two steps.  Without ``write`` (batch only, files that do not change) the files are scanned
    again instead of a table of their lines."""
    mid = F.monotonically_increasing_id()
    tagged = materialize(raw.withColumn("_mid", mid), "lines") if write else planned_once(raw).withColumn("_mid", mid)
    part = F.shiftright("_mid", 33)
    blocks = tagged.groupBy("file", "_blk", part.alias("_pid")).agg(
        F.min("_mid").alias("_from"), F.max("_mid").alias("_to"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # numbers only, and written, so that the planner knows its bytes
    blocks = materialize(blocks.select(F.col("_pid").alias("_bpid"), "_from", "_to", "_off"), "line-blocks")
    joined = tagged.join(blocks, (part == F.col("_bpid")) & F.col("_mid").between(F.col("_from"), F.col("_to")))
    keep = [c for c in raw.columns if c not in ("_mid", "_blk")]
    return joined.select(*keep, (F.col("_off") + F.col("_mid") - F.col("_from") + F.lit(base)).alias("line"))


def text_with_blocks(df: DataFrame) -> DataFrame:
    """``text, file, _blk`` from a text-source DataFrame (``value`` + file metadata)."""
    return df.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("_blk"))


def read_lines(spark: SparkSession, path: str | list[str], base: int = 1, write: bool = True) -> DataFrame:
    """Lines of text files: ``text, file, line`` (``base``-based, dense per file); ``write`` as in :func:`number_lines`."""
    paths = [path] if isinstance(path, str) else list(path)
    return number_lines(text_with_blocks(spark.read.text(paths)), base, write)


WHOLE = 32 << 20  # bytes up to which a task reads a file in one go
COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"
HELD = 4 << 20  # bytes of lines that a task holds before it passes them on


def read_named_lines(paths: DataFrame, path_col: str = "path", base: int = 1, whole: int = WHOLE) -> DataFrame:
    """Lines of the distinct files that a table names: ``text, file, line`` as :func:`read_lines` numbers them, ``file`` as named.

    For trees of many small files: the names are dealt over tasks, which read and number the lines, so neither the
    driver nor the plan of a scan lists files.  Files of more than ``whole`` bytes, compressed ones and folders (whose
    files keep their own names) are left to :func:`read_lines`, which splits files.  Names without a file have no lines.
    """
    spark = paths.sparkSession

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        text, file, line = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), pa.array(file, pa.string()), pa.array(line, pa.int64())], names=["text", "file", "line"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                where, path = resolve(name)
                with where.open_input_stream(path, compression=None) as f:
                    data = f.read()
                for n, text in enumerate(data.removeprefix(b"\xef\xbb\xbf").splitlines(), base):
                    held.append((text, name, n))
                    size += len(text) + 100
                    if size >= HELD:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    found = materialize(path_kinds(paths, path_col).where("length > 0"), "named-files")
    small = F.col("is_file") & (F.col("length") <= whole) & ~F.col("path").rlike(COMPRESSED)
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: the rows are names, not the bytes to be read
    lines = found.where(small).select("path").repartition(deal, "path").mapInArrow(read, "text binary, file string, line bigint")
    lines = lines.select(F.col("text").cast("string").alias("text"), "file", "line")
    large = found.where(~small).select("path")
    names = [r["path"] for r in large.toLocalIterator()]  # as few as their bytes allow
    if not names:
        return lines
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rest = read_lines(spark, names, base).withColumn("_as", plain(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))))
    rest = rest.join(F.broadcast(large.withColumn("_as", plain(F.col("path")))), "_as", "left")
    return lines.unionByName(rest.select("text", F.coalesce("path", "file").alias("file"), F.col("line").cast("bigint").alias("line")))


def parse_jsonl(lines: DataFrame, on_error: str = "fail", text_col: str = "text") -> DataFrame:
    """Parse non-blank lines into ``v VARIANT``.

    * ``fail``    -- a malformed line fails the job (``parse_json`` raises in the task)
    * ``collect`` -- keep every non-blank line; ``v`` is NULL and ``parse_error`` true when malformed
    * ``drop``    -- malformed lines are skipped
    ``NaN`` and other non-standard JSON count as malformed (Python would accept ``NaN``).
    """
    if on_error not in POLICIES:
        raise ValueError(f"on_error must be one of {POLICIES}")
    lines.sparkSession.conf.set(LAST_KEY_WINS, "true")
    body = lines.where(~is_blank(text_col))
    stripped = py_strip(text_col)
    if on_error == "fail":
        return body.withColumn("v", F.parse_json(stripped)).drop(text_col)
    parsed = body.withColumn("v", F.try_parse_json(stripped))
    if on_error == "drop":
        return parsed.where(F.col("v").isNotNull()).drop(text_col)
    return parsed.withColumn("parse_error", F.col("v").isNull())


def number_and_parse(raw: DataFrame) -> DataFrame:
    """:func:`number_lines`, then :func:`parse_jsonl` with ``collect``, of ``text, file, _blk`` in one pass: lines are parsed when
    they are tagged, so only the parsed rows are written.  The numbers are added where the result is read."""
    raw.sparkSession.conf.set(LAST_KEY_WINS, "true")
    blank = is_blank("text")
    lines = number_lines(raw.select(F.when(~blank, F.try_parse_json(py_strip("text"))).alias("v"), blank.alias("_blank"), "file", "_blk"))
    return lines.where(~F.col("_blank")).select("file", "line", "v", F.col("v").isNull().alias("parse_error"))


def read_jsonl(spark: SparkSession, path: str | list[str], on_error: str = "fail",
               base: int = 1, write: bool = True) -> DataFrame:
    """SC1+SC2: ``file, line, v`` (plus ``text, parse_error`` for ``collect``); ``write`` as in :func:`number_lines`."""
    return parse_jsonl(read_lines(spark, path, base, write), on_error)


def read_json_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SC3: one JSON document per file -> ``file, v`` (``v`` NULL when unreadable)."""
    spark.conf.set(LAST_KEY_WINS, "true")
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.option("wholetext", "true").text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file"),
                      F.try_parse_json(py_strip("value")).alias("v"))
