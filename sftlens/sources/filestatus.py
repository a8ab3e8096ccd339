"""File status at scale: which files exist and how long they are, zero-length files included.

File scans of Spark skip files without bytes, and their listing is the driver's; metadata calls on the driver are serial.
Here tasks ask the shared file system themselves (``pyarrow.fs``: local and shared folders, ``s3://``,
``gs://``, ``hdfs://``), so neither the number of files nor of folders passes through the driver:

* ``path_status``: the paths that a table names, dealt over tasks; each task asks for a batch at a time.
* ``list_tree``: a data source (``file_status``) whose partitions are folders of a tree.  The driver reads the names
  of the folders of the first ``depth`` levels only (models and runs, say); each partition walks its folders.

A folder written by Spark stands for one file: its length is that of its data parts.
"""
from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY = "path string, folder string, name string, is_file boolean, length bigint"
BATCH = 4096

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need pyarrow, not this package


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a plain path or a URI; ``file:/x`` is a form that Hadoop writes."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def children(where: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    return sorted(where.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda i: i.base_name)


def is_data(name: str) -> bool:
    return not name.startswith(("_", "."))


@dataclass
class Folders(InputPartition):
    """Folders (below the root) of one partition; the ``shallow`` ones are listed without what is below them."""

    deep: list[str]
    shallow: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.depth, self.slots = int(options.get("depth", 1)), int(options.get("numpartitions", 8))

    def partitions(self) -> list[Folders]:
        where, base = resolve(self.root)
        level, shallow = [""], []
        for _ in range(self.depth):
            shallow += level
            level = [f"{at}/{i.base_name}" for at in level for i in children(where, base + at) if i.type == fs.FileType.Directory]
        dealt = [Folders([], []) for _ in range(max(1, self.slots))]
        for at in level:
            dealt[zlib.crc32(at.encode()) % len(dealt)].deep.append(at)
        for at in shallow:
            dealt[zlib.crc32(at.encode()) % len(dealt)].shallow.append(at)
        return [p for p in dealt if p.deep or p.shallow] or dealt[:1]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        where, base = resolve(self.root)
        todo, rows = [(at, True) for at in partition.deep] + [(at, False) for at in partition.shallow], []
        while todo:
            at, deep = todo.pop()
            for i in children(where, base + at):
                below = i.type == fs.FileType.Directory
                if below and deep:
                    todo.append((f"{at}/{i.base_name}", True))
                rows.append((f"{self.root}{at}/{i.base_name}", self.root + at, i.base_name, not below, 0 if below else i.size))
                if len(rows) == BATCH:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["path", "folder", "name", "is_file", "length"])


class FileStatusSource(DataSource):
    """``spark.read.format("file_status").option("depth", 2).load(root)`` after ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "file_status"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def list_tree(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """``path, folder, name, is_file, length`` of every file and folder below ``root``, files without bytes included.

    A partition is a share of the folders ``depth`` levels below the root, so ``depth`` should reach the level with enough
    folders to keep the cluster busy.  Paths start with ``root`` as it was given.  A root that does not exist has no rows.
    """
    spark.dataSource.register(FileStatusSource)
    slots = spark.conf.get("spark.sql.shuffle.partitions")
    return spark.read.format("file_status").option("depth", depth).option("numPartitions", slots).load(root)


def named_lengths(tree: DataFrame) -> DataFrame:
    """``path, length`` of everything in a ``list_tree`` that a manifest may name: files, and folders as the sum of their
    data parts (0 for a folder without any)."""
    data = F.col("is_file") & ~F.col("name").rlike("^[_.]")
    parts = tree.where(data).groupBy(F.col("folder").alias("path")).agg(F.sum("length").alias("parts"))
    folders = tree.where(~F.col("is_file")).select("path").join(parts, "path", "left")
    return tree.where("is_file").select("path", "length").unionByName(
        folders.select("path", F.coalesce("parts", F.lit(0)).cast("bigint").alias("length")))


def path_status(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``path, length`` for the distinct paths of a table that exist; null and empty names are left out."""
    return path_kinds(paths, path_col).select("path", "length")


def path_kinds(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``path_status`` and ``is_file``.

    The distinct is the shuffle that deals the paths, so a few hot folders are spread over all tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            by_system: dict = {}
            for name in names:
                where, path = resolve(name)
                by_system.setdefault(where.type_name, (where, []))[1].append((name, path))
            found = []
            for where, asked in by_system.values():
                for (name, path), info in zip(asked, where.get_file_info([p for _, p in asked])):
                    if info.type == fs.FileType.File:
                        found.append((name, info.size, True))
                    elif info.type == fs.FileType.Directory:
                        found.append((name, sum(i.size for i in children(where, path) if i.type == fs.FileType.File and is_data(i.base_name)), False))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))], names=["path", "length", "is_file"])

    named = paths.select(F.col(path_col).cast("string").alias("path")).where("path <> ''").distinct()
    return named.mapInArrow(run, "path string, length bigint, is_file boolean")
