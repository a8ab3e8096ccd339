"""File status by tasks, trees of one file per document, first of several patterns, repeats on ties."""
import json
import os

import pytest
from pyspark.sql import functions as F

from sftlens.operators.quality import later_rows
from sftlens.operators.validate import validate_export_file, validate_samples
from sftlens.sinks.writers import write_files
from sftlens.sources import filestatus
from sftlens.sources.jsonl import read_jsonl
from sftlens.sources.manifests import discover_first


def make_tree(spark, root, names):
    df = spark.createDataFrame([(f"{root}/{n}", c) for n, c in names.items()], "path string, content string")
    assert write_files(df) == len(names)


TREE = {"m1/t1/a.json": "{}", "m1/t1/b.json": "", "m1/t2/c/d/e.json": "xyz", "m2/f.json": None, "top.json": "é", "m1/t1/_meta": "not data", "m2/with space/+%.json": "1"}


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
@pytest.mark.parametrize("depth", [0, 1, 2, 9])
def test_tree_lists_files_without_bytes(spark, tmp_dir, scheme, depth):
    root = f"{scheme}{tmp_dir}"
    make_tree(spark, tmp_dir, TREE)
    os.makedirs(f"{tmp_dir}/m3/empty")
    rows = filestatus.list_tree(spark, root, depth).collect()
    files = {r["path"]: r["length"] for r in rows if r["is_file"]}
    assert files == {f"{root}/{n}": len((c or "").encode()) for n, c in TREE.items()}
    folders = sorted(r["path"][len(root) + 1:] for r in rows if not r["is_file"])
    assert folders == ["m1", "m1/t1", "m1/t2", "m1/t2/c", "m1/t2/c/d", "m2", "m2/with space", "m3", "m3/empty"]
    named = {r["path"][len(root) + 1:]: r["length"] for r in filestatus.named_lengths(filestatus.list_tree(spark, root, depth)).collect()}
    assert named["m1/t1"] == 2 and named["m3/empty"] == 0 and named["m1/t2"] == 0 and named["m1/t1/b.json"] == 0


def test_tree_that_is_not_there(spark, tmp_dir):
    assert filestatus.list_tree(spark, f"{tmp_dir}/no").count() == 0


def test_folders_are_dealt_over_partitions(tmp_dir):
    for i in range(40):
        os.makedirs(f"{tmp_dir}/m{i}")
        open(f"{tmp_dir}/m{i}/x", "w").close()
    reader = filestatus.TreeReader({"path": tmp_dir, "depth": "1", "numpartitions": "8"})
    parts = reader.partitions()
    assert len(parts) == 8 and max(len(p.deep) for p in parts) < 20
    seen = [p for part in parts for b in reader.read(part) for p in b.column(0).to_pylist()]
    assert len(seen) == len(set(seen)) == 80


def test_status_of_thousands_of_named_paths(spark, tmp_dir):
    df = spark.range(3000).select(F.concat(F.lit(f"{tmp_dir}/d"), F.col("id") % 7, F.lit("/"), "id").alias("path"),
                                  F.when(F.col("id") % 3 == 0, "").otherwise(F.col("id").cast("string")).alias("content"))
    write_files(df.where("content <> '5'"))
    spark.createDataFrame([(1,)], "n int").write.json(f"{tmp_dir}/folder")
    os.makedirs(f"{tmp_dir}/bare")
    named = df.select("path").unionByName(df.select("path")).unionByName(
        spark.createDataFrame([(None,), ("",), (f"{tmp_dir}/folder",), (f"{tmp_dir}/bare",), (f"file:{tmp_dir}/d1/1",)], "path string"))
    got = {r["path"]: r["length"] for r in filestatus.path_status(named).collect()}
    assert got.pop(f"{tmp_dir}/folder") == 8 and got.pop(f"{tmp_dir}/bare") == 0 and got.pop(f"file:{tmp_dir}/d1/1") == 1
    assert got == {f"{tmp_dir}/d{i % 7}/{i}": 0 if i % 3 == 0 else len(str(i)) for i in range(3000) if i != 5}


def test_validation_reports_missing_and_empty_files(spark, tmp_dir):
    sample = {"doc_id": 1, "prompt": "p", "resps": ["x"]}
    make_tree(spark, tmp_dir, {"ok.jsonl": json.dumps(sample), "none.jsonl": ""})
    files = spark.createDataFrame([("ok", f"{tmp_dir}/ok.jsonl"), ("none", f"{tmp_dir}/none.jsonl"), ("gone", f"{tmp_dir}/gone.jsonl"), ("unnamed", None)], "task string, path string")
    parsed = read_jsonl(spark, f"{tmp_dir}/*.jsonl", on_error="collect").withColumn("task", F.lit("ok"))
    got = sorted((r["task"], r["code"]) for r in validate_samples(parsed, files=files).collect())
    assert got == [("gone", "file_not_found"), ("none", "file_empty"), ("unnamed", "file_missing")]
    codes = {(r["task"], r["code"]) for r in validate_export_file(parsed, files=files).collect()}
    assert {("gone", "file_not_found"), ("none", "file_empty"), ("unnamed", "file_missing"), ("ok", "empty_field")} <= codes


def test_first_of_several_patterns(spark):
    paths = ["/r/z/results_t1_x.json", "/r/b/t1/summary.json", "/r/t12/summary.json", "/r/c/results_t12_1.json", "/r/q/results_a.b_1.json", "/r/q/results_aXb_1.json",
             "/r/out/2024_t3_late.json", "/r/out/common.txt", "/r/x/t9/deep/summary.json"]
    listing = spark.createDataFrame([(p, 0) for p in paths], "path string, length long")
    tasks = spark.createDataFrame([(t,) for t in ("t1", "t12", "a.b", "t3", "t9", "none", "t1")], "task string")

    def first(*patterns):
        return {r["task"]: r["path"] for r in discover_first(listing, tasks, list(patterns)).collect() if r["path"]}

    assert first("results_{task}_*.json", "{task}/summary.json") == {"t1": "/r/b/t1/summary.json", "t12": "/r/c/results_t12_1.json", "a.b": "/r/q/results_a.b_1.json"}
    assert first("out/*_{task}_late.json") == {"t3": "/r/out/2024_t3_late.json"}
    assert first("{task}/deep/*.json") == {"t9": "/r/x/t9/deep/summary.json"}
    assert set(first("common.*").values()) == {"/r/out/common.txt"} and len(first("common.*")) == 6


def test_ties_come_back_as_they_are(spark):
    rows = [("k", 1, "a", "z"), ("k", 1, "b", "y"), ("k", 1, "b", "y"), ("k", 2, None, "q"), ("one", 1, "x", "x"), (None, 3, "n", None), (None, 3, "n", None), ("s", 5, "a", "a"), ("s", 5, "a", "a")]
    df = spark.createDataFrame(rows, "key string, at int, a string, b string")
    got = sorted((tuple(r)[:4] for r in later_rows(df, ["key"], ["at"]).select("key", "at", "a", "b").collect()), key=str)
    assert got == sorted([rows[1], rows[2], rows[3], rows[5], rows[7]], key=str)
    assert {r["_first"]["at"] for r in later_rows(df, ["key"], ["at"]).where("key = 'k'").collect()} == {1}


@pytest.mark.parametrize("whole", [1 << 20, 7])
def test_named_files_are_read_by_tasks(spark, tmp_dir, whole, monkeypatch):
    """Lines and numbers of the files that a table names, as the scan gives them, without the scan for small files."""
    from sftlens.sources import jsonl

    names = {"a b/x+%.jsonl": "1\n\n2\r\n3", "m/y.jsonl": "﻿é\rz\n", "m/z.jsonl": "", "m/unnamed.jsonl": "no"}
    make_tree(spark, tmp_dir, names)
    asked = [f"{tmp_dir}/{n}" for n in ("a b/x+%.jsonl", "m/y.jsonl", "m/z.jsonl", "m/none.jsonl", "m/y.jsonl")] + [None]
    paths = spark.createDataFrame([(p,) for p in asked], "path string")
    scans = []
    monkeypatch.setattr(jsonl, "read_lines", lambda spark, path, base=1, old=jsonl.read_lines: scans.append(len(path)) or old(spark, path, base))
    got = sorted(map(tuple, jsonl.read_named_lines(paths, base=0, whole=whole).select("file", "line", "text").collect()))
    assert got == [(asked[0], i, t) for i, t in enumerate(["1", "", "2", "3"])] + [(asked[1], 0, "é"), (asked[1], 1, "z")]
    assert scans == ([] if whole > 8 else [1])
