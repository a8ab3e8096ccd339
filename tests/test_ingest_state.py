"""Ids and counts remembered over the runs of the ingest stream; scratch tables go with their micro-batch."""
import json
import os

from pyspark.sql import functions as F

from sftlens.session import ensure_checkpoint_dir, scratch_dir, scratch_scope
from sftlens.sources.jsonl import parse_jsonl
from sftlens.streaming.ingest import REPEAT, ingest_samples, remember, short_counts


def land(tmp, stage, model, task, ids):
    folder = f"{tmp}/landing/{stage}/model={model}/task={task}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{len(os.listdir(folder))}.jsonl", "w") as f:
        f.writelines(json.dumps({"doc_id": i, "prompt": "p", "resps": ["x"]}) + "\n" for i in ids)


def test_repeats_in_later_files_and_runs(spark, tmp_dir):
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))

    def run():
        return ingest_samples(spark, f"{tmp_dir}/landing/*/*/*", f"{tmp_dir}/sink", f"{tmp_dir}/checkpoint", lambda good: good.select("model", "task", "line"), state=f"{tmp_dir}/state")

    land(tmp_dir, "a", "m", "t", [1, 2, "2", 2])
    land(tmp_dir, "a", "m", "u", [1])
    assert run() == 1
    land(tmp_dir, "b", "m", "t", [2, 3])
    land(tmp_dir, "b", "n", "t", [1])
    assert run() == 1
    land(tmp_dir, "c", "m", "t", [3, 3, 4])
    assert run() == 1
    got = spark.read.schema(REPEAT + ", batch_id int").parquet(f"{tmp_dir}/sink/repeats").collect()
    assert sorted((r["batch_id"], r["model"], r["task"], r["line"], r["detail"]) for r in got) == [
        (0, "m", "t", 4, "doc_id=2"), (1, "m", "t", 1, "doc_id=2"), (2, "m", "t", 1, "doc_id=3"), (2, "m", "t", 2, "doc_id=3")]
    assert {r["first_line"] for r in got if r["batch_id"] == 2} == {2}
    expected = spark.createDataFrame([("m", "t", 9), ("m", "u", 2), ("n", "t", 1), ("n", "none", 3)], "model string, task string, expected long")
    assert sorted(map(tuple, short_counts(spark, f"{tmp_dir}/state", expected).collect())) == [("m", "u", 2, 1), ("n", "none", 3, 0)]
    assert set(os.listdir(base)) == before  # nothing of the micro-batches is left


def test_a_retried_batch_replaces_its_increment(spark, tmp_dir):
    def batch(ids):
        lines = spark.createDataFrame([("m", "t", "f", k + 1, json.dumps({"doc_id": i})) for k, i in enumerate(ids)], "model string, task string, file string, line long, text string")
        return parse_jsonl(lines, "collect")

    def repeats(n):
        return sorted(r["line"] for r in spark.read.parquet(f"{tmp_dir}/r/batch_id={n}").collect())

    for _ in range(2):
        remember(spark, batch([1, 2, 1]), f"{tmp_dir}/s", f"{tmp_dir}/r", 0)
        assert repeats(0) == [3]
    for ids, want in (([2, 5], [1]), ([2, 5, 5], [1, 3]), ([7], [])):
        remember(spark, batch(ids), f"{tmp_dir}/s", f"{tmp_dir}/r", 1)
        assert repeats(1) == want
    assert spark.read.parquet(f"{tmp_dir}/s/ids").count() == 3


def test_scratch_scope(spark):
    outside = scratch_dir(spark, "kept")
    spark.range(1).write.parquet(outside)
    with scratch_scope(spark):
        inside = scratch_dir(spark, "gone")
        spark.range(1).write.parquet(inside)
        assert spark.read.parquet(inside).count() == 1
    assert not os.path.exists(inside.removeprefix("file:")) and spark.read.parquet(outside).agg(F.sum("id")).first()[0] == 0


def test_lines_are_parsed_when_they_are_numbered(spark, tmp_path, monkeypatch):
    """As numbering, then parsing: blank lines keep their number, malformed ones are marked; no text is written."""
    from sftlens.sources import jsonl

    for name, lines in (("a", ['{"x": 1}', "", "{bad", ' {"x": 2, "x": 3} ']), ("b", ["   ", "null", "[1]"] * 50)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    raw = jsonl.text_with_blocks(spark.read.text(str(tmp_path)))
    shown = lambda df: sorted((r["file"], r["line"], str(r["v"]), r["parse_error"]) for r in
                              df.selectExpr("file", "line", "to_json(v) v", "parse_error").collect())
    want = shown(jsonl.parse_jsonl(jsonl.number_lines(raw), on_error="collect"))
    written, write = [], jsonl.materialize
    monkeypatch.setattr(jsonl, "materialize", lambda df, name: written.append(df.columns) or write(df, name))
    assert shown(jsonl.number_and_parse(raw)) == want and len(want) == 103
    assert not any("text" in columns for columns in written)
