import json
import os

import pytest
from pyspark.sql import functions as F

from sftlens.operators.attempts import attempt_rollup, classify_attempts, first_success, parse_telemetry, peak
from sftlens.operators.compare import pair_runs
from sftlens.operators.validate import validate_export_file
from sftlens.sinks.writers import PublishError, output_name, publish_validated, write_jsonl
from sftlens.sources.manifests import active_runs, discover_first, list_files, scan_json_tree, task_manifests_of


def _write(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(obj if isinstance(obj, str) else json.dumps(obj))


def test_active_run_pointer(spark, tmp_dir):
    root = os.path.join(tmp_dir, "model_a")
    for run in ("r1", "r2"):
        _write(f"{root}/runs/{run}/run_manifest.json", {"run_id": run, "status": "complete"})
        for t in ("t1", "t2"):
            _write(f"{root}/runs/{run}/tasks/{t}/task_manifest.json", {"task": t})
    _write(f"{root}/runs/r2/tasks/t3/task_manifest.json", "{ corrupt")
    _write(f"{root}/active_run.json", {"active_run_id": "r2", "status": "complete"})
    missing = os.path.join(tmp_dir, "model_b")
    os.makedirs(missing)
    tree = scan_json_tree(spark, [root, missing])
    roots = spark.createDataFrame([("file:" + root,), ("file:" + missing,)], "root string")
    runs = {r["root"]: r for r in active_runs(tree, roots).collect()}
    assert runs["file:" + root]["run_id"] == "r2" and runs["file:" + root]["error"] is None
    assert runs["file:" + missing]["error"] is not None
    tms = sorted((r["run_id"], r["task"]) for r in task_manifests_of(tree, active_runs(tree, roots)).collect())
    assert tms == [("r2", "t1"), ("r2", "t2")]  # r1 not read, corrupt t3 skipped


def test_discover_first(spark, tmp_dir):
    for name in ("samples_t1_2024-02.jsonl", "samples_t1_2024-01.jsonl", "other.jsonl", "x/samples_t2_a.jsonl"):
        _write(os.path.join(tmp_dir, name), "{}")
    found = {r["task"]: r["path"] for r in discover_first(
        list_files(spark, [tmp_dir]), spark.createDataFrame([("t1",), ("t2",), ("t3",)], "task string"),
        ["samples_{task}_*.jsonl", "samples_{task}*.jsonl"]).collect()}
    assert found["t1"].endswith("samples_t1_2024-01.jsonl") and found["t2"].endswith("samples_t2_a.jsonl")
    assert found["t3"] is None


def test_write_jsonl_keeps_nulls_and_publish(spark, tmp_dir):
    df = spark.createDataFrame([("a", None)], "sample_id string, gold_answer string")
    write_jsonl(df, os.path.join(tmp_dir, "out"))
    text = "".join(open(os.path.join(tmp_dir, "out", f)).read() for f in os.listdir(os.path.join(tmp_dir, "out"))
                   if f.endswith(".json"))
    assert '"gold_answer":null' in text
    ok = spark.createDataFrame([(f"s{i}", "t", "b", "q", "p", "o", "h", "h", "r", i, None, 32768, 40960, 3,
                                 "llama_tokenizer") for i in range(3)],
                               "sample_id string, task string, benchmark string, question string, prompt string, "
                               "raw_output string, prompt_hash string, output_hash string, run_id string, "
                               "doc_id long, gold_answer string, max_gen_toks int, max_model_len int, "
                               "output_token_count int, output_token_count_method string")
    dest = os.path.join(tmp_dir, "published")
    assert publish_validated(ok, dest, validate_export_file, expected_count=3) == 3
    with pytest.raises(PublishError):
        publish_validated(ok, os.path.join(tmp_dir, 'short'), validate_export_file, expected_count=4)
    assert os.path.isdir(dest)
    with pytest.raises(PublishError):
        publish_validated(ok.withColumn("max_gen_toks", F.lit(1)), os.path.join(tmp_dir, "bad"), validate_export_file)
    assert not os.path.exists(os.path.join(tmp_dir, "bad")) and not any(
        x.startswith("bad._staging") for x in os.listdir(tmp_dir))


def test_output_name(spark):
    df = spark.createDataFrame([("LIMO-817", "local_math500_32k"), ("My Model!", "local_aime24_32k")],
                               "m string, t string")
    got = [r[0] for r in df.select(output_name(F.col("m"), F.col("t"), 5)).collect()]
    assert got == ["limo_math500_smoke5", "mymodel_aime24_smoke5"]


def test_telemetry_peaks(spark):
    lines = ["2026/07/19 12:00:10, 45000, 46068, 99", "2026/07/19 12:00:15, 44000, 46068, 99",
             "2026/07/19 12:00:20,  42120.7 , 46068, 50", "bad line", "x, N/A, 1, 2"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert peak(parse_telemetry(df)).first()["peak"] == 45000
    assert peak(parse_telemetry(df.limit(0))).first()["peak"] == 0


def test_attempts_and_ladder(spark):
    att = spark.createDataFrame([("a", 1, 1, 10), ("a", 2, 1, 20), ("a", 3, 0, 300), ("b", 1, 1, 5), ("b", 2, 0, 7),
                                 ("c", 1, 1, 3)], "task string, attempt int, exit_code int, elapsed_seconds long")
    logs = spark.createDataFrame([("a", 1, "torch.cuda.OutOfMemoryError: CUDA out of memory"),
                                  ("a", 2, "The model's max seq len (40960) is larger than the maximum number of "
                                           "tokens that can be stored"),
                                  ("b", 1, "RuntimeError: CUDA error: device-side assert"), ("c", 1, "hbm OUT of memory")],
                                 "task string, attempt int, log_line string")
    c = classify_attempts(att, logs)
    st = {(r["task"], r["attempt"]): r["status"] for r in c.collect()}
    assert st[("a", 1)] == st[("a", 2)] == "oom" and st[("b", 1)] == "error" and st[("c", 1)] == "oom"
    roll = {r["task"]: r for r in attempt_rollup(c).collect()}
    assert (roll["a"]["successful_attempt_elapsed_seconds"], roll["a"]["failed_attempt_elapsed_seconds"]) == (300, 30)
    fs = {r["task"]: r for r in first_success(c).collect()}
    assert (fs["a"]["outcome"], fs["a"]["successful_attempt"]) == ("success", 3)
    assert (fs["b"]["outcome"], fs["b"]["stop_attempt"]) == ("stopped", 1)
    assert fs["c"]["outcome"] == "exhausted"


def test_config_comparability(spark):
    cols = ("model_name string, max_gen_toks int, max_model_len int, max_num_batched_tokens int, max_num_seqs int, "
            "gpu_memory_utilization double, enable_prefix_caching boolean, enable_chunked_prefill boolean, "
            "dtype string, vllm_version string, lm_eval_version string, fallback_level int, "
            "generation_complete boolean")
    base = [32768, 40960, 8192, 32]
    runs = spark.createDataFrame([
        ("a", *base, 0.90, True, True, "bf16", "v", "l", 1, True),
        ("b", *base, 0.9, True, True, "bf16", "v", "l", 2, True),
        ("c", *base, 0.88, True, True, "bf16", "v", "l", 1, False)], cols)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "model_a string, model_b string")
    got = {(r["model_a"], r["model_b"]): r for r in pair_runs(runs, pairs).collect()}
    ab, ac = got[("a", "b")], got[("a", "c")]
    assert ab["config_comparable"] and ab["throughput_comparable"] and not ab["configs_equal"]
    assert ab["conservativeness"] == -1
    assert not ac["config_comparable"] and not ac["throughput_comparable"]


def test_write_comparison(spark, tmp_dir):
    from sftlens.sinks.writers import write_comparison

    m = spark.createDataFrame([("throughput_comparable", 0.0, 0.0), ("tokens_per_s", 3.5, 0.0), ("p50", 1.0, 2.0),
                               ("config_comparable", 1.0, 1.0)], "metric string, a double, b double")
    out = os.path.join(tmp_dir, "cmp")
    stats = spark.createDataFrame([("a", 8192, "bf16"), ("b", 4096, None)], "model_name string, max_num_batched_tokens int, dtype string")
    write_comparison(m, out, ["a", "b"], stats)
    doc = spark.read.json(os.path.join(out, "document")).first()
    assert doc["config_comparable"] and not doc["throughput_comparable"] and doc["runs"]["b"]["max_num_batched_tokens"] == 4096
    csv = [f for f in os.listdir(os.path.join(out, "csv")) if f.endswith(".csv")]
    order = [x.split(",")[0] for x in open(os.path.join(out, "csv", csv[0])).read().splitlines()]
    assert order == ["metric", "p50", "tokens_per_s", "config_comparable", "throughput_comparable"]
    md = open(os.path.join(out, "comparison.md")).read()
    assert "| Metric | a | b |" in md and "| tokens_per_s | 3.5 | 0.0 |" in md
    assert "| max_num_batched_tokens | 8192 | 4096 |" in md and "| dtype | bf16 | None |" in md
    assert spark.read.json(os.path.join(out, "json")).count() == 4
    assert spark.read.option("header", "true").csv(os.path.join(out, "csv")).count() == 4
