import json
import os

from pyspark.sql import functions as F

from sftlens.operators.validate import validate_export_file, validate_run_manifests, validate_samples, \
    validate_task_manifests
from sftlens.sources.jsonl import parse_jsonl, read_jsonl, read_lines
from sftlens.sources.manifests import file_status


def _lines(spark, texts, task="t"):
    return spark.createDataFrame([(task, i + 1, t) for i, t in enumerate(texts)], "task string, line long, text string")


def _sample(i, **kw):
    o = {"doc_id": i, "doc": {"problem": "p"}, "arguments": {"gen_args_0": {"arg_0": "q"}}, "resps": [["a"]]}
    o.update(kw)
    return json.dumps(o)


def codes(df):
    return sorted(((r["line"], r["code"]) for r in df.collect()), key=lambda x: (x[0] or 0, x[1]))


def test_v1_rules(spark):
    texts = [_sample(0), _sample(0), _sample(1, resps=[[""]]), "{ broken json",
             json.dumps({"doc_id": 2}), json.dumps({"doc_id": "0", "resps": [["x"]]}),
             json.dumps({"doc_id": 3, "resps": [["x"]]})]
    parsed = parse_jsonl(_lines(spark, texts), on_error="collect")
    exp = spark.createDataFrame([("t", 30)], "task string, expected long")
    got = codes(validate_samples(parsed, exp))
    assert (2, "duplicate_doc_id") in got and (3, "empty_output") in got and (4, "parse_error") in got
    assert (5, "missing_resps") in got and (5, "empty_output") in got and (5, "missing_prompt") in got
    assert (6, "duplicate_doc_id") not in got  # "0" is not 0
    assert (7, "missing_prompt") in got
    assert (None, "count_mismatch") in got  # 7 lines (corrupt included) vs 30


def test_v1_filtered_fallback_no_error(spark):
    parsed = parse_jsonl(_lines(spark, [_sample(0, resps=[["raw"]], filtered_resps=[[""]])]), on_error="collect")
    assert codes(validate_samples(parsed)) == []


def _record(**kw):
    r = {f: "x" for f in ("sample_id", "task", "benchmark", "question", "prompt", "raw_output", "prompt_hash",
                          "output_hash", "run_id")}
    r.update(doc_id=0, gold_answer=None, max_gen_toks=32768, max_model_len=40960, output_token_count=5,
             output_token_count_method="llama_tokenizer")
    r.update(kw)
    return r


def test_v2_v3_rules(spark):
    recs = [_record(sample_id="a"), _record(sample_id="a"), _record(sample_id=None), _record(sample_id=None),
            _record(run_id=" "), _record(max_gen_toks="32768"), _record(max_model_len=1024),
            _record(output_token_count=0), _record(output_token_count_method="split_estimate")]
    texts = [json.dumps(r) for r in recs]
    no_gold = _record(sample_id="b")
    del no_gold["gold_answer"]
    texts.append(json.dumps(no_gold))
    parsed = parse_jsonl(_lines(spark, texts), on_error="collect")
    got = codes(validate_export_file(parsed))
    assert (2, "duplicate_sample_id") in got
    assert not any(c == "duplicate_sample_id" and line == 4 for line, c in got)  # null ids ignored
    for line, code in [(3, "empty_field"), (5, "empty_field"), (6, "bad_max_gen_toks"), (7, "short_max_model_len"),
                       (8, "bad_output_token_count"), (9, "bad_token_method"), (10, "missing_gold_answer")]:
        assert (line, code) in got
    assert (1, "empty_field") not in got


def test_read_lines_numbering_and_policies(spark, tmp_dir):
    p = os.path.join(tmp_dir, "s.jsonl")
    with open(p, "w") as f:
        f.write(_sample(0) + "\n\n" + "{ bad\n" + _sample(1) + "\n")
    lines = sorted((r["line"], r["text"][:6]) for r in read_lines(spark, p).collect())
    assert [x[0] for x in lines] == [1, 2, 3, 4]
    assert read_jsonl(spark, p, on_error="drop").count() == 2
    col = read_jsonl(spark, p, on_error="collect")
    assert sorted(r["line"] for r in col.where("parse_error").collect()) == [3]


def test_manifest_rules(spark, tmp_dir):
    export = os.path.join(tmp_dir, "exported.jsonl")
    with open(export, "w") as f:
        f.write("{}\n")
    empty = os.path.join(tmp_dir, "empty.jsonl")
    open(empty, "w").close()
    listing = file_status(spark, [export, empty])
    good = {"status": "complete", "max_gen_toks": 32768, "max_model_len": 40960, "export_status": "complete",
            "exported_generation_file": export, "expected_sample_count": 2, "actual_sample_count": 2,
            "exported_sample_count": 2}
    bad = dict(good, status="running", exported_generation_file=empty, actual_sample_count=1)
    tm = spark.createDataFrame([("good", json.dumps(good)), ("bad", json.dumps(bad))], "task string, s string") \
              .select("task", F.parse_json("s").alias("m"))
    got = sorted((r["task"], r["code"]) for r in validate_task_manifests(tm, listing).collect())
    assert got == [("bad", "actual_count"), ("bad", "export_file_empty"), ("bad", "status")]
    run = {"status": "complete", "evaluation_mode": "generation_only", "predict_only": True,
           "judging_status": "pending_local", "max_gen_toks": 32768, "gpu_peak_memory_mib": 42120,
           "enable_chunked_prefill": True, "tasks": ["a", "b"], "exported_generation_files": {"a": export},
           "expected_sample_counts": {"a": 2, "b": 3}, "actual_sample_counts": {"a": 2, "b": 2}}
    rm = spark.createDataFrame([("r1", json.dumps(run))], "run_id string, s string") \
              .select("run_id", F.parse_json("s").alias("m"))
    got = sorted((r["task"], r["code"]) for r in validate_run_manifests(rm, listing).collect())
    assert got == [("r1/b", "export_file_missing"), ("r1/b", "task_count")]


def test_export_does_not_shuffle_samples_by_task(spark):
    """Rows of unknown size (the manifests, the catalog) must not make the planner join by task: few tasks have all samples."""
    from sftlens.functions.tokenize import CodePointTokenizer
    from sftlens.operators.export import flatten_samples, manifest_settings
    from sftlens.plans.export_queries import task_manifests
    from sftlens.sources.catalog import task_catalog
    from sftlens.sources.jsonl import parse_jsonl

    lines = spark.range(4).selectExpr("if(id < 2, 'local_math500_32k', 'local_aime24_32k') AS task", "id AS line", "concat('{\"doc_id\": ', id, '}') AS text")
    e = flatten_samples(parse_jsonl(lines), task_catalog(spark), manifest_settings(task_manifests(spark)), model_name="m", model_path="p",
                        git_commit="g", created_at="c", tokenizer=CodePointTokenizer())
    plan = e._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    assert sorted(r["sample_id"] for r in e.collect()) == ["local_aime24_32k:2", "local_aime24_32k:3", "local_math500_32k:0", "local_math500_32k:1"]
