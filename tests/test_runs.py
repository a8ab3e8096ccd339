from pyspark.sql import functions as F

from sftlens.operators.analysis import python_int
from sftlens.operators.runs import catalog_consistency, judge_completion, run_rollup, task_errors
from sftlens.sources.catalog import catalog_with_generation


def test_catalog_consistency(spark):
    r = catalog_consistency(catalog_with_generation(spark)).first()
    assert r["names_unique"] and r["same_stop_strings"] and r["same_generation"]
    changed = catalog_with_generation(spark).withColumn(
        "max_gen_toks", F.when(F.col("task") == "local_aime24_32k", 4096).otherwise(F.col("max_gen_toks")))
    assert not catalog_consistency(changed).first()["same_generation"]


def test_run_rollup_maps(spark):
    tasks = spark.createDataFrame(
        [("r", "b", 10, 8, 2, 30, 30, [], "res_b.json"), ("r", "a", 5, 5, 0, 2, 1, ["oops"], "res_a.json")],
        "run_id string, task string, pipeline_elapsed_seconds long, successful_attempt_elapsed_seconds long, "
        "failed_attempt_elapsed_seconds long, expected long, actual long, errors array<string>, results_file string")
    r = run_rollup(tasks).first()
    assert r["n_tasks"] == 2 and r["pipeline_elapsed_seconds"] == 15 and r["failed_attempt_elapsed_seconds"] == 2
    assert r["expected_sample_counts"] == {"a": 2, "b": 30} and r["actual_sample_counts"]["a"] == 1
    assert r["completion_errors"] == ["oops"] and r["results_file"] == "res_a.json"


def test_judge_completion(spark):
    tasks = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t4",)], "task string")
    errs = spark.createDataFrame([("t2", 3, "empty_output", None)], "task string, line long, code string, detail string")
    results = spark.createDataFrame([("t1", "r1.json"), ("t2", "r2.json"), ("t3", None), ("t4", "r4.json")],
                                    "task string, path string")
    export_fail = spark.createDataFrame([("t4", "row count mismatch")], "task string, error string")
    got = {r["task"]: r for r in judge_completion(tasks, errs, results, export_fail).collect()}
    assert got["t1"]["status"] == "complete" and got["t1"]["completion_errors"] == []
    assert got["t2"]["status"] == "incomplete" and got["t3"]["status"] == "incomplete"
    assert got["t4"]["status"] == "incomplete" and got["t4"]["completion_errors"][0].startswith("export failed")


def test_judge_completion_of_limits_and_files(spark):
    tasks = spark.createDataFrame(
        [("ok", "s", 32768, 40960), ("gen", "s", 4096, 40960), ("len", "s", 32768, 16384), ("none", None, 32768, 40960), ("bad", "s", 32768, 32768)],
        "task string, sample_file string, max_gen_toks int, max_model_len int")
    errs = spark.createDataFrame([], "task string, line long, code string, detail string")
    results = spark.createDataFrame([(t, "r.json", t != "bad") for t in ("ok", "gen", "len", "none", "bad")], "task string, path string, parses boolean")
    got = {r["task"]: r["completion_errors"] for r in judge_completion(tasks, errs, results).collect()}
    assert got == {"ok": [], "gen": ["max_gen_toks is not the required one"], "len": ["max_model_len is below max_gen_toks"],
                   "none": ["sample file not found"], "bad": ["results file does not parse"]}


def test_task_errors(spark):
    docs = [('{"status":"complete","export_status":"complete","exported_generation_file":"/f"}', 5),
            ('{"status":"running","export_status":"failed","exported_generation_file":"/f"}', 0), ('{"status":"complete","export_status":"complete"}', None), (None, None)]
    df = spark.createDataFrame([(f"t{i}", d, n) for i, (d, n) in enumerate(docs)], "task string, d string, n long")
    got = [r[0] for r in df.orderBy("task").select(task_errors(F.try_parse_json("d"), F.col("n"))).collect()]
    assert got == [[], ["task t1: not complete", "task t1: export file is empty", "task t1: export not complete"],
                   ["task t2: no export file named"], ["task t3: no manifest"]]


def test_token_counts_as_python_reads_them(spark):
    cases = {'5': 5, '"5"': 5, '" 7 "': 7, '"4.7"': 0, '4.7': 4, '-2.9': -2, '"n/a"': 0, 'true': 1, 'false': 0, 'null': 0, '""': 0, '[]': 0, '[3]': 0, '{"a": 1}': 0, '"+1_000"': 1000, '"1__0"': 0, '1e3': 1000}
    df = spark.createDataFrame([(k,) for k in cases], "j string").select("j", python_int(F.parse_json("j")).alias("n"))
    assert {r["j"]: r["n"] for r in df.collect()} == cases
