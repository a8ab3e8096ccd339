"""SQL functions against the DataFrame operators; publication by pointer."""
import json
import os

import pytest
from pyspark.sql import functions as F

from sftlens.functions import variant
from sftlens.functions.sqlcatalog import register
from sftlens.operators.grading import grade, is_equiv
from sftlens.operators.validate import validate_samples
from sftlens.sinks import publication
from sftlens.sinks.publication import current, publish, read_current, remove_unused, version_path
from sftlens.sinks.writers import PublishError
from sftlens.sources.jsonl import parse_jsonl

SAMPLES = [{"doc_id": 0, "resps": [["a"]], "arguments": [["p", {}]]}, {"id": "0", "filtered_resps": ["b"], "arguments": {"gen_args_0": {"arg_0": None}, "b": {"arg_0": "B"}, "a": {"arg_0": 7}}},
           {"resps": [[""]], "filtered_resps": [["x"]], "prompt": "q"}, {"resps": [], "doc": {}}, {"resps": [[]], "filtered_resps": None, "arguments": []}, {"doc_id": None, "id": False, "resps": [[None]]},
           {"resps": "text", "arguments": ["whole"], "prompt": None}, {"resps": [[{"a": 1}]], "doc": None, "prompt": 5}, {"resps": [["  　"]], "doc_id": 1.0, "prompt": ""}, {"doc_id": True, "resps": [[True]], "prompt": []}, [], 3]


def test_fields_and_rules_equal_the_operators(spark):
    register(spark)
    lines = [json.dumps(s) for s in SAMPLES] + ["{ not json"]
    df = spark.createDataFrame([(i + 1, t, "t") for i, t in enumerate(lines)], "line long, text string, task string")
    v = parse_jsonl(df, "drop")
    want = v.select("line", variant.extract_output("v").alias("o"), variant.extract_prompt("v").alias("p"), variant.typed_key(variant.extract_doc_id("v", F.col("line"))).alias("k"))
    got = spark.sql("SELECT line, sample_output(v) AS o, sample_prompt(v) AS p, typed_key(sample_doc_id(v, line)) AS k FROM {v}", v=v)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    rules = spark.sql("SELECT line, inline(errors) FROM (SELECT line, sample_errors(text) AS errors FROM {df})", df=df)
    want = validate_samples(parse_jsonl(df, "collect")).where("code NOT LIKE 'duplicate%'")
    assert sorted((r["line"], r["code"]) for r in rules.collect()) == sorted((r["line"], r["code"]) for r in want.collect())


ANSWERS = [None, "", "1", "42 ", "0.5", ".5", "\\frac12", "\\frac{1}{2}", "\\frac1{72}", "1/2", "01/2", "-3/4", "x=5", "5", "abc=5", "\\sqrt3", "\\sqrt{3}", "\\sqrt", "3\\frac", "\\frac1", "a\\text{ cm}", "a",
           "\\text{ a}\\text{ b}", "90^\\circ", "90", "\\left(1,2\\right)", "(1,2)", "10\\%", "10", "\\$5", "\\\\frac12", "1\n2", "12", "\\tfrac{1}{2}", "it's"]


def test_answers_equal_the_operators(spark):
    register(spark)
    pairs = spark.createDataFrame([(a, b) for a in ANSWERS for b in ANSWERS], "a string, b string")
    want = is_equiv(pairs, "a", "b", "same")
    got = spark.sql("SELECT a, b, is_equivalent(a, b) AS same FROM {pairs}", pairs=pairs)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_the_catalog_names_the_grader(spark):
    register(spark)
    outputs = ["So \\boxed{42}.", "$42$", "42", "\\boxed 42$", "\\fbox{4{2}}", "\\boxed{4", "no", ""]
    docs = [{"answer": "42"}, {"Answer": "42"}, {"answer": 42}, {"solution": "thus \\boxed{42}"}, {"Answer": None, "Solution": "$\\boxed{42}$"}, {"answer": None}, {"answer": "", "solution": "x"}]
    rows = [(f"{g}-{a}", i, o, json.dumps(d), g, a, "answer" if a == "low" else "Answer", "solution" if a == "low" else "Solution")
            for g in ("reference", "fixed") for a in ("low", "high") for i, (o, d) in enumerate([(o, d) for o in outputs for d in docs])]
    df = spark.createDataFrame(rows, "task string, doc_id int, output string, doc string, grader string, x string, answer_field string, solution_field string")
    df = df.withColumn("doc", F.parse_json("doc"))
    want = grade(df.select("task", "doc_id", "output"), df.select("task", "doc_id", "doc", "answer_field", "solution_field", "grader"))
    got = spark.sql("SELECT task, doc_id, grade(grader, output, doc, answer_field, solution_field) AS exact_match FROM {df}", df=df)
    scores = sorted((r["task"], r["doc_id"], r["exact_match"]) for r in got.collect())
    assert scores == sorted((r["task"], r["doc_id"], r["exact_match"]) for r in want.collect())
    assert 0 < sum(s for *_, s in scores) < len(scores)
    assert spark.sql("SELECT grade('unknown', 'a', parse_json('1'), 'b', 'c')").first()[0] is None


def no_errors(parsed, expected):
    return parsed.limit(0).select("task", F.col("line"), F.lit("").alias("code"), F.lit("").alias("detail"))


def blank_is_wrong(parsed, expected):
    return parsed.where(F.try_variant_get("v", "$.s", "string") == "").select("task", "line", F.lit("blank").alias("code"), F.lit("s").alias("detail"))


def values(spark, root):
    return sorted(r["i"] for r in read_current(spark, root, "i long, s string").collect())


def test_versions_and_pointer(spark, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/table"
    df = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "i long, s string")
    assert current(spark, root) is None
    with pytest.raises(PublishError):
        read_current(spark, root)
    first = publish(df(1, 2), root, no_errors, expected_version=None)
    reader = read_current(spark, root, "i long")
    second = publish(df(1, 2, 3), root, no_errors, expected_count=3, expected_version=first)
    assert sorted(r[0] for r in reader.collect()) == [1, 2] and values(spark, root) == [1, 2, 3]  # a reader keeps its version
    assert current(spark, root) == {"version": second, "rows": 3, "previous": first}
    refusals = [lambda: publish(df(1).withColumn("s", F.lit("")), root, blank_is_wrong), lambda: publish(df(), root, no_errors),
                lambda: publish(df(1), root, no_errors, expected_count=2), lambda: publish(df(1), root, no_errors, expected_version=first)]
    for refused in refusals:
        with pytest.raises(PublishError):
            refused()
    assert current(spark, root)["version"] == second and remove_unused(spark, root) == []

    def crash(*args):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:  # all of the version is written, the pointer is not
        m.setattr(publication, "replace_pointer", crash)
        with pytest.raises(RuntimeError):
            publish(df(7), root, no_errors)
    assert values(spark, root) == [1, 2, 3]
    assert len(remove_unused(spark, root)) == 1 and values(spark, root) == [1, 2, 3]
    publish(df(9), root, no_errors)
    assert values(spark, root) == [9] and remove_unused(spark, root) == [first]


def test_a_pointer_that_moves_meanwhile(spark, tmp_dir):
    root = f"{tmp_dir}/table"
    one = spark.createDataFrame([(1,)], "i long")

    def publish_another(parsed, expected):
        publish(one.withColumn("i", F.lit(2)), root, no_errors)
        return no_errors(parsed, expected)

    with pytest.raises(PublishError, match="meanwhile"):
        publish(one, root, publish_another)
    assert [r["i"] for r in read_current(spark, root, "i long").collect()] == [2]


def test_publishing_writes_no_second_copy_of_the_lines(spark, tmp_dir, monkeypatch):
    """What is written besides the version is far smaller than it, and gone when the publication ends; lines keep their numbers."""
    from sftlens import session

    size = lambda folder: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    df = spark.range(50).selectExpr("id AS i", "IF(id = 7, '', concat_ws('', transform(sequence(1, 1000), x -> hex(hash(id, x))))) AS s")
    made, wrote = [], []
    monkeypatch.setattr(session, "scratch_dir", lambda spark, name, old=session.scratch_dir: made.append(old(spark, name).removeprefix("file:")) or made[-1])

    def rules(parsed, expected):
        found = session.materialize(blank_is_wrong(parsed, expected), "rules")
        wrote.append(sum(map(size, made)))
        return found

    publish(df.where("id <> 7"), f"{tmp_dir}/table", rules)
    with pytest.raises(PublishError, match=r"blank \(line 8\)"):
        publish(df.coalesce(1), f"{tmp_dir}/table", rules)
    lines = size(version_path(f"{tmp_dir}/table", current(spark, f"{tmp_dir}/table")["version"]))
    assert len(wrote) == 2 and 0 < max(wrote) < lines / 10 and not any(map(os.path.exists, made))


@pytest.mark.parametrize("query, most", [("SAMPLE_ERRORS", 9), ("EXPORT_ERRORS", 11)])
def test_filters_that_are_pushed_down_parse_a_text_once(spark, query, most):
    from sftlens.plans import sql_queries

    register(spark)
    lines = spark.range(5).selectExpr("'t' AS task", "id AS line", "concat('{\"id\": ', id, '}') AS text")
    expected = spark.createDataFrame([("t", 5)], "task string, expected long")
    named = {"lines": lines, "expected": expected} if query == "SAMPLE_ERRORS" else {"lines": lines, "method": "x"}
    plan = spark.sql(getattr(sql_queries, query), **named)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") <= most  # 226 and 57 when every use of a value had its own parse


def test_publications_read_one_export(spark, tmp_dir, monkeypatch):
    """The samples are parsed and flattened once, however often their records are published."""
    from sftlens.plans import export_queries, publication_queries

    spark.range(8).selectExpr("id AS doc_id", "'out' AS text", "'en' AS lang", "'src' AS source", "3L AS n_chars").write.parquet(f"{tmp_dir}/documents.parquet")
    read = []
    monkeypatch.setattr(publication_queries, "publish", lambda df, *a, old=publication.publish, **k: read.append(df.inputFiles()) or old(df, *a, **k))
    got = publication_queries.q_publish_by_pointer(spark, tmp_dir)
    assert sorted((r["sample_id"].split(":")[1], r["rows_before"], r["third_refused"]) for r in got.collect()) == [(str(i), 4, True) for i in range(8)]
    lines = set(export_queries.sample_lines(spark, tmp_dir).inputFiles())
    assert len(read) == 3 and all(not lines & set(files) for files in read)
