import json

import pytest
from pyspark.sql import functions as F

from sftlens.functions.mathnorm import add_boxed_answer, dollar_span, last_boxed, normalize, remove_boxed
from sftlens.operators.grading import grade, is_equiv

PAIRS = [
    ("42", "42", True), ("\\frac12", "\\frac{1}{2}", True), ("1/2", "\\dfrac{1}{2}", True),
    ("0.5", "\\frac{1}{2}", True), (".5", "\\frac{1}{2}", True), ("01/2", "\\frac{1}{2}", False),
    ("x = 3", "3", True), ("abc=3", "3", False), ("\\sqrt3", "\\sqrt{3}", True), ("90^\\circ", "90", True),
    ("5\\text{ cm}", "5", True), ("2\\frac", "2\\frac", True), (None, None, True), (None, "1", False),
    ("\\frac1{72}", "\\frac{1}{72}", True), ("\\left( 1 \\right)", "(1)", True), ("50\\%", "50", True),
    ("1\\text{ a}\\text{ b}", "1", False), ("\\sqrt", "\\sqrt", True), ("-3/4", "\\frac{-3}{4}", True),
]


def test_is_equiv_table(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in PAIRS], "a string, b string")
    got = [r[0] for r in is_equiv(df, "a", "b", "eq").select("eq").collect()]
    assert got == [e for _, _, e in PAIRS]


def test_normalize_errors_become_null(spark):
    df = spark.createDataFrame([("\\frac",), ("a\\sqrt",), ("1\\text{ a}\\text{ b}",), ("\\frac1",)], "a string")
    got = [r[0] for r in normalize(df, "a", "n").select("n").collect()]
    assert got == [None, None, None, "\\frac1"]


BOXED = [
    ("The answer is \\boxed{\\frac{1}{2}}.", "\\boxed{\\frac{1}{2}}"),
    ("\\boxed{1} then \\boxed{2}", "\\boxed{2}"),
    ("\\fbox{7}", "\\fbox{7}"),
    ("no box", None),
    ("\\boxed{unbalanced", None),
    ("x \\boxed 5$ and more", "\\boxed 5"),
    ("\\boxed{a{b}c}", "\\boxed{a{b}c}"),
]


def test_last_boxed(spark):
    df = spark.createDataFrame([(a,) for a, _ in BOXED], "s string")
    got = [r[0] for r in df.select(last_boxed(F.col("s"))).collect()]
    assert got == [e for _, e in BOXED]
    via_df = [r[0] for r in add_boxed_answer(df, "s", "b").select("b").collect()]
    assert via_df == ["\\frac{1}{2}", "2", "\\fbox{7}", None, None, "5", "a{b}c"]


def test_remove_boxed_and_dollars(spark):
    df = spark.createDataFrame([("\\boxed{5}",), ("\\boxed 5",), ("plain",), ("\\boxed{5",), ("a $x$ b $y$",)],
                               "s string")
    got = df.select(remove_boxed(F.col("s")).alias("r"), dollar_span(F.col("s")).alias("d")).collect()
    assert [r["r"] for r in got] == ["5", "5", "plain", None, "a $x$ b $y$"]
    assert got[4]["d"] == "x$ b $y"


def _grade(spark, output, doc, mode, answer_field="answer", solution_field="solution"):
    gens = spark.createDataFrame([("m", "t", 1, output)], "model string, task string, doc_id long, output string")
    gold = spark.createDataFrame([("t", 1, json.dumps(doc), answer_field, solution_field)],
                                 "task string, doc_id long, d string, answer_field string, solution_field string") \
                .select("task", "doc_id", F.parse_json("d").alias("doc"), "answer_field", "solution_field")
    return grade(gens, gold, mode=mode).select("exact_match").first()[0]


@pytest.mark.parametrize("mode,expected", [("reference", 0), ("fixed", 1)])
def test_boxed_output_needs_fixed_mode(spark, mode, expected):
    assert _grade(spark, "The answer is \\boxed{42}.", {"answer": "42"}, mode) == expected


def test_capitalised_fields_and_solution_fallback(spark):
    doc = {"Answer": "7"}
    assert _grade(spark, "$7$", doc, "reference", "Answer", "Solution") == 0
    assert _grade(spark, "$7$", doc, "fixed", "Answer", "Solution") == 1
    assert _grade(spark, "$\\frac12$", {"solution": "so $\\boxed{\\frac{1}{2}}$"}, "reference") == 1


def test_integer_gold(spark):
    assert _grade(spark, "$42$", {"answer": 42}, "reference") == 0
    assert _grade(spark, "$42$", {"answer": 42}, "fixed") == 1
