import json

from pyspark.sql import functions as F

from sftlens.functions import variant as V
from sftlens.functions.text import content_hash, is_blank, py_strip, whitespace_token_count

TEXTS = ["", "a", "  a  b\tc\n", "　x y\x1c", "one two  three", "\n\n", "é∑😀 z"]


def test_strip_and_split_match_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select(py_strip("t").alias("s"), whitespace_token_count("t").alias("n"),
                    is_blank("t").alias("b")).collect()
    for t, r in zip(TEXTS, got):
        assert r["s"] == t.strip()
        assert r["n"] == len(t.split())
        assert r["b"] == (not t.strip())


def test_content_hash(spark):
    import hashlib
    r = spark.createDataFrame([("héllo",)], "t string").select(content_hash("t").alias("h")).first()
    assert r["h"] == hashlib.sha256("héllo".encode()).hexdigest()[:16]


def _eval(spark, objs, col):
    df = spark.createDataFrame([(json.dumps(o),) for o in objs], "s string").select(F.parse_json("s").alias("v"))
    return [r[0] for r in df.select(col.alias("x")).collect()]


def test_extract_output_cases(spark):
    objs = [{"resps": [["x"]]}, {"resps": ["x"]}, {"resps": []}, {"resps": [[""]], "filtered_resps": [["y"]]},
            {"resps": [[]], "filtered_resps": [["f"]]}, {"resps": [5], "filtered_resps": ["g"]},
            {"filtered_resps": [["only filtered"]]}, {"resps": None, "filtered_resps": None}]
    assert _eval(spark, objs, V.extract_output("v")) == ["x", "x", "", "", "f", "g", "only filtered", ""]


def test_extract_prompt_cases(spark):
    objs = [
        {"arguments": {"gen_args_1": {"arg_0": "p1"}, "gen_args_0": {"arg_0": "p0"}}},
        {"arguments": {"gen_args_0": {"arg_0": None}, "gen_args_1": {"arg_0": "p1"}}},
        {"arguments": {"b": {"arg_0": "pb"}, "a": {"arg_0": "pa"}}},
        {"arguments": [["prompt", {"max_gen_toks": 1}]]},
        {"arguments": ["p"]}, {"arguments": []}, {}, {"prompt": "standalone"},
    ]
    assert _eval(spark, objs, V.extract_prompt("v")) == ["p0", "p1", "pa", "prompt", "p", "", "", "standalone"]


def test_doc_id_zero_is_valid(spark):
    objs = [{"doc_id": 0, "id": 99}, {"id": 42}, {"doc_id": None, "id": 7}, {}]
    df = spark.createDataFrame([(json.dumps(o), i + 1) for i, o in enumerate(objs)], "s string, line long")
    got = df.select(V.py_str(V.extract_doc_id(F.parse_json("s"), F.col("line")))).collect()
    assert [r[0] for r in got] == ["0", "42", "7", "4"]


def test_typed_key_distinguishes_int_and_string(spark):
    objs = [{"k": 0}, {"k": "0"}, {"k": 0.0}, {"k": False}]
    keys = _eval(spark, objs, V.typed_key("v", V.key("k")))
    assert keys[0] != keys[1] and keys[0] == keys[2] == keys[3]


def test_first_truthy_python_semantics(spark):
    objs = [{"question": "", "problem": "p"}, {"question": 0, "query": "q"}, {"question": "  ", "problem": "p"},
            {"question": [], "input": {}, "prompt": "z"}, {"instruction": "i"}, {}]
    got = _eval(spark, objs, V.first_truthy_text("v", V.PROBLEM_FIELDS))
    assert got == ["p", "q", "  ", "z", "i", ""]
