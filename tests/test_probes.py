"""Cases that once gave a wrong answer: repeats across part files, scopes, large ids, split sizes,
NULL groups, fractions, repeated JSON keys, repeated sample ids."""
import json
import os

import pytest
from pyspark.sql import functions as F

from sftlens.operators.export import publication_violations
from sftlens.operators.indexing import dense_index
from sftlens.operators.prepare import sample_exact
from sftlens.operators.quality import repeat_rows
from sftlens.operators.stats import percentile_linear
from sftlens.operators.validate import missing_files, validate_export_file, validate_samples
from sftlens.session import ensure_checkpoint_dir
from sftlens.sinks.writers import PublishError, publish_validated
from sftlens.sources.jsonl import number_lines, parse_jsonl, read_lines, text_with_blocks

RECORD = {f: "x" for f in ("task", "benchmark", "question", "prompt", "raw_output", "prompt_hash", "output_hash", "run_id")}
RECORD |= {"doc_id": 0, "gold_answer": None, "max_gen_toks": 32768, "max_model_len": 40960, "output_token_count": 5,
           "output_token_count_method": "llama_tokenizer"}
SCHEMA = ("sample_id string, task string, benchmark string, question string, prompt string, raw_output string, prompt_hash string, "
          "output_hash string, run_id string, doc_id long, gold_answer string, max_gen_toks int, max_model_len int, "
          "output_token_count int, output_token_count_method string")


def _records(spark, ids, **kw):
    return spark.createDataFrame([{**RECORD, "sample_id": i, **kw} for i in ids], SCHEMA)


@pytest.mark.parametrize("ids,kw", [(["a", "a"], {}), ([], {}), (["a", "b"], {"question": " "}), (["a", "b"], {"max_gen_toks": 5})])
def test_publisher_refuses(spark, tmp_dir, ids, kw):
    dest = os.path.join(tmp_dir, "out")
    with pytest.raises(PublishError):
        publish_validated(_records(spark, ids, **kw).repartition(2, "gold_answer").repartition(4), dest, validate_export_file)
    assert not os.path.exists(dest)


def test_publisher_publishes(spark, tmp_dir):
    dest = os.path.join(tmp_dir, "out")
    assert publish_validated(_records(spark, ["a", "b", "c"]).repartition(3), dest, validate_export_file) == 3
    assert spark.read.json(dest).count() == 3


def test_publisher_writes_no_second_copy_of_the_lines(spark, tmp_dir, monkeypatch):
    """What is written besides the staged lines is far smaller than they are, and gone when the publication ends."""
    from sftlens import session

    size = lambda folder: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    long = F.expr("concat_ws('', transform(sequence(1, 2000), x -> hex(hash(sample_id, x))))")
    records = _records(spark, [f"s{i}" for i in range(40)]).withColumn("raw_output", long)
    made, wrote = [], []
    monkeypatch.setattr(session, "scratch_dir", lambda spark, name, old=session.scratch_dir: made.append(old(spark, name).removeprefix("file:")) or made[-1])

    def rules(parsed, expected):
        found = validate_export_file(parsed, expected)
        wrote.append(sum(map(size, made)))
        return found

    assert publish_validated(records, f"{tmp_dir}/good", rules) == 40
    with pytest.raises(PublishError, match="bad_max_gen_toks"):
        publish_validated(records.withColumn("max_gen_toks", F.lit(1)), f"{tmp_dir}/bad", rules)
    assert len(wrote) == 2 and 0 < max(wrote) < size(f"{tmp_dir}/good") / 10 and not any(map(os.path.exists, made))
    assert os.listdir(tmp_dir) == ["good"]


def _sample(doc_id):
    return json.dumps({"doc_id": doc_id, "prompt": "p", "resps": [["x"]], "filtered_resps": [["x"]]})


def test_scope_is_the_file_and_ties_count(spark):
    rows = [("A", "t", "f1", 1, _sample(5)), ("B", "t", "f2", 1, _sample(5)), ("A", "t", "f1", 2, _sample(5)),
            ("C", "t", "f3", 1, _sample(7)), ("C", "t", "f3", 1, _sample(7)), ("C", "t", "f3", 1, _sample(7))]
    parsed = parse_jsonl(spark.createDataFrame(rows, "model string, task string, file string, line long, text string"), "collect")
    got = validate_samples(parsed, scope=("model", "task", "file")).groupBy("model", "code").count().collect()
    assert sorted(tuple(r) for r in got) == [("A", "duplicate_doc_id", 1), ("C", "duplicate_doc_id", 2)]


def test_large_ids_differ_and_whole_numbers_agree(spark):
    ids = [9007199254740992, 9007199254740993, 4, 4.0, True, 1]
    rows = [("t", i + 1, _sample(x)) for i, x in enumerate(ids)]
    parsed = parse_jsonl(spark.createDataFrame(rows, "task string, line long, text string"), "collect")
    assert sorted(r["line"] for r in validate_samples(parsed).collect()) == [4, 6]


def test_publication_rules_count_rows_with_equal_lines(spark):
    df = _records(spark, ["a", "a", "a"]).withColumn("line", F.lit(1).cast("bigint"))
    assert [r["code"] for r in publication_violations(df).collect()] == ["duplicate_sample_id"] * 2


def test_repeat_rows_with_ties_and_null_keys(spark):
    df = spark.createDataFrame([("k", 1), ("k", 1), ("k", 3), (None, 2), (None, 4), ("z", 9)], "key string, line long")
    got = sorted((r["key"] or "", r["line"], r["first_line"]) for r in repeat_rows(df, ["key"], "line").collect())
    assert got == [("", 4, 2), ("k", 1, 1), ("k", 3, 1)]


def test_missing_and_empty_files(spark):
    files = spark.createDataFrame([("a", "/x/a"), ("b", "/x/b"), ("c", None), ("d", "/x/d")], "task string, path string")
    listing = spark.createDataFrame([("/x/a", 5), ("/x/b", 0)], "path string, length long")
    got = sorted((r["task"], r["code"]) for r in missing_files(files, listing).collect())
    assert got == [("b", "file_empty"), ("c", "file_missing"), ("d", "file_not_found")]


def test_line_numbers_survive_other_split_sizes(spark, tmp_dir):
    path = os.path.join(tmp_dir, "big.txt")
    with open(path, "w") as f:
        f.writelines(f"row {i}\n" for i in range(20_000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        raw = text_with_blocks(spark.read.text(path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        lines = number_lines(raw)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        n, wrong = lines.agg(F.count(F.lit(1)), F.count_if(F.col("text") != F.format_string("row %d", F.col("line") - 1))).first()
        again = read_lines(spark, path, base=0).agg(F.min("line"), F.max("line"), F.count_distinct("line")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert (n, wrong) == (20_000, 0) and tuple(again) == (0, 19_999, 20_000)


def test_line_numbers_without_a_table_of_lines(spark, tmp_dir, monkeypatch):
    """The second scan has the partitions of the first, whatever the split size is by then."""
    from sftlens.sources import jsonl

    for name, rows in (("a", 9_000), ("b", 1), ("c", 5_000)):
        with open(os.path.join(tmp_dir, f"{name}.txt"), "w") as f:
            f.writelines(f"{name} {i}\n" for i in range(rows))
    written = []
    monkeypatch.setattr(jsonl, "materialize", lambda df, name, old=jsonl.materialize: written.append(name) or old(df, name))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        lines = read_lines(spark, f"{tmp_dir}/*.txt", base=0, write=False)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        got = lines.select(F.regexp_extract("file", r"(\w)\.txt", 1).alias("f"), F.col("text") == F.format_string("%s %d", "f", "line"), "line")
        got = got.toDF("f", "right", "line").groupBy("f").agg(F.count_if("right"), F.min("line"), F.max("line"), F.count_distinct("line")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(tuple(r) for r in got) == [("a", 9_000, 0, 8_999, 9_000), ("b", 1, 0, 0, 1), ("c", 5_000, 0, 4_999, 5_000)]
    assert written == ["line-blocks"]


def test_dense_index_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("g", 2), (None, 2)], "g string, o long")
    got = sorted((r["g"] or "", r["o"], r["idx"]) for r in dense_index(df, ["o"], ["g"]).collect())
    assert got == [("", 1, 0), ("", 2, 1), ("", 3, 2), ("g", 2, 0)]


def test_percentiles_of_fractions(spark):
    df = spark.createDataFrame([(1.5,), (2.5,)], "x double")
    assert percentile_linear(df, "x", [50]).first()["p50"] == 2.0


def test_repeated_json_keys_parse_whatever_the_session_says(spark):
    old = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    try:
        df = parse_jsonl(spark.createDataFrame([('{"a":1,"a":2}',)], "text string"), "drop")
        assert df.select(F.try_variant_get("v", "$.a", "int")).first()[0] == 2
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", old)


def test_exact_sample_rejects_repeated_ids(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,)], "id long")
    with pytest.raises(ValueError):
        sample_exact(df, 2, 1, "id")
    assert sample_exact(df.distinct(), 2, 1, "id").count() == 2


def test_checkpoint_folder_must_be_named_off_local():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
