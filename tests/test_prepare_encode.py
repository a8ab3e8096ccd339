import json

from pyspark.sql import functions as F

from sftlens.functions.tokenize import CodePointTokenizer
from sftlens.operators.encode import collate_batches, encode_records, encode_stats
from sftlens.operators.prepare import prepare_counters, sample_exact, unify_records


def _raw(spark, objs):
    return spark.createDataFrame([(json.dumps(o), i) for i, o in enumerate(objs)], "s string, raw_index long") \
                .select(F.parse_json("s").alias("v"), "raw_index")


def test_unify_records(spark):
    objs = [{"problem": " P ", "solution": "S", "answer": 3}, {"question": "  ", "problem": "p", "output": "o"},
            {"query": "q", "response": ""}, {"input": "i", "reasoning": "r"}]
    flagged = unify_records(_raw(spark, objs), "limo", keep_skipped=True)
    got = {r["id"]: r for r in flagged.collect()}
    assert got["limo_0"]["prompt"] == "### Problem:\nP\n\n### Solution:\n" and got["limo_0"]["kept"]
    assert got["limo_0"]["metadata"]["answer"].toPython() == 3  # keeps its JSON type
    assert got["limo_0"]["source"] == "local_limo"
    assert not got["limo_1"]["kept"]  # "  " is chosen, then strips to empty
    assert not got["limo_2"]["kept"] and got["limo_3"]["kept"] and got["limo_3"]["metadata"]["answer"].toPython() == ""
    c = prepare_counters(flagged).first()
    assert (c["total"], c["kept"], c["skipped"]) == (4, 2, 2)


def test_sample_exact_is_exact_and_stable(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    a = sorted(r[0] for r in sample_exact(df, 37, 42, "k").collect())
    b = sorted(r[0] for r in sample_exact(df.repartition(7), 37, 42, "k").collect())
    assert len(a) == 37 and a == b
    assert sample_exact(df, 5000, 42, "k").count() == 1000


def test_encode_mask_eos_and_length(spark):
    tok = CodePointTokenizer()
    df = spark.createDataFrame([("ab", "cd"), ("ab", "c\u0003"), ("", "x"), ("abc", "defgh")],
                               "prompt string, completion string")
    enc = encode_records(df, tok, max_seq_length=5, keep_all=True).collect()
    assert enc[0]["input_ids"] == [97, 98, 99, 100, 3] and enc[0]["labels"] == [-100, -100, 99, 100, 3]
    assert enc[0]["attention_mask"] == [1] * 5 and enc[0]["status"] == "kept"  # equality is kept
    assert enc[1]["input_ids"] == [97, 98, 99, 3]  # EOS not appended twice
    assert enc[2]["status"] == "skipped_empty" and enc[3]["status"] == "skipped_too_long"
    s = encode_stats(encode_records(df, tok, 5, keep_all=True)).first()
    assert (s["total"], s["kept"], s["skipped_empty"], s["skipped_too_long"]) == (4, 2, 1, 1)


def test_collate_pads_to_longest_in_batch(spark):
    tok = CodePointTokenizer()
    df = spark.createDataFrame([(i, "p", "c" * (i + 1)) for i in range(5)], "i long, prompt string, completion string")
    enc = encode_records(df, tok, 100).withColumn("shard", F.lit(0))
    out = {r["i"]: r for r in collate_batches(enc, 2, "i", "shard", tok.pad_or_eos).collect()}
    assert [out[i]["batch"] for i in range(5)] == [0, 0, 1, 1, 2]
    assert len(out[0]["input_ids"]) == len(out[1]["input_ids"]) == 4
    assert out[0]["input_ids"][-1] == 3 and out[0]["labels"][-1] == -100 and out[0]["attention_mask"][-1] == 0


def test_sample_exact_matches_brute_force(spark):
    import hashlib

    df = spark.range(0, 3000).withColumnRenamed("id", "k").repartition(9)
    for n in (1, 37, 1500, 2999):
        want = sorted(range(3000), key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))[:n]
        got = sorted(r[0] for r in sample_exact(df, n, 7, "k").collect())
        assert got == sorted(want), n


def test_prepare_to_jsonl(spark, tmp_dir):
    import os

    from sftlens.operators.prepare import prepare_to_jsonl

    objs = [{"problem": f"p{i}", "solution": f"s{i}"} for i in range(20)] + [{"problem": "", "solution": "x"}]
    out = os.path.join(tmp_dir, "prepared")
    c = prepare_to_jsonl(_raw(spark, objs), "limo", out, sample_size=7, seed=42)
    assert c == {"total": 21, "kept": 20, "skipped": 1, "written": 7}
    back = spark.read.json(out)
    assert back.count() == 7 and set(back.columns) >= {"id", "source", "prompt", "completion", "metadata"}


def test_encode_to_parquet(spark, tmp_dir):
    import os

    from sftlens.operators.encode import encode_to_parquet

    df = spark.createDataFrame([(f"r{i}", "p", "c" * (i + 1)) for i in range(10)] + [("e", "", "x")],
                               "id string, prompt string, completion string")
    out = os.path.join(tmp_dir, "encoded")
    c = encode_to_parquet(df, out, max_seq_length=8, batch_size=2, n_shards=2)
    assert c == {"total": 11, "kept": 6, "skipped_empty": 1, "skipped_too_long": 4}
    back = spark.read.parquet(out).collect()
    assert len(back) == 6
    for r in back:
        assert len(r["input_ids"]) == len(r["labels"]) == len(r["attention_mask"])
    c2 = encode_to_parquet(df, os.path.join(tmp_dir, "flat"), max_seq_length=8)
    assert c2 == c and spark.read.parquet(os.path.join(tmp_dir, "flat")).count() == 6
