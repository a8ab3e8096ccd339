import os

import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from sftlens.functions.tokenize import HFTokenizer  # noqa: E402


def test_tokenizer_file_through_pandas_udf(spark, tmp_dir):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = {"[UNK]": 0, "hello": 1, "world": 2, "!": 3}
    tok = Tokenizer(models.WordLevel(vocab, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    path = os.path.join(tmp_dir, "tokenizer.json")
    tok.save(path)
    hf = HFTokenizer(path)
    df = spark.createDataFrame([("hello world!",), ("",), ("zzz hello",)], "t string")
    got = df.select(hf.encode(F.col("t")).alias("ids"), hf.count(F.col("t")).alias("n")).collect()
    assert [r["ids"] for r in got] == [[1, 2, 3], [], [0, 1]]
    assert [r["n"] for r in got] == [3, 0, 2]


def test_padding_id_of_a_tokenizer_file(spark, tmp_dir):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from sftlens.operators.encode import encode_to_parquet

    tok = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2, "</s>": 3}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = os.path.join(tmp_dir, "tokenizer.json")
    tok.save(path)
    hf = HFTokenizer(path, eos_token="</s>")
    os.remove(path)  # the file's text travels with the function
    assert hf.pad_or_eos == 3 and HFTokenizer.pad_or_eos.fget(type("T", (), {"pad_id": 9, "eos_id": None})) == 9
    rows = [("r1", "a b ", " a </s>"), ("r2", "a ", " b </s>"), ("r3", "a ", "")]
    df = spark.createDataFrame(rows, "id string, prompt string, completion string")
    out = os.path.join(tmp_dir, "encoded")
    stats = encode_to_parquet(df, out, hf, batch_size=2)
    assert stats == {"total": 3, "kept": 2, "skipped_empty": 1, "skipped_too_long": 0}
    got = {r["id"]: (list(r["input_ids"]), list(r["labels"])) for r in spark.read.parquet(out).collect()}
    assert got == {"r1": ([1, 2, 1, 3], [-100, -100, 1, 3]), "r2": ([1, 2, 3, 3], [-100, 2, 3, -100])}
