"""Byte-level BPE against the tiktoken library and by round trip."""
import base64
import hashlib
import weakref

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from sftlens.llm import bpe, common  # noqa: E402

with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
    RANKS = f.read()
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab eé ñ'st\n\t  \x1c\x85\xa0 129²Ⅷ!_?-中🙂́́ÀBzr")), max_size=60))
def test_equals_tiktoken(text):
    assert CODEC.encode(text) == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["", "a" * 4000, " " * 3000, "ab" * 3000, "aaab" * 500 + "é" * 300, "<|endoftext|>", "x" * 70 + " y", " lead", "'s's 've"])
def test_long_and_odd_pieces(text):
    assert CODEC.encode(text) == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("size", [0, 4, 1000])
def test_small_memo_gives_the_same(size):
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN, size)
    for text in ("the cat sat on the mat", "one two three four five six", "the cat sat on the mat") * 2:
        ids = REFERENCE.encode_ordinary(text)
        assert codec.digest(text)[:2] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_new_pre_tokens_of_all_texts_share_one_queue(monkeypatch):
    codec, queues = bpe.Codec(RANKS, public_tokenizers.PATTERN), []
    joined = codec._join
    monkeypatch.setattr(codec, "_join", lambda ids, *rest: queues.append(len(ids)) or joined(ids, *rest))
    texts = [f"qz{i}vrx zzk{i}! plomb{'abc' * i}ard, a\0b\1c" for i in range(50)] + [None, ""]
    for room in (bpe.MEMO, 20):  # all chunks are new, then some remembered
        codec.room, codec.said, codec.raw = room, bpe.Known(), bpe.Known()
        for _ in range(2):
            for t, (n, ids, decoded) in zip(texts, codec.digests(texts), strict=True):
                want = REFERENCE.encode_ordinary(t or "")
                assert (n, ids) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
                assert decoded == hashlib.sha256((t or "").encode()).hexdigest()
    assert sum(n > 100 for n in queues) <= 8  # the first words of texts and the other ones, per call


def test_table_whose_joins_rank_before_their_parts():
    words = [b"ab", b"ba", b"aa", b"aab", b"aba", b"abab", b"baab", b"bb", b"abb", b"aaaa", b"bbb"]
    ranks = words[::-1] + [bytes([i]) for i in range(256)]
    data = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(ranks))
    codec, pattern = bpe.Codec(data, r"[^ ]+| +"), r"[^ ]+| +"
    reference = tiktoken.Encoding("odd", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    assert not codec.ordered
    for n in range(3, 9):
        for i in range(1 << n):
            text = f"{i:0{n}b}".replace("0", "a").replace("1", "b")
            assert codec.encode(text) == reference.encode_ordinary(text)


def test_digests_and_round_trip_of_rows(spark):
    texts = [None, "", "Hello, wörld!  it's 12\n", "Hello, wörld!  it's 12\n", "z" * 500]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = REFERENCE.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.digests(docs.where(F.lit(False)), RANKS, public_tokenizers.PATTERN).count() == 0


def test_merging_holds_a_bounded_part_of_a_large_batch(monkeypatch):
    codec, sizes, merge = bpe.Codec(RANKS, public_tokenizers.PATTERN, 1000), [], bpe.Codec.merge
    monkeypatch.setattr(bpe.Codec, "merge", lambda self, chunks: sizes.append(sum(map(len, chunks))) or merge(self, chunks))
    texts = [" ".join(f"w{i * 20_000 + j:x}" for j in range(20_000)) for i in range(22)]
    got = list(codec.digests(texts))
    assert sum(sizes) > 2_900_000 and max(sizes) < 1_300_000
    for text, (n, ids, _) in list(zip(texts, got, strict=True))[::7]:
        want = REFERENCE.encode_ordinary(text)
        assert (n, ids) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())


def test_a_worker_lets_go_of_what_an_earlier_job_left():
    class Held:
        pass

    ref = weakref.ref(common.per_worker("one", Held))
    assert ref() is common.per_worker("one", Held)
    assert common.per_worker("two", lambda: ref() is None)
