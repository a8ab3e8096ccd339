"""Filter audit, fill-in-middle and the digest index against plain Python."""
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sftlens.llm import exactdedup, fillmiddle, filteraudit

SPACE = " \t\n\x0b\x0c\r"


def words(t):
    return [w for w in re.split(f"[{SPACE}]+", t) if w]


def brute_audit(rows, labels):
    least, failing = {}, []
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, part in rows:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        good, toxic = (any(x == d and y[k] == 1 for x, *y in labels if d is not None) for k in range(2))
        failing.append((part or "", {f for f, x in fails.items() if x}, good, toxic))
    out, shapley = {}, {}
    for part in {p for p, *_ in failing}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in failing if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                hit = [r for r in failing if r[0] == part and f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, order, step] = [len(left), len(gone), len(hit) - len(gone), sum(r[1] == {f} for r in hit), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_every_order(spark):
    rng = random.Random(4)
    long = lambda n, voc: " ".join(rng.choice(voc) for _ in range(n))
    voc = [f"w{i}" for i in range(500)]
    rows = [(i, rng.choice([long(rng.randint(150, 260), voc), long(300, voc[:20]), "SHOUTING " * 90, long(210, voc) + " #", "same", "", None]), rng.choice(["x", "y", None, ""]))
            for i in range(120)]
    rows += [(7, "same", "x"), (7, "same", "x"), (None, "same", "x"), (None, None, None), (500, "w w  \x0b\x85 ÄÖ", "only"), (501, "$" * 300_000, "only")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 120, 2)] + [(7, 0, 1), (7, 1, 0), (None, 1, 1), (9, None, None), (9999, 1, 1)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, lang string, mask string, n int")
    tagged = spark.createDataFrame([(*r, "b") for r in labels], "doc_id long, quality int, toxic int, text string")
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    got = filteraudit.audit(docs, tagged).collect()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit
    expected = brute_audit(rows, labels)
    assert len(got) == len(expected) == 600 * 4
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == expected
    assert filteraudit.audit(docs.where("false"), tagged).count() == 0
    assert filteraudit.audit(docs, tagged.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(i, "a" * (i % 4), "p") for i in range(20)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filteraudit.audit(docs, labels, filters=lambda t: {"L": F.char_length(t) > 1})
    assert sorted(tuple(r[1:5]) for r in got.collect()) == [("EL", 1, 4, 16), ("EL", 2, 2, 2), ("LE", 1, 10, 10), ("LE", 2, 2, 8)]


def brute_middle(d, t):
    t = t or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, t
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_against_slicing(spark):
    rng = random.Random(9)
    texts = ["", None, "\n", "\n\n\n", "a", "a\n", "\na", "<P>", "x<S>\ny", "<M", "<", ">\n<", "P>a\n<", "<P\n>", "<<P>>", "\r\nß €\U0001f600\n" * 3, "line\n" * 400_000, "é" * 1_500_000]
    texts += ["".join(rng.choice(["a", "\n", "é", "€", "<", ">", "S", "\U0001f600", "word "]) for _ in range(rng.randint(0, 200))) for _ in range(1500)]
    rows = [(i - 3, t) for i, t in enumerate(texts)] + [(None, "null\nid\n"), (4, "again\nb"), (4, "again\nb")]
    docs = spark.createDataFrame([(*r, "z", 5) for r in rows], "doc_id long, text string, output string, n int")
    got = fillmiddle.restore(fillmiddle.transform(docs)).collect()
    assert sorted(((r["doc_id"] or 0), r["restored"]) for r in got) == sorted((d or 0, t or "") for d, t in rows)
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=key) == \
        sorted(((d, *brute_middle(d, t)) for d, t in rows), key=key)
    assert fillmiddle.restore(fillmiddle.transform(docs.where("false"))).count() == 0


def test_middle_in_small_blocks(monkeypatch):
    monkeypatch.setattr(fillmiddle, "BLOCK", 7)
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice(list(b"ab\n"), n)) for n in rng.integers(0, 30, 300)] + [b"", b""]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    before, n = fillmiddle.line_counts(data, offs)
    units = [re.findall(rb"[^\n]*\n|[^\n]+", t) for t in texts]
    assert n.tolist() == [len(u) for u in units]
    cut_units = np.sort(rng.integers(0, n[:, None] + 1, (len(n), 2)), axis=1)
    cuts = fillmiddle.cut_positions(data, offs, before, cut_units)
    assert [(c - o).tolist() for c, o in zip(cuts, offs)] == [[len(b"".join(u[:k])) for k in ks] for u, ks in zip(units, cut_units)]
    forms = np.array(rng.choice(["psm", "spm", "plain"], len(n)), dtype=object)
    out_offs, out = fillmiddle.scatter(data, offs, cuts, forms, (b"<PRE>", b"[S]", b"|"))
    back = fillmiddle.gather(out, out_offs, forms, (b"<PRE>", b"[S]", b"|"))
    assert back[0].tolist() == offs.tolist() and back[1].tobytes() == data.tobytes()
    with pytest.raises(ValueError):
        fillmiddle.gather(out, out_offs, np.where(forms == "psm", "spm", "psm"), (b"<PRE>", b"[S]", b"|"))


def test_middle_rates_and_sentinels(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'a\\nb\\nc' AS text")
    forms = {r["form"]: r["count"] for r in fillmiddle.transform(docs, rate=40, spm_rate=100, seed=3).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm"} and 120 < forms["spm"] < 200
    for bad in [(b"", b"a", b"b"), (b"ab", b"ba", b"c"), (b"aa", b"b", b"c"), (b"abc", b"b", b"x"), (b"a", b"a", b"b")]:
        with pytest.raises(ValueError):
            fillmiddle.check_sentinels(bad)


def normal(t):
    return re.sub(f"[{SPACE}]+", " ", t or "")


def test_exact_dedup_against_a_dictionary(spark):
    rng = random.Random(1)
    texts = ["a b", "a  b", "a\tb", " a b", "a b ", "a b", "", None, " ", "\n", "long " * 100_000, "long  " * 100_000, "A b", "é"]
    rows = [(rng.randint(-500, 500), rng.choice(texts)) for _ in range(400)] + [(None, "a b"), (None, "only null"), (None, "only null"), (3, "a b"), (3, "a b")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, digest string, row int")
    got = exactdedup.deduplicate(docs).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(normal(t), []).append(d)
    least = {t: min((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    expected = [(d, least[normal(t)], len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for d, t in rows]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(expected, key=key)
    kept = [(r["doc_id"], r["text_sha256"]) for r in got if r["kept"]]
    assert sorted(kept, key=key) == sorted(((least[t], hashlib.sha256(t.encode()).hexdigest()) for t in groups), key=key)
    assert exactdedup.deduplicate(docs.where("false")).count() == 0


def test_index_persists_and_is_not_shuffled(spark, tmp_dir):
    def batch(rows):
        return exactdedup.digests(spark.createDataFrame(rows, "doc_id long, text string"))

    def entries(index):
        return sorted((r["id"], bytes(r["digest"])) for r in index.rows().collect())

    index = exactdedup.DigestIndex(spark, f"{tmp_dir}/index", buckets=4)
    index.add(batch([(1, "a"), (2, "a "), (3, "b")]))
    first = entries(index)
    assert [i for i, _ in first] == [1, 2, 3]
    index.close()
    index = exactdedup.DigestIndex(spark, f"{tmp_dir}/index", buckets=16)  # as it was created
    assert index.buckets == 4 and entries(index) == first
    index.add(batch([(0, "a"), (9, "c"), (8, "c")]))  # a text of an earlier batch keeps its first id
    assert [i for i, _ in entries(index)] == [1, 2, 3, 8]
    index.add(batch([(0, "a"), (9, "c"), (8, "c")]))  # again, as after a failure
    assert [i for i, _ in entries(index)] == [1, 2, 3, 8]
    got = sorted((r["keep_id"], r["group_size"]) for r in index.groups(batch([(0, "a"), (8, "c"), (9, "c")])).collect())
    assert got == [(1, 1), (8, 2)]
    for df, kind in ((index.new(index.firsts(batch([(1, "a")]))), "LeftAnti"), (index.groups(batch([(1, "a")])), "Inner")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        index_side = plan[plan.rindex("+- Sort"):]
        assert f", {kind}" in plan and "Bucketed: true" in index_side and "Exchange" not in index_side, plan
    index.close()
