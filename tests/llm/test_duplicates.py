"""Jaccard join, substring dedup and embedding near-dedup against brute force."""
import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sftlens.llm import jaccard, neardup, substring
from sftlens.llm.common import connected_components, split_by_keys


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute_jaccard(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)])
    union = Union(sets)
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            union.join(a, b)
    return {d: (len(s), union.find(d)) for d, s in sets.items()}


def corpus(seed):
    """Near copies of one text, a passage that many texts share, tiny texts."""
    rng = np.random.default_rng(seed)
    voc = [f"w{i}" for i in range(2000)]
    base, passage, rows = list(rng.choice(voc, 110)), list(rng.choice(voc, 50)), []
    for i in range(120):
        w = base.copy()
        for j in rng.choice(110, rng.integers(0, 6), replace=False):
            w[j] = rng.choice(voc)
        rows.append((i, " ".join(w)))
    for i in range(120, 260):
        rows.append((i, " ".join([*rng.choice(voc, rng.integers(0, 25)), *passage, *rng.choice(voc, rng.integers(0, 9))])))
    for i in range(260, 300):
        rows.append((i, " ".join("a b c d e f g h i j k".split()[:rng.integers(0, 11)])))
    return [*rows, (300, None), (301, ""), (302, " \n"), (303, "x"), (304, "X"), (305, "\u00a0x"), (306, "long " * 5000), (307, "long " * 4000)]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, percent):
    rows = corpus(k)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, cls int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, k, percent).collect()}
    assert got == brute_jaccard(rows, k, percent)


def test_jaccard_repeated_rows_null_ids_and_dedup(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (5, text), (3, text.upper()), (9, "other words of another text here"), (None, text), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.near_duplicates(docs).collect())
    assert got == [(0, 0, 0), (0, 6, 0), (3, 6, 3), (5, 6, 3), (5, 6, 3), (9, 2, 9)]
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in jaccard.deduplicate(docs).collect())
    assert kept == sorted([(0, text), (0, ""), (3, text.upper()), (9, rows[3][1])])
    twice = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert jaccard.deduplicate(twice).count() == 1
    empty = docs.where(F.lit(False))
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.deduplicate(empty).count() == 0


def test_parities_never_drop_a_link():
    rng = np.random.default_rng(8)
    for n in (1, 5, 60, 400, 3000):
        for percent in (80, 85):
            for _ in range(40):
                s = np.unique(rng.integers(-2**63, 2**63 - 1, n))
                t = np.union1d(s[rng.random(len(s)) > 0.12 * rng.random()], rng.integers(-2**63, 2**63 - 1, int(n * 0.12 * rng.random())))
                both = len(np.intersect1d(s, t))
                differ = int(sum(bin(int(x) & (1 << 64) - 1).count("1") for x in jaccard.parities(s) ^ jaccard.parities(t)))
                assert differ <= len(s) + len(t) - 2 * both
                if 100 * both >= percent * (len(s) + len(t) - both):
                    assert differ <= len(s) + len(t) - 2 * -(-percent * (len(s) + len(t)) // (100 + percent))


def test_texts_that_share_passages_are_no_pairs(spark):
    """Hundreds of texts of the same passages in other words, and their near copies: brute force, and no pair but near copies is compared."""
    rng = np.random.default_rng(5)
    voc = [f"w{i}" for i in range(4000)]
    shared = [" ".join(rng.choice(voc, 30)) for _ in range(6)]
    rows = []
    for i in range(400):
        parts = [shared[j] for j in rng.choice(6, 4, replace=False)] + [" ".join(rng.choice(voc, 25))]
        rows.append((2 * i, " ".join(parts)))
        if i % 20 == 0:
            rows.append((2 * i + 1, rows[-1][1] + " end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    real = jaccard.overlap_filter
    try:
        jaccard.overlap_filter = lambda pairs, *rest: seen.append(pairs.count()) or real(pairs, *rest)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, 5, 80).collect()}
    finally:
        jaccard.overlap_filter = real
    assert got == brute_jaccard(rows, 5, 80)
    assert max(seen) < len(rows)


def test_signatures_of_linked_sets_meet():
    """Any two sets at the threshold share a signature, whatever share of shingles is frequent."""
    rng = np.random.default_rng(8)
    for share in (0.0, 0.5, 0.95, 1.0):
        bitmap = (rng.random((1 << jaccard.LOG2_BITMAP) // 8) < 0).astype(np.uint8)
        for percent in (80, 85):
            for n in (6, 7, 20, 33, 130, 700):
                x = np.unique(rng.integers(-2**63, 2**63 - 1, n, dtype=np.int64))
                for token in x[rng.random(len(x)) < share].view(np.uint64):
                    p = int(token) & ((1 << jaccard.LOG2_BITMAP) - 1)
                    bitmap[p >> 3] |= 1 << (p & 7)
                miss = jaccard.losses(len(x), percent)
                y = np.sort(x[rng.permutation(len(x))[:len(x) - miss]])
                if 100 * len(y) < percent * len(x):
                    continue
                a, b = (jaccard.signatures(len(s), s, bitmap, percent, True) for s in (x, y))
                assert len(np.intersect1d(a, b)) or np.array_equal(x, y), (share, percent, n)


def brute_windows(rows, size):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i:i + size]) for _, w in words for i in range(len(w) - size + 1))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if d is None else d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeated_windows(spark):
    rng = np.random.default_rng(3)
    voc = [f"w{i}" for i in range(40)]
    passages = [list(rng.choice(voc, n)) for n in (34, 35, 36, 50, 80)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.integers(0, 4)):
            w += [*rng.choice(voc, rng.integers(0, 40)), *passages[rng.integers(0, 5)][rng.integers(0, 3):]]
        rows.append((i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "a " * 200), (303, "a " * 36), (304, " ".join(passages[4])), (305, " ".join(passages[4])),
             (305, " ".join(passages[3] * 2)), (None, " ".join([*passages[4], "z"])), (None, "x"), (306, "A " * 36), (307, "\u00a0".join(passages[4]))]
    docs = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, seq int, pos string")
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in substring.repeated_windows(docs).collect())
    assert got == brute_windows(rows, 35)
    assert substring.repeated_windows(docs.where(F.lit(False))).count() == 0


def test_cover_holds_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    x = [(base + rng.standard_normal(8) * s).tolist() for s in (0.1, 0.3) for _ in range(700)] + [base.tolist()] * 40
    x += [[-v for v in base.tolist()], (2 * base).tolist(), [0.0] * 8, [float("nan")] * 8, [None] * 8, None, [], [float("inf")] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, i % 3) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in neardup.near_duplicates(vectors).collect()}
    union, links = Union(range(len(x))), Counter()
    groups = defaultdict(list)
    for i, v in enumerate(x):
        if v and None not in v and np.isfinite(v).all() and any(v):
            groups[len(v)].append(i)
    for ids in groups.values():
        m = np.array([x[i] for i in ids])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.9, 1))):
            links[ids[a]] += 1
            links[ids[b]] += 1
            union.join(ids[a], ids[b])
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert all(got[i]["n_links"] <= links[i] for i in range(len(x))) and found >= 0.999 * sum(links.values())
    assert all(got[i]["component_id"] == union.find(i) and got[i]["kept"] == (union.find(i) == i) for i in range(len(x)))
    assert neardup.near_duplicates(vectors.where(F.lit(False))).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(400)] + [(1000, 2000 + i) for i in range(300)] + [(5000, 5000), (7, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(401)}, 1000: 1000, **{2000 + i: 1000 for i in range(300)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_split_by_keys_loses_nothing(spark):
    df = spark.createDataFrame([(i, f"b{i}") for i in range(500)] + [(None, "null")], "id long, block string")
    keys = spark.createDataFrame([(i * 7,) for i in range(60)], "k long")
    out, maybe = split_by_keys(df, keys, "id", "k")
    assert out.columns == maybe.columns == df.columns and out.count() + maybe.count() == 501
    assert {r[0] for r in maybe.select("id").collect()} >= {i * 7 for i in range(60)} and out.where("id is null").count() == 1


def test_pairs_that_share_many_signatures_are_met_once(spark, monkeypatch):
    """Chains of near copies, of which a class links to its neighbours only: the last step finds what the stars miss."""
    import random

    from sftlens.llm import jaccard

    rng, rows = random.Random(5), []
    for g in range(3):
        words = [f"w{g}x{i}" for i in range(120)]
        for i in range(40):
            at = rng.randrange(len(words))
            words[at] = f"n{g}y{i}"
            rows.append((len(rows), " ".join(words)))
    met = []
    write = jaccard.Scratch.write
    monkeypatch.setattr(jaccard.Scratch, "write", lambda self, df, name: met.append((name, df)) or write(self, df, name))
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85)
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}

    sets = [frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) for w in (t.split() for _, t in rows)]
    want = list(range(len(rows)))
    for a, x in enumerate(sets):
        for b in range(a):
            if want[a] != want[b] and 100 * len(x & sets[b]) >= 85 * len(x | sets[b]):
                lo, hi = sorted((want[a], want[b]))
                want = [lo if c == hi else c for c in want]
    assert got == dict(enumerate(want))
    assert [n for n, _ in met if n.startswith("pairs")] == ["pairs-0", "pairs-1", "pairs-2"]


def test_first_meeting_keeps_a_pair_at_one_shared_signature(spark):
    from pyspark.sql import functions as F

    from sftlens.llm import jaccard

    sides = {"x": [1, 4, 6, 9], "y": [2, 4, 6, 9], "z": [7, 8, 9, 11]}
    rows = [(k, s, v[:3]) for k, v in sides.items() for s in v]
    t = spark.createDataFrame(rows, "cls string, sig long, lowest array<long>")
    x, y = t.alias("x"), t.alias("y")
    got = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.cls") < F.col("y.cls")) & jaccard.first_meeting())
    assert sorted((r[0], r[3], r[1]) for r in got.collect()) == [("x", "y", 4), ("x", "z", 9), ("y", "z", 9)]


def test_no_stage_of_the_join_holds_two_python_steps(spark, monkeypatch):
    rng, rows = np.random.default_rng(4), []
    for base in range(40):
        text = [f"w{base}x{i}" for i in range(205)]
        for copy in range(9):
            own = list(text)
            own[int(rng.integers(205))] = f"new{copy}"
            rows.append((len(rows), " ".join(own)))
    plans, write = {}, jaccard.Scratch.write

    def noted(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, df, name)

    monkeypatch.setattr(jaccard.Scratch, "write", noted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: i - i % 9 for i in range(len(rows))}
    assert "signed-again" in plans and "0-full" in plans  # sets that are made a second time
    assert {name for name, plan in plans.items() if plan.count("MapInPandas") > 1} == set()
