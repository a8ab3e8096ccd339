"""Decontamination: the search for candidates loses nothing that the check accepts."""
import itertools
import math
import random
from collections import Counter

import numpy as np

from sftlens.llm import decontam

RARE = ["".join(a + b for a, b in zip(x, "aeiou")) for x in itertools.product("bcdfgklmnprst", repeat=3)]


def passes(need, tail, part):
    got = decontam.common_subsequence(need, part)
    return got >= decontam.COPY * len(need) or (
        got >= max(4, decontam.PARAPHRASE * len(need)) and decontam.common_subsequence(tail, part) >= decontam.ANSWER * len(tail))


class Brute:
    """Content words by counting all passages, and every stretch of a document compared with every item."""

    def __init__(self, texts, items):
        vocabulary = sorted({decontam.term(w) for _, t in items for w in t.split()})
        self.number = {t: i for i, t in enumerate(vocabulary)}
        size, df, total = decontam.BLOCK * decontam.SPAN, Counter(), 0
        for t in texts:
            w = t.split()
            for s in range(0, len(w), size):
                df.update({decontam.term(x) for x in w[s:s + size]})
                total += 1
        self.content = {t for t in vocabulary if math.log((1 + total) / (1 + df[t])) >= decontam.CONTENT_IDF}
        self.items = {i: (self.ids(t), self.ids([s for s in t.split(".") if s.strip()][-1]), len(t.split())) for i, t in items}

    def ids(self, text):
        return np.array([self.number[t] for w in text.split() if (t := decontam.term(w)) in self.content], int)

    def leak(self, words, i):
        need, tail, n = self.items[i]
        step, span = -(-n // 16) + 1, 3 * -(-n // 16) + 2
        return any(passes(need, tail, self.ids(" ".join(words[s * 16:(s + span) * 16]))) for s in range(0, len(words) // 16 + 1, step))


def test_search_finds_what_the_check_accepts(spark):
    rng = random.Random(11)
    unknown = (f"zq{i}x" for i in range(10**6))
    prose = lambda n: " ".join(rng.choice(RARE) for _ in range(n))
    items = [(i, f"{prose(n)}. {prose(5)}.") for i, n in enumerate([6, 7, 9] * 4 + [25, 40, 55] * 6 + [420, 600])]
    filler = lambda n: " ".join(next(unknown) for _ in range(n))
    rows, planted = [], []
    for k, (i, text) in enumerate(items * 3):
        words = text.split()
        share = rng.uniform(0.45, 0.6)
        span = [w if j >= len(words) - 5 or rng.random() < share else next(unknown) for j, w in enumerate(words)]
        rows.append((k, f"{filler(rng.randint(0, 200))} {' '.join(span)} {filler(rng.randint(0, 200))}"))
        planted.append((k, i, " ".join(span)))
    rows += [(1000 + k, prose(rng.randint(50, 900))) for k in range(40)]
    brute = Brute([t for _, t in rows], items)
    want = {(k, i) for k, t in rows for i, _ in items if brute.leak(t.split(), i)}
    sure = {(k, i) for k, i, span in planted if passes(*brute.items[i][:2], brute.ids(span))}
    assert len(sure) > 60 and {i for _, i in sure} >= {0, 1, 2, 30, 31} and sure <= want
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want)
    assert {r["doc_id"] for r in decontam.without_leaks(docs, bench).collect()} == {k for k, _ in rows} - {k for k, _ in want}


def test_passages_are_counted_beyond_a_byte():
    import numpy as np

    from sftlens.llm import decontam

    flags = np.random.default_rng(2).random((1000, 7)) < np.array([0, 0.1, 0.3, 0.5, 0.9, 1, 1])
    for n in (0, 1, 254, 255, 256, 600, 1000):
        assert decontam.column_sums(flags[:n]).tolist() == [int(c.sum()) for c in flags[:n].T]


def test_words_are_numbered_as_one_by_one_and_ascii_ones_not_in_python():
    terms = sorted({"copy", "i̇", "k", "naïve", "straße", "σας", "it's", "42"})
    spaces = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    words = ["Copy", "(copy)", "copy\x00", "İ", "K", "«Naïve»", "STRASSE", "Straße", "ΣΑΣ", "ΣΑΣ.", "It's", "--", "«»", "…42…", "­", "co­py", "zz"]
    texts = [None, "", " ", *(f"{a}{s}{b}" for s in spaces for a, b in itertools.product(words, repeat=2)), spaces.join(words)]
    index = {t: i for i, t in enumerate(terms)}
    want = [[index.get(t, -1) for w in (x or "").split() if (t := decontam.term(w))] for x in texts]
    vocabulary = decontam.Vocabulary(terms)
    got = list(vocabulary.all_ids(texts))
    assert [x.tolist() for x in got] == want and {x.dtype for x in got} == {np.dtype(np.int32)}
    assert vocabulary.ids(texts[-1]).tolist() == want[-1]
    assert not any(map(str.isascii, vocabulary))
