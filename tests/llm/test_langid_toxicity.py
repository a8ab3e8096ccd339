"""Language ID and toxicity: held-out accuracy on made-up corpora, exact neighbours, edge cases."""
import numpy as np
from pyspark.sql import functions as F

from sftlens.llm import langid, toxicity

SYLLABLES = {"aa": "ka lo mi ne ru sa to".split(), "bb": "schu tze gra fli pfo dre kno".split(), "cc": "ña llo ció rra que xi ho".split()}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = np.random.default_rng(5)
    langs = sorted(SYLLABLES)
    rows = [(i, words(rng, langs[i % 3], int(rng.integers(3, 80))), langs[i % 3], 0.5) for i in range(300)]
    rows += [(300, None, "aa", 0.0), (301, "", "aa", 0.0), (302, "123 !? \n", "bb", 0.0), (303, words(rng, "aa", 40), None, 0.0),
             (304, words(rng, "aa", 60) + " " + words(rng, "bb", 60), None, 0.0), (305, "K" * 30_000, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    held = langid.remainder("doc_id", 4) == 2
    model = langid.train(docs.where(~held))
    assert model[0] == langs
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    hits = [got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:300]]
    assert np.mean(hits) > 0.98
    for i in (300, 301, 302):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0
    assert sorted(got[304]["langs"]) == ["aa", "bb"] and abs(got[304]["shares"][0] - 0.5) < 0.2
    assert got[303]["langs"] == ["aa"] and got[305]["lang_pred"] in langs
    tagged = {r["doc_id"]: r["_p"] for r in langid.tag(docs, model, "_p").collect()}
    assert tagged == {i: r["lang_pred"] for i, r in got.items()}
    none = langid.train(docs.where(F.lit(False)))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.where(F.lit(False)), model).count() == 0


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    like = rng.random((200, 2)).astype(np.float32) + 0.01
    like /= like.sum(axis=0)
    n = rng.multinomial(50_000, like @ [0.7, 0.3] / (like @ [0.7, 0.3]).sum()).astype(np.float32)
    p, _ = langid.em(like, n, np.array([0]), np.ones((1, 2)))
    assert abs(p[0, 0] - 0.7) < 0.05


def test_neighbours_are_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for i in range(700):
        terms = tuple(sorted(rng.choice(60, rng.integers(1, 6), replace=False).tolist()))
        w = rng.random(len(terms)) + 0.1
        w /= np.sqrt((w * w).sum())
        vectors.append((terms, tuple(w), 1.0, 1.0, i))
    index = toxicity.Index(vectors)
    dense = np.zeros((700, 60))
    for i, (t, w, *_) in enumerate(vectors):
        dense[i, list(t)] = w
    for t, w, *_ in vectors[:60]:
        q = np.zeros(60)
        q[list(t)] = w
        cos = dense @ q
        kth = np.sort(cos)[-toxicity.K]
        ids, got = index.nearest(t, w)
        assert ids.tolist() == np.flatnonzero(cos >= max(kth - 1e-9, 1e-12)).tolist()
        assert np.allclose(got, cos[ids])


def test_neighbours_of_a_batch_equal_those_alone_and_brute_force():
    rng = np.random.default_rng(5)
    rate = np.concatenate([np.full(30, 0.4), np.full(400, 0.01)])  # terms with columns, terms with posting lists
    x = (rng.random((1500, 430)) < rate) * (rng.random((1500, 430)) + 0.1).astype(np.float32)
    x = (x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-9)[:, None]).astype(np.float32)
    x = x[x.any(axis=1)]
    index = toxicity.Index([(np.flatnonzero(r), r[r > 0], 1.0, 1.0, i) for i, r in enumerate(x)])
    assert index.blocks > 2 * toxicity.FIRST and 0 < index.dense < 430 and len(index.lists)
    unknown = (np.array([500, 9000]), np.array([0.6, 0.8]))
    queries = [unknown] + [(np.flatnonzero(r), r[r > 0].astype(float)) for r in x[:300]] + [(np.array([40, 700]), np.array([0.6, 0.8]))]
    got = list(index.nearest_all(queries))
    assert len(got) == len(queries) and not len(got[0][0])
    for (terms, w), (ids, cos) in zip(queries, got):
        alone, own = index.nearest(terms, w)
        assert ids.tolist() == alone.tolist() and cos.tolist() == own.tolist()
        q = np.zeros(9001)
        q[terms] = w
        every = x.astype(float) @ q[:430]
        kth = np.sort(every)[-toxicity.K]
        assert ids.tolist() == np.flatnonzero(every >= max(kth - toxicity.TIE, 1e-12)).tolist()
        assert np.allclose(cos, every[ids], rtol=0, atol=1e-6)
    assert list(index.nearest_all([])) == []


def test_scores_do_not_depend_on_the_batch(monkeypatch):
    import xxhash

    rng = np.random.default_rng(6)
    texts = [words(rng, "aa", 12) for _ in range(150)] + ["", None, words(rng, "aa", 3)]
    table = np.unique(np.array([xxhash.xxh3_64_intdigest(f) for t in texts[:100] for w in t.split() for f in toxicity.features(w)], np.uint64))
    weight = rng.random(len(table)) + 0.5
    seen = {(t.tobytes(), n.tobytes()): (t, n) for t, n in toxicity.Terms(table).counts(texts[:100])}
    model = table, weight, [(t, toxicity.unit(t, n, weight), i % 2, 1 - i % 2, i) for i, (t, n) in enumerate(seen.values())], 0.25, 0.5
    want = list(toxicity.Scorer(*model).scores(texts + texts[:20]))
    assert want[150] == want[151] == (0.25, []) and want[:20] == want[-20:]
    monkeypatch.setattr(toxicity, "TOGETHER", 1)
    monkeypatch.setattr(toxicity, "MEMO", 3)
    got = list(toxicity.Scorer(*model).scores(texts + texts[:20]))
    assert got == want


def test_counting_and_scoring_share_the_tokens_met():
    table = np.array([1, 5, 9], np.uint64)
    first = toxicity.learnt(table)
    assert toxicity.learnt(table.copy()) is first and toxicity.learnt(table[:2])["terms"] is not first["terms"]


def test_toxicity_scores(spark):
    rng = np.random.default_rng(7)
    bad = ["vilgor", "trasmun", "ekelpot"]
    rows, labels = [], []
    for i in range(400):
        text, toxic = words(rng, "aa", 30), int(i % 4 == 0)
        if toxic:
            text += " " + " ".join(rng.choice(bad, 3))
        rows.append((i, text, 9))
        labels.append((i, toxic if i % 50 else None, "y"))
    rows += [(400, None, 0), (401, "", 0), (402, rows[0][1], 0), (402, rows[0][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    table = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    learn = langid.remainder("doc_id", 5) != 0
    model = toxicity.fit(docs, table, learn)
    got = toxicity.scores(docs, model).collect()
    assert len(got) == len(rows)
    score = {r["doc_id"]: r["score"] for r in got}
    assert min(score[i] for i in range(0, 400, 4)) > 0.5 > max(score[i] for i in range(400) if i % 4)
    assert 0 <= score[400] == score[401] < 0.5 and score[402] == score[0]
    assert all(r["evidence"] for r in got if r["doc_id"] in (0, 4, 8))
    one = toxicity.fit(docs, table.where("toxic = 0"), learn)
    assert {r["score"] for r in toxicity.scores(docs, one).collect()} == {0.0}
    empty = toxicity.fit(docs.where(F.lit(False)), table, learn)
    assert toxicity.scores(docs.where(F.lit(False)), empty).count() == 0


def test_documents_without_telling_terms_have_neighbours(spark):
    """Every term of the examples is in the vectors, of either class: scores and neighbours by brute force."""
    rng = np.random.default_rng(9)
    bad = ["vilgor", "trasmun", "ekelpot"]
    rows = [(i, words(rng, "abc"[i % 3] * 2, 25) + (" " + " ".join(rng.choice(bad, 3)) if i % 4 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    learn = langid.remainder("doc_id", 5) != 0
    model = toxicity.fit(docs, table, learn)
    got = {r["doc_id"]: r for r in toxicity.scores(docs, model).collect()}
    learnt = [r["doc_id"] for r in docs.where(learn).collect()]
    counts = [{} for _ in rows]
    for c, (_, text) in zip(counts, rows, strict=True):
        for f in (f for t in text.split() for f in toxicity.features(t)):
            c[f] = c.get(f, 0) + 1
    names = sorted({f for i in learnt for f in counts[i]})
    tf = np.array([[1 + np.log(c[f]) if f in c else 0 for f in names] for c in counts])
    y = np.array([i % 4 == 0 for i in learnt])
    held, n, pos = tf[learnt] > 0, len(learnt), y.sum()
    a, b = held[y].sum(axis=0), held[~y].sum(axis=0)
    chi2 = n * (a * (n - pos) - b * pos) ** 2.0 / ((a + b) * np.maximum(n - a - b, 0.5) * pos * (n - pos))
    x = tf * (np.log((1 + len(rows)) / (1 + (tf > 0).sum(axis=0))) + 1) * (1 + np.sqrt(chi2))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    for i in range(len(rows)):
        cos = x[learnt] @ x[i]
        at = cos >= np.sort(cos)[-toxicity.K] - toxicity.TIE
        vote = cos[at] ** 2
        assert abs((vote @ y[at] + toxicity.PRIOR * pos / n) / (vote.sum() + toxicity.PRIOR) - got[i]["score"]) < 1e-4
        assert got[i]["evidence"] == [learnt[j] for j in np.argsort(-cos)[:3]]


def test_documents_in_no_learnt_language(spark):
    rng = np.random.default_rng(4)
    speak = lambda voc, n: " ".join(rng.choice(voc, n))
    one, two = ["der", "garten", "scheint", "hell", "und"], ["the", "garden", "is", "shining", "bright"]
    rows = [(i, speak(one if i % 2 else two, 40), "de" if i % 2 else "en") for i in range(60)]
    odd = [(100, "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 " * 9), (101, "zq xv jk " * 30), (102, "12 !"), (103, None), (104, "")]
    mixed = [(110, speak(one, 20) + " " + speak(two, 20)), (111, "garden"), (112, speak(two, 30) + " qx" * 20)]
    docs = spark.createDataFrame(rows + [(*r, None) for r in odd + mixed], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in langid.known(docs, langid.train(docs)).collect()}
    assert kept == set(range(60)) | {110, 111, 112}
    nothing = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["doc_id"] for r in langid.known(docs, nothing).collect()} == kept | {100, 101}
    assert langid.known(docs.where("false"), nothing).count() == 0


def test_letters_of_every_plane():
    is_letter = langid.letters()
    assert len(langid.trigrams("\U00030000\U00031350", is_letter)) and not len(langid.trigrams("\U0001f600 1", is_letter))
    got = langid.infer(["\U00030000"], ["x"], np.full((langid.BUCKETS, 1), 1 / langid.BUCKETS, np.float32), is_letter)
    assert got[0][0] == "x"


def test_long_words_are_whole_terms():
    assert toxicity.features("a" * 60 + "b") != toxicity.features("a" * 60 + "c")


def test_terms_of_tokens_by_their_beginnings(monkeypatch):
    """As every feature looked up by itself, whatever is remembered; frequent tokens are not learnt again."""
    import numpy as np
    import xxhash

    from sftlens.llm import toxicity

    known = ["gorblin", "gorbles", "the", "straße", "²x", "abc", "abcdefghijkl", "ab1cd"]
    table = np.unique(np.array([xxhash.xxh3_64_intdigest(f) for t in known for f in toxicity.features(t)], np.uint64))
    texts = ["The gorbling, GORBLIN the the", None, "", "abcdefghijkl abcdefghi abcd straßen STRASSE ²x x² ab1cd Ⅷ", "l'abc gorbles-abc the"] * 3
    learnt = []
    monkeypatch.setattr(toxicity, "TOKENS", 4)
    for words in (0, 3, 1000):
        monkeypatch.setattr(toxicity, "WORDS", words)
        terms = toxicity.Terms(table)
        learn = terms._learn
        monkeypatch.setattr(terms, "_learn", lambda learn=learn, terms=terms: learnt.append((words, list(terms.new))) or learn())
        for t, (own, count) in zip(texts, terms.counts(texts), strict=True):
            want = {}
            for f in (f for w in (t or "").split() for f in toxicity.features(w)):
                at = np.flatnonzero(table == np.uint64(xxhash.xxh3_64_intdigest(f)))
                for i in at.tolist():
                    want[i] = want.get(i, 0) + 1
            assert dict(zip(own.tolist(), count.tolist())) == want and own.tolist() == sorted(want)
        assert len(terms) <= words + 20
    assert sum("The" in new for words, new in learnt if words == 3) == 1


def test_words_are_counted_once_for_all_texts_of_a_group(monkeypatch):
    """Words of up to 16 letters are told apart by their bits, looked up together and learnt once; counts are those of
    every feature looked up by itself."""
    import numpy as np
    import xxhash

    from sftlens.llm import toxicity

    words = ["a", "ab", "abcd", "abcdefgh", "abcdefghi", "abcdefgha", "bbcdefghi", "abcdefghijklmnop", "abcdefghijklmnoq",
             "abcdefghijklmnopq", "abcdefghijklmnopqr", "straße", "naïveté", "ΟΔΟΣ", "İstanbul", "x1y2", "²x", "Ⅷ", "co\u00adop", "\u212aelvin"]
    texts = [None, "", " \t\n", " ".join(words), "\u3000".join(words).upper(), *(f"({a}-{b})\x1f{b}_{a}\x85{b}é{a}" for a in words for b in words), "7" * 50]
    table = np.unique(np.array([xxhash.xxh3_64_intdigest(f) for t in words[::2] for f in toxicity.features(t)], np.uint64))
    number = {int(h): i for i, h in enumerate(table)}
    learnt = []
    for tokens, limit in ((1, 0), (50, 5), (10**6, 10**6)):
        monkeypatch.setattr(toxicity, "TOKENS", tokens)
        monkeypatch.setattr(toxicity, "WORDS", limit)
        terms = toxicity.Terms(table)
        learn = terms._learn
        monkeypatch.setattr(terms, "_learn", lambda learn=learn, terms=terms: learnt.append((limit, list(terms.new))) or learn())
        for _ in range(2):
            for t, (own, count) in zip(texts, terms.counts(texts), strict=True):
                want = {}
                for f in (f for w in (t or "").split() for f in toxicity.features(w)):
                    if (i := number.get(xxhash.xxh3_64_intdigest(f))) is not None:
                        want[i] = want.get(i, 0) + 1
                assert dict(zip(own.tolist(), count.tolist())) == want and own.tolist() == sorted(want)
    once = [t for limit, new in learnt if limit == 10**6 for t in new]
    assert len(once) == len(set(once)) and {"abcdefghi", "abcdefghijklmnopq", "straße"} <= set(once)
    assert not any(t.isascii() and not t.isalpha() for t in once)
