"""PII: base patterns against plain regular expressions, the CRF on its table and on held-out lines."""
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sftlens.llm import crf, pii

TAGGER = pii.Tagger()


def plain(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(out)]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(4)
    pieces = ["a@b.c", "@b.c", "x", "1.2.3.4", "999.1.1.1", "0001.2.3.4", "5", "4111111111111111", "4111 1111-1111 1111", "+1 (212) 555-0143",
              "+", "-", ".", " ", "\n", "é", "me@x", "@", "a.b%c@d-e.f.g", "12", "3782 822463 10005", "+49.30.901820"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "@a.b" * 50_000):
        pii.base_spans(text)


def test_labelled_table_and_new_lines():
    for words, labels in pii.parse_labelled(pii.LABELLED):
        assert TAGGER.label([words]).tolist() == labels, words
    held_out = ["the office is at [phone|(303) 555-0177] now", "reach [email|zoe.k@site.example.org] or [ip|10.1.2.3]",
                "pay [card|5105 1051 0510 5100] today", "nothing to see at all here at noon", "invoice 1234567890123455 was sent"]
    for words, labels in pii.parse_labelled(held_out):
        assert TAGGER.label([words]).tolist() == labels, words


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    chain = crf.Chain(np.zeros((1, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3))
    em = rng.standard_normal((4, 3))
    best = max(np.ndindex(3, 3, 3, 3), key=lambda y: chain.start[y[0]] + sum(em[i, y[i]] for i in range(4))
               + sum(chain.steps[y[i], y[i + 1]] for i in range(3)))
    assert crf.decode(em, np.array([0]), np.array([4]), chain).tolist() == list(best)


def test_rows_and_redaction(spark):
    texts = [None, "", "mail a.b@c.example.org, ip 10.0.0.1", "call (212) 555-0199 ok", "call (212) 555-0199 ok", "plain words only", "w " * 5000]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    assert got[0]["spans"] == got[1]["spans"] == got[5]["spans"] == got[6]["spans"] == ""
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[2]["spans"] == "email:5:22,ip:27:35" and (got[2]["n_email"], got[2]["n_ip"]) == (1, 1)
    assert got[3]["n_phone"] == 0 and got[3]["spans"] == got[4]["spans"] == "phone:5:19"  # the method's span
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert redacted[0] is None and redacted[2] == "mail [email], ip [ip]" and redacted[3] == "call [phone] ok" and redacted[5] == texts[5]
    assert pii.spans(docs.where(F.lit(False))).count() == 0
