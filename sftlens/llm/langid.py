"""Language identification by multilingual mixture inference.

Every document is modelled as a mixture of languages: each of its character trigrams comes
from language l with probability p_l and is then drawn from l's trigram distribution.
Expectation-maximisation estimates the proportions p of each document (batches of documents
at once in numpy), and the set of languages is chosen by penalised likelihood: a further
language must raise the log-likelihood by half the log of the number of trigrams.  Trigrams
overlap, so their likelihood counts a third.

Trigram counts are taken over all labelled documents, aggregated in each task before the
shuffle; trigrams are hashed to a fixed number of buckets, so the broadcast model is
``BUCKETS x languages`` floats whatever the corpus size.

Edge cases: null text or text without a letter is ``und`` with score 0, as is everything if
there is no labelled text; documents with a null label are not learnt from; repeated rows get
equal results; an empty table an empty result; ties go to the language first in name order.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LOG2_BUCKETS = 15
BUCKETS = 1 << LOG2_BUCKETS
ROUNDS = 40          # EM stops earlier once proportions settle
SETTLED = 1e-3
OVERLAP = 3.0        # a character is part of three trigrams
UNKNOWN = 0.75       # a document with more than this share of trigrams that no language explains is rejected
CELLS = 400_000      # distinct trigrams handled at a time
ALPHABET = 0x110000  # all code points


def letters() -> np.ndarray:
    """1 for code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(ALPHABET)), bool, ALPHABET)


def trigrams(text: str | None, is_letter: np.ndarray) -> np.ndarray:
    """Bucket of each letter trigram of the lower-cased text; other characters act as one blank.
    Empty if there is no letter."""
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(is_letter[np.minimum(c, ALPHABET - 1)], c, 0).astype(np.uint32)
    if not c.any():
        return np.zeros(0, np.int64)
    c = np.concatenate([np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)])
    c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])]  # runs of blanks become one
    if c[-1]:
        c = np.append(c, np.uint32(0))
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - LOG2_BUCKETS)).astype(np.int64)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, BUCKETS x languages trigram probabilities), counted over all of ``labelled``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        is_letter, sums = letters(), {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"]):
                if text is None or lang is None:
                    continue
                own = sums.get(lang)
                if own is None:
                    own = sums[lang] = np.zeros(BUCKETS, np.int64)
                own += np.bincount(trigrams(text, is_letter), minlength=BUCKETS)
        for lang, own in sums.items():
            at = own.nonzero()[0]
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": own[at]})

    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sums = (rows.mapInPandas(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c")))  # BUCKETS entries at most
    found = {r.lang: r.c for r in sums.collect() if r.c}  # BUCKETS entries a language
    langs = sorted(found)
    counts = np.zeros((BUCKETS, len(langs)))
    for j, lang in enumerate(langs):
        counts[[x.bucket for x in found[lang]], j] = [x.n for x in found[lang]]
    probs = (counts + 0.05) / (counts.sum(axis=0) + 0.05 * BUCKETS) if langs else counts
    return langs, probs.astype(np.float32)


def em(like: np.ndarray, n: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood per document.  ``like``: trigrams x languages, ``n``: counts,
    documents begin at ``starts``; ``allowed``: documents x languages."""
    sizes = np.diff(np.append(starts, len(n)))
    total = np.add.reduceat(n, starts)
    p = allowed / allowed.sum(axis=1, keepdims=True)
    live = np.arange(len(starts))
    out, ll = p.copy(), np.zeros(len(starts))
    for _ in range(ROUNDS):
        mix = like * np.repeat(p, sizes, axis=0)
        whole = mix.sum(axis=1)
        new = np.add.reduceat(mix * (n / whole)[:, None], starts, axis=0) / total[:, None]
        ll[live] = np.add.reduceat(n * np.log(whole), starts)
        out[live] = new
        moving = np.abs(new - p).max(axis=1) > SETTLED
        if not moving.any():
            break
        if moving.mean() < 0.5:  # go on with the documents that have not settled
            keep = np.repeat(moving, sizes)
            like, n, sizes, total = like[keep], n[keep], sizes[moving], total[moving]
            live, new = live[moving], new[moving]
            starts = np.cumsum(sizes) - sizes
        p = new
    return out, ll


def runs(texts: list[str | None], is_letter: np.ndarray) -> Iterator[tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    """(places, trigram buckets and their counts) of the texts with a letter, about ``CELLS`` buckets at a time."""
    at, parts, size = [], [], 0
    for i, t in enumerate(texts):
        g = trigrams(t, is_letter)
        if not len(g):
            continue
        if len(g) < 3000:
            bucket, n = np.unique(g, return_counts=True)
        else:
            n = np.bincount(g, minlength=BUCKETS)
            bucket = n.nonzero()[0]
            n = n[bucket]
        at.append(i)
        parts.append((bucket, n))
        size += len(bucket)
        if size >= CELLS:
            yield at, parts
            at, parts, size = [], [], 0
    if at:
        yield at, parts


def infer(texts: list[str | None], langs: list[str], probs: np.ndarray, is_letter: np.ndarray) -> list[tuple[str, float, list[str], list[float]]]:
    """(language, its proportion, selected languages, their proportions) of each text."""
    out: list = [("und", 0.0, [], [])] * len(texts)
    for at, parts in runs(texts, is_letter) if langs else ():
        for i, row in zip(at, _infer(parts, langs, probs), strict=True):
            out[i] = row
    return out


def unknown_shares(texts: list[str | None], probs: np.ndarray, is_letter: np.ndarray) -> np.ndarray:
    """Share of each text's trigrams that falls to a component which draws all trigrams alike, in a mixture with the
    learnt languages; 1 for a text without a letter, 0 for any other if no language was learnt."""
    out = np.ones(len(texts))
    probs = np.column_stack([probs, np.full(BUCKETS, 1 / BUCKETS, np.float32)])
    for at, parts in runs(texts, is_letter):
        if probs.shape[1] == 1:
            out[at] = 0.0
            continue
        sizes = np.array([len(b) for b, _ in parts])
        n = np.concatenate([c for _, c in parts]).astype(np.float32)
        shares, _ = em(probs[np.concatenate([b for b, _ in parts])], n, np.cumsum(sizes) - sizes, np.ones((len(parts), probs.shape[1])))
        out[at] = shares[:, -1]
    return out


def _infer(parts, langs, probs):
    sizes = np.array([len(b) for b, _ in parts])
    starts = np.cumsum(sizes) - sizes
    like = probs[np.concatenate([b for b, _ in parts])]
    n = np.concatenate([c for _, c in parts]).astype(np.float32)
    total = np.add.reduceat(n, starts)
    d, k = len(parts), len(langs)
    single = np.add.reduceat(np.log(like) * n[:, None], starts, axis=0)
    full, ll_full = em(like, n, starts, np.ones((d, k)))
    order = np.argsort(-full, axis=1, kind="stable")
    chosen = np.zeros((d, k), bool)
    chosen[np.arange(d), single.argmax(axis=1)] = True
    share = chosen.astype(float)
    best = single.max(axis=1) / OVERLAP
    fee = 0.5 * np.log(total + 1)
    for size in range(2, k + 1):
        # no set of this size can gain more than the full mixture has
        at = np.flatnonzero(ll_full / OVERLAP - fee * (size - 1) > best)
        if not len(at):
            break
        allowed = np.zeros((len(at), k))
        np.put_along_axis(allowed, order[at, :size], 1, axis=1)
        keep = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in at])
        p, ll = em(like[keep], n[keep], np.cumsum(sizes[at]) - sizes[at], allowed)
        value = ll / OVERLAP - fee[at] * (size - 1)
        better = value > best[at]
        chosen[at[better]] = allowed[better] > 0
        share[at[better]] = p[better]
        best[at[better]] = value[better]
    rows = []
    for i in range(d):
        top = int(np.where(chosen[i], share[i], -1).argmax())
        own = [j for j in np.argsort(-share[i], kind="stable") if chosen[i, j]]
        rows.append((langs[top], float(min(1.0, max(0.0, full[i, top]))), [langs[j] for j in own], [float(share[i, j]) for j in own]))
    return rows


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``keep`` columns, lang_pred, score (the language's share in the
    document), langs and shares (the selected set)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (langs, probs), is_letter = shared.value, letters()
        for b in batches:
            rows = infer(b[text_col].tolist(), langs, probs, is_letter)
            out = b[[id_col, *keep]].copy()
            out["lang_pred"] = [r[0] for r in rows]
            out["score"] = np.array([r[1] for r in rows], float)
            out["langs"] = [r[2] for r in rows]
            out["shares"] = [r[3] for r in rows]
            yield out

    kinds = dict(docs.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep))
    return docs.select(id_col, *keep, text_col).mapInPandas(
        run, f"{head}, lang_pred string, score double, langs array<string>, shares array<double>")


def tag(docs: DataFrame, model: tuple[list[str], np.ndarray], out: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the predicted language in column ``out``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (langs, probs), is_letter = shared.value, letters()
        for b in batches:
            yield pd.Series([r[0] for r in infer(b.tolist(), langs, probs, is_letter)], dtype=object)

    return docs.withColumn(out, F.pandas_udf(run, "string")(F.col(text_col)))


def known(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", most: float = UNKNOWN) -> DataFrame:
    """The rows of ``docs`` in a learnt language: those with a letter of which at most the share ``most`` falls to the
    unknown component (``unknown_shares``).  If nothing was learnt, all rows with a letter."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model[1])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        probs, is_letter = shared.value, letters()
        for b in batches:
            yield pd.Series(unknown_shares(b.tolist(), probs, is_letter) <= most)

    return docs.where(F.pandas_udf(run, "boolean")(F.col(text_col)))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % n
