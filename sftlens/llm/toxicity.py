"""Toxicity from the nearest labelled examples, by exact cosine of weighted TF-IDF vectors.

1. Examples: up to ``PER_CLASS`` labelled documents of each class, those with the lowest hash
   of their id (a bounded sample of labelled rows; classes keep their true weight).
2. Terms: all words and word beginnings (4 to 8 letters) of the examples, of either class, as 64-bit hashes.  Their
   document frequencies are counted over all documents.  A term weighs its idf times 1 + the root of
   its chi-square between the classes, so no term falls below its TF-IDF and telling ones lead.
3. Index: examples with equal vectors form one entry that carries the class weights.  Entries are ordered so that
   like ones share a block.  A term in one of ``DENSE`` entries or more has a column of weights and its
   largest weight in each block; others have a posting list.
4. Score: a document's cosines over posting lists, plus the block maxima of the other terms, bound every block's
   cosines; the blocks with the highest bounds are opened first, then those whose bound reaches the
   K-th best cosine found, so the neighbours are exact (weights are single precision, cosines within ``TIE`` count as
   equal).  The documents of a batch that open a block do so by one product of matrices; what comes near the K-th best is
   weighed again document by document, so a score does not depend on the batch.  Neighbours vote with weight cosine squared, together with a small prior.
   Documents whose vector is zero get the rate of the examples whose vector is zero.

Equal vectors are scored once per worker (bounded memo).

Edge cases: null and empty texts have the zero vector; without labelled rows of both classes
every score is the share of toxic labels (0 without labels); ties in cosine are all counted;
several labels of one document: toxic if any is; an empty table gives an empty result.
"""
from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, per_worker, split_by_keys

PER_CLASS = 2000
K = 20
BLOCK = 64
FIRST = 8  # blocks opened before the first bound is known
DENSE = 16
TIE = 1e-6
MEMO = 100_000
TOKENS = 100_000  # tokens counted at a time, taken as ``LETTERS`` characters each
LETTERS = 6
TOGETHER = 120_000  # terms of texts whose neighbours are looked up together
WORDS = 300_000  # distinct tokens whose terms are kept
PRIOR = 0.5
SHORTEST, LONGEST = 4, 8  # letters of beginnings
WORD = re.compile(r"[^\W\d_]+")
PLAIN = bytes(i if i < 128 and chr(i).isalpha() else 32 for i in range(256))  # letters of ASCII, else blanks


def features(token: str) -> list[str]:
    """Words of a blank-separated token, and their beginnings."""
    out = []
    for w in WORD.findall(token.lower()):
        out.append(w + " ")
        out += [w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1)]
    return out


def packed(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits for each word of ASCII letters, and which words have up to 16 letters, whose bits tell them apart: up to 8
    letters as they are, mixed with those that follow."""
    _, ends, data = words.buffers()
    data = (data or pa.py_buffer(b"")).to_pybytes() + bytes(16)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # from each byte on
    ends = np.frombuffer(ends, np.int64)[:len(words) + 1] if len(words) else np.zeros(1, np.int64)
    size, masks = np.diff(ends), np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    start = ends[:-1]
    head = eight[start] & masks[np.minimum(size, 8)]
    tail = eight[np.minimum(start + 8, len(eight) - 1)] & masks[np.clip(size - 8, 0, 8)]
    return head ^ mix64(tail), size <= 16


class Terms(dict):
    """Token -> its place among the tokens met, whose term numbers are kept: of the first ``WORDS`` ones for good,
    of later ones while their texts are counted.  Tokens of ASCII are met as their words, others whole; words of up to 16
    letters are not in the dictionary but found by ``keys``, 64 bits each, in order."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.hashes = hashes
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new, self.ends, self.flat = [], np.zeros(1, np.int64), np.zeros(0, np.int32)

    def forget(self) -> None:
        self.ends = self.ends[:WORDS + 1]
        self.flat = self.flat[:self.ends[-1]]

    def _find(self, features: list[str]) -> np.ndarray:
        """Numbers of the terms among ``features``; -1: none."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, features), np.uint64, len(features))
        order = np.argsort(h)  # neighbours are found in the same part of the table
        h = h[order]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        out = np.empty(len(h), np.int64)
        out[order] = np.where(self.hashes[at] == h, at, -1)
        return out

    def _learn(self) -> None:
        """The terms of each new token.  Terms come with all their beginnings, so a word one of whose beginnings is
        no term has no longer one either, nor is it a term itself."""
        lower = "\n".join(self.new).lower().split("\n")  # as one by one: no token holds white space
        alpha = np.fromiter(map(str.isalpha, lower), bool, len(lower))
        words, token = list(compress(lower, alpha)), np.flatnonzero(alpha).tolist()
        for i in np.flatnonzero(~alpha).tolist():
            own = WORD.findall(lower[i])
            words += own
            token += [i] * len(own)
        token, size = np.array(token, np.int64), np.fromiter(map(len, words), np.int64, len(words))
        alive, whole, found = np.flatnonzero(size >= SHORTEST), size < SHORTEST, []
        for n in range(SHORTEST, LONGEST + 1):
            at = self._find([words[i][:n] for i in alive.tolist()])
            alive, at = alive[at >= 0], at[at >= 0]
            found.append((token[alive], at))
            whole[alive] = (size[alive] == n) | (n == LONGEST)
            alive = alive[size[alive] > n]
        whole = np.flatnonzero(whole)
        at = self._find([words[i] + " " for i in whole.tolist()])
        found.append((token[whole[at >= 0]], at[at >= 0]))
        token, at = (np.concatenate(x) for x in zip(*found))
        self.flat = np.append(self.flat, at[np.argsort(token, kind="stable")].astype(np.int32))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.bincount(token, minlength=len(self.new))))
        self.new = []

    def counts(self, texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms in order, their counts) of each text."""
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= TOKENS * LETTERS:
                yield from self._counts(group)
                group, size = [], 0
        yield from self._counts(group)

    @staticmethod
    def tokens(group: list[str]) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
        """Words of the tokens of ASCII and the text of each; the other tokens and the text of each."""
        lists = pc.utf8_split_whitespace(pa.array(group, pa.large_string()))  # white space as in str.split
        tokens, text = lists.flatten(), np.repeat(np.arange(len(group)), np.diff(lists.offsets.to_numpy()))
        ascii = pc.string_is_ascii(tokens).to_numpy(zero_copy_only=False)
        _, ends, data = tokens.buffers()
        words = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(tokens), ends, pa.py_buffer((data or pa.py_buffer(b"")).to_pybytes().translate(PLAIN))))
        token, words = np.repeat(np.arange(len(tokens)), np.diff(words.offsets.to_numpy())), words.flatten()
        kept, other = ascii[token] & (pc.binary_length(words).to_numpy() > 0), np.flatnonzero(~ascii)
        return words.filter(pa.array(kept)), text[token[kept]], tokens.take(pa.array(other)), text[other]

    def _counts(self, group: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.forget()
        words, text, others, text_of_others = self.tokens(group)
        key, short = packed(words)
        others = pa.concat_arrays([words.filter(pa.array(~short)), others]).dictionary_encode()
        text = np.concatenate([text[short], text[~short], text_of_others])
        key, place = np.unique(key[short], return_inverse=True)
        one = np.empty(len(key), np.int64)  # a word of each key
        one[place] = np.flatnonzero(short)
        at = np.searchsorted(self.keys, key)
        number = np.where(np.append(self.keys, np.uint64(0))[at] == key, np.append(self.places, -1)[at], -1)
        fresh = number < 0
        met = others.dictionary.to_numpy(zero_copy_only=False)
        number_of_others = np.fromiter(map(self.get, met, repeat(-1)), np.int64, len(met))
        strange = number_of_others < 0
        self.new = words.take(pa.array(one[fresh])).to_numpy(zero_copy_only=False).tolist() + met[strange].tolist()
        if self.new:
            first = len(self.ends) - 1
            number[fresh] = first + np.arange(fresh.sum())
            number_of_others[strange] = first + fresh.sum() + np.arange(strange.sum())
            fresh &= number < WORDS
            strange &= number_of_others < WORDS
            self.keys, self.places = np.insert(self.keys, at[fresh], key[fresh]), np.insert(self.places, at[fresh], number[fresh])
            self.update(zip(met[strange].tolist(), number_of_others[strange].tolist()))
            self._learn()
        token = np.append(number[place], number_of_others[others.indices.to_numpy()])
        n, v = self.ends[token + 1] - self.ends[token], len(self.hashes)
        text, last = np.repeat(text, n), np.cumsum(n)
        terms = self.flat[np.arange(len(text)) + np.repeat(self.ends[token] - last + n, n)]
        key, count = np.unique(text * v + terms, return_counts=True)
        first = np.searchsorted(key, np.arange(len(group) + 1) * v)
        terms = (key % v).astype(np.int32)
        for i, j in zip(first[:-1], first[1:], strict=True):
            yield terms[i:j], count[i:j]


def learnt(hashes: np.ndarray) -> dict:
    """What a Python worker keeps for these terms: the tokens it has met, which counting and scoring share."""
    return per_worker(("toxicity", xxhash.xxh3_128_digest(hashes.tobytes())), lambda: {"terms": Terms(hashes)})


def examples(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(_id, text, toxic) of the sampled labelled rows, and how many labelled rows a class has.
    Ids are joined and sampled first; only texts that are likely in the sample are shuffled."""
    keep = Scratch(docs.sparkSession, "toxicity")
    lab = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = keep.write(docs.where(learn).select(F.col(id_col).alias("_id")).join(lab, "_id"), "known")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen, bound = F.lit(False), 1 << 40
    for y, n in counts.items():  # a small class whole, else the ids under a hash bound
        chosen = chosen | ((F.col("toxic") == y) & (F.pmod(F.xxhash64("_id"), F.lit(bound)) < int(min(1.0, PER_CLASS / n) * bound)))
    chosen = keep.write(known.where(chosen).distinct(), "chosen")
    rows = split_by_keys(docs.where(learn).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")), chosen, "_id")[1]
    return keep.write(rows.join(chosen, "_id"), "examples"), counts


def select_terms(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Hashes of all terms of the examples in order, their chi-square, and how many examples a class has."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: list[Counter] = [Counter(), Counter()]
        for b in batches:
            for text, y in zip(b["text"], b["toxic"]):
                sums[y].update({f for t in set((text or "").split()) for f in features(t)})
        for y in (0, 1):
            if sums[y]:
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, sums[y]), np.uint64, len(sums[y]))
                yield pd.DataFrame({"term": h.view(np.int64), "toxic": y, "n": np.fromiter(sums[y].values(), np.int64, len(h))})

    sampled = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = sampled.get(1, 0), sampled.get(0, 0)
    if not pos or not neg:
        return np.zeros(0, np.uint64), np.zeros(0), sampled
    # the terms of at most 2 * PER_CLASS examples, about
    got = sample.mapInPandas(count, "term bigint, toxic int, n bigint").groupBy("term").agg(
        F.sum(F.expr("if(toxic = 1, n, 0)")).alias("a"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("b")).toArrow()
    terms = got["term"].to_numpy().view(np.uint64)
    order = np.argsort(terms)
    a, b, n = got["a"].to_numpy()[order].astype(float), got["b"].to_numpy()[order].astype(float), pos + neg
    chi2 = n * (a * neg - b * pos) ** 2 / ((a + b) * np.maximum(n - a - b, 0.5) * pos * neg)
    return terms[order], chi2, sampled


def document_frequencies(docs: DataFrame, text_col: str, hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """Rows of ``docs`` and, per term, how many hold it; counted over all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = learnt(shared.value)["terms"]
        df = np.zeros(len(terms.hashes) + 1, np.int64)
        for b in batches:
            df[-1] += len(b)
            for own, _ in terms.counts(b["text"]):
                df[own] += 1
        at = df.nonzero()[0]
        yield pd.DataFrame({"term": at.astype(np.int32), "n": df[at]})

    got = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(hashes) + 1, np.int64)
    df[got["term"].to_numpy()] = got["n"].to_numpy()  # a row per term
    return int(df[-1]), df[:-1]


def together(vectors: list[tuple], entry: np.ndarray, row: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
    """Order of the entries by halving along principal axes of their frequent terms (entry, row, weight)."""
    x = np.zeros((len(vectors), rows), np.float32)
    x[entry, row] = w
    start = np.random.default_rng(7).standard_normal(rows).astype(np.float32)

    def halve(at: np.ndarray) -> list[np.ndarray]:
        if len(at) <= BLOCK:
            return [at]
        own = x[at] - x[at].mean(axis=0)
        axis = start
        for _ in range(4):
            axis = own.T @ (own @ axis)
            axis /= max(float(np.sqrt(axis @ axis)), 1e-12)
        at = at[np.argsort(own @ axis, kind="stable")]
        half = -(-len(at) // (2 * BLOCK)) * BLOCK
        return halve(at[:half]) + halve(at[half:])

    return np.concatenate(halve(np.arange(len(vectors))))


def flatten(vectors: list[tuple]) -> tuple[np.ndarray, ...]:
    """(distinct terms, entry, place of the term among them, weight) of all weights, and which terms are frequent."""
    sizes = [len(v[0]) for v in vectors]
    entry = np.repeat(np.arange(len(vectors), dtype=np.int32), sizes)
    known, place = np.unique(np.concatenate([np.asarray(v[0], np.int32) for v in vectors] or [np.zeros(0, np.int32)]), return_inverse=True)
    w = np.concatenate([np.asarray(v[1], np.float32) for v in vectors] or [np.zeros(0, np.float32)])
    return known, entry, place.astype(np.int32), w, np.bincount(place, minlength=len(known)) * DENSE >= max(1, len(vectors))


class Index:
    """Examples under an inverted index; frequent terms with block maxima."""

    def __init__(self, vectors: list[tuple]):
        """``vectors``: (terms, unit weights, toxic weight, other weight, an id), distinct."""
        self.ids = [v[4] for v in vectors]
        self.pos = np.array([v[2] for v in vectors])
        self.neg = np.array([v[3] for v in vectors])
        self.size, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        known, entry, place, w, frequent = flatten(vectors)
        order = np.argsort(-np.bincount(place, minlength=len(known)), kind="stable")  # the frequent ones first, as they are met most
        rank = np.empty(len(known), np.int32)
        rank[order] = np.arange(len(known), dtype=np.int32)
        self.places = np.full(int(known.max(initial=-1)) + 1, -1, np.int32)  # of a term among the known ones
        self.places[known] = rank
        place, self.dense = rank[place], int(frequent.sum())
        held = place < self.dense
        self.near = np.zeros((self.blocks * BLOCK, self.dense), np.float32)  # entry x frequent term
        self.near[entry[held], place[held]] = w[held]
        self.tops = np.ascontiguousarray(self.near.reshape(self.blocks, BLOCK, self.dense).max(axis=1).T)  # frequent term x block
        entry, place, w = entry[~held], place[~held], w[~held]
        order = np.argsort(place, kind="stable")
        self.lists = np.column_stack([entry[order].astype(np.int32), w[order].astype(np.float32).view(np.int32)]).ravel().view(np.int64)  # entry and weight side by side
        self.first = np.searchsorted(place[order], np.arange(len(known) + 1))

    def nearest(self, terms, weights, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Entries and cosines of the k nearest entries and of all that tie with the last."""
        return next(self.nearest_all([(np.asarray(terms), np.asarray(weights, float))], k))

    def nearest_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for each (terms, weights).  Those that open a block do so by one product of matrices."""
        if not queries:
            return
        total, width = len(queries), self.blocks * BLOCK
        query = np.repeat(np.arange(total), [len(t) for t, _ in queries])
        terms, weights = (np.concatenate(x) for x in zip(*queries))
        here = terms < len(self.places)
        here[here] = self.places[terms[here]] >= 0
        place, query, weights = self.places[terms[here]], query[here], weights[here]
        held = place < self.dense
        listed, ends = np.zeros((total, width)), np.cumsum(np.bincount(query[~held], minlength=total))
        rare, rarely, steps = place[~held], weights[~held], np.arange(0)
        for i, (a, b) in enumerate(zip([0, *ends], ends)):  # one at a time, so that it stays in the processor's cache
            if b > a:
                n = self.first[rare[a:b] + 1] - self.first[rare[a:b]]
                last = np.cumsum(n)
                at = np.repeat(self.first[rare[a:b]] - last + n, n)
                if len(at) > len(steps):
                    steps = np.arange(2 * len(at))
                at += steps[:len(at)]
                own = self.lists.take(at)
                listed[i] = np.bincount(own.view(np.int32)[::2], weights=own.view(np.float32)[1::2] * np.repeat(rarely[a:b], n), minlength=width)
        rows, own_q = place[held], weights[held].astype(np.float32)
        q, cos = np.zeros((total, self.dense), np.float32), listed.astype(np.float32)
        q[query[held], rows] = own_q
        bound = cos.reshape(total, self.blocks, BLOCK).max(axis=2) + q @ self.tops
        opened, kth = np.zeros(bound.shape, bool), np.zeros(total)
        for first in (True, False):  # the blocks with the highest bounds, then all that may still matter
            todo = (bound > 0) & (bound >= kth[:, None] - 2 * TIE) & ~opened
            if first and self.blocks > FIRST:
                todo &= bound >= np.partition(bound, -FIRST, axis=1)[:, -FIRST, None]
            opened |= todo
            for b in np.flatnonzero(todo.any(axis=0)):
                own, block = np.flatnonzero(todo[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                cos[own, block] += q[own] @ self.near[block].T
            if self.size >= k:
                kth = np.partition(cos[:, :self.size], -k, axis=1)[:, -k].astype(float)
        ends = np.cumsum(np.bincount(query[held], minlength=total))
        for i, (a, b) in enumerate(zip([0, *ends], ends)):  # what comes near the last of them is weighed again, alone
            at = np.flatnonzero(cos[i, :self.size] >= max(kth[i] - 2 * TIE, 1e-12))
            x = np.zeros((b - a, -(-len(at) // BLOCK) * BLOCK), np.float32)
            x[:, :len(at)] = self.near[np.ix_(at, rows[a:b])].T
            own = listed[i, at] + (own_q[a:b] @ x)[:len(at)]
            least = np.partition(own, -k)[-k] - TIE if len(own) >= k else 0.0
            keep = own >= max(least, 1e-12)
            yield at[keep], own[keep]


class Scorer:
    def __init__(self, hashes, weight, entries, zero_rate: float, prior: float, terms: Terms | None = None):
        self.terms, self.weight, self.index = Terms(hashes) if terms is None else terms, weight, Index(entries)
        self.zero_rate, self.prior, self.memo = zero_rate, prior, {}

    def scores(self, texts) -> Iterator[tuple[float, list]]:
        """Score and the ids of up to three of the nearest examples, of each text."""
        if not len(self.terms.hashes):
            yield from ((self.zero_rate, []) for _ in texts)
            return
        held, size = [], 0
        for own in self.terms.counts(texts):
            held.append(own)
            size += len(own[0])
            if size >= TOGETHER:
                yield from self._scores(held)
                held, size = [], 0
        yield from self._scores(held)

    def _scores(self, held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list]]:
        keys = [xxhash.xxh3_128_digest(terms.tobytes() + counts.tobytes()) if len(terms) else b"" for terms, counts in held]
        new = {key: own for key, own in zip(keys, held, strict=True) if key and key not in self.memo}
        found = {b"": (self.zero_rate, [])}
        for key, (ids, cos) in zip(new, self.index.nearest_all([(terms, unit(terms, counts, self.weight)) for terms, counts in new.values()]), strict=True):
            vote = cos ** 2
            pos, neg = (vote * self.index.pos[ids]).sum(), (vote * self.index.neg[ids]).sum()
            best = np.lexsort((ids, -cos))[:3]
            found[key] = float((pos + PRIOR * self.prior) / (pos + neg + PRIOR)), [self.index.ids[ids[i]] for i in best]
        out = [found[key] if key in found else self.memo[key] for key in keys]
        if len(self.memo) + len(found) > MEMO:
            self.memo.clear()
        self.memo |= found
        return out


def unit(terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (1 + log tf) ``weight`` of the terms, scaled to length 1."""
    w = (1 + np.log(counts)) * weight[terms]
    return w / (math.sqrt(w @ w) or 1.0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple:
    """Arguments of ``Scorer``; ``learn`` marks the documents whose labels may be learnt."""
    sample, counts = examples(docs, labels, learn, id_col, text_col)
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    hashes, chi2, sampled = select_terms(sample)
    if not len(hashes):
        return hashes, chi2, [], rate, rate
    rows, df = document_frequencies(docs, text_col, hashes)
    weight = (np.log((1 + rows) / (1 + df)) + 1) * (1 + np.sqrt(chi2))
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms(shared.value)
        for b in batches:
            got = list(terms.counts(b["text"]))
            yield pd.DataFrame({"_id": b["_id"], "toxic": b["toxic"], "terms": [t.astype(np.int32).tobytes() for t, _ in got],
                                "counts": [n.astype(np.int32).tobytes() for _, n in got]})

    # at most 2 * PER_CLASS examples, about
    kind = dict(sample.dtypes)["_id"]
    grouped = sample.mapInPandas(vectors, f"_id {kind}, toxic int, terms binary, counts binary").groupBy("terms", "counts").agg(
        F.min("_id").alias("one"), F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).collect()
    worth = {y: counts.get(y, 0) / max(1, sampled.get(y, 0)) for y in (0, 1)}
    least = min((w for w in worth.values() if w), default=1.0)
    entries, zero = [], rate
    for r in sorted(grouped, key=lambda r: (bytes(r["terms"]), bytes(r["counts"]))):
        pos, neg = r["pos"] * worth[1] / least, r["neg"] * worth[0] / least
        if not r["terms"]:
            zero = pos / (pos + neg)
            continue
        terms, n = np.frombuffer(bytes(r["terms"]), np.int32), np.frombuffer(bytes(r["counts"]), np.int32)
        entries.append((terms, unit(terms, n, weight).astype(np.float32), pos, neg, r["one"]))
    if entries:
        _, entry, place, w, frequent = flatten(entries)
        held = frequent[place]
        order = together(entries, entry[held], (np.cumsum(frequent) - 1)[place[held]], w[held], int(frequent.sum()))
        entries = [entries[i] for i in order]  # like vectors share blocks, which makes the bounds tight
    return hashes, weight, entries, zero, rate


def scores(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, evidence) of every row; evidence names the nearest examples."""
    shared, job = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = learnt(shared.value[0])
        if job not in kept:
            for other in kept.keys() - {"terms"}:
                del kept[other]
            kept[job] = Scorer(*shared.value, kept["terms"])
        scorer = kept[job]
        for b in batches:
            got = list(scorer.scores(b[text_col]))
            yield pd.DataFrame({id_col: b[id_col], "score": np.array([g[0] for g in got], float), "evidence": [g[1] for g in got]})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, score double, evidence array<{kind}>")
