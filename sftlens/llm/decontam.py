"""Benchmark decontamination by word counts and common subsequences, with latent semantic cosines.

1. Terms are the lower-cased words of the benchmark; their frequencies are counted over passages of
   all documents (``BLOCK * SPAN`` words each), which gives the idf weights.
2. A randomised SVD of the benchmark's TF-IDF passages, computed by Spark in passes over the table (a
   range finder with power iterations; tasks return partial sums of terms x rank), gives the
   latent space, which gives the reported cosines.
3. Every document is cut into overlapping stretches for each item length (``Searcher.grid``: any span of
   up to twice the item's words lies in one).  A stretch is a candidate for an item if it holds as many of the
   item's content words as the check below asks for at least.  That counts every occurrence, so
   the search is never stricter than the check; words outside the benchmark don't matter.
4. A candidate stretch is checked word by word: the longest common subsequence of the item's content
   words (those in few passages) with the stretch.  An item is leaked if ``COPY`` of its content words
   follow in order, or ``PARAPHRASE`` of them if the stretch also has the answer: ``ANSWER`` of the
   content words of the item's last sentence, in order.
5. ``cosine`` is the best one of the windows (``SPAN`` blocks of ``BLOCK`` words, one block apart) of the
   reported stretch, estimated in the latent space and divided by the part of the item that
   the space keeps.  The window's norm counts words outside the benchmark too, at the highest idf.

The benchmark is taken in slices of ``ITEMS`` items, so what is broadcast has a size bound whatever the
table's size.  Steps 1 and 3 read the documents without a shuffle of text.

Edge cases: null and empty texts and items match nothing; items without three content words
need all their words one after the other, and match nothing if they have fewer than ``SHORTEST``; repeated rows give equal rows; equal items are all reported; empty tables give
an empty result; other columns are ignored.
"""
from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, small_batches

BLOCK, SPAN = 16, 3
RANK, EXTRA, POWER = 64, 8, 2
CONTENT_IDF = 2.5  # words in fewer than one passage of twelve
COPY, PARAPHRASE, ANSWER = 0.7, 0.4, 0.6
ITEMS = 5000
GROUP = 256  # items of one length whose words are counted at once
SHORTEST = 5  # words of an item that is looked up literally
TASKS = 16
BATCH_WORDS = 300_000
LETTERS = 1_000_000  # characters whose words are looked up at once
FLAGS = 4_000_000  # bytes in which a task marks passages and terms
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»‹›“”„‘’‚…–—·•§¶©®™°\u00ad"
ASCII_EDGES = "".join(filter(str.isascii, EDGES))
SENTENCE = re.compile(r"[.!?\n]+\s*")
RESULT = "item_id bigint, cosine double, lcs_ratio double, kind string, start bigint"


def term(word: str) -> str:
    """A word without case and without punctuation around it."""
    return word.lower() if word.isalpha() else word.lower().strip(EDGES)


class Vocabulary(dict):
    """Blank-separated word -> term number; -1: another word, -2: no word at all.  Words of ASCII are looked up by
    Arrow, many texts at once; others one by one, memoised and bounded."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.index = {t: i for i, t in enumerate(terms)}
        self.values = pa.array([*terms, ""], pa.large_string())

    def __missing__(self, word):
        t = term(word)
        got = self.index.get(t, -1) if t else -2
        if len(self) < 400_000:
            self[word] = got
        return got

    def ids(self, text: str | None) -> np.ndarray:
        return next(self.all_ids([text]))

    def all_ids(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Term numbers of the words of each text."""
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= LETTERS:
                yield from self._ids(group)
                group, size = [], 0
        yield from self._ids(group)

    def _ids(self, group: list[str]) -> Iterator[np.ndarray]:
        lists = pc.utf8_split_whitespace(pa.array(group, pa.large_string()))  # white space as in str.split, blank edges give an empty word
        words, ends = lists.flatten(), lists.offsets.to_numpy()
        out = pc.index_in(pc.ascii_trim(pc.ascii_lower(words), ASCII_EDGES), self.values).fill_null(-1).to_numpy().copy()
        out[out == len(self.index)] = -2
        other = np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False))
        if len(other):
            out[other] = np.fromiter(map(self.__getitem__, words.take(pa.array(other)).to_numpy(zero_copy_only=False)), np.int32, len(other))
        kept = out != -2
        ends = np.append(0, np.cumsum(kept))[ends]
        out = out[kept]
        return (out[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True))


def column_sums(flags: np.ndarray) -> np.ndarray:
    """How often each column is true; summed in bytes, as many rows at a time as these can count."""
    out = np.zeros(flags.shape[1], np.int64)
    for s in range(0, len(flags), 255):
        out += flags[s:s + 255].view(np.uint8).sum(axis=0, dtype=np.uint8)
    return out


def passage_frequencies(docs: DataFrame, text_col: str, terms: list[str]) -> tuple[int, np.ndarray]:
    """Passages of all documents, and how many hold each term."""
    size, v = BLOCK * SPAN, len(terms)

    job = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = per_worker(("terms", job), lambda: Vocabulary(terms))
        df, total = np.zeros(v, np.int64), 0
        seen = np.zeros((max(1, FLAGS // v), v), bool)  # passage x term
        used = 0
        for b in batches:
            for ids in vocabulary.all_ids(b["t"]):
                total += -(-len(ids) // size)
                for s in range(0, len(ids), size * len(seen)):
                    part = ids[s:s + size * len(seen)]
                    n = -(-len(part) // size)
                    if used + n > len(seen):
                        df += column_sums(seen[:used])
                        seen[:used], used = False, 0
                    at = np.flatnonzero(part >= 0)
                    seen[used + at // size, part[at]] = True
                    used += n
        df += column_sums(seen[:used])
        at = df.nonzero()[0]
        yield pd.DataFrame({"term": np.append(at, -1).astype(np.int32), "n": np.append(df[at], total)})

    got = docs.select(F.col(text_col).alias("t")).mapInPandas(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(v, np.int64), 0
    for r in got:  # a row per term
        if r.term < 0:
            total = r.n
        else:
            df[r.term] = r.n
    return total, df


def weights_of(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, tf * idf) of content terms."""
    own, n = np.unique(ids[ids >= 0], return_counts=True)
    w = n * idf[own]
    return own[idf[own] >= CONTENT_IDF], w[idf[own] >= CONTENT_IDF]


def latent_space(items: DataFrame, terms: list[str], idf: np.ndarray, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF matrix of ``items`` (t), by a randomised
    SVD whose products run as Spark passes."""
    sc = items.sparkSession.sparkContext
    v = len(terms)
    width = min(rank + EXTRA, v)

    def product(q: np.ndarray) -> np.ndarray:
        """A'A q, summed over tasks; a task returns v x width numbers."""
        shared = sc.broadcast(q)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vocabulary, out = Vocabulary(terms), np.zeros((v, width))
            for b in batches:
                for ids in vocabulary.all_ids(b["t"]):
                    own, w = weights_of(ids, idf)
                    if len(own):
                        w = w / np.sqrt((w * w).sum())
                        out[own] += np.outer(w, w @ shared.value[own])
            yield pd.DataFrame({"sum": [out.tobytes()]})

        out = np.zeros((v, width))
        for r in items.coalesce(TASKS).mapInPandas(run, "sum binary").toLocalIterator():
            out += np.frombuffer(bytes(r["sum"])).reshape(v, width)
        return out

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((v, width)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(product(q))[0]
    small = q.T @ product(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = masks.get(x)
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Searcher:
    def __init__(self, terms, idf, other, space, items):
        """``items``: (item_id, text); ``other``: idf of words outside the benchmark."""
        self.vocabulary, self.idf = Vocabulary(terms), idf
        self.weighted = (space * idf[:, None]).astype(np.float32)
        self.square = np.append(idf ** 2, other ** 2)
        self.content = idf >= CONTENT_IDF
        self.items, rows, norms = [], [], []
        for item_id, text in items:
            ids = self.vocabulary.ids(text)
            ids = ids[ids >= 0]
            own, w = weights_of(ids, idf)
            if not len(ids):
                continue
            sentences = [s for x in SENTENCE.split(text) if len(s := self.vocabulary.ids(x))]
            need = ids[self.content[ids]]
            strict = len(need) < 3
            if strict and len(ids) < SHORTEST:
                continue
            tail = [s[self.content[s]] for s in sentences if self.content[s].any()]
            self.items.append((item_id, ids if strict else need, tail[-1] if tail else need, strict, len(ids)))
            weights = w if len(own) else np.ones(1)
            rows.append(weights @ space[own] if len(own) else np.zeros(space.shape[1]))
            norms.append(np.sqrt((idf[ids] ** 2).sum()))
        self.needs = [(list(Counter(need.tolist()).items()), self.least(len(need))) for _, need, *_ in self.items]
        self.rows = np.array(rows, np.float32).reshape(len(rows), space.shape[1])
        norm = np.array(norms)
        kept = (self.rows.astype(float) ** 2).sum(axis=1)
        # <w, i> in the space stands for kept / norm^2 of the true product
        scale = np.divide(norm, kept, out=np.zeros(len(norm)), where=kept > 1e-9)
        self.rows = (self.rows * scale[:, None]).astype(np.float32)
        self.exact: dict[int, list[int]] = {}  # strict items are looked up by their rarest term
        lengths: dict[int, list[int]] = {}
        for i, (_, ids, _, strict, n) in enumerate(self.items):
            if strict:
                self.exact.setdefault(int(ids[np.argmax(idf[ids])]), []).append(i)
            else:
                lengths.setdefault(-(-n // BLOCK), []).append(i)
        self.rarest = np.zeros(len(idf) + 1, bool)
        self.rarest[list(self.exact)] = True
        self.groups = [self._group(blocks, own[s:s + GROUP]) for blocks, own in sorted(lengths.items()) for s in range(0, len(own), GROUP)]

    def _group(self, blocks: int, own: list[int]) -> tuple:
        """Items of one length in blocks: (length, items, words the check asks for, postings by term)."""
        pairs = sorted({(int(t), k) for k, i in enumerate(own) for t in self.items[i][1]})
        first = np.searchsorted([t for t, _ in pairs], np.arange(len(self.idf) + 2))  # the last term is any other word
        return blocks, np.array(own), np.array([self.least(len(self.items[i][1])) for i in own]), first, np.array([k for _, k in pairs])

    @staticmethod
    def least(words: int) -> int:
        """Words of an item that the check asks for at least, in order."""
        return min(math.ceil(COPY * words - 1e-9), max(4, math.ceil(PARAPHRASE * words - 1e-9)))

    @staticmethod
    def grid(blocks: int) -> tuple[int, int]:
        """Distance and length, in blocks, of the stretches for items of ``blocks`` blocks."""
        return blocks + 1, 3 * blocks + 2

    def candidates(self, texts: list[np.ndarray]) -> list[dict[int, list[tuple[int, int]]]]:
        """Per text: item -> (first word, end) of the stretches that may leak it."""
        out: list[dict] = [{} for _ in texts]
        ids = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        if not len(ids) or not self.items:
            return out
        blocks = np.array([-(-len(t) // BLOCK) for t in texts])
        starts, total = np.cumsum(blocks) - blocks, int(blocks.sum())
        block = np.concatenate([s + np.arange(len(t)) // BLOCK for s, t in zip(starts, texts, strict=True)])
        doc = np.repeat(np.arange(len(texts)), blocks)  # of each block
        for i in np.flatnonzero(self.rarest[ids]) if self.exact else ():
            d = int(doc[block[i]])
            at = int((block[i] - starts[d]) * BLOCK)
            for item in self.exact[int(ids[i])]:
                n = self.items[item][4]
                out[d].setdefault(item, []).append((max(0, at - n), at + BLOCK + n))
        known = ids >= 0
        ids, block = ids[known], block[known]
        inside = np.arange(total) - starts[doc]
        for length, own, least, first, postings in self.groups:
            size = first[ids + 1] - first[ids]
            at = np.flatnonzero(size)
            size = size[at]
            last = np.cumsum(size)
            if not len(at):
                continue
            items = postings[np.arange(last[-1]) + np.repeat(first[ids[at]] - last + size, size)]
            held = np.zeros((total + 1, len(own)), np.int32)
            np.cumsum(np.bincount(np.repeat(block[at], size) * len(own) + items, minlength=total * len(own)).reshape(total, len(own)), axis=0, out=held[1:])
            step, span = self.grid(length)
            # a stretch behind one that reaches the end of the text has nothing of its own
            rows = np.flatnonzero((inside % step == 0) & ((inside == 0) | (inside - step + span < blocks[doc])))
            ends = np.minimum(rows + span, (starts + blocks)[doc[rows]])
            for r, k in np.argwhere(held[ends] - held[rows] >= least).tolist():
                d, lo = int(doc[rows[r]]), int(inside[rows[r]]) * BLOCK
                out[d].setdefault(int(own[k]), []).append((lo, lo + span * BLOCK))
        return out

    def verify(self, ids: np.ndarray, found: dict[int, list[tuple[int, int]]]) -> list[tuple]:
        """(item_id, cosine, ratio, kind, start) of leaked items."""
        out, parts = [], {}
        for i, stretches in sorted(found.items()):
            item_id, need, tail, strict, n = self.items[i]
            if strict:
                for lo, hi in stretches:
                    part = ids[lo:hi]
                    if len(part) >= n and (at := np.flatnonzero((np.lib.stride_tricks.sliding_window_view(part, n) == need).all(axis=1))).size:
                        out.append((item_id, self._cosine(part, i), 1.0, "copy", lo + int(at[0])))
                        break
                continue
            best = (-1, 0, 0, ids[:0])
            for lo, hi in stretches:
                if (lo, hi) not in parts:
                    part = ids[lo:hi]
                    part = part[part >= 0]
                    part = part[self.content[part]]
                    parts[lo, hi] = part, Counter(part.tolist())
                part, here = parts[lo, hi]
                got = self._common(i, part, here)
                if got > best[0]:
                    best = (got, lo, hi, part)
            got, lo, hi, part = best
            ratio = got / len(need)
            kind = None
            if ratio >= COPY:
                kind = "copy"
            elif ratio >= PARAPHRASE and got >= 4 and common_subsequence(tail, part) >= ANSWER * len(tail):
                kind = "paraphrase"
            if kind:
                out.append((item_id, self._cosine(ids[lo:hi], i), ratio, kind, lo))
        return out

    def _cosine(self, ids: np.ndarray, item: int) -> float:
        """Best cosine of the windows of a stretch with the item."""
        block = np.arange(len(ids)) // BLOCK
        total = max(int(block[-1]) + 1, SPAN)
        norm = np.bincount(block, weights=self.square[ids], minlength=total)
        hit = ids >= 0
        hit[hit] = self.content[ids[hit]]
        dot = np.bincount(block[hit], weights=self.weighted[ids[hit]] @ self.rows[item], minlength=total)
        dot, norm = (np.convolve(x, np.ones(SPAN), "valid") for x in (dot, norm))
        return float((dot / np.sqrt(np.maximum(norm, 1e-9))).max())

    def _common(self, item: int, part: np.ndarray, here: Counter) -> int:
        """Longest common subsequence, or 0 if too few of the words are there at all."""
        counts, least = self.needs[item]
        if sum([min(n, here[x]) for x, n in counts if x in here]) < least:
            return 0
        return common_subsequence(self.items[item][1], part)

    def search(self, texts: list[str | None]) -> Iterator[list[tuple]]:
        group, size = [], 0
        for ids in self.vocabulary.all_ids([*texts, None]):
            group.append(ids)
            size += len(ids)
            if size >= BATCH_WORDS:
                yield from (self.verify(x, f) if f else [] for x, f in zip(group, self.candidates(group), strict=True))
                group, size = [], 0
        got = [self.verify(x, f) if f else [] for x, f in zip(group, self.candidates(group), strict=True)]
        yield from got[:-1] if group else []


def _slices(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str) -> Iterator:
    """A broadcast of ``Searcher``'s arguments for each slice of the benchmark."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("t")).where("t is not null and item_id is not null")
    slices = -(-bench.count() // ITEMS)
    for k in range(slices):
        part = bench.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(slices)) == k)
        items = sorted((r.item_id, r.t) for r in part.collect())  # about ITEMS rows
        terms = sorted({t for _, text in items for w in text.split() if (t := term(w))})
        if not terms:
            continue
        total, df = passage_frequencies(docs, text_col, terms)
        idf = np.log((1 + total) / (1 + df))
        yield spark.sparkContext.broadcast((terms, idf, float(np.log(1 + total)), latent_space(part, terms, idf), items))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs_ratio, kind, start) for every document and item it leaks."""
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, {RESULT}"
    result = docs.sparkSession.createDataFrame([], schema)
    for shared in _slices(docs, benchmark, text_col, item_col, item_text_col):
        job = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], shared=shared, job=job) -> Iterator[pd.DataFrame]:
            searcher = per_worker(("searcher", job), lambda: Searcher(*shared.value))
            for b in batches:
                rows = [(i, *hit) for i, hits in zip(b["id"], searcher.search(b["t"].tolist()), strict=True) for hit in hits]
                if rows:
                    yield pd.DataFrame(rows, columns=[id_col, "item_id", "cosine", "lcs_ratio", "kind", "start"])

        result = result.union(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, schema))
    return result


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    out = docs
    for shared in _slices(docs, benchmark, text_col, item_col, item_text_col):
        out = out.where(_is_clean(shared)(F.col(text_col)))
    return out


def _is_clean(shared):
    job = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = per_worker(("searcher", job), lambda: Searcher(*shared.value))
        for b in batches:
            yield pd.Series([not hits for hits in searcher.search(b.tolist())], dtype=bool)

    return F.pandas_udf(run, "boolean")
