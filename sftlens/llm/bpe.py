"""Byte-level BPE encoding and decoding over whole texts.

Method: a rank queue of hierarchical bitmaps.  The bytes of pre-tokens form doubly linked lists, one
behind the other with a bar between them; every adjacent pair with a merge rank puts its left position into
the bucket of its group of ranks.  Two levels of bitmaps mark the non-empty groups and find-first-set (lowest set bit of
a Python int) gives the next one; positions whose pair has changed since they were queued are skipped.  In the group each
pre-token joins the pairs of its lowest rank, every other one from the left where they overlap.  Pre-tokens don't touch
each other, so all that are new in a batch share one queue, whose steps are a few passes over arrays; a megabyte
long pre-token (a run of letters, of spaces) takes as many steps as it has ranks to join, not as it has bytes.

Most pre-tokens are short and repeat; each Python worker memoises them (bounded memo, kept
between its tasks).

Edge cases: null or empty text has no tokens; special-token strings are ordinary text;
repeated rows are encoded alike; an empty table gives an empty result; other columns of the
input are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, small_batches

SHORT = 64  # pieces up to this many characters are memoised
MEMO = 400_000  # merged pieces, and chunks with their digests' parts, that a worker remembers (about 300 MB)
GROUP = 1_000_000  # characters of texts whose new chunks are merged together (about 100 MB of a worker)
RANKS = 256  # ranks of a bucket


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The tiktoken file format: base64 token, blank, rank per line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


def is_utf8(token: bytes) -> bool:
    try:
        return bool(token.decode("utf-8"))
    except UnicodeDecodeError:
        return False


def remember(memo: dict, new: dict, room: int) -> None:
    """``memo`` takes the short keys of ``new`` while it has room."""
    if len(memo) < room:
        for k, v in new.items():
            if len(k) <= SHORT and k not in memo:
                memo[k] = v
                if len(memo) >= room:
                    break


class Known(dict):
    """What is remembered, and ``new`` of the texts at hand behind it."""

    def __missing__(self, key: str):
        return self.new[key]


class Codec:
    """Encodes and decodes with one rank table.  ``pattern`` splits texts into pre-tokens."""

    def __init__(self, rank_file: bytes, pattern: str, memo: int = MEMO):
        self.ranks = parse_ranks(rank_file)
        self.size = max(self.ranks.values(), default=0) + 1
        self.token = {r: t for t, r in self.ranks.items()}
        self.whole = {t.decode("utf-8"): r for t, r in self.ranks.items() if is_utf8(t)}
        # of ids; -1 stands between chunks
        self.decimal = {-1: "|"} | {r: str(r) for r in self.token}
        self.sizes = np.zeros(self.size + 1, np.int64)
        self.sizes[list(self.token)] = list(map(len, self.token.values()))
        self.bytes = {-1: b""} | self.token
        self.split = regex.compile(pattern)
        # a blank before a letter or digit always starts a pre-token, whatever precedes it
        self.chunks, self.odd = re.compile(r" (?=[^\W_])"), re.compile(r" (?![^\W_])")
        self.room = memo
        self.memo: dict[str, tuple[int, ...]] = {}  # chunk -> ids
        self.said = Known()  # chunk after a blank -> its ids as text
        self.raw = Known()  # the same chunk -> the bytes that its ids decode to
        # left id << 17 | right id -> rank of their join
        rank_of = self.ranks.get
        pairs = {left << 17 | right: rank for token, rank in self.ranks.items() for i in range(1, len(token))
                 if (left := rank_of(token[:i])) is not None and (right := rank_of(token[i:])) is not None}
        self.pair = np.array([*sorted(pairs), 1 << 62])
        self.pair_rank = np.array([*map(pairs.get, self.pair[:-1].tolist()), -1])
        # a join ranks behind its parts, as in any table that merging has made
        self.ordered = all(rank > key >> 17 and rank > key & (1 << 17) - 1 for key, rank in pairs.items())
        self.byte_ids = np.array([self.ranks.get(bytes([i]), -3) for i in range(256)])
        self.first = self._ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))  # two bytes -> rank of their join
        self.words = [0] * (self.size // RANKS // 16 + 1)  # all zero between calls

    def merge(self, chunks: list[str]) -> np.ndarray:
        """Ids of the chunks (none empty), a -1 before, between and behind them."""
        pieces, last = [], [0]
        for c in chunks:
            if c[:1] == " " and c[1:].isalpha():  # one pre-token
                pieces.append(c)
            else:
                pieces += self.split.findall(c)
            last.append(len(pieces))
        raw = np.frombuffer("\0".join(["", *pieces, ""]).encode("utf-8"), np.uint8).astype(np.int64)
        bars = np.flatnonzero(raw == 0)
        if len(bars) != len(pieces) + 1:  # pre-tokens hold such bytes too
            bars = np.append(0, np.cumsum([len(p.encode("utf-8")) + 1 for p in pieces]))
        # ids of the parts that start at a position; -1: a bar, which joins with nothing; -2: inside a part
        ids = self.byte_ids[raw]
        ids[bars] = -1
        want = np.append(self.first[raw[:-1] << 8 | raw[1:]], -1)  # the rank that a position waits for
        want[bars] = want[bars[1:] - 1] = -1
        whole = np.fromiter(map(self.whole.get, pieces, repeat(-1)), np.int64, len(pieces))
        inside = np.repeat(np.append(whole >= 0, False), np.diff(bars, append=len(raw)))
        ids[inside], want[inside] = -2, -1  # pre-tokens that are one token
        ids[bars] = -1
        ids[bars[:-1][whole >= 0] + 1] = whole[whole >= 0]
        self._join(ids, want, np.repeat(np.arange(len(bars)), np.diff(bars, append=len(raw))))
        ids[bars] = -2
        ids[bars[last]] = -1
        return ids[ids != -2]

    def _join(self, ids: np.ndarray, want: np.ndarray, piece: np.ndarray) -> None:
        """Joins parts in place, by the rank queue: ``words`` and ``top`` mark the non-empty groups of ``RANKS`` ranks, ``buckets``
        holds the positions of a group.  Of the lowest group, each pre-token joins the pairs of its lowest rank."""
        words, buckets, top = self.words, {}, 0
        after, before, n = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1), len(ids).bit_length()
        fresh = np.flatnonzero(want >= 0)
        while True:
            if len(fresh):
                group = want[fresh] // RANKS
                order = np.argsort(group, kind="stable")
                fresh, group = fresh[order], group[order]
                heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist()
                for g, i, j in zip(group[heads].tolist(), heads, [*heads[1:], len(fresh)]):
                    if g in buckets:
                        buckets[g].append(fresh[i:j])
                    else:
                        buckets[g] = [fresh[i:j]]
                        words[g >> 4] |= 1 << (g & 15)
                        top |= 1 << (g >> 4)
            if not top:
                return
            w = (top & -top).bit_length() - 1
            word = words[w]
            g = (w << 4) + (word & -word).bit_length() - 1
            held = buckets.pop(g)
            words[w] = word = word & (word - 1)
            if not word:
                top &= top - 1
            at = np.concatenate(held) if len(held) > 1 else held[0]
            at = at[want[at] // RANKS == g]  # others wait for another rank by now
            if not len(at):
                fresh = at
                continue
            # by pre-token, rank and position
            key = (piece[at] * RANKS + want[at] % RANKS) << n | at
            key.sort()
            key = key[np.append(True, key[1:] != key[:-1])]
            at, rank = key & ((1 << n) - 1), key >> n
            heads = np.append(True, rank[1:] // RANKS != rank[:-1] // RANKS)
            if self.ordered:
                heads = np.flatnonzero(heads)
                now = rank == np.repeat(rank[heads], np.diff(heads, append=len(rank)))
            else:
                now = heads
            i, rest = at[now], at[~now]
            # of pairs that overlap, every other one from the left
            chained = np.append(False, after[i[:-1]] == i[1:])
            if chained.any():
                place = np.arange(len(i))
                i = i[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            j, r = after[i], want[i]
            k = after[j]
            ids[i], ids[j], want[j] = r, -2, -1
            after[i], before[k] = k, i
            h = before[i]
            ends = np.concatenate([h, i])
            rank = self._ranks(np.concatenate([ids[h], r]), np.concatenate([r, ids[k]]))
            want[ends] = rank
            fresh = ends[rank >= 0]
            if len(rest):
                fresh = np.concatenate([fresh, rest[want[rest] >= 0]])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the join of two ids, or -1."""
        key = left << 17 | right
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.pair_rank[at], -1)

    def pieces(self, text: str) -> list[str]:
        """``text`` cut at blanks that start a pre-token; those blanks are left out."""
        return text.split(" ") if not self.odd.search(text) else self.chunks.split(text)

    def encode_all(self, texts) -> list[list[int]]:
        """Ids of each text; chunks that are new are merged together."""
        cut = [[c for c in (first, *(" " + p for p in rest)) if c] for first, *rest in (self.pieces(t or "") for t in texts)]
        new = list(set().union(*cut).difference(self.memo))
        ids = self.merge(new)
        ends, ids = np.flatnonzero(ids == -1).tolist(), ids.tolist()
        known = {c: tuple(ids[i + 1:j]) for c, i, j in zip(new, ends, ends[1:])}
        out = [[i for c in own for i in (known[c] if c in known else self.memo[c])] for own in cut]
        remember(self.memo, known, self.room)
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def _learn(self, new: list[str]) -> tuple[dict[str, str], dict[str, bytes]]:
        """Of chunks that are not empty: their ids as text, and the bytes that these decode to."""
        ids = self.merge(new)
        ends = np.cumsum(self.sizes[ids])[ids == -1].tolist()
        ids = ids.tolist()
        said = " ".join(map(self.decimal.__getitem__, ids))[2:-2].split(" | ") if new else []
        every = b"".join(map(self.bytes.__getitem__, ids))
        return dict(zip(new, said, strict=True)), dict(zip(new, (every[i:j] for i, j in zip(ends, ends[1:])), strict=True))

    def digests(self, texts) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, sha256 of the ids, sha256 of the decoded bytes) of each text:
        a chunk's ids are kept as their decimal text and as the bytes they decode to."""
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= GROUP:
                yield from self._digests(group)
                group, size = [], 0
        yield from self._digests(group)

    def _digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        cut = [self.pieces(t) for t in texts]
        firsts = [c.pop(0) for c in cut]
        new = list(set().union(*cut).difference(self.said))
        said, raw = (dict(zip(new, x.values(), strict=True)) for x in self._learn([" " + w for w in new]))
        head, head_raw = self._learn(list({f for f in firsts if f}))
        self.said.new, self.raw.new = said, raw
        say, give = self.said.__getitem__, self.raw.__getitem__
        for first, rest in zip(firsts, cut, strict=True):
            words = " ".join([*([head[first]] if first else []), *map(say, rest)])
            decoded = b"".join([head_raw[first] if first else b"", *map(give, rest)])
            yield (words.count(" ") + 1 if words else 0, hashlib.sha256(words.encode("ascii")).hexdigest(), hashlib.sha256(decoded).hexdigest())
        remember(self.said, said, self.room)
        remember(self.raw, raw, self.room)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        return next(self.digests([text]))


def encode(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row.  The rank file's bytes travel as a broadcast;
    its size is that of a tokenizer's vocabulary and does not depend on the data."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = per_worker(("bpe", pattern, hash(shared.value)), lambda: Codec(shared.value, pattern))
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "ids": [np.array(i, np.int32) for i in codec.encode_all(b[text_col])]})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, decoded binary) of every row of ``encode``'s result; null ids decode to nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = per_worker(("bpe", pattern, hash(shared.value)), lambda: Codec(shared.value, pattern))
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "decoded": [b"" if i is None else codec.decode(map(int, i)) for i in b["ids"]]})

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, "ids").mapInPandas(run, f"`{id_col}` {kind}, decoded binary")


def gathered(batches: Iterator[pd.DataFrame], text_col: str) -> Iterator[pd.DataFrame]:
    """Batches put together up to ``GROUP`` characters, about."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += sum(len(t) for t in b[text_col] if t)
        if size >= GROUP:
            yield pd.concat(held)
            held, size = [], 0
    if held:
        yield pd.concat(held)


def digests(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """One row per document: n_tokens, ids_sha256, decoded_sha256.  ``memo`` trades a worker's memory
    for time."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = per_worker(("bpe", pattern, hash(shared.value), memo), lambda: Codec(shared.value, pattern, memo))
        for b in gathered(batches, text_col):
            rows = list(codec.digests(b[text_col]))
            yield pd.DataFrame({id_col: b[id_col], "n_tokens": np.array([r[0] for r in rows], np.int64),
                                "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInPandas(
        run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
