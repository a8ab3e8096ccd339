"""Substring dedup: words covered by a repeated window of ``window`` words are removed.

Method: difference-cover anchors.  The positions of a document whose remainder modulo ``PERIOD``
lies in ``COVER`` are anchors; each anchor hashes the ``window - PERIOD + 1`` words from it on.
Every remainder is a difference of two members of the cover, so wherever a sequence of ``window``
words occurs twice, the occurrences share an aligned anchor among their first ``PERIOD``
positions.  Only windows that hold a repeated anchor can be repeated; the match is then extended
to the whole window by an exact count of the window hashes (64 bits) of those candidates.

1. anchors -> those that occur at two places, as a bitmap of fixed size (two probes; a false hit
   only adds candidates);
2. candidates of each document -> windows that occur at two places;
3. documents with removed words are read once more and cut; all others are final after step 2.

Texts that are equal word for word count as one place in steps 1 and 2 (a place is a hash of the
word sequence and the position), and are removed as wholes if they have ``window`` words: so a large
group of copies adds no work.  All keys are hashes of words at positions, hence spread evenly however
often a passage or a document repeats, and are aggregated in each task before the shuffle.

Edge cases: null or empty text has no words; shorter texts lose nothing; repeated rows are
repeated texts; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHash, collect_bitmap, mix64, semi_join_prefiltered, signed, test_bits

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)  # every remainder modulo 21 is a difference of two of these
LOG2_BITMAP = 27
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SALT = np.uint64(0xE7037ED1A0B428DB)


class Rolling:
    """Hashes of word windows: powers are kept between texts."""

    def __init__(self):
        self.words, self.up, self.down = WordHash(), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def prefix(self, words: list[bytes]) -> np.ndarray:
        """Prefix sums from which ``window`` takes differences."""
        n = len(words)
        if len(self.up) <= n:
            m = 2 * n
            for name, by in (("up", BASE), ("down", INVERSE)):
                p = np.full(m + 1, by, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words.array(words) * self.up[:n], dtype=np.uint64, out=out[1:])
        return out

    def window(self, prefix: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each position on."""
        return mix64((prefix[at + size] - prefix[at]) * self.down[at])

    def whole(self, prefix: np.ndarray) -> int:
        """Hash of the whole sequence."""
        n = len(prefix) - 1
        return int(signed(mix64(prefix[n:] + SALT + np.uint64(n)))[0])


def anchors(n: int, size: int) -> np.ndarray:
    """Anchor positions of a text of n words, for anchors of ``size`` words."""
    last = n - size + 1
    if last <= 0:
        return np.zeros(0, np.int64)
    at = (np.arange(-(-last // PERIOD))[:, None] * PERIOD + np.array(COVER)).ravel()
    return at[at < last]


def probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << LOG2_BITMAP) - 1)
    return h & mask, (h >> np.uint64(LOG2_BITMAP)) & mask


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    size = window - PERIOD + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll = Rolling()
        for b in batches:
            seq, hashes = [], []
            for t in b["t"]:
                words = t.split() if t else []
                if len(words) >= window:
                    p = roll.prefix(words)
                    seq.append(roll.whole(p))
                    hashes.append(signed(roll.window(p, anchors(len(words), size), size)))
            yield pd.DataFrame({"seq": np.array(seq, np.int64), "h": hashes})

    return docs.select("t").mapInPandas(run, "seq bigint, h array<bigint>")


def _candidate_rows(docs: DataFrame, window: int, bitmap, id_type: str) -> DataFrame:
    size = window - PERIOD + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll, bits = Rolling(), bitmap.value
        none = (np.zeros(0, np.int32), np.zeros(0, np.int64))
        for b in batches:
            rows = []
            for t in b["t"]:
                words = t.split() if t else []
                n = len(words)
                p = roll.prefix(words)
                pos, w = none
                if n >= window:
                    at = anchors(n, size)
                    one, two = probes(roll.window(p, at, size))
                    hit = test_bits(bits, one)
                    hit[hit] = test_bits(bits, two[hit])
                    if hit.any():
                        seen = np.zeros(n + 1, np.int32)
                        seen[at[hit] + 1] = 1
                        seen = np.cumsum(seen)
                        start = np.arange(n - window + 1)
                        pos = np.flatnonzero(seen[start + PERIOD] > seen[start])  # windows end beyond their first PERIOD positions
                        w = signed(roll.window(p, pos, window))
                rows.append((n, roll.whole(p), hashlib.sha256(b" ".join(words)).hexdigest(), pos.astype(np.int32), w))
            n, seq, sha, pos, w = zip(*rows) if rows else ((),) * 5
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": np.array(n, np.int64), "seq": np.array(seq, np.int64),
                                "sha": sha, "pos": pos, "w": w})

    return docs.select("doc_id", "t").mapInPandas(
        run, f"doc_id {id_type}, n_words bigint, seq bigint, sha string, pos array<int>, w array<bigint>")


def _cut_rows(rows: DataFrame, window: int, id_type: str) -> DataFrame:
    """Texts without the words that the windows at ``pos`` cover; rows of another text with the
    same id (``seq`` differs) are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll = Rolling()
        for b in batches:
            out = []
            for i, t, seq, pos in zip(b["doc_id"], b["t"], b["seq"], b["pos"]):
                words = t.split() if t else []
                n = len(words)
                if roll.whole(roll.prefix(words)) != seq:
                    continue
                edge = np.zeros(n + 1, np.int32)
                pos = np.unique(np.asarray(pos, np.int64))
                np.add.at(edge, pos, 1)
                np.add.at(edge, pos + window, -1)
                covered = np.cumsum(edge[:n]) > 0
                kept = b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])
                out.append((i, n, int(covered.sum()), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"]).astype({"n_words": "int64", "n_removed": "int64"})

    return rows.select("doc_id", "t", "seq", "pos").mapInPandas(run, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string")


def repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by
    one blank)."""
    if window < PERIOD + 4:
        raise ValueError(f"windows need {PERIOD + 4} words at least")
    spark = docs.sparkSession
    keep = Scratch(spark, "substring")
    id_type = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    place = F.xxhash64("seq", "pos").alias("place")

    found = _anchor_rows(texts, window).select("seq", F.posexplode("h").alias("pos", "h")).select("h", place)
    found = found.groupBy("h").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo <> hi").select("h")
    found = keep.write(found, "anchors")
    mask = (1 << LOG2_BITMAP) - 1
    bits = found.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", LOG2_BITMAP).bitwiseAND(mask))).alias("bit"))
    bitmap = spark.sparkContext.broadcast(collect_bitmap(bits, F.col("bit"), LOG2_BITMAP))

    rows = keep.write(_candidate_rows(texts, window, bitmap, id_type), "rows")
    bitmap.unpersist()
    windows = rows.select("seq", F.explode(F.arrays_zip("pos", "w")).alias("x")).select("seq", "x.pos", "x.w")
    twice = windows.select("w", place).groupBy("w").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo <> hi").select("w")
    twice = keep.write(twice, "windows")
    # a text's windows; copies of a text give the same ones
    cuts = windows.join(twice, "w").groupBy("seq").agg(F.collect_set("pos").alias("pos"))
    cuts = keep.write(cuts, "cuts")
    copies = rows.where(F.col("n_words") >= window).groupBy("seq").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("seq", F.lit(True).alias("copy"))
    head = rows.select("doc_id", "n_words", "seq", "sha").join(copies, "seq", "left") \
        .join(cuts.select("seq", F.lit(True).alias("cut")), "seq", "left")
    head = keep.write(head, "head")
    empty = hashlib.sha256(b"").hexdigest()
    whole = head.where("copy or cut is null").select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(F.col("copy"), empty).otherwise(F.col("sha")).alias("kept_sha256"))
    part = keep.write(head.where("copy is null and cut").select("doc_id", "seq").distinct(), "part")
    sources = semi_join_prefiltered(texts.where("doc_id is not null"), part.where("doc_id is not null"), "doc_id").union(
        texts.where("doc_id is null"))
    todo = part.join(cuts, "seq").withColumnRenamed("doc_id", "_id")
    cut = _cut_rows(sources.join(todo, F.col("doc_id").eqNullSafe(F.col("_id"))), window, id_type)
    keep.drop("anchors", "rows", "windows")
    return whole.union(cut).withColumnRenamed("doc_id", id_col)
