"""Embedding near-duplicates: sign hashes of random hyperplanes in several tables, exact cosine
verification, distributed connected components.

Equal vectors form a class; one vector per class is hashed.  A table's code is the signs of
``bits`` random projections; vectors meet where a table gives them the same code.  ``bits`` grows with
the log of the number of classes so that a bucket holds about ``BUCKET`` of them, and the number of
tables follows from it so that a pair at the threshold is missed with probability ``MISS`` at
most (closer pairs far more rarely).

Inside a bucket all cosines are computed in double precision by blocks; a bucket of more than
``BLOCK`` vectors is dealt out as pairs of blocks, so a hot code is the work of many tasks.  A pair
counts in the first table that joins it.  A task returns link counts and, for connectivity, a star per
component of its block; pairs are never written out.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different length do not link; rows that share an id are separate vectors; an empty
table gives an empty result; other columns (labels too) are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

BUCKET = 200
BLOCK = 1024
MISS = 0.0001
SEED = 11


def plan(classes: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for so many classes."""
    bits = max(4, round(math.log2(max(classes, 1) / BUCKET))) if classes > BUCKET else 4
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - same)))


def usable(v, kind) -> np.ndarray | None:
    """The vector, or None if it links with nothing."""
    if v is None or not len(v):
        return None
    v = np.asarray([math.nan if x is None else x for x in v] if getattr(v, "dtype", None) == object else v, kind)
    return v if np.isfinite(v).all() and v.any() else None


def _classes(vectors: DataFrame, kind: str, id_type: str) -> DataFrame:
    """(vec_id, cls, v): 64-bit key and bytes of each vector; null for unusable ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [None if (x := usable(v, kind)) is None else (x + 0.0).tobytes() for v in b["v"]]  # -0.0 is 0.0
            keys = [None if r is None else xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw]
            yield pd.DataFrame({"vec_id": b["vec_id"], "cls": pd.array(keys, "Int64"), "v": raw})

    return vectors.mapInPandas(run, f"vec_id {id_type}, cls bigint, v binary")


def _codes(reps: DataFrame, kind: str, bits: int, tables: int) -> DataFrame:
    """(cls, m, dim, v, codes) with a code per table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for b in batches:
            rows = [np.frombuffer(v, kind) for v in b["v"]]
            codes: list = [None] * len(rows)
            dims = np.fromiter(map(len, rows), np.int64, len(rows))
            for d in np.unique(dims):
                p = planes.get(d)
                if p is None:
                    p = planes[d] = np.random.default_rng(SEED).standard_normal((d, tables * bits))
                at = np.flatnonzero(dims == d)
                side = (np.stack([rows[i] for i in at]).astype(float) @ p > 0).reshape(len(at), tables, bits)
                for i, c in zip(at, (side * weights).sum(axis=2).astype(np.int32), strict=True):
                    codes[i] = c
            yield pd.DataFrame({"cls": b["cls"], "m": b["m"], "dim": dims, "v": b["v"], "codes": codes})

    return reps.select("cls", "m", "v").mapInPandas(run, "cls bigint, m bigint, dim bigint, v binary, codes array<int>")


def block_links(part: pd.DataFrame, threshold: float, kind: str) -> pd.DataFrame:
    """Of the rows of a pair of blocks: per class the multiplicity of its new links, and the
    smallest class that they reach inside the block."""
    table, i, j = int(part["t"].iloc[0]), int(part["i"].iloc[0]), int(part["j"].iloc[0])
    part = part.sort_values("cls", ignore_index=True)
    x = np.stack([np.frombuffer(v, kind) for v in part["v"]]).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    codes = np.stack(part["codes"].to_list())[:, :table]
    m, block = part["m"].to_numpy(), part["block"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    links, head = np.zeros(len(part), np.int64), np.arange(len(part))
    ps, qs = [], []
    for s in range(0, len(left), 256):
        a, b = np.nonzero(x[left[s:s + 256]] @ x[right].T >= threshold)
        p, q = left[s:s + 256][a], right[b]
        if i == j:
            p, q = p[p < q], q[p < q]
        for c in range(0, len(p), 100_000):
            cp, cq = p[c:c + 100_000], q[c:c + 100_000]
            new = ~(codes[cp] == codes[cq]).any(axis=1)
            cp, cq = cp[new], cq[new]
            np.add.at(links, cp, m[cq])
            np.add.at(links, cq, m[cp])
            ps.append(cp)
            qs.append(cq)
    p, q = (np.concatenate(y) if y else np.zeros(0, np.int64) for y in (ps, qs))
    while len(p):  # smallest reachable row
        low = np.minimum(head[p], head[q])
        if (head[p] == low).all() and (head[q] == low).all():
            break
        np.minimum.at(head, p, low)
        np.minimum.at(head, q, low)
        head = head[head]
    at = np.flatnonzero(links)
    cls = part["cls"].to_numpy()
    return pd.DataFrame({"cls": cls[at], "links": links[at], "head": cls[head[at]]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    keep = Scratch(spark, "neardup")
    kinds = dict(vectors.dtypes)
    kind = "float32" if kinds[vector_col] == "array<float>" else "float64"
    rows = keep.write(_classes(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")), kind, kinds[id_col]), "rows")
    reps = rows.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("rep"), F.first("v").alias("v"))
    reps = keep.write(reps, "reps")
    bits, tables = plan(reps.count(), threshold)
    hashed = keep.write(_codes(reps, kind, bits, tables), "hashed")
    spots = hashed.select("dim", F.posexplode("codes").alias("t", "code"))
    hot = spots.groupBy("dim", "t", "code").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK) \
        .select("dim", "t", "code", F.ceil(F.col("c") / BLOCK).alias("blocks"))
    dealt = hashed.select("cls", "m", "dim", "v", "codes", F.posexplode("codes").alias("t", "code")) \
        .join(hot, ["dim", "t", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) \
        .withColumn("block", F.pmod(F.xxhash64("cls"), "blocks")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))) \
        .select("cls", "m", "dim", "v", "codes", "t", "code", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return block_links(part, threshold, kind)

    found = dealt.groupBy("dim", "t", "code", "i", "j").applyInPandas(run, "cls bigint, links bigint, head bigint")
    found = keep.write(found, "links")
    comp = connected_components(found.select(F.col("cls").alias("src"), F.col("head").alias("dst")), "neardup-components") \
        .withColumnRenamed("node", "cls")
    per = reps.select("cls", "m", "rep").join(found.groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left") \
        .join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    per = keep.write(per, "classes")
    heads = per.groupBy("component").agg(F.min("rep").alias("least"))
    per = per.join(heads, "component").select("cls", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "least")
    out = rows.select("vec_id", "cls").join(per, "cls", "left")
    keep.drop("hashed", "links")
    component = F.coalesce("least", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
