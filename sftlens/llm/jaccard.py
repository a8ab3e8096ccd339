"""N-gram Jaccard self-join: near-duplicate documents by token-combination prefixes.

A document's set holds its distinct word shingles (64-bit hashes).  Two sets link when
``100 * intersection >= percent * union``.  Sets that are equal form a class, and only
classes are joined.

Signatures.  Shingles have a global order: first the rare ones among the "low" hashes, then the
frequent low ones, then the rest, each by hash.  A set of n shingles may miss at most
``r = n - ceil(percent * n / 100)`` of them in a partner.  Its prefix is extended until no r
missing shingles could destroy all its signatures: a rare shingle is a signature by itself;
frequent ones fall into classes by hash, and the pairs within a class are its signatures (m
shingles of a class survive m - 2 losses, so they count m - 1).  Two linked sets therefore share
a signature.  The number of classes follows a set's size (powers of two; a set near the border
signs for both).  How often a low shingle occurs is counted over all documents; the frequent ones
travel as a bitmap of fixed size, whose collisions only turn rare shingles into frequent ones.

Verification.  Classes that share a signature of fewer than ``FREQUENT`` rows are all compared.  In a
larger one, one class, chosen by one of a few hash orders, is compared with the others; links merge
components.  Signatures that still lie in different components then choose again, each by an order of its own, so
a class meets as many others as it has signatures.  Then the pairs between different components that still share a
signature are compared.  So a group of n near copies, each linked to some of the others, costs about n times its signatures
in pairs, not n * n, and no link between components is missed.

A class carries the parities of its shingles in ``SKETCH`` x 64 hash buckets.  A shingle that only one of two sets
has changes one parity, so the sets differ in at least as many shingles as parities; the join on signatures
drops a pair that differs in more than the threshold allows while it still holds both rows.  So texts that share a
passage, but little else, never become pairs, whatever the number of signatures that they share.  What is
left is compared on low shingles (another bound that loses nothing), then in full.  Near copies share most of their
signatures, and so most of the ``LOWEST`` smallest ones too: the last step's join keeps such a pair at the smallest of these
that both have, once instead of at every signature.  The join itself still looks at every two rows of a signature that lie in
different components.

Edge cases: a text with fewer words than a shingle is one shingle; null texts and texts without words
have an empty set and link with nothing; rows with a null id get no component; repeated
rows are one class; an empty table gives an empty result.  Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHash, collect_bitmap, connected_components, mix64, semi_join_prefiltered, signed, split_by_keys, test_bits

FREQUENT = 8        # documents from which a shingle counts as frequent
LOG2_BITMAP = 24
HEADS = 6           # orders by which a class of a large signature is chosen
LOWEST = 16         # signatures of a class by which pairs that share many are met once
SKETCH = 8          # longs of parities of a class
SMALL = 64          # sets up to this size keep all shingles at hand
MUL = np.uint64(0x9E3779B97F4A7C15)
SALT = np.uint64(0xA0761D6478BD642F)
MASK = (1 << 64) - 1


def shingle_set(text: bytes | None, k: int, words: WordHash) -> np.ndarray:
    """Distinct shingles of k words as sorted 64-bit hashes; A-Z count as a-z."""
    w = words.array(text.lower().split()) if text else np.zeros(0, np.uint64)
    if not len(w):
        return np.zeros(0, np.int64)
    whole = len(w) < k
    span = len(w) if whole else k
    acc = w[:len(w) - span + 1].copy()
    for j in range(1, span):
        acc = acc * MUL + w[j:len(w) - span + 1 + j]
    if whole:
        acc = acc + np.uint64(int(SALT) * span & MASK)
    return np.unique(signed(mix64(acc)))


def class_key(s: np.ndarray) -> int:
    """64 bits that equal sets share."""
    total = int(mix64(s.view(np.uint64) ^ SALT).sum(dtype=np.uint64)) + len(s) * int(MUL)
    return int(signed(mix64(np.array([total & MASK], np.uint64)))[0])


def parities(s: np.ndarray) -> np.ndarray:
    """Of the shingles in each of ``SKETCH * 64`` hash buckets, whether there is an odd number; as longs."""
    odd = np.bincount((s.view(np.uint64) >> np.uint64(17)).astype(np.int64) % (SKETCH * 64), minlength=SKETCH * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def low_bound(percent: int) -> int:
    """Hashes below this are low: twice the share that a partner may miss."""
    return -(1 << 63) + int(min(0.9, 2 * (100 - percent) / 100) * (1 << 64))


def losses(n: int, percent: int) -> int:
    return n + (-percent * n // 100)


def levels(n: int, percent: int) -> range:
    """Size levels a set of n signs for; linked sets share one."""
    return range(n.bit_length() - 1, (100 * n // percent).bit_length())


def signatures(n: int, s: np.ndarray, bitmap: np.ndarray, percent: int, complete: bool) -> np.ndarray | None:
    """Signatures of a set of n shingles of which ``s`` are at hand (all low ones at least);
    None if those don't suffice.  Sets whose links are all equal sets have none."""
    r = losses(n, percent)
    if 100 * n // percent <= n:
        return np.zeros(0, np.int64)
    is_low = s < low_bound(percent)
    often = is_low & test_bits(bitmap, s.view(np.uint64) & np.uint64((1 << LOG2_BITMAP) - 1))
    rare, freq, rest = s[is_low & ~often], s[often], s[~is_low]
    out = [rare[:r + 1]]
    if len(rare) <= r:
        low_share = min(0.9, 2 * (100 - percent) / 100)
        for level in levels(n, percent):
            groups = np.uint64(max(1, int(low_share * 0.56 * (1 << level))))
            g = (mix64(freq.view(np.uint64)) % groups).astype(np.int64)
            first = np.zeros(len(freq), bool)
            first[np.unique(g, return_index=True)[1]] = True
            cover = len(rare) + np.cumsum(~first)
            end = int(np.searchsorted(cover, r + 1)) + 1 if len(freq) and cover[-1] > r else len(freq)
            have = int(cover[end - 1]) if end else len(rare)
            order = np.argsort(g[:end], kind="stable")
            gs, fs = g[:end][order], freq[:end][order].view(np.uint64)
            for d in range(1, end):
                same = gs[d:] == gs[:-d]
                if not same.any():
                    break
                out.append(signed(mix64(fs[:-d][same] * MUL + fs[d:][same] + np.uint64(int(SALT) * (level + 1) & MASK))))
            if have <= r:
                if not complete and len(rest) <= r - have:
                    return None
                out.append(rest[:r + 1 - have])
    return np.unique(np.concatenate(out))


def sets(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, low_only: bool, pack: bool = False) -> DataFrame:
    """(doc_id, n, cls, tokens, sketch): the low shingles of each document, or all of small sets.  With ``pack``
    (cls, n, set) as of ``_pack``, by the same Python worker."""
    bound = low_bound(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHash()
        for b in batches:
            rows = [shingle_set(t, k, words) for t in b["t"]]
            n, cls = np.fromiter(map(len, rows), np.int64, len(rows)), [class_key(s) for s in rows]
            if pack:
                yield pd.DataFrame({"cls": cls, "n": n, "set": [s.tobytes() for s in rows]})
            else:
                yield pd.DataFrame({"doc_id": b["doc_id"], "n": n, "cls": cls,
                                    "tokens": [s[s < bound] if low_only and len(s) > SMALL else s for s in rows],
                                    "sketch": [parities(s) for s in rows]})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInPandas(
        run, "cls bigint, n bigint, set binary" if pack else
        f"doc_id {dict(docs.dtypes)[id_col]}, n bigint, cls bigint, tokens array<bigint>, sketch array<bigint>")


def sign(rows: DataFrame, bitmap, percent: int, complete: bool) -> DataFrame:
    """(doc_id, cls, n, sigs) of sets; sigs is null where the tokens at hand don't suffice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = bitmap.value
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "cls": b["cls"], "n": b["n"],
                                "sigs": [signatures(int(n), np.asarray(s, np.int64), bits, percent, complete or n <= SMALL)
                                         for n, s in zip(b["n"], b["tokens"])]})

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "cls", "n", "tokens").mapInPandas(run, f"doc_id {kind}, cls bigint, n bigint, sigs array<bigint>")


def size_ok(a: str, b: str, percent: int):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def parity_ok(x: str, y: str, percent: int):
    """False only for pairs that differ in more shingles than two sets of their sizes may (columns ``x`` and ``y``.n, .p0 ..)."""
    differ = " + ".join(f"bit_count({x}.p{i} ^ {y}.p{i})" for i in range(SKETCH))
    both = f"({x}.n + {y}.n)"
    return F.expr(f"{differ} <= {both} - 2 * (({percent} * {both} + {99 + percent}) div {100 + percent})")


def first_meeting():
    """False where ``x`` and ``y`` share a smaller signature than the row's that is among the ``lowest`` of both: they
    meet there too.  (A smaller one that is among them is the least that they share, so they meet at least once.)"""
    return F.expr("coalesce(array_min(array_intersect(x.lowest, y.lowest)) >= x.sig, true)")


def overlap_filter(pairs: DataFrame, sets_of: DataFrame, percent: int, full: bool) -> DataFrame:
    """Pairs (a, b, na, nb) whose sets reach the threshold; with ``full`` false ``sets_of`` holds
    low shingles only and pairs are kept unless those alone rule them out."""
    bound = low_bound(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for na, nb, x, y in zip(b["na"], b["nb"], b["x"], b["y"]):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                if not full:
                    x, y = x[x < bound], y[y < bound]
                z = np.concatenate([x, y])
                z.sort()
                both = int((z[1:] == z[:-1]).sum())
                if full:
                    keep.append(100 * both >= percent * (len(z) - both))
                else:
                    need = -(-percent * int(na + nb) // (100 + percent))
                    keep.append(len(z) - 2 * both <= int(na + nb) - 2 * need)
            yield b.loc[np.array(keep, bool), ["a", "b", "na", "nb"]]

    own = sets_of.select("cls", "set")
    joined = pairs.join(own.withColumnsRenamed({"cls": "a", "set": "x"}), "a").join(own.withColumnsRenamed({"cls": "b", "set": "y"}), "b")
    return joined.select("a", "b", "na", "nb", "x", "y").mapInPandas(run, "a bigint, b bigint, na bigint, nb bigint")


def _pack(df: DataFrame) -> DataFrame:
    """(cls, n, set): tokens as packed bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cls": b["cls"], "n": b["n"], "set": [np.asarray(s, np.int64).tobytes() for s in b["tokens"]]})

    return df.select("cls", "n", "tokens").mapInPandas(run, "cls bigint, n bigint, set binary")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    keep = Scratch(spark, "jaccard")
    every = keep.write(sets(docs, k, percent, id_col, text_col, True), "sets")
    known = every.where("doc_id is not null")
    classes = keep.write(known.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    parity = [f"p{i}" for i in range(SKETCH)]
    sketches = classes.select("cls", *[F.col("sketch")[i].alias(p) for i, p in enumerate(parity)])
    reps = known.join(classes.select(F.col("rep").alias("doc_id"), "cls"), ["doc_id", "cls"], "left_semi")
    low = known.select(F.explode("tokens").alias("t")).where(F.col("t") < low_bound(percent)) \
        .groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= FREQUENT)
    bitmap = spark.sparkContext.broadcast(collect_bitmap(low, F.col("t").bitwiseAND((1 << LOG2_BITMAP) - 1), LOG2_BITMAP))

    signed_rows = keep.write(sign(reps, bitmap, percent, False), "signed")
    missing = signed_rows.where("sigs is null")
    if not missing.isEmpty():
        # written, since two Python steps in a stage would double the workers that an executor holds from then on
        again = keep.write(sets(semi_join_prefiltered(docs, missing.select(F.col("doc_id").alias(id_col)), id_col), k, percent, id_col, text_col, False), "sets-again")
        signed_rows = signed_rows.where("sigs is not null").unionByName(
            keep.write(sign(again.join(missing.select("doc_id", "cls"), ["doc_id", "cls"], "left_semi"), bitmap, percent, True), "signed-again"))
    sigs = signed_rows.select("cls", "n", F.explode("sigs").alias("sig"))
    shared = sigs.groupBy("sig").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    members = keep.write(sigs.join(shared.select("sig", "size"), "sig").withColumn("component", F.col("cls")).join(sketches, "cls"), "members")

    def ordered(df: DataFrame) -> DataFrame:
        """Distinct pairs (a < b) that sizes allow."""
        return df.where((F.col("a") != F.col("b")) & size_ok("na", "nb", percent)).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
            F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
            F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()

    packed = keep.write(_pack(reps), "packed")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Links (src, dst) among ``pairs``."""
        left = keep.write(overlap_filter(pairs, packed, percent, False), name)
        need = left.select(F.col("a").alias("cls")).union(left.select(F.col("b").alias("cls"))).distinct() \
            .join(classes.select("cls", F.col("rep").alias(id_col)), "cls")
        need = keep.write(need, name + "-need")
        text = semi_join_prefiltered(docs, need, id_col)
        full = keep.write(sets(text, k, percent, id_col, text_col, False, True).dropDuplicates(["cls"]), name + "-full")
        links = overlap_filter(left, full, percent, True).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        return keep.write(links, name + "-links")

    def all_pairs(rows: DataFrame, also=F.lit(True)) -> DataFrame:
        """Pairs of classes that share a signature and lie in different components."""
        x, y = rows.alias("x"), rows.alias("y")
        return x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.component") != F.col("y.component"))
                      & size_ok("x.n", "y.n", percent) & parity_ok("x", "y", percent) & also).select(F.col("x.cls").alias("a"), F.col("x.n").alias("na"), F.col("y.cls").alias("b"), F.col("y.n").alias("nb"))

    def one_against_the_others(rows: DataFrame, orders: int | None) -> DataFrame:
        """A class per signature with the others.  It is the first by one of ``orders`` orders, so the signatures
        that a group shares name few different ones; with None each signature has an order of its own."""
        order = F.xxhash64("cls", F.pmod("sig", F.lit(orders)) if orders else F.col("sig"))
        heads = rows.groupBy("sig").agg(F.min(F.struct(order.alias("h"), "cls", "n", "component", *parity)).alias("r"))
        y = heads.select(F.col("sig").alias("s"), "r.*").alias("y")
        near = (F.col("x.sig") == F.col("y.s")) & (F.col("x.component") != F.col("y.component")) & size_ok("x.n", "y.n", percent) & parity_ok("x", "y", percent)
        return rows.alias("x").join(y, near).select(
            F.col("y.cls").alias("a"), F.col("y.n").alias("na"), F.col("x.cls").alias("b"), F.col("x.n").alias("nb"))

    def merged(links: DataFrame, comp: DataFrame | None, name: str) -> DataFrame | None:
        """Components by ``links`` and those so far, of which a star each stands for its links."""
        if links.isEmpty():
            return comp
        if comp is not None:
            links = links.union(comp.select(F.col("node").alias("src"), F.col("component").alias("dst")))
        return keep.write(connected_components(links, "jaccard-components"), name)

    lowest = signed_rows.select("cls", F.slice("sigs", 1, LOWEST).alias("lowest"))

    def mixed(rows: DataFrame, comp: DataFrame | None, name: str) -> DataFrame:
        """``rows`` of the signatures that lie in different components, and in which."""
        if comp is None:
            placed = rows.withColumn("component", F.col("cls"))
        else:
            placed = rows.drop("component").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        sig = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
        return keep.write(placed.join(sig, "sig", "left_semi"), name)

    rows = members.where(F.col("size") >= FREQUENT).select("cls", "n", "sig", "component", *parity)
    done = keep.write(ordered(one_against_the_others(rows, HEADS).union(all_pairs(members.where(F.col("size") < FREQUENT)))), "pairs-0")
    comp = merged(verified(done, "0"), None, "comp-0")
    for i, last in enumerate((False, True), 1):
        rows = mixed(rows, comp, f"live-{i}")
        found = all_pairs(rows.join(lowest, "cls"), first_meeting()) if last else one_against_the_others(rows, None)
        pairs = keep.write(ordered(found).join(done.select("a", "b"), ["a", "b"], "left_anti"), f"pairs-{i}")
        if not pairs.isEmpty():
            comp = merged(verified(pairs, str(i)), comp, f"comp-{i}")
            done = done.union(pairs)
    if comp is None:
        comp = spark.createDataFrame([], "node bigint, component bigint")
    placed = classes.select("cls", "rep").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    placed = keep.write(placed, "placed")
    heads = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = keep.write(placed.join(heads, "component").select("cls", "component_id"), "ids")
    narrow = every.select("doc_id", "n", "cls")
    out = narrow.join(ids, "cls", "left").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
                                                 F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    keep.drop(*[name for name in keep.paths if name not in ("sets", "ids")])
    return out


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id; of rows with the same
    id and text, one.  Rows with a null id stay.  Only documents that may go are shuffled."""
    keep = Scratch(docs.sparkSession, "jaccard-dedup")
    found = keep.write(near_duplicates(docs, k, percent, id_col, text_col).where(F.col(id_col).isNotNull()), "found")
    odd = found.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("component_id") != F.col(id_col)).alias("_goes"), F.count(F.lit(1)).alias("_n")) \
        .where("_goes or _n > 1")
    odd = keep.write(odd, "odd")
    sure, maybe = split_by_keys(docs, odd, id_col, "_id")
    kept = maybe.join(odd, F.col(id_col) == F.col("_id"), "left").where("_goes is null or not _goes")
    once = kept.where("_n is null").select(*docs.columns).union(kept.where("_n > 1").select(*docs.columns).dropDuplicates([id_col, text_col]))
    return sure.union(once)
