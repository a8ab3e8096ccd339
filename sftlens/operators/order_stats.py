"""Distributed order statistics (A3 on columns of any number of distinct values).

``stats.percentile_linear`` needs a histogram and a window over it, which suits token counts.  Here ranks are selected:

1. Every group gets ``splits`` + 1 splitters from one mergeable sketch (``percentile_approx``; partial aggregates).
   For each wanted rank two of them are picked far enough apart to hold it whatever the sketch's error.
2. One pass counts, by partial aggregates, the rows below, at and between the two splitters.  The counts are exact, so they
   either say that the wanted value is a splitter (values that repeat often end here) or give its rank
   between the two; a rank outside would be found out, and then all rows of its group stay.
3. Only rows strictly between the splitters are kept, about 4 / ``splits`` of them, and the step is repeated on those
   until at most ``small`` rows are left for a rank; these are sorted.

So the column is read twice and never shuffled or sorted; what moves are sketches, counts and the last few rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SPLITS = 1000
SMALL = 100_000
SKETCH = 20  # accuracy of the sketch in units of 1 / splits


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null."""
    b = b.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    return a.join(b, same).drop(*[f"_b_{k}" for k in keys])


def _brackets(rows: DataFrame, keys: list[str], ranks: DataFrame, splits: int) -> DataFrame:
    """(keys, want): the (t, r) of ``ranks`` with the splitters ``lo`` and ``hi`` that hold rank ``r``."""
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("v", [i / splits for i in range(1, splits)], SKETCH * splits).alias("at"), F.min("v").alias("least"), F.max("v").alias("most"))

    def splitter(i, otherwise):
        return F.when((i >= 1) & (i < splits), F.try_element_at("at", i.cast("int"))).otherwise(otherwise)

    share = lambda r: r / F.col("n") * splits
    few = F.col("n") < 2 * splits
    want = F.transform("want", lambda w: F.struct(
        w["t"].alias("t"), w["r"].alias("r"),
        F.when(few, F.col("least")).otherwise(splitter(F.floor(share(w["r"])) - 1, F.col("least"))).alias("lo"),
        F.when(few, F.col("most")).otherwise(splitter(F.ceil(share(w["r"] + 1)) + 1, F.col("most"))).alias("hi")))
    return materialize(_join(ranks, sketch, keys).select(*keys, want.alias("want")), "order-brackets")


def _select(rows: DataFrame, keys: list[str], ranks: DataFrame, width: int, splits: int, small: int) -> DataFrame:
    """(keys, t, x): the value at 0-based rank ``r`` for each (t, r) of ``ranks`` (keys, n, want); t is below ``width``."""
    size = ranks.agg(F.max("n")).first()[0]
    if size is None or size <= small:
        lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("vs"))  # at most ``small`` values
        picked = _join(ranks.withColumn("w", F.explode("want")), lists, keys)
        return picked.select(*keys, F.col("w.t").alias("t"), F.get("vs", F.col("w.r").cast("int")).alias("x"))
    brackets, v = _brackets(rows, keys, ranks, splits), F.col("v")
    bounds = brackets.select(*keys, *[F.get("want", F.lit(i))[side].alias(f"{side}{i}") for i in range(width) for side in ("lo", "hi")])
    between = lambda i: (v > F.col(f"lo{i}")) & (v < F.col(f"hi{i}"))
    parts = lambda i: (v < F.col(f"lo{i}"), v == F.col(f"lo{i}"), between(i), (v == F.col(f"hi{i}")) & (F.col(f"hi{i}") > F.col(f"lo{i}")))
    counted = _join(rows, bounds, keys).groupBy(*keys).agg(*[F.array(*[F.count_if(c) for c in parts(i)]).alias(f"c{i}") for i in range(width)])
    counted = counted.select(*keys, F.array(*[f"c{i}" for i in range(width)]).alias("cs"))
    place = (_join(brackets, counted, keys).select(*keys, F.posexplode("want").alias("i", "w"), "cs")
             .select(*keys, "w.*", F.get("cs", F.col("i")).alias("c")).withColumn("i", F.col("r") - F.col("c")[0]))
    inside = F.col("c")[1] + F.col("c")[2]
    kind = (F.when((F.col("i") < 0) | (F.col("i") >= inside + F.col("c")[3]), "lost").when(F.col("i") < F.col("c")[1], "lo")
             .when(F.col("i") < inside, "inside").otherwise("hi"))
    place = materialize(place.withColumn("kind", kind), "order-places")
    done = place.where("kind IN ('lo', 'hi')").select(*keys, "t", F.when(F.col("kind") == "lo", F.col("lo")).otherwise(F.col("hi")).alias("x"))
    left = place.where("kind IN ('inside', 'lost')")
    kinds = {k: n for k, n in left.groupBy("kind").count().collect()}
    if not kinds:
        return done
    # each rank that is left is a group of its own, of the rows between its splitters
    open_ranks = left.groupBy(*keys).agg(
        *[F.max(F.when(F.col("t") == i, F.col(side))).alias(f"{side}{i}") for i in range(width) for side in ("lo", "hi")],
        *[F.bool_or((F.col("t") == i) & (F.col("kind") == "lost")).alias(f"all{i}") for i in range(width)])
    holds = [F.coalesce(F.col(f"all{i}") | between(i), F.lit(False)) for i in range(width)]
    any_of = holds[0]
    for h in holds[1:]:
        any_of = any_of | h
    near = _join(rows, open_ranks, keys).where(any_of).select(
        *keys, "v", F.explode(F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(holds)]))).alias("t"))
    near = materialize(near, "order-rows")
    n = near.groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("n"))
    rank = F.when(F.col("kind") == "lost", F.col("r")).otherwise(F.col("i") - F.col("c")[1])
    sub = _join(left.select(*keys, "t", F.array(F.struct(F.lit(0).alias("t"), rank.alias("r"))).alias("want")), n, [*keys, "t"])
    deeper = dict(zip([*keys, "t"], [*[f"{k}_" for k in keys], "t_"]))  # t is a key from here on
    renamed = lambda d: d.select(*[F.col(c).alias(deeper.get(c, c)) for c in d.columns])
    if "lost" in kinds:  # splitters did not hold the rank: sort what there is
        small = max(small, _join(n, left.where("kind = 'lost'").select(*keys, "t"), [*keys, "t"]).agg(F.max("n")).first()[0])
    found = _select(renamed(near), list(deeper.values()), materialize(renamed(sub), "order-ranks"), 1, splits, small)
    return done.unionByName(found.select(*[F.col(b).alias(a) for a, b in deeper.items()], "x"))


def percentiles_by_selection(df: DataFrame, value_col: str, pcts: Sequence[float], group_cols: Sequence[str] = (),
                             splits: int = SPLITS, small: int = SMALL) -> DataFrame:
    """Exact percentiles (``p`` in 0..100) per group by the reference's linear rule; null values are left out.

    Columns are the group's and ``p50``, ``p99_5`` ...; the result equals :func:`stats.percentile_linear`.  Groups
    may be null; a group without values is absent.
    """
    keys = [f"g{i}" for i in range(len(group_cols))] or ["g0"]
    groups = [F.col(c) for c in group_cols] or [F.lit(0)]
    rows = materialize(df.where(F.col(value_col).isNotNull()).select(*[g.alias(k) for g, k in zip(groups, keys)], F.col(value_col).alias("v")), "order-column")
    at = [F.lit(p / 100.0) * (F.col("n") - 1) for p in pcts]
    want = [F.struct(F.lit(2 * j + k).alias("t"), F.least(F.floor(a) + k, F.col("n") - 1).cast("bigint").alias("r")) for j, a in enumerate(at) for k in (0, 1)]
    ranks = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("want", F.array(*want)), "order-ranks")
    found = _select(rows, keys, ranks, len(want), splits, small)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("t") == t, F.col("x"))).cast("double").alias(f"x{t}") for t in range(len(want))])
    values = [F.when((F.col("n") == 1) | (F.floor(a) + 1 >= F.col("n")), F.col(f"x{2 * j + 1}"))
              .otherwise(F.col(f"x{2 * j}") + (F.col(f"x{2 * j + 1}") - F.col(f"x{2 * j}")) * (a - F.floor(a))).alias(f"p{p:g}".replace(".", "_"))
              for j, (p, a) in enumerate(zip(pcts, at))]
    return _join(ranks, wide, keys).select(*[F.col(k).alias(c) for k, c in zip(keys, group_cols)], *values)
