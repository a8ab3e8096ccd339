"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

1. One pass over the texts gives each document its mask, a bit for each filter it fails.  Conditions on the text
   alone are column expressions; the filter for copies compares digests over the whole table.
2. Masks are counted by part (partial aggregates): at most 2^filters cells a part, with the documents, the good and the
   toxic ones of the cell.  What follows reads these cells only, however many documents there are.
3. A recursive common table expression extends filter prefixes by every unused letter.  A row carries the bits
   applied so far; each level joins the part's mask cells and emits the metrics of its step.
4. Each order reads its steps from its own prefixes (an equi-join on part and prefix).

Copies: a row fails the last filter if an equal text has a smaller id.  The smallest id of a text is an
aggregate by digest, and rows look it up by digest and id together, so a text that makes up a third of all rows is
spread over its ids.

Results of the edge cases: null texts count as empty, null parts as the empty string; a null id has no
smaller one and no label; rows repeated with the same id do not make each other copies; a document with
several label rows is good or toxic if one of them says so; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

SPACE = r"[\x20\x09-\x0D]+"
COPIES = "E"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (``__`` for a dot) for what runs inside; the earlier ones are put back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def text_filters(text: Column) -> dict[str, Column]:
    """Letter -> failure condition on a text that is not null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 200,
        "B": F.lit(100) * distinct < F.lit(50) * n,
        "C": F.lit(100) * capitals > F.lit(3) * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
               filters=text_filters, keep: Scratch | None = None) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters they fail.  Bit k is the k-th letter of
    ``filters``, the bit after them the filter for copies."""
    keep = keep or Scratch(docs.sparkSession, "filteraudit")
    text = F.coalesce(F.col(text_col), F.lit(""))
    conditions = list(filters(F.col("t")).values())
    mask = sum((c.cast("int") * (1 << k) for k, c in enumerate(conditions)), F.lit(0))
    rows = keep.write(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("t"))
                      .select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask")), "masks")
    firsts = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = (labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).cast("int").alias("g"), (F.col("toxic") == 1).cast("int").alias("x"))
             .where("id IS NOT NULL").groupBy("id").agg(F.max("g").alias("g"), F.max("x").alias("x")))
    copy = (F.col("id").isNotNull() & F.col("first").isNull()).cast("int") * (1 << len(conditions))
    return (rows.join(firsts, ["digest", "id"], "left").join(marks, "id", "left")
            .select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("x", F.lit(0)).alias("x"))
            .groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("good"), F.sum("x").alias("toxic")))


def prefix_steps(cells: DataFrame, letters: str) -> DataFrame:
    """Every ordered choice of filters as a row per part: prefix, step (its length), letter (its last), and what
    that last filter does after the others: kept, removed, redundant, unique_fails, good_lost, toxic_lost."""
    spark = cells.sparkSession
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    unused = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(letters))

    def total(column: str, where: str) -> str:
        return f"aggregate(c.cells, 0L, (sum, x) -> sum + if({where}, x.{column}, 0L))"

    here = "x.mask & p.applied = 0 AND x.mask & u.bit <> 0"
    return spark.sql(f"""
        WITH RECURSIVE prefixes (part, prefix, applied, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
          SELECT part, '', 0, 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
          UNION ALL
          SELECT p.part, concat(p.prefix, u.letter), p.applied | u.bit, p.step + 1, u.letter,
                 {total("n", "x.mask & (p.applied | u.bit) = 0")}, {total("n", here)},
                 {total("n", "x.mask & p.applied <> 0 AND x.mask & u.bit <> 0")}, {total("n", "x.mask = u.bit")},
                 {total("good", here)}, {total("toxic", here)}
          FROM prefixes p JOIN {{cells}} c ON c.part = p.part
          LATERAL VIEW inline(filter(array({unused}), f -> f.bit & p.applied = 0)) u AS letter, bit
        )
        SELECT * FROM prefixes WHERE step > 0""", cells=by_part)


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          filters=text_filters) -> DataFrame:
    """Per part, filter_order (each order of the letters) and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, and shapley (what the step's filter removes, summed over all orders).

    The number of orders is the factorial of the number of filters, so chains should be short; the recursion
    itself holds a row per part and prefix (325 for five filters).
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "filteraudit")
    letters = "".join(filters(F.lit(""))) + COPIES
    cells = keep.write(mask_cells(docs, labels, part_col, id_col, text_col, filters, keep), "cells")
    with settings(spark, spark__sql__cteRecursionRowLimit="-1"):  # rows are known: parts x prefixes
        steps = keep.write(prefix_steps(cells, letters), "steps")
    keep.drop("masks", "cells")
    orders = (steps.where(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
              .withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
              .withColumn("prefix", F.expr("substring(filter_order, 1, at)")))
    rows = orders.join(steps, ["part", "prefix"])
    shapley = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
