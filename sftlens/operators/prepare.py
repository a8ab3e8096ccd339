"""Prepare stage: raw SFT rows -> unified prompt/completion records.

Input: ``v VARIANT`` (one parsed JSON line) and ``raw_index BIGINT`` (its
physical 0-based line number).  All steps are column expressions on the
partition that holds the row -- no shuffle until the optional sample.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..functions.variant import COMPLETION_FIELDS, PROBLEM_FIELDS, field, first_truthy_text, is_none
from ..session import materialize

# The SFT prompt template.
PROMPT_PREFIX = "### Problem:\n"
PROMPT_SUFFIX = "\n\n### Solution:\n"
FETCH = 4096  # keys of a bucket that the driver sorts


def format_prompt(problem) -> Column:
    """P3."""
    p = F.col(problem) if isinstance(problem, str) else problem
    return F.concat(F.lit(PROMPT_PREFIX), p, F.lit(PROMPT_SUFFIX))


def extract_pair(df: DataFrame, v_col: str = "v") -> DataFrame:
    """P1 + P2: ``problem`` / ``completion`` = stripped text of the first truthy field."""
    v = F.col(v_col)
    return (df.withColumn("problem", py_strip(first_truthy_text(v, PROBLEM_FIELDS)))
              .withColumn("completion", py_strip(first_truthy_text(v, COMPLETION_FIELDS))))


def unify_records(df: DataFrame, dataset: str, v_col: str = "v", index_col: str = "raw_index",
                  keep_skipped: bool = False) -> DataFrame:
    """Unified ``id, source, prompt, completion, metadata{answer, raw_index}``.

    Rows whose problem or completion is empty are dropped (P5); with
    ``keep_skipped`` they are kept and flagged by ``kept = false`` so one pass
    can also produce the counters.  ``metadata.answer`` keeps its JSON
    value as a VARIANT (``""`` when the key is missing, NULL when it is JSON null).
    """
    pairs = extract_pair(df, v_col)
    ans = field(v_col, "answer")
    answer = F.when(F.col(v_col).isNotNull() & ans.isNull(), F.lit("").cast("variant")).when(~is_none(ans), ans)
    out = pairs.select(
        F.concat(F.lit(f"{dataset}_"), F.col(index_col).cast("string")).alias("id"),
        F.lit(f"local_{dataset}").alias("source"),
        format_prompt("problem").alias("prompt"),
        F.col("completion"),
        F.struct(answer.alias("answer"), F.col(index_col).cast("bigint").alias("raw_index")).alias("metadata"),
        ((F.length("problem") > 0) & (F.length("completion") > 0)).alias("kept"),
    )
    return out if keep_skipped else out.where("kept").drop("kept")


def prepare_counters(flagged: DataFrame) -> DataFrame:
    """One row ``total, kept, skipped`` from :func:`unify_records` (keep_skipped=True)."""
    return flagged.agg(F.count(F.lit(1)).alias("total"),
                       F.count_if("kept").alias("kept"),
                       F.count_if(~F.col("kept")).alias("skipped"))


def sample_key(seed: int, id_col: str) -> Column:
    """Reproducible, partition-independent pseudo-random key of a row (hex md5)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def cut_key(keys: DataFrame, n: int, distinct_keys: bool = False) -> bytes | None:
    """The ``n``-th smallest of the 16-byte keys in column ``k`` by radix selection; None if there are no more than ``n``.

    One mergeable count by the first two bytes (at most 65,536 rows reach the driver) names the bucket that holds
    rank ``n``.  Only that bucket is looked at again: by two more bytes while it has more than ``FETCH`` keys, else
    its keys are fetched.  ValueError for a missing or repeated key; ``distinct_keys`` leaves out the
    shuffle of keys that finds repeated ones.
    """
    counts = keys.withColumn("c", F.lit(1).cast("bigint")) if distinct_keys else keys.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    prefix, rank = b"", n
    while len(prefix) < 16:
        inside = counts.where(F.substring("k", 1, len(prefix)) == F.lit(prefix)) if prefix else counts
        buckets = inside.groupBy(F.substring("k", 1, len(prefix) + 2).alias("p")).agg(F.sum("c").alias("n"), F.max("c").alias("most")).collect()
        if any(b["p"] is None or b["most"] > 1 for b in buckets):
            raise ValueError("ids must be present and distinct to draw an exact sample")
        if not prefix and rank >= sum(b["n"] for b in buckets):
            return None
        for size, prefix in sorted(((b["n"], bytes(b["p"])) for b in buckets), key=lambda x: x[1]):
            if rank <= size:
                break
            rank -= size
        if size <= FETCH:
            found = keys.where(F.substring("k", 1, len(prefix)) == F.lit(prefix)).collect()
            return sorted(bytes(r["k"]) for r in found)[rank - 1]
    return prefix


def sample_exact(df: DataFrame, n: int | None, seed: int, id_col: str, distinct_ids: bool = False, write_keys: bool = False) -> DataFrame:
    """L1: exactly ``n`` rows uniformly without replacement when ``n < count``; else all rows.

    Rows are ranked by ``md5(seed:id)``; the key at rank ``n`` is found by :func:`cut_key` (two or three jobs over the id
    column alone), and the sample is a filter on that key: no join, no ranking of rows, nothing is shuffled but the
    keys that the check for repeated ids needs.  Ids must be present and distinct, else ValueError; with
    ``distinct_ids`` the caller vouches for the latter and even that shuffle goes.  ``write_keys`` writes the keys
    first, for a ``df`` that is expensive to compute.
    """
    if n is None:
        return df
    if n <= 0:
        return df.limit(0)
    key = F.unhex(sample_key(seed, id_col))
    keys = df.select(key.alias("k"))
    cut = cut_key(materialize(keys, "sample-keys") if write_keys else keys, n, distinct_ids)
    return df if cut is None else df.where(key <= F.lit(cut))


def prepare_to_jsonl(raw: DataFrame, dataset: str, out_path: str, sample_size: int | None = None,
                     seed: int = 42, v_col: str = "v", index_col: str = "raw_index") -> dict:
    """Prepare stage end to end: unified records -> optional exact sample -> JSON lines.

    Returns ``{"total", "kept", "skipped", "written"}``.  The counters are
    observed (``df.observe``) on the pass that produces the records, so
    counting costs no extra job.
    """
    from pyspark.sql import Observation

    from ..sinks.writers import write_jsonl

    seen = Observation(f"prepare-{dataset}")
    flagged = unify_records(raw, dataset, v_col, index_col, keep_skipped=True).observe(
        seen, F.count(F.lit(1)).alias("total"), F.count_if("kept").alias("kept"))
    records = sample_exact(flagged.where("kept").drop("kept"), sample_size, seed, "id", distinct_ids=True, write_keys=True)  # ids are line numbers
    wrote = Observation(f"prepare-{dataset}-written")
    write_jsonl(records.observe(wrote, F.count(F.lit(1)).alias("written")), out_path)
    c, w = seen.get, wrote.get
    return {"total": int(c["total"]), "kept": int(c["kept"]), "skipped": int(c["total"] - c["kept"]),
            "written": int(w["written"])}
