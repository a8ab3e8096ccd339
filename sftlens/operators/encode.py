"""Encode stage: prompt/completion -> input_ids / attention_mask / labels.

Per-row work is pure column expressions; the only shuffles are the counters'
single aggregate and, for batching, the distributed dense index per shard.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokenize import CodePointTokenizer
from .indexing import dense_index

IGNORE_INDEX = -100
DEFAULT_MAX_SEQ_LENGTH = 4096


def append_eos(completion, eos_token: str | None):
    """Add EOS unless the completion already ends with it (never to the prompt)."""
    c = F.col(completion) if isinstance(completion, str) else completion
    if not eos_token:
        return c
    return F.when(c.endswith(F.lit(eos_token)), c).otherwise(F.concat(c, F.lit(eos_token)))


def encode_records(df: DataFrame, tokenizer=None, max_seq_length: int = DEFAULT_MAX_SEQ_LENGTH,
                   prompt_col: str = "prompt", completion_col: str = "completion",
                   keep_all: bool = False) -> DataFrame:
    """E1-E4 plus a ``status`` per row: ``kept`` / ``skipped_empty`` / ``skipped_too_long``.

    Prompt and completion are encoded separately without special tokens;
    ``labels`` masks the prompt with -100; rows longer than ``max_seq_length``
    are dropped, never truncated (equality is kept).  ``keep_all`` keeps the
    skipped rows (with their status) so the counters come from the same pass.
    """
    tok = tokenizer or CodePointTokenizer()
    p = F.coalesce(F.col(prompt_col), F.lit(""))
    c = F.coalesce(F.col(completion_col), F.lit(""))
    empty = (F.length(p) == 0) | (F.length(c) == 0)
    out = (df.withColumn("_p_ids", F.when(~empty, tok.encode(p)))
             .withColumn("_c_ids", F.when(~empty, tok.encode(append_eos(c, tok.eos_token))))
             .withColumn("input_ids", F.concat("_p_ids", "_c_ids"))
             .withColumn("labels", F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.size("_p_ids")), F.col("_c_ids")))
             .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
             .withColumn("status", F.when(empty, F.lit("skipped_empty"))
                         .when(F.size("input_ids") > max_seq_length, F.lit("skipped_too_long"))
                         .otherwise(F.lit("kept")))
             .drop("_p_ids", "_c_ids"))
    return out if keep_all else out.where(F.col("status") == "kept").drop("status")


def encode_stats(flagged: DataFrame) -> DataFrame:
    """E5: total / kept / skipped_empty / skipped_too_long (disjoint, empty tested first)."""
    s = F.col("status")
    return flagged.agg(F.count(F.lit(1)).alias("total"),
                       F.count_if(s == "kept").alias("kept"),
                       F.count_if(s == "skipped_empty").alias("skipped_empty"),
                       F.count_if(s == "skipped_too_long").alias("skipped_too_long"))


def collate_batches(encoded: DataFrame, batch_size: int, order_col: str, shard_col: str,
                    pad_id: int, label_pad_id: int = IGNORE_INDEX) -> DataFrame:
    """Consecutive rows of a shard (in ``order_col`` order) form batches of
    ``batch_size``; each row is right-padded to the longest ``input_ids`` of its
    batch -- ids with ``pad_id``, labels with -100, attention mask with 0.

    Positions come from the distributed dense index over (id column, shard, order, size)
    alone, and the longest size of a batch is taken on that narrow table; the wide arrays are
    joined to it once, on a row key.  A NULL shard is a shard of its own.  ``order_col`` must
    be distinct within a shard.
    """
    narrow = encoded.select(F.col(shard_col).alias("_shard"), F.col(order_col).alias("_order"), F.size("input_ids").alias("_size"))
    idx = dense_index(narrow, ["_order"], partition_by=["_shard"], out="_pos")
    idx = idx.withColumn("batch", F.floor(F.col("_pos") / batch_size).cast("bigint"))
    longest = idx.groupBy("_shard", "batch").agg(F.max("_size").alias("padded_len"))
    longest = longest.withColumnsRenamed({"_shard": "_lshard", "batch": "_lbatch"})
    idx = idx.join(longest, F.col("_shard").eqNullSafe(F.col("_lshard")) & (F.col("batch") == F.col("_lbatch"))) \
             .select("_shard", "_order", "batch", "padded_len")
    b = encoded.join(idx, F.col(order_col).eqNullSafe(F.col("_order")) & F.col(shard_col).eqNullSafe(F.col("_shard"))).drop("_shard", "_order")
    pad = F.col("n_pad")
    return (b.withColumn("n_pad", F.col("padded_len") - F.size("input_ids"))
             .withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad_id), pad)))
             .withColumn("labels", F.concat("labels", F.array_repeat(F.lit(label_pad_id), pad)))
             .withColumn("attention_mask", F.concat("attention_mask", F.array_repeat(F.lit(0), pad))))


def encode_to_parquet(records: DataFrame, out_path: str, tokenizer=None,
                      max_seq_length: int = DEFAULT_MAX_SEQ_LENGTH, batch_size: int | None = None,
                      n_shards: int = 1, order_col: str = "id") -> dict:
    """Encode stage end to end: records -> encoded rows (optionally padded per batch within
    ``n_shards`` shards) -> parquet.  Returns E5's ``total, kept, skipped_empty,
    skipped_too_long``.

    Without batching the counters are observed on the single writing pass.  With
    batching the encoded rows are written once (the batch numbering samples and
    re-reads its input, which would count an observation twice) and the
    counters come from that table's narrow ``status`` column.
    """
    from pyspark.sql import Observation

    from ..session import materialize

    tok = tokenizer or CodePointTokenizer()
    flagged = encode_records(records, tok, max_seq_length, keep_all=True)
    cols = ("id", "shard", "batch", "input_ids", "attention_mask", "labels")
    if batch_size:
        table = materialize(flagged, "encoded")
        stats = encode_stats(table).first().asDict()
        kept = table.where(F.col("status") == "kept").drop("status")
        kept = kept.withColumn("shard", F.pmod(F.xxhash64(order_col), F.lit(n_shards)))
        kept = collate_batches(kept, batch_size, order_col, "shard", tok.pad_or_eos)
        kept.select(*[c for c in kept.columns if c in cols]).write.parquet(out_path)
        return {k: int(v) for k, v in stats.items()}
    seen = Observation("encode")
    s = F.col("status")
    observed = flagged.observe(
        seen, F.count(F.lit(1)).alias("total"), F.count_if(s == "kept").alias("kept"),
        F.count_if(s == "skipped_empty").alias("skipped_empty"),
        F.count_if(s == "skipped_too_long").alias("skipped_too_long"))
    kept = observed.where(s == "kept").drop("status")
    kept.select(*[c for c in kept.columns if c in cols]).write.parquet(out_path)
    return {k: int(v) for k, v in seen.get.items()}
