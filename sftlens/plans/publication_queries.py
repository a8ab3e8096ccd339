"""SK2 + SC4 by pointer: two publications, a third that is refused, and what readers then see."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import validate_export_file
from ..session import materialize, scratch_dir, scratch_scope
from ..sinks.publication import current, publish, read_current, remove_unused
from ..sinks.writers import PublishError
from .export_queries import EXPORT_COLUMNS, SQL_EXPORT_FLATTEN, TOKENIZER, exported

FIELDS = "sample_id string, task string, output_hash string, gold_answer string"


def q_publish_by_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First the records of even documents, then all; a third export with blank run ids is refused and leaves no folder.
    Rows: every record of the second version, with the number of rows of the version before and whether the third was refused."""
    rules = lambda parsed, expected: validate_export_file(parsed, expected, expected_method=TOKENIZER.name)
    root, export = scratch_dir(spark, "publication"), exported(spark, sf_dir, write=False).select(*EXPORT_COLUMNS)
    with scratch_scope(spark):
        records = materialize(export, "publication-records", "zstd")  # one export, published three times
        first = publish(records.where(F.col("doc_id").cast("bigint") % 2 == 0), root, rules, expected_version=None)
        n = current(spark, root)["rows"]
        second = publish(records, root, rules, expected_version=first)
        refused = False
        try:
            publish(records.withColumn("run_id", F.lit(" ")), root, rules, expected_version=second)
        except PublishError:
            refused = True
    kept = remove_unused(spark, root) == [] and current(spark, root)["version"] == second
    return read_current(spark, root, FIELDS).select("*", F.lit(n).cast("bigint").alias("rows_before"), F.lit(refused and kept).alias("third_refused"))


SQL_PUBLISH_BY_POINTER = ("SELECT sample_id, task, output_hash, gold_answer, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS rows_before, "
                          "true AS third_refused FROM (" + SQL_EXPORT_FLATTEN + ")")

QUERIES = {"publish_by_pointer": q_publish_by_pointer}
ORACLES = {"publish_by_pointer": SQL_PUBLISH_BY_POINTER}
