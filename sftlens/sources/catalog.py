"""SC5: the task catalog as a small dimension table, joined by broadcast."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The three evaluation tasks -- benchmark name, dataset path and
# split, the doc field names for question / answer / solution, and the prompt
# template with its placeholder field.
TASK_CATALOG = [
    ("local_math500_32k", "MATH500", "HuggingFaceH4/MATH-500", "test",
     "problem", "answer", "solution", "Problem: {problem}\nAnswer:", "problem"),
    ("local_aime24_32k", "AIME24", "Maxwell-Jia/AIME_2024", "train",
     "Problem", "Answer", "Solution", "Question: {Problem}\nAnswer:", "Problem"),
    ("local_aime25_32k", "AIME25", "math-ai/aime25", "test",
     "problem", "answer", "solution", "Question: {problem}\nAnswer:", "problem"),
]
# Generation settings shared by every task.
STOP_STRINGS = ("</s>", "<|eot_id|>")
GENERATION = {"do_sample": False, "temperature": 0.0, "max_gen_toks": 32768,
              "repeats": 1, "num_fewshot": 0, "metric": "exact_match", "aggregation": "mean"}

CATALOG_SCHEMA = ("task string, benchmark string, dataset_path string, dataset_split string, "
                  "question_field string, answer_field string, solution_field string, "
                  "template string, template_field string")


def task_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASK_CATALOG, CATALOG_SCHEMA)


def catalog_with_generation(spark: SparkSession) -> DataFrame:
    """Catalog plus the per-task generation settings (A13 checks these are shared)."""
    return task_catalog(spark).select(
        "*",
        F.array(*[F.lit(s) for s in STOP_STRINGS]).alias("until"),
        F.lit(GENERATION["do_sample"]).alias("do_sample"),
        F.lit(GENERATION["temperature"]).alias("temperature"),
        F.lit(GENERATION["max_gen_toks"]).alias("max_gen_toks"),
        F.lit(GENERATION["repeats"]).alias("repeats"),
        F.lit(GENERATION["num_fewshot"]).alias("num_fewshot"),
    )


def with_catalog(df: DataFrame, catalog: DataFrame, task_col: str = "task") -> DataFrame:
    """Left join the catalog (a handful of rows, broadcast: the planner does not know their size) and fill the defaults for an unknown task: ``benchmark =
    upper(task)``, path/split ``unknown``, lower-case field names."""
    cat = catalog.withColumnRenamed("task", "_cat_task")
    j = df.join(F.broadcast(cat), df[task_col] == F.col("_cat_task"), "left")
    t = F.col(task_col)
    return (j.withColumn("benchmark", F.coalesce("benchmark", F.upper(t)))
             .withColumn("dataset_path", F.coalesce("dataset_path", F.lit("unknown")))
             .withColumn("dataset_split", F.coalesce("dataset_split", F.lit("unknown")))
             .withColumn("question_field", F.coalesce("question_field", F.lit("problem")))
             .withColumn("answer_field", F.coalesce("answer_field", F.lit("answer")))
             .withColumn("solution_field", F.coalesce("solution_field", F.lit("solution")))
             .drop("_cat_task"))


def render_prompt(template_col: str = "template", field_col: str = "template_field",
                  question_col: str = "question"):
    """Substitute the question into the task template (``{field}`` placeholder)."""
    return F.replace(F.col(template_col), F.concat(F.lit("{"), F.col(field_col), F.lit("}")),
                     F.col(question_col))
