"""Writers: flat step logs, result tables and appended ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat_log(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """One row per step in tabular form: no NULL text, the answer only on the answering step."""
    def blank(c):
        return F.coalesce(F.col(c), F.lit("")).alias(c)

    answer = F.when(F.col("tool") == "answer", F.coalesce("answer_text", F.lit("")))
    kind = F.coalesce("kind", F.lit("")).alias("error_kind")
    return steps.join(ends, "run_id").select(
        "task_id", "run_id", "idx", blank("tool"), kind, F.col("state").alias("terminal_state"),
        "tokens_in", "tokens_out", F.coalesce(answer, F.lit("")).alias("answer"))


def write_table(df: DataFrame, path: str, partition_by=(), form: str = "parquet") -> None:
    """Replace a result table."""
    writer = df.write.mode("overwrite").format(form)
    if form == "csv":
        writer = writer.option("header", True).option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def append_ratings(ratings: DataFrame, path: str) -> None:
    """Add submitted ratings to the response table, stamped with the time of arrival."""
    (ratings.withColumn("received_at", F.current_timestamp()).write.mode("append")
     .parquet(path))
