"""Readers for feedback corpora, tasks, ratings and score files."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonescope import schema


def _csv(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """All columns as text: no inference pass over the data. Quotes are doubled inside quotes."""
    rows = (spark.read.option("header", True).option("escape", '"')
            .option("multiLine", multi_line).csv(path))
    clean = {c: c.replace("﻿", "").strip() for c in rows.columns}
    return rows.withColumnsRenamed(clean)


def _typed(df: DataFrame, struct: T.StructType, required) -> DataFrame:
    """Columns of the struct in order and with its types; optional ones may be absent."""
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns {lacking}")
    return df.select(*_cast(df, struct))


def _cast(df: DataFrame, struct: T.StructType) -> list[Column]:
    return [F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)
            if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in struct.fields]


def read_feedback(spark: SparkSession, *paths: str, form: str = "csv") -> DataFrame:
    """One or several splits of labelled feedback as one table; `child_aspect` becomes `aspect`."""
    if form == "csv":
        rows = _csv(spark, list(paths))
    else:
        rows = spark.read.format(form).load(list(paths))
    if "aspect" not in rows.columns:
        rows = rows.withColumnRenamed("child_aspect", "aspect")
    needed = ["industry", "org", "aspect", "sentiment"]
    return _typed(rows, schema.FEEDBACK, needed)


def read_reviews(spark: SparkSession, *paths: str, form: str = "parquet") -> DataFrame:
    """Raw reviews with their label-code literals."""
    rows = _csv(spark, list(paths), True) if form == "csv" else spark.read.format(form).load(
        list(paths))
    return _typed(rows, schema.RAW_REVIEW, ["id", "label_codes"])


def read_public_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Public tasks. Any other column is refused: gold fields must never travel with them."""
    rows = _csv(spark, path, True)
    expected = schema.PUBLIC_TASK.fieldNames()
    if rows.columns != expected:
        raise ValueError(f"public tasks must have exactly {expected}, found {rows.columns}")
    return rows


def read_gold_tasks(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path, True)
    return _typed(rows, schema.GOLD_TASK, ["task_id", "gold_answer", "gold_num_steps"])


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Rater responses: quoted comments may span lines and the file may start with a mark."""
    return _typed(_csv(spark, path, True), schema.RATING, ["tagger_name", "task_id", "score"])


def read_judge_scores(spark: SparkSession, path: str) -> DataFrame:
    return _typed(_csv(spark, path, True), schema.JUDGE_SCORE, ["task_id", "judge_score"])


def score_files(spark: SparkSession, root: str, name: str = "scores.csv") -> DataFrame:
    """(file, names, lacking) of every score file below a folder: its columns, and the required ones that it has not."""
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root)
             .select("value", F.col("_metadata.file_path").alias("file"), F.input_file_block_start().alias("start"),
                     F.monotonically_increasing_id().alias("nth")))
    # Lines of a block have rising numbers, so the first line of a file is the lowest of its first block.
    header = F.min_by("value", "nth")
    cell = lambda c: F.btrim(F.replace(c, F.lit("\ufeff"), F.lit("")), F.lit(' "\r\t'))
    first = lines.where("start = 0").groupBy("file").agg(header.alias("header"))
    wanted = F.array(*[F.lit(w) for w in ("task_id", *schema.METRICS)])
    told = first.withColumn("names", F.transform(F.split("header", ","), cell))
    return told.select("file", "names", F.array_except(wanted, "names").alias("lacking"))


def read_scores(spark: SparkSession, root: str, name: str = "scores.csv") -> DataFrame:
    """Every score file below a folder as one table with `run_dir`; files of an older layout, lacking a required column,
    are left out (`score_files` names them).

    Files of one layout are read together by the CSV reader against their own header, so quoted commas and line breaks
    survive; layouts are few, their tables are united by column name.
    """
    files = score_files(spark, root, name).where(F.size("lacking") == 0)
    layouts = files.groupBy("names").agg(F.collect_list("file").alias("files")).collect()
    run_dir = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), "^run_dir=", "")
    none = spark.createDataFrame([], T.StructType([T.StructField("run_dir", T.StringType()), *schema.SCORES.fields]))
    for layout in sorted(layouts, key=lambda r: r.names):
        shape = T.StructType([T.StructField(c, T.StringType()) for c in layout.names])
        rows = (spark.read.schema(shape).option("header", True).option("escape", '"').option("multiLine", True)
                .csv([unquote(f) for f in layout.files]).select("*", run_dir.alias("_dir")))
        none = none.unionByName(rows.select(F.col("_dir").alias("run_dir"), *_cast(rows, schema.SCORES)))
    return none


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, sha256) of all files at or below a path, for provenance. A task reads a file block by block."""
    from tonescope.sources.digests import FileDigests
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").load(path)


def tasks_of(spark: SparkSession, valid_path: str) -> DataFrame:
    """Ids of the valid tasks, for a semi-join."""
    return _csv(spark, valid_path, True).select("task_id").distinct()
