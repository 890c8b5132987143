"""Helpers shared by the operators: tables written in the shared folder, search in a sorted list of bounds."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of the text operators: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset (tests on a local master) it is set."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        top = context.getCheckpointDir()
    return f"{top}/llm-{uuid.uuid4().hex}"


#: Rows of a few numbers that one task writes with ease.
TASK_ROWS = 200_000


def settle(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: cuts lineage, outlives executors.

    `rows`, a bound of the rows where one is known, sizes the tasks of small results.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}"
    (df if rows is None else df.coalesce(1 + rows // TASK_ROWS)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input can't clash with those made here."""
    return df.select(*[F.col(n) for n in names])


def bounds_search(bounds: list[int], value: Column) -> Column:
    """How many of the sorted `bounds` are at most `value` (0 for null): two short scans of a constant list."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    rows = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(r[0]) for r in rows])
    table = F.array(*[F.array(*[F.lit(b) for b in r]) for r in rows])
    row = F.size(F.filter(heads, lambda b: b <= value))
    within = F.size(F.filter(F.get(table, row - 1), lambda b: b <= value))
    return F.coalesce(F.when(row > 0, (row - 1) * F.lit(step) + within), F.lit(0))


def lookup(values: list, index: Column, kind: str = "long") -> Column:
    """values[index] of a constant list."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), index)


def pick_parts(spark: SparkSession, most: int = 0) -> int:
    """Shuffle partitions of the session, at least `most`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), most)
