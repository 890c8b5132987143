"""Agent run traces: JSON lines with three record kinds, many files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonescope import schema
from tonescope.operators.runlogs import agent_name


def read_traces(spark: SparkSession, folder: str) -> DataFrame:
    """All records of all trace files with `trace_file`. The schema is given, nothing is inferred."""
    return (spark.read.schema(schema.TRACE).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.jsonl").json(folder)
            .select("*", F.col("_metadata.file_path").alias("trace_file")))


#: Partitions of a trace store below each run folder; a run is in the one that its id names.
SLOTS = 64


def slot_of(run_id, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(slots)).cast("int")


def write_store(lines: DataFrame, root: str, slots: int = SLOTS) -> None:
    """Store trace records (run_dir, run_id, record: one JSON object) by run folder and slot, as JSON lines.

    Only the partitions that `lines` has rows for are replaced, as a whole: storing the same runs again changes nothing, and
    a run folder can be stored anew without touching the others.
    """
    placed = lines.withColumn("slot", slot_of("run_id", slots)).select("run_dir", "slot", "record")
    (placed.repartition("run_dir", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_dir", "slot").text(root))


def read_store(spark: SparkSession, root: str, run_id: str | None = None, slots: int = SLOTS) -> DataFrame:
    """All records of a store, or those of one run: then only its slot is listed and read."""
    shape = T.StructType([*schema.TRACE.fields, T.StructField("run_dir", T.StringType()),
                          T.StructField("slot", T.IntegerType())])
    records = spark.read.schema(shape).json(root).withColumn("trace_file", F.col("_metadata.file_path"))
    if run_id is None:
        return records
    return records.where((F.col("slot") == spark.range(1).select(slot_of(F.lit(run_id), slots)).first()[0])
                         & (F.col("run_id") == run_id))


def read_trace(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """Every record of one run; steps carry no run id, so they follow their file's start record."""
    records = read_traces(spark, folder)
    files = records.where((F.col("type") == "run_start") & (F.col("run_id") == run_id)).select(
        "trace_file").distinct()
    return records.join(files, "trace_file", "left_semi")


def run_starts(records: DataFrame) -> DataFrame:
    """One row per run: who ran it, with which seed, and its list prices."""
    def price(name):
        return F.try_variant_get("manifest", f"$.list_prices_usd_per_1m.{name}", "double")

    starts = records.where("type = 'run_start'")
    if "run_dir" not in records.columns:
        starts = starts.withColumn("run_dir", F.element_at(F.split("trace_file", "/"), -2))
    return starts.select("trace_file", "run_id", "task_id", "agent_id", "model", "seed", "run_dir",
                         agent_name().alias("agent"), price("input").alias("input"),
                         price("cached_input").alias("cached_input"),
                         price("output").alias("output"))


def run_steps(records: DataFrame) -> DataFrame:
    """Steps with their run's identity; nested fields as canonical JSON text."""
    # In a store every record names its run; in a trace file only the first one does.
    by = "run_id" if "slot" in records.columns else "trace_file"
    keys = run_starts(records).select(*{by, "run_id"}, "task_id", "agent", "seed")
    steps = records.where("type = 'step'").select(
        by, F.col("idx").cast("bigint").alias("idx"), "tool",
        F.to_json("args").alias("args"), "handle",
        F.to_json("canonical_signature").alias("signature"), "status", "protocol_violation",
        "error_kind", "tokens_in", "tokens_out", "latency_s", "cost_usd",
        F.to_json("raw_response").alias("raw_response"),
        F.try_variant_get("args", "$.text", "string").alias("answer_text"))
    return steps.join(keys, by).drop("trace_file")


def run_ends(records: DataFrame) -> DataFrame:
    return records.where("type = 'run_end'").select(
        "run_id", "terminal_state", "error", F.col("final_answer.text").alias("answer"),
        F.col("final_answer.abstain").alias("abstained"), "n_tool_calls", "tokens_in_total",
        "tokens_out_total", "wall_s")


def gold_steps(gold: DataFrame) -> DataFrame:
    """(task_id, position, tool, signature): the gold path of each task, one row per step."""
    calls = F.try_parse_json("gold_tool_path_json").cast("array<variant>")
    return gold.select("task_id", F.posexplode(calls).alias("p", "call")).select(
        "task_id", (F.col("p") + 1).cast("bigint").alias("position"),
        F.try_variant_get("call", "$.tool", "string").alias("tool"),
        F.to_json("call").alias("signature"))


def read_event_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Another runner's event stream: one line per event, in file order by `seq`."""
    fields = ("type string, session_id string, seq long, "
              "message struct<content: array<struct<type: string, name: string>>>, "
              "result string, num_turns long, total_cost_usd double")
    return spark.read.schema(fields).json(folder).where("type IS NOT NULL")
