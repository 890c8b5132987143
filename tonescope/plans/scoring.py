"""Traces to scores: one plan from trace files to one row per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescope.operators import paths, runlogs
from tonescope.sources import traces


def score_traces(records: DataFrame, gold: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """Score rows of every run that was started, also of one that died before its first step.

    Terminal state, errors, protocol violations, path match, tool recall, completion and abstention (from the final
    answer), tokens, cost, latency. `gold` holds task_id, gold_num_steps and gold_tool_path_json; `valid` restricts the
    tasks.
    """
    starts, ends = traces.run_starts(records), traces.run_ends(records)
    if valid is not None:
        starts = starts.join(valid.select("task_id"), "task_id", "left_semi")
    runs = starts.select("run_id", "task_id", "agent", "seed")
    steps = traces.run_steps(records).join(runs.select("run_id"), "run_id", "left_semi")
    gold_path = traces.gold_steps(gold)
    tools = gold_path.groupBy("task_id").agg(F.collect_set("tool").alias("gold_tools")).join(
        gold.select("task_id", F.col("gold_num_steps").alias("gold_steps")), "task_id")
    scored = runlogs.score_runs(steps, tools).drop("task_id", "agent", "seed", "task_completion")
    walked = paths.work_steps(steps.where("signature IS NOT NULL"))
    matched = paths.path_matches(walked.select("run_id", "task_id", "position", "signature"),
                                 gold_path.select("task_id", "position", "signature"))
    prices = starts.select("run_id", "input", "cached_input", "output")
    costs = runlogs.run_costs(steps, prices, "run_id", on="run_id").select(
        "run_id", "tokens_in", "tokens_out", "cost_list", "cost_usd")
    errors = runlogs.error_text(steps, "run_id")
    broken = steps.groupBy("run_id").agg(
        F.count_if(F.coalesce("protocol_violation", F.lit(False))).alias("n_protocol_violations"))
    gold_of = tools.select("task_id", "gold_steps", "gold_tools")
    told = runs.join(gold_of, "task_id", "left")
    for part in (scored, ends, costs, errors, broken, matched.select("run_id", "path_match")):
        told = told.join(part, "run_id", "left")
    has_gold = F.col("gold_tools").isNotNull()
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_steps", "n_errors", "work_steps", "n_protocol_violations",
                                                 "tokens_in", "tokens_out")}
    return told.withColumns(zero | {
        "task_completion": F.when(F.length(F.trim("answer")) > 0, 1).otherwise(0),
        # a run without a single valid step matches nothing and uses no tool; a task without gold stays unknown
        "path_match": F.when(has_gold, F.coalesce("path_match", F.lit(False))),
        "tool_selection_accuracy": F.when(has_gold, F.coalesce("tool_selection_accuracy", F.lit(0.0))),
        "missing": F.coalesce("missing", F.array_join(F.array_sort("gold_tools"), ",")),
        "tools": F.coalesce("tools", F.lit("")),
        "path_efficiency": F.coalesce("path_efficiency", F.lit(0.0)),
        "state": F.coalesce("terminal_state", F.lit("missing_run_end")),
        "error_kinds": F.coalesce("error_kinds", F.lit(""))}).withColumnRenamed("wall_s", "latency_s").drop(
        "terminal_state", "gold_tools", "gold_steps")
