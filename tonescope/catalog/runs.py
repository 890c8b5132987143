"""Run-log analytics over the derived call log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tonescope.catalog.base import query
from tonescope.catalog.calls import CALLS
from tonescope.functions import text
from tonescope import schema
from tonescope.operators import runlogs
from tonescope.session import checkpoint_dir, cut_lineage
from tonescope.sources import derived

KIND = """CASE WHEN status = 'error' THEN coalesce(error_kind,
    CASE WHEN tool IS NULL THEN 'no_tool_call' ELSE 'tool_error_result' END) END"""
STATES = ["submitted", "stalled", "step_cap", "timeout", "token_budget", "error"]


def _with_replies(calls):
    return calls.withColumns({
        "reply": F.concat(F.lit("r"), (F.col("k") % 4).cast("string")),
        "tokens": F.col("tokens_in") + F.col("tokens_out")})


def steps(spark, folder):
    """The log in order. It comes from one written scan, so several readers of one such log share that."""
    calls = derived.tool_calls(spark, folder)
    return _with_replies(calls.withColumn("answer_text", F.get_json_object("args", "$.text")))


def facts(spark, folder):
    """The log in no order, for queries that only count."""
    return _with_replies(derived.call_facts(spark, folder))


@query("runs_error_kinds", "L-7 D-17", CALLS + f"""
    , e AS (SELECT run_id, {KIND} AS kind, count(*) AS n FROM calls WHERE status = 'error' GROUP BY ALL)
    SELECT run_id, string_agg(kind || ':' || n, ';' ORDER BY n DESC, kind) AS error_kinds FROM e GROUP BY run_id""")
def runs_error_kinds(spark, folder):
    return runlogs.error_text(facts(spark, folder), "run_id")


def prices(spark, folder):
    """A price row for three of the four agents, derived from the agents in the log."""
    agents = derived.table(spark, folder, "events").select(
        (F.col("user_id") % 4).alias("a")).distinct().where("a < 3")
    return agents.select(F.concat(F.lit("agent"), "a").alias("agent"),
                         (F.col("a") + 1).cast("double").alias("input"),
                         ((F.col("a") + 1) / 8.0).alias("cached_input"),
                         ((F.col("a") + 1) * 4).cast("double").alias("output"))


COSTS = CALLS + """, p AS (SELECT 'agent' || a AS agent, (a + 1)::DOUBLE AS input, (a + 1) / 8e0 AS cached_input,
      ((a + 1) * 4)::DOUBLE AS output FROM (SELECT DISTINCT user_id % 4 AS a FROM events) WHERE a < 3),
    s AS (SELECT agent, run_id, sum(tokens_in)::BIGINT AS tokens_in, sum(coalesce(cached, 0))::BIGINT AS cached,
      sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost_usd), 9) AS cost_reported FROM calls GROUP BY ALL),
    c AS (SELECT s.*, ((tokens_in - cached) * input + cached * cached_input + tokens_out * output) / 1e6 AS cost_list
      FROM s LEFT JOIN p USING (agent))"""


@query("runs_costs", "L-8 L-9 I-14", COSTS + """
    SELECT *, coalesce(cost_reported, cost_list) AS cost_usd FROM c""")
def runs_costs(spark, folder):
    told = runlogs.run_costs(facts(spark, folder), prices(spark, folder), "run_id")
    return told.withColumn("cost_reported", F.round("cost_reported", 9)).withColumn(
        "cost_usd", F.coalesce("cost_reported", "cost_list"))


def gold_tasks(spark, folder):
    """Gold tools and steps per task; every third template has a longer tool list."""
    tasks = derived.table(spark, folder, "events").select("user_id").distinct()
    number = F.col("user_id") % 10 + 1
    base = [F.lit("filter"), F.lit("summarise")]
    return tasks.select(
        F.concat(F.lit("T"), number.cast("string"), F.lit("-E"),
                 (F.col("user_id") % 5 + 1).cast("string")).alias("task_id"),
        F.when(number % 2 == 0, F.array(*base, F.lit("rank"))).otherwise(F.array(*base)).alias(
            "gold_tools"), F.lit(4).alias("gold_steps")).distinct()


SCORED = CALLS + """, r AS (SELECT run_id, task_id, agent, seed, count(*) AS n_steps, count(*) FILTER (status = 'error') AS n_errors,
      count(*) FILTER (coalesce(tool <> 'answer', TRUE)) AS work_steps,
      list_sort(coalesce(list(DISTINCT tool) FILTER (tool <> 'answer' AND status = 'ok'), [])) AS tools,
      count(*) FILTER (tool = 'answer' AND status = 'ok') > 0 AS done FROM calls GROUP BY ALL),
    g AS (SELECT *, CASE WHEN CAST(substr(split_part(task_id, '-', 1), 2) AS INT) % 2 = 0 THEN ['filter', 'rank', 'summarise']
      ELSE ['filter', 'summarise'] END AS gold FROM r),
    scored AS (SELECT run_id, task_id, agent, seed, n_steps, n_errors, work_steps,
      array_to_string(tools, ',') AS tools, array_to_string(list_filter(gold, lambda x: NOT list_contains(tools, x)), ',') AS missing,
      CASE WHEN done THEN 1 ELSE 0 END AS task_completion,
      len(list_filter(gold, lambda x: list_contains(tools, x)))::DOUBLE / len(gold) AS tool_selection_accuracy,
      CASE WHEN work_steps = 0 THEN 0e0 ELSE least(1e0, 4e0 / work_steps) END AS path_efficiency,
      (n_steps + seed) % 6 AS insight_score FROM g)"""


def scored(spark, folder, log=None):
    log = facts(spark, folder) if log is None else log
    table = runlogs.score_runs(log, gold_tasks(spark, folder))
    return table.withColumn("insight_score", (F.col("n_steps") + F.col("seed")) % 6)


@query("runs_scored", "L-1 L-2 L-3 L-4 H-2 H-3", SCORED + " SELECT * EXCLUDE (insight_score) FROM scored")
def runs_scored(spark, folder):
    return scored(spark, folder).drop("insight_score")


STOP = CALLS + """, t AS (SELECT *, sum(tokens_in + tokens_out) OVER w AS spent, sum(CAST(round(latency_s * 1000) AS BIGINT)) OVER w AS elapsed,
      CASE WHEN tool IS NULL THEN 'r' || (k % 4) END AS reply FROM calls WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
    f AS (SELECT *, CASE WHEN idx = 0 OR lag(reply) OVER w IS DISTINCT FROM reply THEN 1 ELSE 0 END AS fresh FROM t
      WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY idx) AS island FROM f),
    z AS (SELECT run_id, min(idx) + 1 AS idx FROM i WHERE reply IS NOT NULL GROUP BY run_id, island HAVING count(*) >= 2),
    e AS (SELECT run_id, idx, 1 AS o, 'submitted' AS state FROM t WHERE tool = 'answer' AND status = 'ok'
      UNION ALL SELECT run_id, idx, 1, 'stalled' FROM z UNION ALL SELECT run_id, idx, 2, 'step_cap' FROM t WHERE idx = 11
      UNION ALL SELECT run_id, idx, 3, 'timeout' FROM t WHERE elapsed > 300000
      UNION ALL SELECT run_id, idx, 4, 'token_budget' FROM t WHERE spent > 45000),
    fired AS (SELECT run_id, idx, state, row_number() OVER (PARTITION BY run_id ORDER BY idx, o, state) AS rn FROM e),
    l AS (SELECT run_id, max(idx) AS last_idx FROM t GROUP BY run_id),
    stops AS (SELECT l.run_id, coalesce(b.idx, last_idx) AS stop_idx, coalesce(b.state, 'error') AS state,
      last_idx - coalesce(b.idx, last_idx) AS steps_after FROM l LEFT JOIN fired b ON b.run_id = l.run_id AND rn = 1)"""


def stops(spark, folder, log=None):
    log = steps(spark, folder) if log is None else log
    return runlogs.stopping_states(log, step_cap=12, token_budget=45_000,
                                   timeout_s=300, stall_limit=2)


@query("runs_stopping_audit", "L-17 F-8 F-9", STOP + " SELECT * FROM stops")
def runs_stopping_audit(spark, folder):
    return stops(spark, folder)


@query("runs_agent_roll_up", "L-10", STOP + """, """ + SCORED[len(CALLS) + 2:] + """
    SELECT agent, count(*) AS runs, """ + ", ".join(
    f"count(*) FILTER (state = '{s}') AS {s}" for s in STATES) + """,
      round(avg(CASE WHEN seed = 1 THEN 0e0 ELSE (work_steps = 4)::INT::DOUBLE END), 9) AS path_match_rate,
      round(avg(n_steps::DOUBLE), 9) AS mean_steps, round(avg(n_errors::DOUBLE), 9) AS mean_errors
    FROM scored JOIN stops USING (run_id) GROUP BY agent""")
def runs_agent_roll_up(spark, folder):
    log = steps(spark, folder)
    runs = scored(spark, folder, log).join(stops(spark, folder, log), "run_id").withColumn(
        "path_match", F.when(F.col("seed") != 1, F.col("work_steps") == 4))
    told = runlogs.agent_roll_up(runs, STATES)
    return told.select("agent", "runs", *STATES, *[F.round(c, 9).alias(c) for c in (
        "path_match_rate", "mean_steps", "mean_errors")])


@query("runs_recorded_ends", "L-17", STOP + """, ends AS (SELECT run_id, arg_max({'tool': tool, 'status': status}, idx) AS e, count(*) AS n, sum(latency_s) AS spent
      FROM t GROUP BY run_id),
    last AS (SELECT run_id, e.tool AS tool, e.status AS status, n, spent FROM ends),
    recorded AS (SELECT run_id, CASE WHEN tool = 'answer' AND status = 'ok' THEN 'submitted' WHEN n >= 12 THEN 'step_cap'
      WHEN round(spent, 6) > 300 THEN 'timeout' ELSE 'error' END AS terminal_state FROM last WHERE tool IS NOT NULL)
    SELECT run_id, state AS expected, coalesce(terminal_state, 'missing_run_end') AS recorded, stop_idx, steps_after,
      coalesce(state = terminal_state AND steps_after = 0, FALSE) AS agrees FROM stops LEFT JOIN recorded USING (run_id)""")
def runs_recorded_ends(spark, folder):
    """The rules against ends as a harness records that looks at the last step only, and loses runs without a last call."""
    log = steps(spark, folder)
    end = log.groupBy("run_id").agg(F.max_by(F.struct("tool", "status"), "idx").alias("e"), F.count("*").alias("n"),
                                    F.round(F.sum("latency_s"), 6).alias("spent"))
    state = (F.when((F.col("e.tool") == "answer") & (F.col("e.status") == "ok"), "submitted").when(F.col("n") >= 12, "step_cap")
             .when(F.col("spent") > 300, "timeout").otherwise("error"))
    recorded = end.where("e.tool IS NOT NULL").select("run_id", state.alias("terminal_state"))
    return runlogs.stopping_audit(stops(spark, folder, log), recorded)


@query("runs_agent_totals", "L-10", COSTS + f""",
    v AS (SELECT run_id, count(*) FILTER ({KIND} IN ('no_tool_call', 'unknown_tool')) AS broken FROM calls GROUP BY run_id)
    SELECT agent, sum(broken)::BIGINT AS protocol_violations, round(avg(tokens_out::DOUBLE), 6) AS mean_tokens_out,
      round(sum(cost_list), 6) AS cost_list, round(sum(coalesce(cost_reported, cost_list)), 6) AS cost_usd
    FROM c JOIN v USING (run_id) GROUP BY agent""")
def runs_agent_totals(spark, folder):
    log = facts(spark, folder)
    broken = runlogs.with_error_kind(log).groupBy("run_id").agg(
        F.count_if(F.col("kind").isin("no_tool_call", "unknown_tool")).alias("n_protocol_violations"))
    told = runlogs.agent_totals(runlogs.run_costs(log, prices(spark, folder), "run_id").join(broken, "run_id"))
    return told.withColumns({c: F.round(c, 6) for c in ("mean_tokens_out", "cost_list", "cost_usd")})


# one row per (agent, seed, task): the week's number modulo 3 plays the seed
SEEDED = SCORED + """, rows AS (SELECT agent, split_part(task_id, '-', 1) AS task_id,
      CAST(date_diff('day', DATE '2024-01-01', CAST(substr(run_id, strpos(run_id, '-') + 1) AS DATE)) // 7 % 3 AS BIGINT) AS seed,
      insight_score, tool_selection_accuracy, path_efficiency FROM scored),
    seeded AS (SELECT agent, seed, task_id, max(insight_score) AS insight_score,
      max(tool_selection_accuracy) AS tool_selection_accuracy, max(path_efficiency) AS path_efficiency FROM rows GROUP BY ALL)"""
METRICS = ["insight_score", "tool_selection_accuracy", "path_efficiency"]


def seeded(spark, folder):
    week = F.to_date(F.expr("substr(run_id, instr(run_id, '-') + 1)"))
    turn = F.expr("1") * F.floor(F.date_diff(week, F.lit("2024-01-01").cast("date")) / 7) % 3
    rows = scored(spark, folder).select(
        "agent", text.template_of().alias("task_id"), turn.cast("bigint").alias("seed"), *METRICS)
    return cut_lineage(rows.groupBy("agent", "seed", "task_id").agg(
        *[F.max(m).alias(m) for m in METRICS]))


PASSED = SEEDED + """, k AS (SELECT agent, count(DISTINCT seed) AS k FROM seeded GROUP BY agent),
    passed AS (SELECT agent, task_id, count(DISTINCT seed) = max(k) AND min(insight_score) >= 3 AS passed,
      min(insight_score) >= 3 AS open_passed FROM seeded JOIN k USING (agent) GROUP BY agent, task_id)"""


@query("runs_leaderboard", "L-11 D-16 D-19 A-12", PASSED + """,
    m AS (SELECT agent, seed, """ + ", ".join(f"avg({m}) AS {m}" for m in METRICS) + """ FROM seeded GROUP BY ALL),
    t AS (SELECT agent, count(*) AS k_seeds, """ + ", ".join(
    f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in METRICS) + """ FROM m GROUP BY agent)
    SELECT t.*, n_tasks, pass_k FROM t JOIN (SELECT agent, count(*) AS n_tasks, round(avg(passed::INT::DOUBLE), 6) AS pass_k
      FROM passed GROUP BY agent) USING (agent)""")
def runs_leaderboard(spark, folder):
    told = runlogs.leaderboard(seeded(spark, folder), METRICS, mark=3)
    plain = {"agent", "k_seeds", "n_tasks"}
    return told.select(*[c if c in plain else F.round(c, 6).alias(c) for c in told.columns])


def trace_lines(spark, folder):
    """The log as trace records: a start, the steps and an end per run, each one JSON object. The week plays the seed."""
    log = derived.tool_calls(spark, folder)
    week = F.to_date(F.expr("substr(run_id, instr(run_id, '-') + 1)"))
    turn = (F.floor(F.date_diff(week, F.lit("2024-01-01").cast("date")) / 7) % 3).cast("bigint")
    log = cut_lineage(log.withColumns({"turn": turn, "run_dir": F.concat("agent", F.lit("_s"), turn)}))
    quiet = {"ignoreNullFields": "true"}
    step = F.to_json(F.struct(F.lit("step").alias("type"), "run_id", "idx", "tool", F.try_parse_json("args").alias("args"), "handle",
                              "status", "error_kind", "tokens_in", "tokens_out", "latency_s", "cost_usd",
                              F.try_parse_json("raw_response").alias("raw_response")), quiet)
    said = F.when((F.col("tool") == "answer") & (F.col("status") == "ok"), F.get_json_object("args", "$.text"))
    runs = log.groupBy("run_dir", "run_id", "task_id", "agent", "turn").agg(
        F.max_by(said, F.when(said.isNotNull(), F.col("idx"))).alias("text"), F.round(F.sum("latency_s"), 6).alias("wall_s"))
    start = F.to_json(F.struct(F.lit("run_start").alias("type"), "run_id", "task_id", F.col("run_dir").alias("agent_id"),
                               F.col("agent").alias("model"), F.col("turn").alias("seed")), quiet)
    end = F.to_json(F.struct(F.lit("run_end").alias("type"), "run_id", F.lit("submitted").alias("terminal_state"),
                             F.struct("text").alias("final_answer"), "wall_s"), quiet)
    whole = runs.select("run_dir", "run_id", F.explode(F.array(start, end)).alias("record"))
    return log.select("run_dir", "run_id", step.alias("record")).unionByName(whole)


@query("runs_stored_leaderboard", "A-4 A-5 A-8 A-12 L-1 L-11", PASSED + """,
    m AS (SELECT agent, seed, """ + ", ".join(f"avg({m}) AS {m}" for m in METRICS) + """ FROM seeded GROUP BY ALL),
    t AS (SELECT agent, count(*) AS k_seeds, """ + ", ".join(
    f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in METRICS) + """ FROM m GROUP BY agent)
    SELECT t.*, n_tasks, pass_k FROM t JOIN (SELECT agent, count(*) AS n_tasks, round(avg(passed::INT::DOUBLE), 6) AS pass_k
      FROM passed GROUP BY agent) USING (agent)""")
def runs_stored_leaderboard(spark, folder):
    """Traces are stored, read and scored; the scores are stored by run folder, read again and ranked."""
    from tonescope.plans.scoring import score_traces
    from tonescope.sources import readers, sinks, traces
    at = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    lines = trace_lines(spark, folder)
    traces.write_store(lines, f"{at}/traces", 4)
    traces.write_store(lines.where("run_dir = 'agent0_s0'"), f"{at}/traces", 4)   # stored twice, there once
    gold = gold_tasks(spark, folder).select("task_id", F.col("gold_steps").alias("gold_num_steps"), F.to_json(F.transform(
        "gold_tools", lambda t: F.struct(t.alias("tool")))).alias("gold_tool_path_json"))
    records = traces.read_store(spark, f"{at}/traces")
    made = score_traces(records, gold).join(traces.run_starts(records).select("run_id", "run_dir"), "run_id")
    grade = (F.col("n_steps") + F.split_part("task_id", F.lit("-E"), F.lit(2)).cast("int") - 1) % 6
    sinks.write_table(made.withColumn("insight_score", grade).select("run_dir", "task_id", *schema.METRICS),
                      f"{at}/scores", ["run_dir"], "csv")
    rows = readers.read_scores(spark, f"{at}/scores", "*.csv").select(
        F.split_part("run_dir", F.lit("_s"), F.lit(1)).alias("agent"), text.template_of().alias("task_id"),
        F.split_part("run_dir", F.lit("_s"), F.lit(2)).cast("bigint").alias("seed"), *METRICS)
    told = runlogs.leaderboard(cut_lineage(rows.groupBy("agent", "seed", "task_id").agg(
        *[F.max(m).alias(m) for m in METRICS])), METRICS, mark=3)
    return told.select(*[c if c in {"agent", "k_seeds", "n_tasks"} else F.round(c, 6).alias(c) for c in told.columns])


@query("runs_one_stored_trace", "A-10", CALLS + """
    SELECT run_id, idx, tool, status FROM calls WHERE run_id = (SELECT min(run_id) FROM calls)""")
def runs_one_stored_trace(spark, folder):
    """The steps of one run, from the one slot of the store that holds it."""
    from tonescope.sources import traces
    at = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    lines = trace_lines(spark, folder)
    traces.write_store(lines, at, 4)
    first = lines.agg(F.min("run_id")).first()[0]
    return traces.read_store(spark, at, first, 4).where("type = 'step'").select("run_id", F.col("idx").cast("bigint").alias("idx"),
                                                                             "tool", "status")


@query("runs_passed_tasks", "L-11 L-14 D-16", PASSED + " SELECT agent, task_id, passed FROM passed")
def runs_passed_tasks(spark, folder):
    return runlogs.passed_tasks(seeded(spark, folder), mark=3)


TYPES = """CASE WHEN CAST(substr({c}, 2) AS INT) <= 3 THEN 'descriptive' WHEN CAST(substr({c}, 2) AS INT) <= 7
    THEN 'diagnostic' ELSE 'prescriptive' END"""


@query("runs_pass_by_type", "L-14 I-4", PASSED + f"""
    SELECT agent, {TYPES.format(c='task_id')} AS task_type, round(avg(open_passed::INT::DOUBLE), 9) AS pass_k
    FROM passed GROUP BY ALL""")
def runs_pass_by_type(spark, folder):
    passed = runlogs.passed_tasks(seeded(spark, folder), mark=3, missing="null")
    typed = passed.withColumn("task_type", text.task_type(F.col("task_id")))
    return typed.groupBy("agent", "task_type").agg(
        F.round(F.avg(F.col("passed").cast("double")), 9).alias("pass_k"))


@query("runs_breakdown", "L-13 D-15 D-18 I-3", SCORED + f"""
    , y AS (SELECT *, split_part(task_id, '-', 1) AS template, {TYPES.format(c="split_part(task_id, '-', 1)")} AS task_type FROM scored)
    SELECT agent, task_type, template, """ + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS) + """, count(*) AS n
    FROM y GROUP BY GROUPING SETS ((agent, task_type), (agent, template), (agent))""")
def runs_breakdown(spark, folder):
    typed = scored(spark, folder).withColumn("template", text.template_of())
    typed = typed.withColumn("task_type", text.task_type(F.col("template")))
    told = runlogs.breakdown(typed, METRICS)
    return told.select("agent", "task_type", "template",
                       *[F.round(m, 6).alias(m) for m in METRICS], "n")


@query("runs_all_ok", "D-16", CALLS + """
    SELECT task_id, bool_and(status = 'ok') AS all_ok FROM calls GROUP BY task_id""")
def runs_all_ok(spark, folder):
    return facts(spark, folder).groupBy("task_id").agg(
        F.every(F.col("status") == "ok").alias("all_ok"))


@query("runs_identity", "L-12", CALLS + """
    , x AS (SELECT DISTINCT agent, seed FROM calls)
    SELECT agent, seed, CASE WHEN agent = 'agent0' THEN 'no-tool-agent' WHEN agent = 'agent1' THEN 'big-model'
      WHEN agent = 'agent2' THEN 'agent2_s' || seed ELSE 'dir' || seed END AS name FROM x""")
def runs_identity(spark, folder):
    a = F.col("agent")
    runs = facts(spark, folder).select("agent", "seed").distinct()
    labelled = runs.withColumns({
        "agent_id": F.when(a == "agent0", F.concat(F.lit("no-tool-x_s"), "seed"))
        .when(a != "agent3", F.concat(a, F.lit("_s"), "seed")),
        "model": F.when(a.isin("agent0", "agent1"), "big-model"),
        "run_dir": F.concat(F.lit("dir"), "seed")})
    return labelled.select("agent", "seed", runlogs.agent_name().alias("name"))


@query("runs_report", "L-16", CALLS + """
    SELECT agent, count(*) AS total_steps, count(*) FILTER (status = 'error') AS error_steps,
      (count(*) FILTER (status = 'error'))::DOUBLE / count(*) AS error_share, count(*) FILTER (tool IS NULL) AS no_call_steps,
      (count(*) FILTER (tool IS NULL))::DOUBLE / count(*) AS no_call_share
    FROM calls WHERE coalesce(tool <> 'answer', TRUE) GROUP BY agent""")
def runs_report(spark, folder):
    return runlogs.run_report(facts(spark, folder), "agent")


@query("runs_violations", "L-16 L-7", CALLS + f"""
    , e AS (SELECT agent, {KIND} AS kind FROM calls WHERE status = 'error')
    SELECT agent, kind, count(*) AS steps, CASE WHEN kind IN ('no_tool_call', 'unknown_tool') THEN 'yes' ELSE 'no' END
      AS protocol_violation FROM e GROUP BY agent, kind""")
def runs_violations(spark, folder):
    return runlogs.violation_table(facts(spark, folder), "agent")


@query("runs_tasks_by_state", "L-16 D-17", STOP + """
    SELECT state, string_agg(DISTINCT task_id, ',' ORDER BY task_id) AS tasks, count(DISTINCT task_id) AS n_tasks
    FROM stops JOIN (SELECT DISTINCT run_id, task_id FROM calls) USING (run_id) GROUP BY state""")
def runs_tasks_by_state(spark, folder):
    log = steps(spark, folder)
    tasks = log.select("run_id", "task_id").distinct()
    # task ids are a small vocabulary: the set per state is bounded by it
    return stops(spark, folder, log).join(tasks, "run_id").groupBy("state").agg(
        F.array_join(F.array_sort(F.collect_set("task_id")), ",").alias("tasks"),
        F.count_distinct("task_id").alias("n_tasks"))


@query("runs_tool_sets", "L-22", SCORED + """
    SELECT split_part(task_id, '-', 1) AS template, agent, tools, count(*) AS runs FROM scored GROUP BY ALL""")
def runs_tool_sets(spark, folder):
    runs = scored(spark, folder).withColumn("template", text.template_of())
    return runlogs.tool_sets(runs, "template", "agent")


@query("runs_low_recall", "L-23 H-3", SCORED + """
    SELECT task_id, agent, tools, missing, count(*) AS runs, count(*) FILTER (insight_score >= 4) AS good
    FROM scored WHERE tool_selection_accuracy < 1 GROUP BY ALL""")
def runs_low_recall(spark, folder):
    return runlogs.low_recall(scored(spark, folder), mark=4)


@query("runs_points_and_centroids", "L-25 C-4", SCORED + """
    , p AS (SELECT agent, task_id, avg(tool_selection_accuracy) AS x, avg(insight_score) AS y FROM scored GROUP BY ALL),
    c AS (SELECT agent, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY agent)
    SELECT agent, task_id, round(x, 6) AS x, round(y, 6) AS y, round(cx, 6) AS cx, round(cy, 6) AS cy
    FROM p JOIN c USING (agent)""")
def runs_points_and_centroids(spark, folder):
    points = scored(spark, folder).groupBy("agent", "task_id").agg(
        F.avg("tool_selection_accuracy").alias("x"), F.avg("insight_score").alias("y"))
    centres = points.groupBy("agent").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    told = points.join(centres, "agent", "left")
    return told.select("agent", "task_id", *[F.round(c, 6).alias(c) for c in "x y cx cy".split()])


@query("runs_score_grid", "D-24 C-7", SCORED + """
    SELECT agent, s.s AS insight_score, count(x.run_id) AS runs
    FROM (SELECT DISTINCT agent FROM scored) a CROSS JOIN (SELECT unnest(range(0, 6)) AS s) s
    LEFT JOIN scored x USING (agent) WHERE FALSE GROUP BY ALL""".replace(
        "LEFT JOIN scored x USING (agent) WHERE FALSE", "LEFT JOIN scored x ON x.agent = a.agent AND x.insight_score = s.s")
    .replace("SELECT agent, s.s", "SELECT a.agent, s.s"))
def runs_score_grid(spark, folder):
    runs = scored(spark, folder)
    grid = runs.select("agent").distinct().withColumn(
        "insight_score", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))))
    counted = runs.groupBy("agent", "insight_score").agg(F.count("*").alias("runs"))
    return grid.join(counted, ["agent", "insight_score"], "left").na.fill(0, ["runs"])


FIRST = CALLS + """, q AS (SELECT *, CASE WHEN seed = 4 THEN NULL WHEN seed % 2 = 0 THEN 'rank' ELSE 'filter' END AS expected,
      CASE WHEN seed = 4 THEN 'out_of_scope' WHEN seed % 2 = 0 THEN 'ranking' ELSE 'lookup' END AS question_type FROM calls),
    raw AS (SELECT run_id, idx, tool, CASE tool WHEN 'filter' THEN (k % 2) || '|' || (k % 25)
        WHEN 'summarise' THEN coalesce(sel, 999) || '|' || (k % 10 = 0) || '|' || (k % 3 = 0)
        WHEN 'rank' THEN coalesce(tab, 999) || '|' || (k % 2) || '|' || (k % 7 = 0) WHEN 'answer' THEN k::VARCHAR ELSE '' END AS a
      FROM calls WHERE tool IS NOT NULL),
    lo AS (SELECT run_id, count(*) - count(DISTINCT tool || '~' || a) AS loops FROM raw GROUP BY run_id),
    m AS (SELECT run_id, question_type, expected, count(tool) AS calls, coalesce(bool_or(tool = expected), FALSE) AS hit,
      round(sum(latency_s), 6) AS latency_s FROM q GROUP BY run_id, question_type, expected),
    first AS (SELECT m.run_id, question_type, calls - coalesce(loops, 0) AS tool_calls, coalesce(loops, 0) AS loops,
      CASE WHEN expected IS NOT NULL THEN hit ELSE calls - coalesce(loops, 0) = 0 END AS skill_correct,
      CASE WHEN expected IS NULL THEN calls - coalesce(loops, 0) = 0 ELSE calls - coalesce(loops, 0) = 1 END AS path_efficient,
      FALSE AS answer_has_markup, latency_s FROM m LEFT JOIN lo USING (run_id))"""


def first_generation(spark, folder):
    asked = steps(spark, folder).withColumns({
        "expected_tool": F.expr("CASE WHEN seed = 4 THEN NULL WHEN seed % 2 = 0 THEN 'rank' "
                                "ELSE 'filter' END"),
        "question_type": F.expr("CASE WHEN seed = 4 THEN 'out_of_scope' WHEN seed % 2 = 0 "
                                "THEN 'ranking' ELSE 'lookup' END")})
    return runlogs.first_generation(asked)


@query("runs_first_generation", "L-20 I-6", FIRST + " SELECT * FROM first")
def runs_first_generation(spark, folder):
    return first_generation(spark, folder)


@query("runs_tools_in_order", "L-20", FIRST[:FIRST.index("lo AS (")] + """
    n AS (SELECT run_id, idx, tool, row_number() OVER (PARTITION BY run_id, tool, a ORDER BY idx) AS turn FROM raw)
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY idx) AS position, tool FROM n WHERE turn = 1""")
def runs_tools_in_order(spark, folder):
    return runlogs.tools_in_order(steps(spark, folder))


@query("runs_states_of_tasks", "L-16", STOP + """
    SELECT state, task_id, count(*) AS runs FROM stops JOIN (SELECT DISTINCT run_id, task_id FROM calls) USING (run_id)
    GROUP BY state, task_id""")
def runs_states_of_tasks(spark, folder):
    """One row per state and task, however many tasks a state has."""
    log = steps(spark, folder)
    return stops(spark, folder, log).join(log.select("run_id", "task_id").distinct(), "run_id").groupBy("state", "task_id").agg(
        F.count("*").alias("runs"))


@query("runs_headline", "L-21", FIRST + """
    SELECT question_type, count(*) AS questions, round(avg(skill_correct::INT::DOUBLE), 9) AS skill_correct,
      round(avg(path_efficient::INT::DOUBLE), 9) AS path_efficient, 0e0 AS answer_has_markup,
      round(avg(tool_calls::DOUBLE), 9) AS tool_calls, sum(loops)::BIGINT AS loops
    FROM first GROUP BY ROLLUP (question_type)""")
def runs_headline(spark, folder):
    told = runlogs.headline(first_generation(spark, folder))
    return told.select("question_type", "questions", *[F.round(c, 9).alias(c) for c in (
        "skill_correct", "path_efficient", "answer_has_markup", "tool_calls")], "loops")


@query("runs_usage_ledger", "L-24", CALLS + """
    , s AS (SELECT agent, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out
      FROM calls GROUP BY agent)
    SELECT *, (tokens_in * 0.3e0 + tokens_out * 2.5e0) / 1e6 AS cost_usd FROM s""")
def runs_usage_ledger(spark, folder):
    return runlogs.usage_ledger(facts(spark, folder), "agent", 0.30, 2.50)


@query("runs_gold_leaks", "L-26", """
    SELECT DISTINCT 'task' || item_id AS task_id, 'task' || doc_id AS public_task, item_id = doc_id AS own
    FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def runs_gold_leaks(spark, folder):
    """Every benchmark passage as a gold text, every document as the public text of a task."""
    name = lambda c: F.concat(F.lit("task"), c).alias("task_id")
    public = derived.table(spark, folder, "documents").select(name("doc_id"), F.col("text").alias("public_text"))
    gold = derived.table(spark, folder, "benchmark").select(name("item_id"), F.col("text").alias("gold_text"))
    return runlogs.leaks(public, gold)


@query("runs_gold_label_leaks", "L-26", """
    WITH g AS (SELECT 'b' || p_brand AS task_id, p_brand AS gold_text FROM part
      UNION SELECT 'w' || item_id, split_part(text, ' ', 1) FROM benchmark
      UNION SELECT 'x' || item_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) FROM benchmark)
    SELECT DISTINCT task_id, 'task' || doc_id AS public_task, FALSE AS own FROM g JOIN documents ON contains(text, gold_text)
    WHERE gold_text <> ''""")
def runs_gold_label_leaks(spark, folder):
    """Short gold texts: topic names and the first words of each benchmark passage, in every document."""
    first = lambda n: F.array_join(F.slice(F.split("text", " "), 1, n), " ")
    items = derived.table(spark, folder, "benchmark")
    gold = derived.table(spark, folder, "part").select(
        F.concat(F.lit("b"), "p_brand").alias("task_id"), F.col("p_brand").alias("gold_text")).unionByName(
        items.select(F.concat(F.lit("w"), "item_id").alias("task_id"), first(1).alias("gold_text"))).unionByName(
        items.select(F.concat(F.lit("x"), "item_id").alias("task_id"), first(2).alias("gold_text")))
    public = derived.table(spark, folder, "documents").select(
        F.concat(F.lit("task"), "doc_id").alias("task_id"), F.col("text").alias("public_text"))
    return runlogs.leaks(public, gold)


@query("runs_event_streams", "A-9", CALLS + """
    SELECT run_id AS session_id, count(*) FILTER (tool IN ('filter', 'summarise', 'rank')) AS num_tool_calls,
      CASE WHEN count(*) FILTER (tool = 'answer') > 0 THEN 'answer ' || arg_max(k, idx) FILTER (tool = 'answer') END AS final_answer,
      CASE WHEN count(*) FILTER (tool = 'answer') > 0 THEN arg_max(idx, idx) FILTER (tool = 'answer') END AS num_turns,
      CASE WHEN count(*) FILTER (tool = 'answer') > 0 THEN arg_max(k, idx) FILTER (tool = 'answer') / 100e0 END AS cost_usd,
      CASE WHEN count(*) FILTER (tool = 'answer') = 0 THEN 'no result event' END AS error
    FROM calls GROUP BY run_id""")
def runs_event_streams(spark, folder):
    log = steps(spark, folder)
    used = F.struct(F.lit("tool_use").alias("type"), F.col("tool").alias("name"))
    said = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("name"))
    content = F.when(F.col("tool").isin("filter", "summarise", "rank"), F.array(said, used)
                     ).otherwise(F.array(said))
    events = log.select(
        F.col("run_id").alias("session_id"), F.col("idx").alias("seq"),
        F.when(F.col("tool") == "answer", "result").otherwise("assistant").alias("type"),
        F.struct(content.alias("content")).alias("message"), F.col("answer_text").alias("result"),
        F.col("idx").alias("num_turns"), (F.col("k") / 100.0).alias("total_cost_usd"))
    return runlogs.event_streams(events)


@query("runs_flat_log", "A-11 C-4", STOP + f"""
    SELECT task_id, run_id, idx, coalesce(tool, '') AS tool, coalesce({KIND}, '') AS error_kind, state AS terminal_state,
      tokens_in, tokens_out, CASE WHEN tool = 'answer' THEN 'answer ' || k ELSE '' END AS answer
    FROM calls JOIN stops USING (run_id)""")
def runs_flat_log(spark, folder):
    from tonescope.sources.sinks import flat_log
    log = steps(spark, folder)
    return flat_log(runlogs.with_error_kind(log), stops(spark, folder, log))
