import datetime as dt
import uuid

from pyspark.sql import functions as F

from tonescope.operators import runlogs, summaries
from tonescope.sources import derived
from tonescope.streaming import live

FOLDER = "/root/testdata/sf0.001"


def follow(spark, rows, tmp_path, files):
    """The rows as a file stream that arrives in several micro-batches."""
    path = str(tmp_path / f"in-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    assert spark.read.parquet(path).count() == rows.count()
    return (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path))


def drain(spark, stream, tmp_path, mode="update"):
    out, state = (str(tmp_path / f"{n}-{uuid.uuid4().hex}") for n in ("out", "state"))
    live.write_batches(stream, out, state, mode).awaitTermination()
    return spark.read.parquet(out)


def test_live_cells_equal_batch(spark, tmp_path):
    rows = derived.feedback(spark, FOLDER).repartition(4)
    told = drain(spark, live.live_cells(follow(spark, rows, tmp_path, 4)), tmp_path)
    assert told.select("batch").distinct().count() == 4
    final = live.latest(told, summaries.CELL_KEYS)
    want = summaries.with_rates(summaries.cells(rows))
    assert final.count() == want.count()
    assert final.select(want.columns).exceptAll(want).count() == 0


def test_late_labels_leave_with_their_window(spark, tmp_path):
    shape = "industry string, sentiment string, ts timestamp"
    path = str(tmp_path / "late")
    days = [["2024-01-01", "2024-01-02"], ["2024-03-01"], ["2024-03-02"], ["2024-01-03", "2024-03-03"]]
    for part in days:
        spark.createDataFrame([("I", "negative", d) for d in part], "industry string, sentiment string, t string"
                              ).selectExpr("industry", "sentiment", "cast(t AS timestamp) AS ts").coalesce(1).write.mode(
            "append").parquet(path)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)
    told = drain(spark, live.windowed_rates(stream, "10 days", lateness="5 days"), tmp_path)
    final = live.latest(told, ["window_start", "industry"])
    # lateness is judged by the watermark of the batch before: the January label is dropped
    assert final.agg(F.sum("total_count")).first()[0] == 5


def arrive(spark, parts, made, tmp_path):
    """Every part is written and followed to its end before the next one; the table of all batches."""
    at = str(tmp_path / f"arrive-{uuid.uuid4().hex}")
    for rows in parts:
        rows.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        live.write_batches(made(stream), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out")


STEP = "run_id string, idx long, tool string, status string, reply string, tokens long, latency_s double, ts timestamp"


def step(run, idx, minute, tool="filter", status="ok", reply=None, tokens=10, latency=1.0):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    return (run, idx, tool, status, reply, tokens, latency, at)


def told(table, run):
    """(steps, state) of a run, batch by batch."""
    return [(r.steps, r.state) for r in table.where(F.col("run_id") == run).orderBy("batch").collect()]


def test_runs_end_by_every_rule_and_by_silence(spark, tmp_path):
    parts = [
        [step("answers", 0, 0), step("stalls", 1, 1, None, "error", "x"), step("silent", 0, 0), step("long", 0, 0),
         step("gap", 0, 0), step("open", 1, 2), step("other", 0, 0, None, "error", "x")],
        [step("stalls", 0, 0, None, "error", "x"), step("answers", 1, 2, "answer"), step("slow", 0, 3, latency=301.0),
         step("dear", 0, 3, tokens=60_000), step("other", 1, 3, None, "error", "y"), step("answers", 1, 2, "answer")]
        + [step("long", i, i) for i in range(1, 13)],
        [step("tick", 0, 500), step("gap", 1, 499)],
        [step("tick", 1, 510), step("answers", 2, 505)]]
    parts = [spark.createDataFrame(p, STEP) for p in parts]
    table = arrive(spark, parts, lambda s: live.run_status(s, 12, 45_000, 2, 300, silence_s=3600, keep_s=36_000,
                                                           lateness="10 minutes"), tmp_path)
    assert told(table, "answers") == [(1, "running"), (2, "submitted")]   # what comes after the end changes nothing
    assert told(table, "stalls") == [(2, "stalled")]                      # its first step came after the second
    assert told(table, "other")[-1] == (2, "timeout")                     # other words are no stall
    assert told(table, "slow") == [(1, "timeout")]
    assert told(table, "dear") == [(1, "token_budget")]
    assert told(table, "long")[-1] == (12, "step_cap")
    assert told(table, "silent") == [(1, "running"), (1, "timeout")]      # without another step
    assert told(table, "gap")[-1] == (1, "timeout")                       # the next step is too late to count
    assert told(table, "open") == [(0, "timeout")]                        # its first step never came
    assert told(table, "tick")[-1] == (2, "running")


def test_ended_runs_expire(spark, tmp_path):
    parts = [[step("a", 0, 0, "answer")], [step("b", 0, 300)], [step("a", 0, 310), step("b", 1, 400)]]
    parts = [spark.createDataFrame(p, STEP) for p in parts]
    for keep, last in ((60, [(1, "submitted"), (1, "running")]), (36_000, [(1, "submitted")])):
        table = arrive(spark, parts, lambda s: live.run_status(s, 12, 45_000, 2, 300, keep_s=keep, lateness="1 minute"), tmp_path)
        assert told(table, "a") == last


def test_run_status_equals_stopping_rules_in_any_order(spark, tmp_path):
    from tonescope.catalog.runs import steps
    log = steps(spark, FOLDER).select("run_id", "idx", "tool", "status", "reply", "tokens", "latency_s", "ts")
    parts = [log.where(F.pmod(F.xxhash64("run_id", "idx"), F.lit(3)) == i) for i in range(3)]
    table = arrive(spark, parts, lambda s: live.run_status(s, 12, 45_000, 2, 300, lateness="400 days"), tmp_path)
    final = live.latest(table, ["run_id"])
    want = runlogs.stopping_states(log, 12, 45_000, 300, 2)
    both = final.withColumnRenamed("state", "live").join(want, "run_id")
    assert both.count() == want.count()
    same = F.col("live") == F.when(F.col("state") == "error", "running").otherwise(F.col("state"))
    assert both.where(~same).count() == 0
    assert both.where(F.col("steps") != F.col("stop_idx") + 1).count() == 0
    assert {r.live for r in both.select("live").distinct().collect()} >= {"submitted", "timeout", "stalled"}


def test_late_rows_go_to_a_side_table(spark, tmp_path):
    at = str(tmp_path / "routed")
    days = [["2024-01-01", "2024-01-02"], ["2024-03-01", None], ["2024-02-27", "2024-02-20"], ["2024-01-03", "2024-03-03"]]
    for part in days:
        spark.createDataFrame([(i, d) for i, d in enumerate(part)], "i int, t string").selectExpr(
            "i", "cast(t AS timestamp) AS ts").write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("i int, ts timestamp").parquet(f"{at}/in")
        live.route_late(stream, at, f"{at}/progress", "ts", "5 days").awaitTermination()
    rows = live.routed(spark, at)
    assert rows.count() == 8
    assert {str(r.ts)[:10] for r in rows.where("late").collect()} == {"2024-02-20", "2024-01-03"}
    # a repeated batch replaces itself, and by window a row is late only once its window is closed
    at2 = str(tmp_path / "by-window")
    for part in days:
        spark.createDataFrame([(d,) for d in part], "t string").selectExpr("cast(t AS timestamp) AS ts").write.mode(
            "append").parquet(f"{at2}/in")
        stream = spark.readStream.schema("ts timestamp").parquet(f"{at2}/in")
        live.route_late(stream, at2, f"{at2}/progress", "ts", "5 days", "30 days").awaitTermination()
    late = live.routed(spark, at2).where("late").collect()
    assert {str(r.ts)[:10] for r in late} == {"2024-01-03"}


def test_repeated_ratings_are_dropped(spark, tmp_path):
    rows = spark.createDataFrame([("A", "u1", "2024-01-01"), ("A", "u1", "2024-01-01"), ("A", "u2", "2024-01-02"),
                                  ("B", "u1", "2024-01-02")], "rater string, unit string, t string").selectExpr(
        "rater", "unit", "cast(t AS timestamp) AS submitted_at").repartition(2)
    kept = drain(spark, live.ratings_feed(follow(spark, rows, tmp_path, 2)), tmp_path, "append")
    assert {r.rater: r.n for r in live.rater_counts(kept).collect()} == {"A": 2, "B": 1}


def test_runs_share_state_rows(spark, tmp_path, monkeypatch):
    """The state store is asked per bucket, not per run and step, and runs that share one don't touch each other."""
    parts = [[step(f"r{r}", i, r + i, latency=0.0) for r in range(40) for i in range(part, 6, 2)] for part in (1, 0)]
    parts += [[step("r7", 6, 20, "answer"), step("r8", 9, 20)], [step("tick", 0, 900)], [step("tick", 1, 910)]]
    parts = [spark.createDataFrame(p, STEP) for p in parts]
    table = arrive(spark, parts, lambda s: live.run_status(s, 12, 45_000, 2, 300, silence_s=3600, lateness="100 minutes",
                                                           buckets=3), tmp_path)
    assert told(table, "r7") == [(6, "running"), (7, "submitted")]
    assert told(table, "r8") == [(6, "running"), (6, "timeout")]
    final = live.latest(table, ["run_id"]).where("run_id NOT IN ('r7', 'tick')")
    assert final.groupBy("steps", "state").count().collect() == [(6, "timeout", 39)]
    kept = spark.read.format("statestore").option("stateVarName", "bucket").load(
        str(next(tmp_path.glob("arrive-*")) / "state"))
    assert kept.count() == 3 and kept.selectExpr("explode(value.runs)").count() == 41
