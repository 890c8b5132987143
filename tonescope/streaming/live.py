"""The main aggregates over streams. Each function takes a (streaming or batch) DataFrame."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tonescope.functions import measures as m
from tonescope.operators.summaries import CELL_KEYS
from tonescope.schema import STALL_LIMIT, STEP_CAP, TIMEOUT_SECONDS, TOKEN_BUDGET


def live_cells(feedback: DataFrame, keys=CELL_KEYS) -> DataFrame:
    """Running counts and rates per cell; write in update mode. State is one row per cell."""
    return feedback.groupBy(*keys).agg(*m.sentiment_counts()).select("*", *m.rates())


def with_event_time(df: DataFrame, time: str) -> DataFrame:
    """Event time as an instant: a timestamp without zone is read as UTC, whatever the session."""
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        micros = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{time}`)"
        return df.withColumn(time, F.timestamp_micros(F.expr(micros)))
    return df


def windowed_rates(feedback: DataFrame, length: str, slide: str | None = None, keys=("industry",),
                   lateness: str = "1 day", time: str = "ts") -> DataFrame:
    """Negative rate per time window; labels later than `lateness` are dropped with their window."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    counted = (with_event_time(feedback, time).withWatermark(time, lateness).groupBy(window, *keys)
               .agg(*m.sentiment_counts()))
    return counted.select(F.col("window.start").alias("window_start"),
                          F.col("window.end").alias("window_end"), *keys, "total_count",
                          "neg_count", m.rate("neg_count", "total_count").alias("neg_rate"))


def ratings_feed(ratings: DataFrame, lateness: str = "2 days", time: str = "submitted_at"):
    """Ratings with repeated submissions of one (rater, unit) dropped while they can still arrive."""
    return (with_event_time(ratings, time).withWatermark(time, lateness)
            .dropDuplicatesWithinWatermark(["rater", "unit"]))


def rater_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("rater").agg(F.count("*").alias("n"))


STATUS = "run_id string, steps long, errors long, tokens long, streak long, state string"
ENDS = ("submitted", "stalled", "step_cap", "timeout", "token_budget")
_RUN = ["steps", "errors", "tokens", "elapsed_ms", "streak", "reply", "state", "last_ms", "due_ms", "waiting"]
_STEP = "idx:long,tool:string,status:string,reply:string,tokens:long,latency_s:double,ms:long"
_KEPT = ("timer_ms long, runs array<struct<run_id:string,steps:long,errors:long,tokens:long,elapsed_ms:long,streak:long,"
         f"reply:string,state:string,last_ms:long,due_ms:long,waiting:array<struct<{_STEP}>>>>")


class RunStatus(StatefulProcessor):
    """Follows the runs of one bucket: their steps in order, an end by a rule or by silence, and the expiry of what is kept.

    Every access to the state store is a message, so the runs of a bucket share a value state, read and written once a batch.
    For each run it holds the run as far as its steps are complete, and the steps that came before their predecessors: at most
    `step_cap`, since no run gets past that. A run is due at its last step + `silence_ms` while it is open and at its end +
    `keep_ms` afterwards, when it is dropped; the bucket's timer stands at the first of them.
    """

    def __init__(self, step_cap: int, token_budget: int, stall_limit: int, timeout_s: float, silence_ms: int | None,
                 keep_ms: int | None) -> None:
        self.rules = step_cap, token_budget, stall_limit, int(timeout_s * 1000)
        self.silence_ms, self.keep_ms = silence_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", _KEPT)

    def _load(self) -> tuple[int | None, dict[str, dict]]:
        timer_ms, runs = self.bucket.get() or (None, [])
        return timer_ms, {run_id: dict(zip(_RUN, [*kept, [tuple(step) for step in waiting]]))
                          for run_id, *kept, waiting in runs}

    def _save(self, timer_ms: int | None, runs: dict[str, dict]) -> None:
        first = min((run["due_ms"] for run in runs.values() if run["due_ms"] is not None), default=None)
        if first != timer_ms:
            if timer_ms is not None:
                self.handle.deleteTimer(timer_ms)
            if first is not None:
                self.handle.registerTimer(first)
        if runs:
            self.bucket.update((first, [(run_id, *run.values()) for run_id, run in runs.items()]))
        else:
            self.bucket.clear()

    def _step(self, run: dict, tool, status, reply, tokens, latency_s, ms) -> None:
        """One step of an open run; the rules are tried in their order."""
        step_cap, token_budget, stall_limit, timeout_ms = self.rules
        if None not in (self.silence_ms, run["last_ms"], ms) and ms - run["last_ms"] > self.silence_ms:
            run["state"] = "timeout"  # ended before this step
            return
        run["steps"] += 1
        run["errors"] += int(status == "error")
        run["tokens"] += tokens or 0
        run["elapsed_ms"] += 0 if latency_s is None else math.floor(latency_s * 1000 + 0.5)
        silent = tool is None
        run["streak"] = run["streak"] + 1 if silent and run["streak"] and reply == run["reply"] else int(silent)
        run["reply"] = reply if silent else None
        run["last_ms"] = run["last_ms"] if ms is None else ms
        if tool == "answer" and status == "ok":
            run["state"] = "submitted"
        elif run["streak"] >= stall_limit:
            run["state"] = "stalled"
        elif run["steps"] >= step_cap:
            run["state"] = "step_cap"
        elif run["elapsed_ms"] > timeout_ms:
            run["state"] = "timeout"
        elif run["tokens"] > token_budget:
            run["state"] = "token_budget"

    def _told(self, run_id: str, run: dict) -> Row:
        return Row(run_id=run_id, steps=run["steps"], errors=run["errors"], tokens=run["tokens"], streak=run["streak"],
                   state=run["state"] or "running")

    def _due(self, run: dict, now_ms: int) -> int | None:
        if run["state"] is not None:
            return None if self.keep_ms is None else max(now_ms, run["last_ms"] or 0) + self.keep_ms
        last = now_ms if run["last_ms"] is None else run["last_ms"]
        return None if self.silence_ms is None else last + self.silence_ms + 1

    def _advance(self, run: dict, early: dict[int, tuple], now_ms: int) -> bool:
        """The run as far as its steps are complete; whether it moved."""
        waiting = {idx: step for idx, *step in run["waiting"]}
        before = run["steps"], run["state"]
        while run["state"] is None:
            step = early.pop(run["steps"], None) or waiting.pop(run["steps"], None)
            if step is None:
                break
            self._step(run, *step)
        waiting.update(early)
        # a repeated step counts once
        run["waiting"] = [(idx, *step) for idx, step in waiting.items()
                          if run["state"] is None and run["steps"] < idx < self.rules[0]]
        # Before the first step those that wait stand for it: a run whose first step never comes ends too.
        run["due_ms"] = self._due(run, max([now_ms, *(step[-1] for step in early.values() if step[-1] is not None)]))
        return before != (run["steps"], run["state"])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer_ms, runs = self._load()
        came: dict[str, dict[int, tuple]] = {}
        for row in rows:
            run_id, idx, *step = json.loads(row[-1]).values()
            if run_id not in runs:
                runs[run_id] = dict(zip(_RUN, (0, 0, 0, 0, 0, None, None, None, None, [])))
            if runs[run_id]["state"] is None:  # the end of a run stands
                came.setdefault(run_id, {})[idx] = step
        now_ms = timerValues.getCurrentWatermarkInMs()
        told = [self._told(run_id, runs[run_id]) for run_id, early in came.items()
                if self._advance(runs[run_id], early, now_ms)]
        if came:
            self._save(timer_ms, runs)
        yield from told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, runs = self._load()
        now_ms, fired_ms = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        told = []
        for run_id, run in list(runs.items()):
            if run["due_ms"] is None or run["due_ms"] > max(fired_ms, now_ms - 1):
                continue
            if run["state"] is not None:
                del runs[run_id]
                continue
            run["state"], run["waiting"] = "timeout", []
            run["due_ms"] = self._due(run, now_ms)
            told.append(self._told(run_id, run))
        self._save(None, runs)  # the timer has just gone off
        yield from told

    def close(self) -> None:
        pass


def run_status(steps: DataFrame, step_cap: int = STEP_CAP, token_budget: int = TOKEN_BUDGET,
               stall_limit: int = STALL_LIMIT, timeout_s: float = TIMEOUT_SECONDS, silence_s: int | None = None,
               keep_s: int | None = None, lateness: str = "1 day", buckets: int = 16_384) -> DataFrame:
    """Live status of every run: steps, errors, tokens, stall streak, and running or the state in which it ended.

    Steps may come in any order, in any batches, and more than once; a run advances as far as its steps are complete.
    A run ends by the first rule that fires. With `silence_s` it also times out where that much event time passes
    after a step without another one, be it that the next step is that much later or that the watermark is. With
    `keep_s` the state of an ended run is dropped that much event time later; steps that come after that start a run anew.
    Steps older than the watermark are dropped. Runs share state rows by a hash of their id, `buckets` in all; their number is
    fixed for the life of a checkpoint and wants to be larger where very many runs are kept. Needs run_id, idx, tool, status, reply, tokens, latency_s and ts.
    """
    with_state_store(steps.sparkSession)
    slim = with_event_time(steps.select("run_id", "idx", "tool", "status", "reply", "tokens", "latency_s", "ts"), "ts")
    ms = lambda s: None if s is None else 1000 * s
    # A step travels as one text: every cell of a row costs in Python.
    step = F.struct("run_id", "idx", "tool", "status", "reply", "tokens",
                    F.nanvl("latency_s", F.lit(None)).alias("latency_s"), F.unix_millis("ts").alias("ms"))
    timed = slim.withWatermark("ts", lateness).select(
        F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket"), "ts",
        F.to_json(step, {"ignoreNullFields": "false"}).alias("step"))
    return timed.groupBy("bucket").transformWithState(
        RunStatus(step_cap, token_budget, stall_limit, timeout_s, ms(silence_s), ms(keep_s)), STATUS, "update", "eventTime")


def with_state_store(spark: SparkSession) -> None:
    """The state store that timers and several states per key need, unless the session names one of its own."""
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                       "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def route_late(stream: DataFrame, path: str, checkpoint: str, time: str, lateness: str, window: str | None = None):
    """Write every row of a stream to the table at `path`, with `late` telling whether it came too late.

    A row is late if its time - or, with `window`, the end of its tumbling window - lies before the watermark: the largest
    time of all earlier batches less `lateness`. The table is partitioned by batch and late, so the side table of late rows is
    a partition of it, counted without reading the rest. A repeated batch replaces its own folders.
    """
    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not number:
            mark = F.lit(None).cast("timestamp")
        else:
            # One row per batch.
            tops = spark.read.schema("top timestamp, batch int").parquet(f"{path}/seen").where(F.col("batch") < number)
            mark = F.lit(tops.agg(F.max("top")).first()[0]).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        told = with_event_time(batch, time)
        at = F.window(time, window)["end"] <= mark if window else F.col(time) < mark
        told = told.withColumn("late", F.coalesce(at, F.lit(False)))
        told.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={number}")
        written = spark.read.schema(told.schema).parquet(f"{path}/rows/batch={number}")
        written.agg(F.max(time).alias("top")).write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    return (stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def routed(spark: SparkSession, path: str) -> DataFrame:
    """The table that `route_late` writes."""
    return spark.read.parquet(f"{path}/rows").withColumn("late", F.col("late").cast("boolean"))


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Run over everything available; each micro-batch is appended under its number.

    The table sits in shared storage, so nothing passes through the driver, and a repeated batch
    replaces its own folder.
    """
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (stream.writeStream.outputMode(mode).foreachBatch(keep)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest(table: DataFrame, keys) -> DataFrame:
    """The last written row of every key of a batch table."""
    rest = [c for c in table.columns if c not in {*keys, "batch"}]
    last = F.max_by(F.struct(*rest), "batch").alias("_r")
    return table.groupBy(*keys).agg(last).select(*keys, "_r.*")
