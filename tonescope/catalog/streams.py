"""The streaming forms, run over everything available and read back as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tonescope.catalog.base import on_cells, on_feedback, query
from tonescope.catalog.runs import STOP, steps
from tonescope.session import checkpoint_dir, cut_lineage
from tonescope.sources import derived
from tonescope.streaming import live


def settled(spark, stream, keys, mode="update"):
    """Run the stream to its end into a fresh shared folder and read the final rows."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    live.write_batches(stream, f"{folder}/table", f"{folder}/progress", mode).awaitTermination()
    return live.latest(spark.read.parquet(f"{folder}/table"),
                       keys)


@query("stream_live_cells", "O-1", on_cells("""
    SELECT industry, org, parent_aspect, aspect, total_count, neg_count, neu_count, pos_count,
      neg_count::DOUBLE / total_count AS neg_rate, neu_count::DOUBLE / total_count AS neu_rate,
      pos_count::DOUBLE / total_count AS pos_rate FROM cells"""))
def stream_live_cells(spark, folder):
    lines = derived.stream(spark, folder, "lineitem")
    told = live.live_cells(derived.feedback(spark, folder, lines))
    return settled(spark, told, ["industry", "org", "parent_aspect", "aspect"])


def delivered(spark, slices, follow):
    """The slices come one after the other where the stream looks; it is run over each before the next one comes.

    `follow(stream, folder)` starts the stream. Returns the folder.
    """
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    for rows in slices:
        rows.write.mode("append").parquet(f"{folder}/in")
        follow(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder).awaitTermination()
    return folder


def shuffled(rows, key, n=3):
    """The rows in n slices by a hash of the key, whatever their order."""
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def followed(spark, slices, made, keys, mode="update"):
    """The last row of every key after all slices have come."""
    folder = delivered(spark, slices, lambda stream, at: live.write_batches(
        made(stream), f"{at}/table", f"{at}/progress", mode))
    return live.latest(spark.read.parquet(f"{folder}/table"), keys)


@query("stream_windowed_rates", "O-2", on_feedback("""
    SELECT CAST(epoch(time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS window_start, industry,
      count(*) AS total_count, count(*) FILTER (sentiment = 'negative') AS neg_count,
      (count(*) FILTER (sentiment = 'negative'))::DOUBLE / count(*) AS neg_rate FROM feedback GROUP BY ALL"""))
def stream_windowed_rates(spark, folder):
    """Labels in any order, in three batches; none is later than the watermark allows."""
    rows = cut_lineage(derived.feedback(spark, folder).select("review_id", "industry", "sentiment", "ts"))
    told = followed(spark, shuffled(rows, "review_id"), lambda stream: live.windowed_rates(
        stream, "30 days", lateness="4000 days"), ["window_start", "industry"])
    return told.select(F.unix_timestamp("window_start").alias("window_start"), "industry", "total_count", "neg_count",
                       "neg_rate")


LATE = """, f AS (SELECT *, CASE WHEN ts < TIMESTAMP '1997-01-01' THEN 0 WHEN ts < TIMESTAMP '1999-01-01' THEN 1 ELSE 2 END
      + CASE WHEN (l_orderkey * 7 + l_linenumber) % 40 = 0 THEN 1 ELSE 0 END AS turn FROM feedback),
    m AS (SELECT turn, max(max(ts)) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 60 DAY AS mark
      FROM f GROUP BY turn),
    w AS (SELECT f.*, time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS opened, mark FROM f JOIN m USING (turn)),
    v AS (SELECT *, coalesce(opened + INTERVAL 30 DAY <= mark, FALSE) AS late FROM w)"""


def labels_in_turns(spark, folder):
    """Labels in the order of time, one in forty a turn too late."""
    rows = derived.feedback(spark, folder).withColumn("turn", F.when(F.col("ts") < "1997-01-01", 0).when(
        F.col("ts") < "1999-01-01", 1).otherwise(2) + F.when(F.expr(
            "(split_part(review_id, '-', 1) * 7 + split_part(review_id, '-', 2)) % 40 = 0"), 1).otherwise(0))
    rows = cut_lineage(rows.select("industry", "sentiment", "ts", "turn"))
    return [rows.where(F.col("turn") == i) for i in range(4)]


@query("stream_late_labels", "O-2", on_feedback(LATE + """
    SELECT CAST(epoch(opened) AS BIGINT) AS window_start, industry, count(*) FILTER (NOT late) AS total_count,
      count(*) FILTER (NOT late AND sentiment = 'negative') AS neg_count, count(*) FILTER (late) AS late_count
    FROM v GROUP BY ALL"""))
def stream_late_labels(spark, folder):
    """Windows of the labels that came in time, and how many came when their window was closed."""
    at = delivered(spark, labels_in_turns(spark, folder), lambda stream, at: live.route_late(
        stream, at, f"{at}/progress", "ts", "60 days", "30 days"))
    rows = live.routed(spark, at).withColumn("window_start", F.unix_timestamp(F.window("ts", "30 days")["start"]))
    return rows.groupBy("window_start", "industry").agg(
        F.count_if(~F.col("late")).alias("total_count"),
        F.count_if(~F.col("late") & (F.col("sentiment") == "negative")).alias("neg_count"),
        F.count_if("late").alias("late_count"))


def run_log(spark, folder):
    return cut_lineage(steps(spark, folder).select("run_id", "idx", "tool", "status", "reply", "tokens", "latency_s", "ts"))


@query("stream_run_status", "O-3", STOP + """
    SELECT run_id, CASE WHEN state = 'error' THEN 'running' ELSE state END AS state, stop_idx + 1 AS steps FROM stops""")
def stream_run_status(spark, folder):
    """The steps of a log in any order, in three batches."""
    log = run_log(spark, folder)
    return followed(spark, shuffled(log, F.struct("run_id", "idx")), lambda stream: live.run_status(
        stream, 12, 45_000, 2, 300, lateness="400 days"), ["run_id"]).select("run_id", "state", "steps")


@query("stream_silent_runs", "O-3", STOP + """, g AS (SELECT run_id, idx, ts, lag(ts) OVER (PARTITION BY run_id ORDER BY idx) AS before FROM t),
    x AS (SELECT run_id, idx, state, 0 AS silent FROM fired WHERE rn = 1
      UNION ALL SELECT run_id, min(idx) - 1, 'timeout', 1 FROM g WHERE ts > before + INTERVAL 20 HOUR GROUP BY run_id
      UNION ALL SELECT run_id, max(idx), 'timeout', 1 FROM t GROUP BY run_id
        HAVING max(ts) + INTERVAL 21 HOUR < (SELECT max(ts) FROM t)),
    y AS (SELECT run_id, arg_min(state, 2 * idx + silent) AS state, min(idx) AS idx FROM x GROUP BY run_id)
    SELECT run_id, coalesce(state, 'running') AS state, coalesce(idx, last_idx) + 1 AS steps FROM l LEFT JOIN y USING (run_id)""")
def stream_silent_runs(spark, folder):
    """A log that grows in the order of time; a run without a step for 20 hours has timed out, ended runs expire a day later."""
    log, days = run_log(spark, folder), ["2024-01-01", "2024-01-09", "2024-01-17", "2024-01-25", "2100-01-01"]
    slices = [log.where((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(days, days[1:])]
    return followed(spark, slices, lambda stream: live.run_status(
        stream, 12, 45_000, 2, 300, silence_s=20 * 3600, keep_s=7 * 86_400, lateness="1 hour"),
        ["run_id"]).select("run_id", "state", "steps")


def ratings_of(events):
    return events.select(F.col("user_id").cast("string").alias("rater"), F.get_json_object("props", "$.k").alias("unit"),
                         F.col("ts").alias("submitted_at"), "event_id")


@query("stream_ratings_feed", "O-4 D-21", """
    SELECT CAST(user_id AS VARCHAR) AS rater, count(DISTINCT json_extract_string(props, '$.k')) AS n
    FROM events GROUP BY user_id""")
def stream_ratings_feed(spark, folder):
    """Ratings in any order, in three batches, repeated ones dropped across batches."""
    feed = ratings_of(derived.table(spark, folder, "events"))
    at = delivered(spark, shuffled(feed, "event_id"), lambda stream, at: live.write_batches(
        live.ratings_feed(stream, "400 days"), f"{at}/table", f"{at}/progress", "append"))
    return live.rater_counts(spark.read.parquet(f"{at}/table"))


@query("stream_late_ratings", "O-4 A-13", """
    WITH f AS (SELECT CAST(user_id AS VARCHAR) AS rater, json_extract_string(props, '$.k') AS unit, ts,
      CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END
        + CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS turn FROM events),
    m AS (SELECT turn, max(max(ts)) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark
      FROM f GROUP BY turn),
    v AS (SELECT f.*, coalesce(ts < mark, FALSE) AS late FROM f JOIN m USING (turn))
    SELECT rater, count(DISTINCT unit) FILTER (NOT late) AS n, count(*) FILTER (late) AS late FROM v GROUP BY rater""")
def stream_late_ratings(spark, folder):
    """Ratings in the order of time, one in twenty a turn too late: units rated in time, appended to the sheet, and late rows."""
    from tonescope.sources.sinks import append_ratings
    turn = F.when(F.col("submitted_at") < "2024-01-11", 0).when(F.col("submitted_at") < "2024-01-21", 1).otherwise(2)
    feed = cut_lineage(ratings_of(derived.table(spark, folder, "events")).withColumn(
        "turn", turn + F.when(F.col("event_id") % 20 == 0, 1).otherwise(0)))
    at = delivered(spark, [feed.where(F.col("turn") == i) for i in range(4)], lambda stream, at: live.route_late(
        stream, at, f"{at}/progress", "submitted_at", "2 days"))
    rows = live.routed(spark, at)
    append_ratings(rows.where("not late").select("rater", "unit").distinct(), f"{at}/sheet")
    kept = live.rater_counts(spark.read.parquet(f"{at}/sheet"))
    late = rows.groupBy("rater").agg(F.count_if("late").alias("late"))
    return late.join(kept, "rater", "left").select("rater", F.coalesce("n", F.lit(0)).alias("n"), "late")


@query("input_file_hashes", "A-14")
def input_file_hashes(spark, folder):
    """SHA-256 of every input file; SQL has no access to the files themselves."""
    from tonescope.sources.readers import file_hashes
    return file_hashes(spark, folder)


@query("sql_normal_tail", "P-2 I-17", """
    SELECT round(value / 10, 4) AS z_abs, count(*) AS n FROM events WHERE value / 10 < 6 GROUP BY ALL""")
def sql_normal_tail(spark, folder):
    """The normal tail as a SQL function of the session; the tail itself must fall as z grows."""
    from tonescope.functions.normal import register_sql
    register_sql(spark)
    derived.table(spark, folder, "events").createOrReplaceTempView("tone_events")
    told = spark.sql("SELECT round(value / 10, 4) AS z_abs, count(*) AS n, "
                     "erfc(max(value) / 10 / sqrt(2D)) AS p FROM tone_events "
                     "WHERE value / 10 < 6 GROUP BY round(value / 10, 4)")
    return told.where("p BETWEEN 0 AND 1").select("z_abs", "n")
