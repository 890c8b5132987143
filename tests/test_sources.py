import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tonescope.operators import runlogs
from tonescope.plans.scoring import score_traces
from tonescope.sources import readers, sinks, traces


def test_feedback_splits_and_rename(spark, tmp_path):
    (tmp_path / "a.csv").write_text("review_id,industry,org,parent_aspect,child_aspect,sentiment\n"
                                    "R1,Banking,A,p,speed,negative\n")
    (tmp_path / "b.csv").write_text("review_id,industry,org,parent_aspect,child_aspect,sentiment\n"
                                    "R2,Banking,,p,email,\n")
    rows = readers.read_feedback(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert rows.columns == ["review_id", "industry", "org", "parent_aspect", "aspect", "sentiment"]
    got = {r.review_id: r for r in rows.collect()}
    assert got["R2"].org is None and got["R2"].sentiment is None and got["R1"].aspect == "speed"


def test_ratings_with_mark_and_line_breaks(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        '﻿tagger_name,task_id,score,comments,seconds_on_task,submitted_at\n'
        'A,T1-E1,5,"said ""fine""\nand, more",12,2026-08-19T13:18:42.208Z\nB,T1-E1,4,,7,\n',
        encoding="utf-8")
    rows = readers.read_ratings(spark, str(tmp_path / "r.csv")).orderBy("tagger_name").collect()
    assert len(rows) == 2 and rows[0].comments == 'said "fine"\nand, more'
    assert rows[0].score == 5 and rows[0].submitted_at is not None and rows[1].sitting is None


def test_public_tasks_must_be_exact(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("task_id,dataset,question\nT1,easy,\"a, b?\"\n")
    (tmp_path / "bad.csv").write_text("task_id,dataset,question,gold_answer\nT1,easy,q,42\n")
    assert readers.read_public_tasks(spark, str(tmp_path / "ok.csv")).first().question == "a, b?"
    with pytest.raises(ValueError):
        readers.read_public_tasks(spark, str(tmp_path / "bad.csv"))


def test_score_files_are_found_and_old_ones_left_out(spark, tmp_path):
    full = "task_id,task_completion,insight_score,tool_selection_accuracy,path_efficiency,cost_usd,latency_s"
    turned = "latency_s,task_id,task_completion,insight_score,tool_selection_accuracy,path_efficiency,cost_usd"
    for name, body in (("m_s1", f"{full}\nT1,1,5,1.0,0.5,,3.5\n"), ("deep/m_s2", f"{turned}\n2.5,T1,1,4,1.0,0.5,0.01\n"),
                       ("old", "task_id,score\nT1,3\n")):
        folder = tmp_path / name
        folder.mkdir(parents=True)
        (folder / "scores.csv").write_text(body)
    more = tmp_path / "quoted dir"
    more.mkdir()
    (more / "scores.csv").write_text('\ufeffnote,' + full + '\n"a, ""task_id"" b\nc",T2,0,1,0.5,0.5,1,2\n'
                                     'task_id,T3,1,x,0.5,0.5,1,2\n', encoding="utf-8")
    all_ = readers.read_scores(spark, str(tmp_path)).collect()
    assert sorted((r.task_id, r.insight_score) for r in all_ if r.run_dir.startswith("quoted")) == [("T2", 1.0), ("T3", None)]
    skipped = readers.score_files(spark, str(tmp_path)).where("size(lacking) > 0").collect()
    assert [r.file.split("/")[-2] for r in skipped] == ["old"] and "insight_score" in skipped[0].lacking
    got = {r.run_dir: r for r in all_ if not r.run_dir.startswith("quoted")}
    assert set(got) == {"m_s1", "m_s2"}
    assert got["m_s1"].cost_usd is None and got["m_s1"].latency_s == 3.5
    assert got["m_s2"].insight_score == 4.0 and got["m_s2"].latency_s == 2.5


GOLD_PATH = [{"tool": "filter", "args": {"industry": ["Banking"]}},
             {"tool": "summarise", "args": {"ref": {"tool": "filter", "args": {"industry": ["Banking"]}}}}]


def trace(run, task, seed, steps, end=True):
    lines = [{"type": "run_start", "run_id": run, "task_id": task, "agent_id": f"m_s{seed}", "model": "m",
              "seed": seed, "manifest": {"list_prices_usd_per_1m": {"input": 0.3, "cached_input": 0.03, "output": 2.5}}}]
    for i, (tool, status, signature) in enumerate(steps):
        lines.append({"type": "step", "idx": i, "tool": tool, "args": {"text": "18.7%"} if tool == "answer" else {},
                      "handle": None, "canonical_signature": signature, "output": {}, "status": status,
                      "protocol_violation": tool is None, "tokens_in": 1000, "tokens_out": 100, "latency_s": 1.0,
                      "raw_response": {"usage": {"prompt_tokens_details": {"cached_tokens": 600}}}})
    if end:
        lines.append({"type": "run_end", "run_id": run, "terminal_state": "submitted",
                      "final_answer": {"text": "18.7%", "abstain": False}, "wall_s": 9.5})
    return "".join(json.dumps(x) + "\n" for x in lines)


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "m_s1"
    folder.mkdir()
    f, s = GOLD_PATH
    # keys in another order must not matter
    s = {"args": {"ref": {"args": {"industry": ["Banking"]}, "tool": "filter"}}, "tool": "summarise"}
    (folder / "a.jsonl").write_text(trace("a", "T1", 1, [("filter", "ok", f), ("summarise", "ok", s), ("answer", "ok", None)]))
    (folder / "b.jsonl").write_text(trace("b", "T1", 2, [(None, "error", None), ("filter", "ok", f), ("answer", "ok", None)]))
    (folder / "c.jsonl").write_text(trace("c", "T9", 1, [("filter", "ok", f)], end=False))
    return str(tmp_path)


def test_traces_to_scores(spark, logs):
    gold = spark.createDataFrame([("T1", 2, json.dumps(GOLD_PATH))],
                                 "task_id string, gold_num_steps int, gold_tool_path_json string")
    records = traces.read_traces(spark, logs)
    got = {r.run_id: r for r in score_traces(records, gold).collect()}
    assert got["a"].path_match is True and got["a"].path_efficiency == 1.0
    assert got["a"].tool_selection_accuracy == 1.0 and got["a"].task_completion == 1
    assert got["b"].path_match is False and got["b"].tool_selection_accuracy == 0.5
    assert got["b"].error_kinds == "no_tool_call:1" and got["b"].path_efficiency == 1.0
    assert got["c"].path_match is None and got["c"].state == "missing_run_end"
    assert got["c"].task_completion == 0 and got["c"].tool_selection_accuracy is None
    assert round(got["a"].cost_usd, 9) == round(3 * (400 * 0.3 + 600 * 0.03 + 100 * 2.5) / 1e6, 9)
    (Path(logs) / "m_s1" / "d.jsonl").write_text(trace("d", "T1", 4, [], end=False))
    again = {r.run_id: r for r in score_traces(traces.read_traces(spark, logs), gold).collect()}
    # a run that died before its first step has a row all the same
    dead = again.pop("d")
    assert set(again) == {"a", "b", "c"} and dead.n_steps == 0 and dead.state == "missing_run_end"
    assert dead.path_match is False and dead.tool_selection_accuracy == 0.0 and dead.task_completion == 0
    assert dead.n_protocol_violations == 0 and dead.abstained is None
    totals = {r.agent: r for r in runlogs.agent_totals(score_traces(records, gold)).collect()}
    assert sum(r.protocol_violations for r in totals.values()) == sum(r.n_protocol_violations for r in got.values())
    only = score_traces(records, gold, spark.createDataFrame([("T1",)], "task_id string"))
    assert {r.run_id for r in only.collect()} == {"a", "b"}


def test_one_trace_and_flat_log(spark, logs, tmp_path):
    assert traces.read_trace(spark, logs, "b").count() == 5
    records = traces.read_traces(spark, logs)
    steps = runlogs.with_error_kind(traces.run_steps(records))
    ends = traces.run_ends(records).withColumnRenamed("terminal_state", "state")
    flat = sinks.flat_log(steps, ends)
    out = str(tmp_path / "flat")
    sinks.write_table(flat, out, form="csv")
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 6 and back.where("answer = '18.7%'").count() == 2
    sinks.write_table(flat, str(tmp_path / "parts"), ["task_id"])
    assert spark.read.parquet(str(tmp_path / "parts")).where("task_id = 'T1'").count() == 6


def test_appended_ratings(spark, tmp_path):
    rows = spark.createDataFrame([("A", "T1", 5)], "rater string, unit string, score int")
    for _ in range(2):
        sinks.append_ratings(rows, str(tmp_path / "sheet"))
    sheet = spark.read.parquet(str(tmp_path / "sheet"))
    assert sheet.count() == 2 and sheet.where("received_at IS NULL").count() == 0


def test_event_stream_files(spark, tmp_path):
    events = [{"type": "assistant", "session_id": "x", "seq": 1, "message": {"content": [
        {"type": "text"}, {"type": "tool_use", "name": "filter"}, {"type": "tool_use", "name": "rank"}]}},
        {"type": "result", "session_id": "x", "seq": 2, "result": "done", "num_turns": 3, "total_cost_usd": 0.5},
        {"type": "assistant", "session_id": "y", "seq": 1, "message": {"content": []}}]
    (tmp_path / "e.jsonl").write_text("".join(json.dumps(e) + "\n" for e in events) + "not json\n")
    got = {r.session_id: r for r in runlogs.event_streams(
        traces.read_event_streams(spark, str(tmp_path))).collect()}
    assert (got["x"].num_tool_calls, got["x"].final_answer, got["x"].cost_usd) == (2, "done", 0.5)
    assert got["y"].error == "no result event" and got["y"].num_tool_calls == 0


def test_file_hashes(spark, tmp_path):
    import hashlib
    (tmp_path / "x.csv").write_bytes(b"abc")
    row = readers.file_hashes(spark, str(tmp_path)).first()
    assert row.sha256 == hashlib.sha256(b"abc").hexdigest() and row.length == 3


def test_file_hashes_read_in_blocks(spark, tmp_path, monkeypatch):
    import hashlib

    from tonescope.sources import digests
    body = bytes(range(256)) * 300_000     # several blocks
    deep = tmp_path / "deep"
    deep.mkdir()
    (deep / "big.gz").write_bytes(body)    # whatever the name says, the bytes count
    (tmp_path / "none").write_bytes(b"")
    got = {r.file: (r.length, r.sha256) for r in readers.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {"big.gz": (len(body), hashlib.sha256(body).hexdigest()), "none": (0, hashlib.sha256(b"").hexdigest())}
    assert readers.file_hashes(spark, str(deep / "big.gz")).count() == 1
    assert len(body) > 8 * digests.BLOCK


def test_store_replaces_partitions_and_prunes_by_run(spark, tmp_path):
    at = str(tmp_path / "store")
    line = lambda run, **rest: ("d" + run[0], run, json.dumps({"run_id": run, **rest}))
    rows = [line(f"{d}{i}", type="run_start", task_id=f"T{i}", agent_id=d, seed=1) for d in "ab" for i in range(40)]
    rows += [line(f"{d}{i}", type="step", idx=0, tool="filter", status="ok") for d in "ab" for i in range(40)]
    shape = "run_dir string, run_id string, record string"
    for _ in range(2):
        traces.write_store(spark.createDataFrame(rows, shape), at)
    assert traces.read_store(spark, at).count() == 160
    again = [line("a7", type="run_start", task_id="new", agent_id="a", seed=2)]
    slot = spark.createDataFrame(again, shape).select(traces.slot_of("run_id")).first()[0]
    others = [r for r in rows if r[0] == "da" and r[1] != "a7"]
    same = spark.createDataFrame(others, shape).where(traces.slot_of("run_id") == slot)
    traces.write_store(spark.createDataFrame(again, shape).unionByName(same), at)
    steps = traces.run_steps(traces.read_store(spark, at))
    assert steps.count() == 79 and steps.where("run_id = 'b3'").first().task_id == "T3"
    one = traces.read_store(spark, at, "a7")
    assert [r.task_id for r in one.collect()] == ["new"]
    assert {f.split("/")[-2] for f in one.inputFiles()} == {f"slot={slot}"} or "PartitionFilters: [isnotnull(slot" in (
        one._jdf.queryExecution().executedPlan().toString())


def test_agent_identity(spark):
    rows = spark.createDataFrame([("no-tool-x_s1", "big", "d"), ("y_s1", "big", "d"), ("y_s1", None, "d"),
                                  (None, None, "d")], "agent_id string, model string, run_dir string")
    assert [r.n for r in rows.select(runlogs.agent_name().alias("n")).collect()] == [
        "no-tool-agent", "big", "y_s1", "d"]
    assert rows.where(F.col("agent_id").isNull()).count() == 1
