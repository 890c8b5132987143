import json

import pytest
from pyspark.sql import functions as F

from tonescope.functions import payload, text
from tonescope.operators import ordered, paths, profiling, runlogs

CALL = "run_id string, idx long, tool string, args string, handle string, status string"


def calls(spark, rows):
    return spark.createDataFrame(rows, CALL)


PATH = [("filter", '{"industry": "Banking", "aspect": ["speed", " email "]}', "s1"),
        ("summarise", '{"min_n": 30.0, "group_by": "aspect", "ref": "s1"}', "t1"),
        ("rank", '{"ref": "t1", "top_k": 3, "by": "neg_rate", "exclude": "non_actionable"}', "t2"),
        ("rank", '{"by": "neg_rate", "ref": "t2", "top_k": null, "ascending": false}', "t3")]


def test_handle_names_order_and_defaults_do_not_matter(spark):
    one = [("a", i, t, a, h, "ok") for i, (t, a, h) in enumerate(PATH)]
    rename = {"s1": "s4", "t1": "t7", "t2": "t8", "t3": "t9"}

    def renamed(x):
        for k, v in rename.items():
            x = x.replace(f'"{k}"', f'"{v}"')
        return x
    two = [("b", i, t, json.dumps(dict(reversed(json.loads(renamed(a)).items()))), rename[h], "ok")
           for i, (t, a, h) in enumerate(PATH)]
    two[0] = ("b", 0, "filter", '{"aspect": ["email", "speed", "email"], "industry": ["Banking"]}',
              "s4", "ok")
    got = {(r.run_id, r.idx): r.signature for r in
           paths.canonical_calls(calls(spark, one + two)).collect()}
    for i in range(4):
        assert got["a", i] == got["b", i]
    whole = json.loads(got["a", 3])
    assert whole["args"]["top_k"] is None and "ascending" not in whole["args"]
    inner = whole["args"]["ref"]
    assert "top_k" not in inner["args"]
    assert inner["args"]["exclude"] == ["competitor", "general-satisfaction", "reviews"]
    table = inner["args"]["ref"]
    assert table["args"]["min_n"] == 30 and table["args"]["ref"]["tool"] == "filter"
    assert table["args"]["ref"]["args"]["aspect"] == ["email", "speed"]


def test_two_handles_and_a_missing_one(spark):
    rows = [("a", 0, "filter", '{"org": "X"}', "s1", "ok"),
            ("a", 1, "ztest", '{"ref_a": "s1", "ref_b": "s9", "alternative": "two-sided"}', None, "ok")]
    got = {r.idx: json.loads(r.signature) for r in paths.canonical_calls(calls(spark, rows)).collect()}
    assert got[1]["args"] == {"ref_a": {"args": {"org": ["X"]}, "tool": "filter"},
                              "ref_b": {"unresolved_ref": "s9"}}


def test_chains_of_any_length_are_resolved(spark):
    rows = [("a", 0, "filter", "{}", "s0", "ok")] + [
        ("a", i, "rank", json.dumps({"ref": f"t{i - 1}" if i > 1 else "s0"}), f"t{i}", "ok")
        for i in range(1, 9)]
    got = {r.idx: json.loads(r.signature) for r in paths.canonical_calls(calls(spark, rows)).collect()}
    depth, node = 0, got[8]
    while "ref" in node["args"]:
        depth, node = depth + 1, node["args"]["ref"]
    assert len(got) == 9 and depth == 8 and node["tool"] == "filter"


def test_chains_are_resolved_in_blocks_from_their_makers(spark, monkeypatch):
    rows = [("a", 0, "filter", '{"org": "X"}', "h0", "ok")] + [
        ("a", i, "ztest", json.dumps({"ref_a": f"h{i - 1}", "ref_b": f"h{i // 2}" if i % 3 else "gone"}), f"h{i}", "ok")
        for i in range(1, 9)]
    rows += [("b", 0, "rank", '{"ref": "h1"}', "h0", "ok"), ("b", 1, "rank", '{"ref": "h0"}', "h1", "ok")]

    def node(run, i):
        ref = {k: v for k, v in json.loads(dict(((r[0], r[1]), r[3]) for r in rows)[run, i]).items() if k != "org"}
        made = {r[4]: r[1] for r in rows if r[0] == run and r[1] < i}
        args = {k: node(run, made[v]) if v in made else {"unresolved_ref": v} for k, v in ref.items()}
        return {"tool": {(r[0], r[1]): r[2] for r in rows}[run, i], "args": args or {"org": ["X"]}}

    written = []
    monkeypatch.setattr(paths, "cut_lineage", lambda df, cut=paths.cut_lineage: written.append(cut(df)) or written[-1])
    for block in (2, 3, 256):
        written.clear()
        got = {(r.run_id, r.idx): json.loads(r.signature) for r in paths.canonical_calls(calls(spark, rows), block).collect()}
        assert got == {(r[0], r[1]): node(r[0], r[1]) for r in rows}
    # one row a call, and the two handles nobody made; no row per call and level of its chain
    assert [df.count() for df in written] == [11, 2]


def test_readable_rank_always_shows_top_k(spark):
    rows = [("a", i, "rank", a, None, "ok") for i, a in enumerate(
        ['{"ref": "t1", "top_k": 3}', '{"ref": "t1"}', '{"ref": "t1", "top_k": null}', '{"ref": "t1", "ascending": false}'])]
    got = {r.idx: r.call for r in paths.readable_calls(calls(spark, rows)).collect()}
    assert got == {0: "rank(ref='t1', top_k=3)", 1: "rank(ref='t1', top_k=None)", 2: "rank(ref='t1', top_k=None)",
                   3: "rank(ref='t1', top_k=None)"}


def test_coercion(spark):
    rows = [("a", 0, "summarise", '{"min_n": "-3", "ref": "none"}', None, "ok"),
            ("a", 1, "rank", '{"top_k": 4.0, "ascending": " TRUE ", "by": "Null"}', None, "ok"),
            ("a", 2, "answer", '{"text": "3", "abstain": "maybe"}', None, "ok")]
    got = {(r.idx, r.key): r.value for r in paths.coerced(paths.arguments(calls(spark, rows))).collect()}
    assert got == {(0, "min_n"): "-3", (0, "ref"): "null", (1, "top_k"): "4",
                   (1, "ascending"): "true", (1, "by"): "null", (2, "text"): '"3"',
                   (2, "abstain"): '"maybe"'}


def test_argument_audit(spark):
    rows = [("a", 0, "plot", "{}", None, "error"), ("a", 1, "filter", '{"colour": "red"}', None, "error"),
            ("a", 2, "summarise", '{"ref": "s7"}', None, "error"),
            ("a", 3, "filter", '{"org": "X"}', "s1", "ok"),
            ("a", 4, "rank", '{"ref": "s1", "by": "size"}', None, "error"),
            ("a", 5, "summarise", '{"min_n": "many", "group_by": ["aspect"]}', None, "error"),
            ("a", 6, "summarise", '{"ref": "s1", "min_n": "30"}', "t1", "ok"),
            ("a", 7, "rank", '{"ref": "t1", "top_k": null}', "t2", "ok")]
    got = {(r.idx, r.rule, r.detail) for r in paths.argument_audit(calls(spark, rows)).collect()}
    assert got == {(0, "unknown_tool", "plot"), (1, "unknown_argument", "colour"),
                   (2, "handle_not_issued", "ref"), (4, "wrong_handle_kind", "ref"),
                   (4, "not_a_choice", "by"), (5, "wrong_type", "min_n"),
                   (5, "wrong_type", "group_by"), (5, "missing_argument", "ref")}


def test_repeats_ignore_key_order(spark):
    rows = [("a", 0, "filter", '{"a": 1, "b": "x"}', None, "ok"),
            ("a", 1, "filter", '{"b":"x","a":1}', None, "ok"), ("b", 0, "filter", '{"a": 1, "b": "x"}', None, "ok")]
    got = paths.repeated_calls(calls(spark, rows)).collect()
    assert [(r.run_id, r.idx, r.first_idx) for r in got] == [("a", 1, 0)]


STEP = "run_id string, idx long, tool string, status string, reply string, tokens long, latency_s double"


@pytest.mark.parametrize("rows, state, at", [
    ([(None, "same")] * 5, "stalled", 4),
    ([(None, "same")] * 4 + [("answer", None)], "submitted", 4),
    ([(None, str(i)) for i in range(8)] + [("answer", None)], "submitted", 8),
    ([(None, "x")] * 4 + [("filter", None)] + [(None, "x")] * 4, "error", 8),
    ([("filter", None)] * 40, "step_cap", 37)])
def test_stopping_rules(spark, rows, state, at):
    steps = spark.createDataFrame(
        [("r", i, t, "ok" if t else "error", said, 10, 0.5) for i, (t, said) in enumerate(rows)], STEP)
    got = runlogs.stopping_states(steps, 38, 300_000, 600, 5).first()
    assert (got.state, got.stop_idx) == (state, at)


def test_token_budget_and_timeout(spark):
    steps = spark.createDataFrame([("a", i, "filter", "ok", None, 100, 1.0) for i in range(9)]
                                  + [("b", i, "filter", "ok", None, 1, 3.0) for i in range(9)], STEP)
    got = {r.run_id: (r.state, r.stop_idx) for r in
           runlogs.stopping_states(steps, 38, 450, 10, 5).collect()}
    assert got == {"a": ("token_budget", 4), "b": ("timeout", 3)}


def test_cached_tokens_have_their_own_price(spark):
    steps = spark.createDataFrame(
        [("r", "m", 1000, 100, '{"usage": {"prompt_tokens_details": {"cached_tokens": 600}}}', None),
         ("r", "m", 500, 50, "{}", None), ("q", "x", 1, 1, "not json", 0.25)],
        "run_id string, agent string, tokens_in long, tokens_out long, raw_response string, cost_usd double")
    prices = spark.createDataFrame([("m", 0.30, 0.03, 2.50)],
                                   "agent string, input double, cached_input double, output double")
    got = {r.run_id: r for r in runlogs.run_costs(steps, prices, "run_id").collect()}
    assert round(got["r"].cost_list, 6) == 0.000663 == round(got["r"].cost_usd, 6)
    assert got["q"].cost_list is None and got["q"].cost_usd == 0.25


def test_error_kinds_and_report(spark):
    steps = spark.createDataFrame(
        [("r", None, "error", None)] * 5 + [("r", "rank", "error", "bad_ref"), ("r", "rank", "error", None),
         ("r", "filter", "ok", None), ("r", "answer", "ok", None)],
        "run_id string, tool string, status string, error_kind string")
    assert runlogs.error_text(steps, "run_id").first().error_kinds == (
        "no_tool_call:5;bad_ref:1;tool_error_result:1")
    report = runlogs.run_report(steps, "run_id").first()
    assert (report.total_steps, report.error_steps, report.no_call_steps) == (8, 7, 5)
    flags = {r.kind: r.protocol_violation for r in runlogs.violation_table(steps).collect()}
    assert flags == {"no_tool_call": "yes", "bad_ref": "no", "tool_error_result": "no"}


def test_missing_scores_fail_or_stay_open(spark):
    rows = spark.createDataFrame(
        [("m", 1, "T1", 5.0), ("m", 2, "T1", 4.0), ("m", 1, "T2", 5.0), ("m", 2, "T2", None),
         ("m", 1, "T3", 3.0), ("m", 2, "T3", 5.0), ("m", 1, "T4", 5.0)],
        "agent string, seed int, task_id string, insight_score double")
    fail = {r.task_id: r.passed for r in runlogs.passed_tasks(rows, 4).collect()}
    open_ = {r.task_id: r.passed for r in runlogs.passed_tasks(rows, 4, "null").collect()}
    assert fail == {"T1": True, "T2": False, "T3": False, "T4": False}
    assert open_ == {"T1": True, "T2": None, "T3": False, "T4": True}
    board = runlogs.leaderboard(rows, ["insight_score"], 4).first()
    assert board.k_seeds == 2 and board.n_tasks == 4 and board.pass_k == 0.25
    assert board.insight_score_mean == (18 / 4 + 12 / 3 - 0) / 2 or board.insight_score_mean == (4.5 + 4.5) / 2


def test_payload_forms(spark):
    said = ['```json\n{"a": 1}\n```', 'sure: [1, {"b": 2}] ok', "it’s {'no'} but {\"x\": \"it's\"}",
            "nothing", None, '{"cut": [1, 2', '{"text": "a { b"}', '{"answer": "use ```sql``` here"}',
            '```python x=1 ``` Result: {"a":1}', '  12.5 ', '```\nnone\n```\n```JSON\n{"a":\n1}```', "```", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    got = {r.i: r.p for r in rows.select("i", payload.payload("t").alias("p")).collect()}
    assert got == {0: '{"a":1}', 1: '[1,{"b":2}]', 2: '{"x":"it\'s"}', 3: None, 4: None,
                   5: None, 6: '{"text":"a { b"}', 7: '{"answer":"use ```sql``` here"}', 8: '{"a":1}', 9: "12.5",
                   10: '{"a":1}', 11: None, 12: None}


def test_first_json_among_prose_with_quotes_and_brackets():
    told = {'say "hi {" {bad {"a": "}"} and [1, {"b": []}]': {"a": "}"}, 'use "{" as start. {"a": 1}': {"a": 1},
            'a 5" pipe [see] {"x": "q\\"}"} }': {"x": 'q"}'}, "] } {]": None, '{"cut": {"in": 1}, "c': {"in": 1},
            "{" * 50_000: None, "[" * 50_000 + "x" + "]" * 50_000: None, '{"a" ' * 20_000 + "}" * 20_000: None}
    for text, value in told.items():
        assert payload.first_json(text) == value, text[:50]
    assert payload.first_json('[1] {"a": 2}', "{") == {"a": 2}


def test_recovered_calls_are_worked_out_once(spark):
    """However often a call's fields are read, each of the three Python scans is asked once a row."""
    replies = spark.createDataFrame([("m", 'filter {"a": 1}'), ("m", '{"name": "rank", "arguments": {}}'), ("n", "no call")],
                                    "model string, reply string")
    told = payload.with_calls(replies, ["filter", "rank"]).where("call.tool IS NOT NULL").groupBy("model", "call.tool").count()
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    evaluated = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert sum(line.split("], [")[0].count("scan(") for line in evaluated) == 3
    assert {tuple(r) for r in told.collect()} == {("m", "filter", 1), ("m", "rank", 1)}


def test_recovered_calls(spark):
    said = ['<tool_call>{"name": "filter", "arguments": {"org": "X"}}</tool_call>',
            'I do {"name": "rank", "arguments": {}} now', '-answer {"text": "No answer."}',
            'paint {"text": "x"}', '<tool_call>{"name": "filter"', 'answer {"name": "x"}', "",
            'filter {"name":"x"} then rank {"ref":"t1"}', '{"action":"x","name":"rank","arguments":{"a":[1]}}',
            '{"arguments":{"name":"x"},"z":1}', '{"name":"rank","arguments":"none"} rank {"by":1}',
            '<tool_call>{"a":1}</tool_call> {"name":"rank","arguments":{}}', 'myrank {"a":1} rank {"b":2}',
            'rank {bad} then {"c":3}', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    call = payload.recovered_call("t", ["filter", "rank", "answer"])
    got = {r.i: (r.c.tool, r.c.args) for r in rows.select("i", call.alias("c")).collect()}
    assert got[0] == ("filter", '{"org":"X"}') and got[1] == ("rank", "{}")
    assert got[2] == ("answer", '{"text":"No answer."}')
    assert all(got[i] == (None, None) for i in (3, 4, 5, 6, 9, 14))
    assert got[7] == ("rank", '{"ref":"t1"}') and got[8] == ("rank", '{"a":[1]}') and got[10] == ("rank", '{"by":1}')
    assert got[11] == (None, None) and got[12] == ("rank", '{"b":2}') and got[13] == ("rank", '{"c":3}')


def test_text_functions(spark):
    rows = spark.createDataFrame([("['a.b.-1', 'c.d.1']", "  two  words ", "m-x_20260904_064122_s2555")],
                                 "label_codes string, text string, run_dir string")
    labels = text.explode_labels(rows).collect()
    assert [(r.parent_aspect, r.aspect, r.sentiment) for r in labels] == [
        ("a", "b", "negative"), ("c", "d", "positive")]
    got = rows.select(text.word_count().alias("w"), text.seed_of().alias("s"),
                      text.model_of().alias("m")).first()
    assert (got.w, got.s, got.m) == (2, 2555, "m-x")
    scores = spark.createDataFrame([("<insight_score> 4 </insight_score>",), ("<insight_score>9</insight_score>",),
                                    ("none",)], "r string").select(text.tagged_score("r").alias("s"))
    assert [r.s for r in scores.collect()] == [4, None, None]


def test_ordered_helpers_equal_plain_windows(spark):
    # one group holds most of the rows; slices cut it
    rows = spark.range(3000).selectExpr("CASE WHEN id % 4 = 0 THEN id % 7 ELSE 0 END AS g", "id AS o",
                                        "id div 50 AS s", "id % 13 AS v")
    numbered = ordered.number_rows(rows, ["g"], "s", ["o"], "n")
    summed = ordered.running_sum(numbered, ["g"], "s", ["o"], F.col("v"), "t")
    topped = ordered.running_max_before(summed, ["g"], "s", ["o"], F.col("v"), "m")
    want = rows.selectExpr("g", "o", "row_number() OVER (PARTITION BY g ORDER BY o) AS n",
                           "sum(v) OVER (PARTITION BY g ORDER BY o) AS t",
                           "max(v) OVER (PARTITION BY g ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m")
    assert topped.select("g", "o", "n", "t", "m").exceptAll(want).count() == 0


def test_expanded_labels_have_dense_ids(spark):
    cells = spark.createDataFrame([("I", f"o{i}", "p", f"x{i % 3}", i % 4, i % 2, 1) for i in range(40)],
                                  "industry string, org string, parent_aspect string, aspect string, "
                                  "neg_count long, neu_count long, pos_count long")
    labels = profiling.expand_to_labels(cells)
    ids = sorted(r.review_id for r in labels.collect())
    total = sum(i % 4 + i % 2 + 1 for i in range(40))
    assert ids == [f"R{i:06d}" for i in range(1, total + 1)]


def test_thinning_spares_protected_cells_and_repeats(spark):
    cells = spark.range(2000).selectExpr("'I' AS industry", "cast(id AS string) AS org", "'x' AS aspect")
    kept = profiling.thin(cells, 0.1, F.col("org").cast("int") < 100)
    assert kept.where("cast(org AS int) < 100").count() == 100
    share = kept.where("cast(org AS int) >= 100").count() / 1900
    assert 0.87 < share < 0.93
    assert kept.exceptAll(profiling.thin(cells.repartition(9), 0.1, F.col("org").cast("int") < 100)).count() == 0


def test_recorded_ends_against_the_rules(spark):
    stops = spark.createDataFrame([("a", 3, "submitted", 0), ("b", 2, "stalled", 0), ("c", 5, "timeout", 2), ("d", 1, "error", 0)],
                                  "run_id string, stop_idx long, state string, steps_after long")
    recorded = spark.createDataFrame([("a", "submitted"), ("a", "submitted"), ("b", "step_cap"), ("c", "timeout"), ("x", "error")],
                                     "run_id string, terminal_state string")
    got = {r.run_id: (r.expected, r.recorded, r.agrees) for r in runlogs.stopping_audit(stops, recorded).collect()}
    assert got == {"a": ("submitted", "submitted", True), "b": ("stalled", "step_cap", False), "c": ("timeout", "timeout", False),
                   "d": ("error", "missing_run_end", False), "x": (None, "error", False)}


def test_one_read_of_the_events_a_query(spark, monkeypatch):
    """Counting queries scan the events once; ordered ones scan them once, write, and read what was written."""
    from tonescope.operators import ordered
    from tonescope.sources import derived
    folder = "/root/testdata/sf0.001"

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("events.parquet")

    assert scans(derived.call_facts(spark, folder)) == 1
    written = []
    plain = ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda df: (written.append(scans(df)), plain(df))[1])
    log = derived.tool_calls(spark, folder)
    assert written == [1] and scans(log) == 0


def test_scan_equals_plain_windows(spark):
    import random
    draw = random.Random(3)
    rows = [("hot" if draw.random() < 0.6 else draw.choice("ab"), i // 7, i, draw.randrange(5), draw.random() < 0.2)
            for i in range(400)]
    table = spark.createDataFrame(rows, "g string, s long, o long, v long, hit boolean").repartition(5)
    from tonescope.operators import ordered
    got = {(r.g, r.o): (r.n, r.total, r.last) for r in ordered.scan(
        table, ["g"], "s", ["o"], "n", {"total": F.col("v")}, {"last": F.col("hit")}).collect()}
    count, total, last = {}, {}, {}
    for g, _, o, v, hit in rows:
        count[g], total[g] = count.get(g, 0) + 1, total.get(g, 0) + v
        assert got[g, o] == (count[g], total[g], last.get(g))
        if hit:
            last[g] = count[g]
    assert len(got) == len(rows)


def test_tools_in_order_without_repeats(spark):
    rows = [("r", 0, "filter", '{"a": 1}'), ("r", 1, None, None), ("r", 2, "filter", '{"a": 1}'), ("r", 3, "rank", "{}"),
            ("r", 4, "filter", '{"a": 2}'), ("q", 0, "rank", "{}")]
    steps = spark.createDataFrame(rows, "run_id string, idx long, tool string, args string")
    got = sorted((r.run_id, r.position, r.tool) for r in runlogs.tools_in_order(steps).collect())
    assert got == [("q", 1, "rank"), ("r", 1, "filter"), ("r", 2, "rank"), ("r", 3, "filter")]
