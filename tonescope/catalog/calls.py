"""Tool-call paths and JSON handling over the derived call log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonescope.catalog.base import STEPS, query
from tonescope.functions import payload, text
from tonescope.operators import paths
from tonescope.schema import TOOL_ARGUMENTS
from tonescope.session import cut_lineage
from tonescope.sources import derived

CALLS = f"""WITH steps AS ({STEPS}),
  b AS (SELECT *, tokens // 100 AS k, tool AS event,
      max(CASE WHEN tool = 'view' THEN idx END) OVER p AS sel, max(CASE WHEN tool = 'click' THEN idx END) OVER p AS tab
    FROM steps WINDOW p AS (PARTITION BY run_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  calls AS (SELECT run_id, task_id, agent, seed, idx, event, status, k, tokens + 600 AS tokens_in,
      event_id % 50 AS tokens_out, latency_s, sel, tab, event_id, ts,
      CASE WHEN k % 5 > 0 THEN k % 7 * 100 END AS cached,
      CASE WHEN agent = 'agent1' THEN k / 100000e0 END AS cost_usd,
      CASE event WHEN 'view' THEN 'filter' WHEN 'click' THEN 'summarise' WHEN 'purchase' THEN 'rank'
        WHEN 'signup' THEN 'answer' ELSE CASE WHEN k % 2 = 1 THEN 'plot' END END AS tool,
      CASE WHEN event = 'error' AND k % 4 = 1 THEN 'unknown_tool' END AS error_kind,
      CASE event WHEN 'view' THEN 's' || idx WHEN 'click' THEN 't' || idx WHEN 'purchase' THEN 't' || idx END AS handle
    FROM b)"""

# the canonical text of each call, written out by hand for the three tools that have handles
SIGS = CALLS + """, f AS (SELECT run_id, idx, '{"args":{"aspect":[' ||
      list_aggregate(list_sort(list_distinct(['"Brand#' || (k % 25 + 1) || '"', '"Brand#3"'])), 'string_agg', ',')
      || '],"industry":[' || CASE WHEN k % 2 = 0 THEN '"ASIA"' ELSE '"ASIA","EUROPE"' END || ']},"tool":"filter"}' AS sig
      FROM calls WHERE tool = 'filter'),
    s AS (SELECT c.run_id, c.idx, '{"args":{"group_by":"' || CASE WHEN k % 10 = 0 THEN 'colour' ELSE 'aspect' END
      || '","min_n":' || CASE WHEN k % 3 = 0 THEN '"30"' ELSE '30' END || ',"ref":'
      || coalesce(f.sig, '{"unresolved_ref":"s999"}') || '},"tool":"summarise"}' AS sig
      FROM calls c LEFT JOIN f ON f.run_id = c.run_id AND f.idx = c.sel WHERE tool = 'summarise'),
    r AS (SELECT c.run_id, c.idx, '{"args":{"by":"neg_rate","exclude":' || CASE WHEN k % 2 = 0
        THEN '["competitor","general-satisfaction","reviews"]' ELSE '["email"]' END || ',"ref":'
      || coalesce(s.sig, '{"unresolved_ref":"t999"}') || '},"tool":"rank"}' AS sig
      FROM calls c LEFT JOIN s ON s.run_id = c.run_id AND s.idx = c.tab WHERE tool = 'rank'),
    sigs AS (SELECT * FROM f UNION ALL SELECT * FROM s UNION ALL SELECT * FROM r
      UNION ALL SELECT run_id, idx, '{"args":{"text":"answer ' || k || '"},"tool":"answer"}' FROM calls WHERE tool = 'answer'
      UNION ALL SELECT run_id, idx, '{"args":{},"tool":"plot"}' FROM calls WHERE tool = 'plot')"""


def logged(spark, folder):
    return derived.tool_calls(spark, folder).where("tool IS NOT NULL")


@query("calls_canonical", "L-6 C-10 I-11 I-12", SIGS + " SELECT run_id, idx, sig AS signature FROM sigs")
def calls_canonical(spark, folder):
    return paths.canonical_calls(logged(spark, folder))


MATCH = SIGS + """, p AS (SELECT c.run_id, c.task_id, s.sig, row_number() OVER (PARTITION BY c.run_id ORDER BY c.idx) AS position
      FROM calls c JOIN sigs s USING (run_id, idx) WHERE status = 'ok' AND tool <> 'answer'),
    g AS (SELECT task_id, position, sig FROM p WHERE run_id IN (SELECT min(run_id) FROM p GROUP BY task_id)
      AND task_id NOT LIKE 'T3-%'),
    gn AS (SELECT task_id, count(*) AS gold_steps FROM g GROUP BY task_id),
    n AS (SELECT run_id, task_id, count(*) AS steps FROM p GROUP BY ALL),
    h AS (SELECT run_id, count(*) AS hits FROM p JOIN g USING (task_id, position, sig) GROUP BY run_id)"""


def numbered_paths(spark, folder):
    calls = cut_lineage(logged(spark, folder).select("run_id", "task_id", "idx", "tool", "args",
                                                     "handle", "status"))
    signed = paths.canonical_calls(calls)
    # the numbered path is read several times below, so it is written once
    return cut_lineage(paths.work_steps(calls.join(signed, ["run_id", "idx"])).select(
        "run_id", "task_id", "position", "signature"))


@query("calls_path_match", "L-5", MATCH + """
    SELECT run_id, task_id, steps, gold_steps, CASE WHEN gold_steps IS NOT NULL
      THEN steps = gold_steps AND coalesce(hits, 0) = gold_steps END AS path_match
    FROM n LEFT JOIN gn USING (task_id) LEFT JOIN h USING (run_id)""")
def calls_path_match(spark, folder):
    walked = numbered_paths(spark, folder)
    model = walked.groupBy("task_id").agg(F.min("run_id").alias("run_id"))
    gold = (walked.join(model, ["task_id", "run_id"], "left_semi").where("task_id NOT LIKE 'T3-%'")
            .select("task_id", "position", "signature"))
    return paths.path_matches(walked, gold)


@query("calls_readable", "I-13", CALLS + """
    SELECT run_id, idx, CASE tool WHEN 'answer' THEN 'answer(text=''answer ' || k || ''')' WHEN 'plot' THEN 'plot()'
      WHEN 'filter' THEN 'filter(aspect=[''Brand#' || (k % 25 + 1) || ''', '' Brand#3'', ''Brand#3''], industry='
        || CASE WHEN k % 2 = 0 THEN '''ASIA ''' ELSE '[''EUROPE'', ''ASIA'']' END || ')'
      WHEN 'summarise' THEN 'summarise(group_by=''' || CASE WHEN k % 10 = 0 THEN 'colour' ELSE 'aspect' END
        || ''', min_n=' || CASE WHEN k % 3 = 0 THEN '''30''' ELSE '30.0' END || ', ref=''s' || coalesce(sel, 999) || ''')'
      WHEN 'rank' THEN 'rank(by=''neg_rate'', exclude=''' || CASE WHEN k % 2 = 0 THEN 'non_actionable' ELSE 'email' END
        || ''', ref=''t' || coalesce(tab, 999) || ''', top_k=' || CASE WHEN k % 7 = 0 THEN 'None' ELSE '3' END || ')'
      END AS call
    FROM calls WHERE tool IS NOT NULL""")
def calls_readable(spark, folder):
    return paths.readable_calls(logged(spark, folder))


# up to five ranks of a rank of a summary of a selection: each call refers to the handle of the one before
CHAIN_SQL = """WITH RECURSIVE base AS (SELECT event_id AS run_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    c AS (SELECT run_id, k, 0 AS idx, '{"args":{"industry":["I' || (k % 7) || '"]},"tool":"filter"}' AS signature FROM base
      UNION ALL SELECT run_id, k, idx + 1, CASE WHEN idx = 0 THEN '{"args":{"group_by":"aspect","ref":' || signature
          || '},"tool":"summarise"}' ELSE '{"args":{"by":"neg_rate","ref":' || signature || '},"tool":"rank"}' END
        FROM c WHERE idx < 2 + k % 5)
    SELECT run_id, idx, signature FROM c"""


@query("calls_long_chains", "I-12 L-6", CHAIN_SQL)
def calls_long_chains(spark, folder):
    k = F.get_json_object("props", "$.k").cast("bigint")
    runs = derived.table(spark, folder, "events").select(F.col("event_id").alias("run_id"), k.alias("k"))
    steps = runs.withColumn("idx", F.explode(F.sequence(F.lit(0), (2 + F.col("k") % 5).cast("int"))))
    back = F.format_string('"h%d"', F.col("idx") - 1)
    args = (F.when(F.col("idx") == 0, F.format_string('{"industry": "I%d"}', F.col("k") % 7))
            .when(F.col("idx") == 1, F.concat(F.lit('{"group_by": "aspect", "ref": '), back, F.lit("}")))
            .otherwise(F.concat(F.lit('{"by": "neg_rate", "top_k": 3, "ref": '), back, F.lit("}"))))
    tool = F.when(F.col("idx") == 0, "filter").when(F.col("idx") == 1, "summarise").otherwise("rank")
    return paths.canonical_calls(steps.select("run_id", "idx", tool.alias("tool"), args.alias("args"),
                                              F.format_string("h%d", "idx").alias("handle")))


@query("calls_coerced_arguments", "I-10", CALLS + """
    SELECT run_id, idx, 'min_n' AS key, '30' AS value, 'BIGINT' AS kind FROM calls WHERE tool = 'summarise'
    UNION ALL SELECT run_id, idx, 'ref', '"s' || coalesce(sel, 999) || '"', 'STRING' FROM calls WHERE tool = 'summarise'
    """)
def calls_coerced_arguments(spark, folder):
    args = paths.arguments(logged(spark, folder).where("tool = 'summarise'"))
    return (paths.coerced(args).where("key IN ('min_n', 'ref')")
            .select("run_id", "idx", "key", "value", "kind"))


@query("calls_argument_audit", "L-18", CALLS + """
    SELECT run_id, idx, 'unknown_tool' AS rule, tool AS detail FROM calls WHERE tool = 'plot'
    UNION ALL SELECT run_id, idx, 'not_a_choice', 'group_by' FROM calls WHERE tool = 'summarise' AND k % 10 = 0
    UNION ALL SELECT run_id, idx, 'handle_not_issued', 'ref' FROM calls
      WHERE (tool = 'summarise' AND sel IS NULL) OR (tool = 'rank' AND tab IS NULL)""")
def calls_argument_audit(spark, folder):
    return paths.argument_audit(derived.tool_calls(spark, folder))


@query("calls_repeated", "L-19", SIGS + """
    , raw AS (SELECT run_id, idx, tool, CASE tool WHEN 'filter' THEN (k % 2) || '|' || (k % 25)
        WHEN 'summarise' THEN coalesce(sel, 999) || '|' || (k % 10 = 0) || '|' || (k % 3 = 0)
        WHEN 'rank' THEN coalesce(tab, 999) || '|' || (k % 2) || '|' || (k % 7 = 0) WHEN 'answer' THEN k::VARCHAR ELSE '' END AS a
      FROM calls WHERE tool IS NOT NULL),
    w AS (SELECT *, min(idx) OVER (PARTITION BY run_id, tool, a) AS first_idx FROM raw)
    SELECT run_id, idx, tool, first_idx FROM w WHERE idx > first_idx""")
def calls_repeated(spark, folder):
    return paths.repeated_calls(derived.tool_calls(spark, folder))


@query("json_path_reads", "I-14", CALLS + """
    SELECT agent, sum(coalesce(cached, 0))::BIGINT AS cached_tokens, count(cached) AS reported FROM calls GROUP BY agent""")
def json_path_reads(spark, folder):
    raw = F.try_parse_json("raw_response")
    cached = F.try_variant_get(raw, "$.usage.prompt_tokens_details.cached_tokens", "bigint")
    return derived.call_facts(spark, folder).groupBy("agent").agg(
        F.coalesce(F.sum(cached), F.lit(0)).alias("cached_tokens"),
        F.count(cached).alias("reported"))


REPLIES = """WITH replies AS (SELECT event_id, 'model' || (user_id % 4) AS model,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


@query("reply_payloads", "I-8 P-3", REPLIES + """
    SELECT event_id, CASE k % 5 WHEN 0 THEN '{"score":' || k || '}' WHEN 1 THEN '{"text":"n' || k || '"}'
      WHEN 2 THEN '{"arguments":{"org":"o' || k || '"},"name":"filter"}' END AS payload FROM replies""")
def reply_payloads(spark, folder):
    return derived.model_replies(spark, folder).select(
        "event_id", payload.payload("reply").alias("payload"))


@query("reply_failure_rates", "I-8", REPLIES + """
    SELECT model, count(*) AS replies, count(*) FILTER (k % 5 >= 3) AS unreadable,
      (count(*) FILTER (k % 5 >= 3))::DOUBLE / count(*) AS failure_rate FROM replies GROUP BY model""")
def reply_failure_rates(spark, folder):
    return payload.payload_report(derived.model_replies(spark, folder))


@query("reply_recovered_calls", "I-9 P-3", REPLIES + """
    SELECT model, CASE k % 5 WHEN 1 THEN 'answer' ELSE 'filter' END AS tool, count(*) AS n FROM replies
    WHERE k % 5 IN (1, 2) GROUP BY ALL""")
def reply_recovered_calls(spark, folder):
    found = payload.with_calls(derived.model_replies(spark, folder), TOOL_ARGUMENTS)
    return (found.where("call.tool IS NOT NULL").groupBy("model", F.col("call.tool").alias("tool"))
            .agg(F.count("*").alias("n")))


AWKWARD = """WITH r AS (SELECT event_id, event_id % 8 AS form, json_extract_string(props, '$.k') AS k FROM events)"""


@query("reply_awkward_payloads", "I-8 P-3", AWKWARD + """
    SELECT event_id, CASE form WHEN 0 THEN '{"answer":"use ```sql``` here","k":' || k || '}' WHEN 1 THEN '{"a":' || k || '}'
      WHEN 2 THEN '{"name":"x"}' WHEN 3 THEN '{"action":"x","arguments":{"top_k":' || k || '},"name":"rank"}'
      WHEN 4 THEN '{"arguments":{"name":"x"},"z":' || k || '}' WHEN 5 THEN '{"b":' || k || '}'
      WHEN 6 THEN '{"arguments":{"q":' || k || '},"name":5}' ELSE k END AS payload FROM r""")
def reply_awkward_payloads(spark, folder):
    return derived.awkward_replies(spark, folder).select("event_id", payload.payload("reply").alias("payload"))


@query("reply_awkward_calls", "I-9 P-3", AWKWARD + """
    SELECT event_id, CASE WHEN form IN (2, 3) THEN 'rank' END AS tool,
      CASE form WHEN 2 THEN '{"ref":"t' || k || '"}' WHEN 3 THEN '{"top_k":' || k || '}' END AS args FROM r""")
def reply_awkward_calls(spark, folder):
    found = payload.with_calls(derived.awkward_replies(spark, folder), TOOL_ARGUMENTS)
    return found.select("event_id", "call.tool", "call.args")


@query("reply_markup", "I-6", REPLIES + """
    SELECT model, count(*) FILTER (k % 5 <> 3) AS leaking FROM replies GROUP BY model""")
def reply_markup(spark, folder):
    replies = derived.model_replies(spark, folder)
    return replies.groupBy("model").agg(F.count_if(text.has_markup("reply")).alias("leaking"))


@query("reply_tagged_scores", "I-7", REPLIES + """
    SELECT k % 10 AS said, CASE WHEN k % 10 <= 5 THEN CAST(k % 10 AS INT) END AS score, count(*) AS n
    FROM replies GROUP BY ALL""")
def reply_tagged_scores(spark, folder):
    said = F.col("k") % 10
    graded = derived.model_replies(spark, folder).withColumn(
        "graded", F.concat(F.lit("because <insight_score> "), said.cast("string"),
                           F.lit(" </insight_score>")))
    return graded.groupBy(said.alias("said"), text.tagged_score("graded").alias("score")).agg(
        F.count("*").alias("n"))
