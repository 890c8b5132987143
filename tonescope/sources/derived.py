"""Inputs derived from the benchmark tables: labelled feedback, run steps and ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonescope.operators.ordered import scan
from tonescope.session import cut_lineage

NON_ACTIONABLE_TOPICS = ["Brand#1", "Brand#2", "Brand#3"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A benchmark table as a file stream."""
    shape = table(spark, folder, name).schema
    return spark.readStream.schema(shape).parquet(f"{folder}/{name[:-1]}[{name[-1]}].parquet")


def _labelled_lines(spark: SparkSession, folder: str, lines: DataFrame | None = None):
    """Order lines with their topic and a sentiment, still keyed by supplier."""
    lines = table(spark, folder, "lineitem") if lines is None else lines
    parts = table(spark, folder, "part").select(
        "p_partkey", "p_brand", F.substring("p_brand", 7, 9).cast("int").alias("bn"))
    floor = F.lit(5) + 3 * (F.col("bn") % 10)
    sentiment = (F.when(F.col("l_quantity") <= floor, "negative")
                 .when(F.col("l_quantity") <= floor + 3, "neutral")
                 .otherwise("positive"))
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("p_brand").alias("aspect"),
        F.concat(F.lit("G"), (F.col("bn") % 5).cast("string")).alias("parent_aspect"),
        sentiment.alias("sentiment"), F.col("l_linestatus").alias("source"),
        F.col("l_shipdate").alias("ts"))


def organisations(spark: SparkSession, folder: str) -> DataFrame:
    """(suppkey, industry, org): each organisation sits in one industry."""
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, folder, "region")
    return (supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("suppkey"), F.col("r_name").alias("industry"),
                    F.col("s_name").alias("org")))


def feedback(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """One row per label: industry, org, parent_aspect, aspect, sentiment, source, ts.

    `lines` replaces the order lines, for instance by a stream of them.
    """
    lines = _labelled_lines(spark, folder, lines)
    orgs = organisations(spark, folder)
    return (lines.join(orgs, F.col("l_suppkey") == F.col("suppkey"))
            .select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("review_id"),
                    "industry", "org", "parent_aspect", "aspect", "sentiment", "source", "ts"))


def feedback_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The cell table, aggregated by supplier key *before* names are attached.

    The organisation join then touches one row per (supplier, topic) instead of one per label.
    """
    counted = (_labelled_lines(spark, folder)
               .groupBy("l_suppkey", "parent_aspect", "aspect")
               .agg(F.count("*").alias("total_count"),
                    F.count_if(F.col("sentiment") == "negative").alias("neg_count"),
                    F.count_if(F.col("sentiment") == "neutral").alias("neu_count"),
                    F.count_if(F.col("sentiment") == "positive").alias("pos_count")))
    return (counted.join(organisations(spark, folder), F.col("l_suppkey") == F.col("suppkey"))
            .select("industry", "org", "parent_aspect", "aspect", "total_count", "neg_count",
                    "neu_count", "pos_count"))


def settled_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The cell table written once to the checkpoint folder.

    For questions that read the cells several times with different columns: the labels are then
    scanned once, however many branches follow.
    """
    return cut_lineage(feedback_cells(spark, folder))


def raw_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as raw reviews: one to three label codes each, written as a list literal."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    def code(i):
        return F.concat(F.lit("'G"), (F.col("doc_id") + i) % 5, F.lit(".Brand#"),
                        (F.col("doc_id") * (i + 1)) % 25 + 1, F.lit("."),
                        (F.col("doc_id") + i) % 3 - 1, F.lit("'"))
    kept = F.slice(F.array(code(0), code(1), code(2)), F.lit(1),
                   (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), "text",
        (F.col("doc_id") % 50).cast("int").alias("org_index"), F.col("lang").alias("industry"),
        F.col("source").alias("data_source"),
        F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]")).alias("label_codes"))


def offsets(spark: SparkSession, folder: str) -> DataFrame:
    """An offset on the negative rate of every (org, topic), cycling through five choices."""
    from tonescope.operators.frames import vocabulary
    choices = F.array(*[F.lit(x) for x in (0.0, 0.05, -0.05, 0.15, -0.15)])
    topics = table(spark, folder, "part").select(F.col("p_brand").alias("aspect"))
    rows = organisations(spark, folder).withColumn("aspect",
                                                   F.explode(vocabulary(topics, "aspect")))
    turn = (F.col("suppkey") + F.substring("aspect", 7, 9).cast("int")) % 5
    return rows.select("industry", "org", "aspect",
                       F.element_at(choices, (turn + 1).cast("int")).alias("offset"))


def corpora(spark: SparkSession, folder: str) -> DataFrame:
    """Two corpora for drift: `real` = source O, `made` = source F without topics 7, 14 and 21."""
    marks = corpus_marks()
    corpus = F.when(marks["real"], "real").when(marks["made"], "made")
    return feedback(spark, folder).withColumn("corpus", corpus).where(F.col("corpus").isNotNull())


def corpus_marks():
    """Which labels belong to which of the two corpora."""
    real, topic = F.coalesce(F.col("source") == "O", F.lit(False)), F.substring("aspect", 7, 9).cast("int")
    return {"real": real, "made": ~real & (topic % 7 != 0)}


def logged_steps(spark: SparkSession, folder: str) -> DataFrame:
    """A step log over events, in no order: one run per user and week. One scan, no shuffle."""
    events = table(spark, folder, "events")
    week = F.date_trunc("week", "ts")
    return events.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 week.cast("date").cast("string")).alias("run_id"),
        F.concat(F.lit("T"), (F.col("user_id") % 10 + 1).cast("string"), F.lit("-E"),
                 (F.col("user_id") % 5 + 1).cast("string")).alias("task_id"),
        F.concat(F.lit("agent"), (F.col("user_id") % 4).cast("string")).alias("agent"),
        (F.col("user_id") % 5).alias("seed"), F.col("event_type").alias("tool"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        "event_id", "ts", F.col("value").alias("latency_s"),
        (F.get_json_object("props", "$.k").cast("bigint") * 100).alias("tokens"))


def run_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The step log with steps numbered in the order of time.

    Steps are numbered hour by hour, so a run holding very many events is spread over its hours.
    """
    keyed = logged_steps(spark, folder).withColumn("hour", F.date_trunc("hour", "ts"))
    return (scan(keyed, ["run_id"], "hour", ["ts", "event_id"], "position")
            .withColumn("idx", F.col("position") - 1).drop("position", "hour"))


def _said(steps: DataFrame) -> DataFrame:
    """What a step says by itself: tool, error kind, tokens, usage, cost and the text of an answer."""
    steps = steps.withColumn("k", F.expr("tokens div 100")).withColumnRenamed("tool", "event")
    k, event = F.col("k"), F.col("event")
    tool = (F.when(event == "view", "filter").when(event == "click", "summarise").when(event == "purchase", "rank")
            .when(event == "signup", "answer").when(k % 2 == 1, "plot"))
    kind = F.when((event == "error") & (k % 4 == 1), "unknown_tool")
    cached = F.when(k % 5 > 0, k % 7 * 100)
    usage = F.when(k % 5 > 0, F.format_string(
        '{"usage": {"prompt_tokens_details": {"cached_tokens": %d}}}', cached)).otherwise(F.lit("{}"))
    return steps.withColumns({
        "tool": tool, "error_kind": kind, "tokens_in": F.col("tokens") + 600, "tokens_out": F.col("event_id") % 50,
        "raw_response": usage, "cost_usd": F.when(F.col("agent") == "agent1", k / 100000),
        "answer_text": F.when(event == "signup", F.format_string("answer %d", k))})


FACTS = ["run_id", "task_id", "agent", "seed", "event", "tool", "status", "error_kind", "k", "tokens_in", "tokens_out",
         "raw_response", "latency_s", "cost_usd", "event_id", "ts"]


def call_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The tool calls without order, handles and arguments, for questions that only count: one scan, no shuffle."""
    return _said(logged_steps(spark, folder)).select(*FACTS, "answer_text")


def tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """The step log as tool calls with JSON arguments, handles, error kinds, tokens and replies.

    A view filters, a click summarises the last selection, a purchase ranks the last table, a
    signup answers; an error is a turn without a call or a call to a tool that does not exist.
    Numbers and handles come from one scan: events are read once.
    """
    keyed = logged_steps(spark, folder).withColumn("hour", F.date_trunc("hour", "ts"))
    steps = _said(scan(keyed, ["run_id"], "hour", ["ts", "event_id"], "position", latest={
        "_sel": F.col("tool") == "view", "_tab": F.col("tool") == "click"}))
    k, event = F.col("k"), F.col("event")
    sel = F.concat(F.lit("s"), F.coalesce(F.col("_sel") - 1, F.lit(999)))
    tab = F.concat(F.lit("t"), F.coalesce(F.col("_tab") - 1, F.lit(999)))
    args = (F.when(event == "view", F.format_string(
                '{"industry": %s, "aspect": ["Brand#%d", " Brand#3", "Brand#3"]}',
                F.when(k % 2 == 0, '"ASIA "').otherwise('["EUROPE", "ASIA"]'), k % 25 + 1))
            .when(event == "click", F.format_string(
                '{"ref": "%s", "group_by": "%s", "min_n": %s, "min_n_column": "total_count"}', sel,
                F.when(k % 10 == 0, "colour").otherwise("aspect"),
                F.when(k % 3 == 0, '"30"').otherwise("30.0")))
            .when(event == "purchase", F.format_string(
                '{%s"by": "neg_rate", "ref": "%s", "exclude": "%s"}',
                F.when(k % 7 == 0, "").otherwise('"top_k": 3, '), tab,
                F.when(k % 2 == 0, "non_actionable").otherwise("email")))
            .when(event == "signup", F.format_string('{"text": "answer %d"}', k))
            .when(k % 2 == 1, F.lit("{}")))
    steps = steps.withColumn("idx", F.col("position") - 1)
    handle = (F.when(event == "view", F.concat(F.lit("s"), "idx"))
              .when(event.isin("click", "purchase"), F.concat(F.lit("t"), "idx")))
    return steps.select(*FACTS, "idx", args.alias("args"), handle.alias("handle"))


def model_replies(spark: SparkSession, folder: str) -> DataFrame:
    """One text reply per event, holding JSON in several wrappings or none."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    reply = (F.when(k % 5 == 0, F.format_string('```json\n{"score": %d}\n```', k))
             .when(k % 5 == 1, F.format_string('I think {not json} answer {"text": "n%d"} done', k))
             .when(k % 5 == 2, F.format_string(
                 '<tool_call>{"name": "filter", "arguments": {"org": "o%d"}}</tool_call>', k))
             .when(k % 5 == 3, F.format_string("the score is %d of 100", k))
             .otherwise(F.format_string('{"score": %d, "broken": ', k)))
    return table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("model"), (F.col("user_id") % 4).cast("string")).alias("model"),
        k.alias("k"), reply.alias("reply"))


def awkward_replies(spark: SparkSession, folder: str) -> DataFrame:
    """One reply per event that is easily misread: fences inside and beside JSON, several named calls, odd key orders."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    forms = ['{"answer": "use ```sql``` here", "k": %d}', '```python\nx = {%d}\n```\nResult: {"a": %1$d}',
             'filter {"name": "x"} then rank {"ref": "t%d"}', '{"action": "x", "name": "rank", "arguments": {"top_k": %d}}',
             '{"arguments": {"name": "x"}, "z": %d}', '```json\n{"cut": \n```\n```json\n{"b": %d}\n```',
             'answer {"name": 5, "arguments": {"q": %d}}', "%d"]
    form = F.col("event_id") % len(forms)
    reply = F.coalesce(*[F.when(form == i, F.format_string(said, k)) for i, said in enumerate(forms)])
    return table(spark, folder, "events").select("event_id", form.alias("form"), k.alias("k"), reply.alias("reply"))


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Three raters per document on 0-5, with about one rating in eleven missing."""
    docs = table(spark, folder, "documents").select("doc_id")
    raters = docs.select("doc_id", F.explode(F.array(*[F.lit(r) for r in (1, 2, 3)])).alias("r"))
    return (raters.where((F.col("doc_id") + F.col("r")) % 11 != 0)
            .select(F.col("doc_id").alias("unit"), F.concat(F.lit("r"), "r").alias("rater"),
                    ((F.col("doc_id") * 7 + F.col("r") * (F.col("doc_id") % 3)) % 6)
                    .cast("int").alias("score")))


def reference_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: an automated judge's score, an intended score, and its template number."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return docs.select(F.col("doc_id").alias("unit"),
                       (F.col("n_chars") % 6).cast("int").alias("judge_score"),
                       (F.col("doc_id") * 7 % 6).cast("int").alias("intended_score"),
                       (F.col("doc_id") % 10 + 1).cast("int").alias("template"))
