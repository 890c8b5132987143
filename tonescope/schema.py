"""Record types, vocabularies and fixed conventions of the feedback data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Conventions that must equal the reference's for equal results.
MIN_MENTIONS = 30
MIN_TEST_CELL = 10
ALPHA = 0.05
PASS_MARK = 4
SPREAD_CUT = 2
STEP_CAP = 38
TIMEOUT_SECONDS = 600
STALL_LIMIT = 5
TOKEN_BUDGET = 300_000

# Vocabularies.
SENTIMENTS = ["negative", "neutral", "positive"]
SENTIMENT_CODES = {"-1": "negative", "0": "neutral", "1": "positive"}
INDUSTRIES = ["Banking", "Consulting", "Fashion", "Groceries", "Information Technology",
              "Price Comparison", "Ride Hailing", "Streaming", "Trading", "Travel Booking"]
PARENT_ASPECTS = ["account-management", "company-brand", "logistics-rides", "online-experience",
                  "purchase-booking-experience", "staff-support", "value"]
NON_ACTIONABLE = ["competitor", "general-satisfaction", "reviews"]
ASPECT_LABELS = {
    "account-access": "account access",
    "app-website": "the app or website",
    "attitude-of-staff": "staff attitude",
    "competitor": "comparisons with competitors",
    "discounts-promotions": "discounts and promotions",
    "ease-of-use": "ease of use",
    "email": "email support",
    "general-satisfaction": "general satisfaction",
    "phone": "phone support",
    "price-value-for-money": "price and value for money",
    "reviews": "other reviews and forums",
    "speed": "speed",
}
ASPECTS = sorted(ASPECT_LABELS)
TASK_TYPES = {"descriptive": [1, 2, 3], "diagnostic": [4, 5, 6, 7], "prescriptive": [8, 9, 10]}

# The tools whose calls a run log may hold, their arguments and handle kinds.
TOOL_ARGUMENTS = {
    "filter": ["industry", "org", "aspect", "sentiment", "exclude_org"],
    "summarise": ["ref", "group_by", "min_n", "min_n_column"],
    "rank": ["ref", "by", "top_k", "ascending", "exclude"],
    "ztest": ["ref_a", "ref_b", "alternative"],
    "answer": ["text", "abstain"],
}
HANDLE_ARGUMENTS = {"summarise": {"ref": "s"}, "rank": {"ref": "t"},
                    "ztest": {"ref_a": "s", "ref_b": "s"}}
REQUIRED_ARGUMENTS = {"summarise": ["ref"], "rank": ["ref"], "ztest": ["ref_a", "ref_b"],
                      "answer": ["text"]}
SET_ARGUMENTS = ["industry", "org", "aspect", "sentiment", "exclude_org", "exclude"]
INTEGER_ARGUMENTS = ["min_n", "top_k"]
BOOLEAN_ARGUMENTS = ["ascending", "abstain"]
ARGUMENT_CHOICES = {
    ("summarise", "group_by"): ["industry", "org", "aspect", "sentiment"],
    ("summarise", "min_n_column"): ["total_count", "neg_count", "neu_count", "pos_count"],
    ("rank", "by"): ["total_count", "neg_count", "neu_count", "pos_count", "neg_rate",
                     "neu_rate", "pos_rate", "prevalence", "priority_score"],
    ("ztest", "alternative"): ["two-sided", "smaller", "larger"],
}
DEFAULT_ARGUMENTS = {("summarise", "min_n_column"): '"total_count"',
                     ("rank", "ascending"): "false",
                     ("rank", "top_k"): "3",
                     ("ztest", "alternative"): '"two-sided"'}
MARKUP_SIGNS = ["Tool Calls:", "### User:", "### Assistant:", '{"', "```json"]

FILTER_FIELDS = ["industry", "org", "aspect", "parent_aspect", "sentiment", "source"]
# Columns whose distinct values form a small fixed vocabulary. Grouping by one of them yields a
# bounded number of rows per slice, so a window over the slice is safe; `org` is not among them.
VOCABULARY_COLUMNS = {"industry", "aspect", "parent_aspect", "sentiment", "source"}
COUNT_COLUMNS = ["total_count", "neg_count", "neu_count", "pos_count"]
METRICS = ["task_completion", "insight_score", "tool_selection_accuracy", "path_efficiency",
           "cost_usd", "latency_s"]


def _strings(*names):
    return [T.StructField(n, T.StringType()) for n in names]


FEEDBACK = T.StructType(_strings("review_id", "industry", "org", "parent_aspect", "aspect",
                                 "sentiment"))
FEEDBACK_CSV = T.StructType(_strings("review_id", "industry", "org", "parent_aspect",
                                     "child_aspect", "sentiment"))
RAW_REVIEW = T.StructType([
    *_strings("id", "text"), T.StructField("org_index", T.IntegerType()),
    *_strings("industry", "data_source", "labels", "label_codes")])
PUBLIC_TASK = T.StructType(_strings("task_id", "dataset", "question"))
GOLD_TASK = T.StructType([
    *_strings("task_id", "template", "dataset", "question", "gold_answer",
              "gold_tool_path_display", "gold_tool_path_json"),
    T.StructField("gold_num_steps", T.IntegerType())])
SCORES = T.StructType([
    T.StructField("task_id", T.StringType()), T.StructField("task_completion", T.IntegerType()),
    *[T.StructField(m, T.DoubleType()) for m in METRICS[1:]]])
RATING = T.StructType([
    *_strings("tagger_name", "task_id", "difficulty"), T.StructField("score", T.IntegerType()),
    *_strings("comments", "flag_comment"),
    T.StructField("seconds_on_task", T.LongType()),
    T.StructField("seconds_session_elapsed", T.LongType()),
    T.StructField("sitting", T.LongType()), T.StructField("submitted_at", T.TimestampType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("presentation_order", T.IntegerType()),
    T.StructField("received_at", T.StringType())])
JUDGE_SCORE = T.StructType([
    T.StructField("task_id", T.StringType()), T.StructField("judge_score", T.IntegerType()),
    T.StructField("judge_reasoning", T.StringType()),
    T.StructField("latency_s", T.DoubleType()), T.StructField("cost_usd", T.DoubleType())])
# One schema for the three record kinds of a trace file; absent fields read as NULL.
TRACE = T.StructType([
    *_strings("type", "run_id", "task_id", "agent_id", "model"),
    T.StructField("temperature", T.DoubleType()), T.StructField("seed", T.LongType()),
    T.StructField("step_cap", T.LongType()), T.StructField("timeout_s", T.LongType()),
    T.StructField("token_budget", T.LongType()), T.StructField("manifest", T.VariantType()),
    T.StructField("idx", T.IntegerType()), T.StructField("tool", T.StringType()),
    T.StructField("args", T.VariantType()),
    *_strings("handle"), T.StructField("canonical_signature", T.VariantType()),
    T.StructField("output", T.VariantType()), T.StructField("status", T.StringType()),
    T.StructField("protocol_violation", T.BooleanType()),
    T.StructField("error_kind", T.StringType()),
    T.StructField("tokens_in", T.LongType()), T.StructField("tokens_out", T.LongType()),
    T.StructField("latency_s", T.DoubleType()), T.StructField("cost_usd", T.DoubleType()),
    *_strings("served_model", "finish_reason"), T.StructField("raw_response", T.VariantType()),
    *_strings("terminal_state", "error"),
    T.StructField("final_answer", T.StructType([T.StructField("text", T.StringType()),
                                                T.StructField("abstain", T.BooleanType())])),
    T.StructField("n_tool_calls", T.LongType()),
    T.StructField("tokens_in_total", T.LongType()),
    T.StructField("tokens_out_total", T.LongType()),
    T.StructField("served_models", T.ArrayType(T.StringType())),
    T.StructField("wall_s", T.DoubleType()), T.StructField("ts", T.DoubleType())])
