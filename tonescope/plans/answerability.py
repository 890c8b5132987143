"""Which parameterised questions the data can answer, and why the others cannot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescope.functions import measures as m
from tonescope.plans import questions
from tonescope.schema import MIN_MENTIONS, MIN_TEST_CELL, NON_ACTIONABLE

# The wording of each template, with its parameters in braces.
TEMPLATES = {
    "T1": "What proportion of {a} reviews that mention {aspect} are {sentiment}?",
    "T2": "What is the sentiment breakdown across all {a} reviews, as percentages?",
    "T3": "What are the top 3 topics with the most number of complaints in {a}?",
    "T4": "Looking only at reviews about {aspect}, is the {sentiment} sentiment rate higher in "
          "{a} or {b}?",
    "T5": "Do {a} and {b} have significantly different {sentiment} sentiment rates for {aspect}?",
    "T6": "How do individual organisations in {a} compare to the industry average on {aspect}?"
          " Give me each organisation's negative sentiment rate and ignore any organisations with less than"
          " 30 mentions about {aspect}.",
    "T7": "What is the biggest driver of dissatisfaction at {a}? Rank topics by negative sentiment rate"
          " and ignore any topics with less than 30 mentions.",
    "T8": "Which 2 issues should {a} address first? Rank aspects using this formula: priority score = aspect prevalence"
          " x aspect negative rate. Ignore any aspects with less than 30 negative reviews.",
    "T9": "Why does {a} have a higher complaint rate than {b}? What should {a} improve first?",
    "T10": "Write a CX report for {a}. Cover overall sentiment, the top 3 issues ranked by negative sentiment rate, and how"
           " the top issue compares with the industry average using a statistical significance test. Also give me an"
           " improvement roadmap.",
}


def question_text(params: DataFrame) -> DataFrame:
    """`question` for a whole parameter table; a missing parameter leaves its template blank."""
    text = F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv])[F.col("template")]
    for name in ("a", "b", "aspect", "sentiment"):
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(name), F.lit("")))
    return params.withColumn("question", text)


def _segment_facts(segments: DataFrame, floor: int) -> DataFrame:
    over = F.col("total_count") >= floor
    return segments.groupBy("segment").agg(
        F.min("industry").alias("home"), F.sum("total_count").alias("n"),
        F.count_if(over).alias("topics"),
        F.count_if(F.col("neg_count") >= floor).alias("negative_topics"))


def evidence(params: DataFrame, segments: DataFrame, cells: DataFrame,
             non_actionable=NON_ACTIONABLE, floor: int = MIN_MENTIONS,
             test_floor: int = MIN_TEST_CELL) -> DataFrame:
    """Parameters (task_id, template, a, b, aspect, sentiment) with the counts that decide them.

    Every lookup is an equi-join on a named segment, so one plan judges any number of questions.
    The test-cell floor is inclusive here, as the question builder states it.
    """
    topic_cells = segments.select("segment", "aspect", "total_count", "neg_count", "neu_count",
                                  "pos_count")

    def cell(side):
        wanted = (F.when(F.col("sentiment") == "negative", F.col("neg_count"))
                  .when(F.col("sentiment") == "neutral", F.col("neu_count"))
                  .otherwise(F.col("pos_count")))
        right = topic_cells.withColumnRenamed("segment", side)
        return lambda df: (df.join(right, [side, "aspect"], "left")
                           .na.fill(0, ["total_count", "neg_count", "neu_count", "pos_count"])
                           .withColumn(f"cell_{side}", F.col("total_count"))
                           .withColumn(f"hit_{side}", wanted)
                           .drop("total_count", "neg_count", "neu_count", "pos_count"))

    facts = _segment_facts(segments, floor)
    side_a = facts.select(F.col("segment").alias("a"), F.col("n").alias("n_a"),
                          F.col("home").alias("home_a"), "topics", "negative_topics")
    side_b = facts.select(F.col("segment").alias("b"), F.col("home").alias("home_b"))
    orgs = (cells.where(F.col("total_count") >= floor)
            .groupBy(F.col("industry").alias("a"), "aspect").agg(F.count("*").alias("orgs")))
    pairs = params.where("template = 'T9'").select("a", "b").distinct()
    gaps = questions.why_worse(pairs, segments, non_actionable, floor=floor).select(
        "a", "b", "premise", "n_compared", "n_worse",
        F.col("fix_first").isNotNull().alias("usable"))
    present = (cells.select("industry", "aspect").distinct()
               .withColumn("_here", F.lit(True)))

    def home(side):
        right = present.select(F.col("industry").alias(f"home_{side}"), "aspect",
                               F.col("_here").alias(f"present_{side}"))
        return lambda df: df.join(right, [f"home_{side}", "aspect"], "left")

    judged = (params.transform(cell("a")).transform(cell("b"))
              .join(side_a, "a", "left").join(side_b, "b", "left")
              .join(orgs, ["a", "aspect"], "left").join(gaps, ["a", "b"], "left")
              .transform(home("a")).transform(home("b"))
              .na.fill(0, ["n_a", "topics", "negative_topics", "orgs", "n_compared", "n_worse"])
              .na.fill(False, ["usable", "present_a", "present_b"]))
    smallest = F.least("hit_a", F.col("cell_a") - F.col("hit_a"), "hit_b",
                       F.col("cell_b") - F.col("hit_b"))
    t = F.col("template")
    rule = (F.when(t == "T1", F.col("cell_a") >= floor).when(t == "T2", F.col("n_a") >= floor)
            .when(t == "T3", F.col("topics") >= 3)
            .when(t == "T4", F.least("cell_a", "cell_b") >= floor)
            .when(t == "T5", smallest >= test_floor).when(t == "T6", F.col("orgs") >= 2)
            .when(t == "T7", F.col("topics") >= 1).when(t == "T8", F.col("negative_topics") >= 2)
            .when(t == "T9", F.col("usable")).when(t == "T10", F.col("topics") >= 3))
    return judged.withColumn("smallest_cell", smallest).withColumn("answerable", rule)


def abstention_reason(judged: DataFrame, floor: int = MIN_MENTIONS) -> DataFrame:
    """Why an unanswerable question is so: thin, absent, too few topics, or nothing to act on."""
    t = F.col("template")
    one_sided = t.isin("T1", "T6")
    absent = ((t.isin("T1", "T4", "T5", "T6") & ~F.col("present_a"))
              | (t.isin("T4", "T5") & ~F.col("present_b")))
    empty = (F.col("cell_a") == 0) | (~one_sided & (F.col("cell_b") == 0))
    few = t.isin("T3", "T6", "T7", "T8", "T10")
    reason = (F.when(F.col("answerable"), F.lit(None))
              .when(absent, questions.ABSENT)
              .when((t == "T2") | ((t.isin("T3", "T7", "T8", "T10")) & (F.col("n_a") < floor)),
                    questions.THIN)
              .when((t == "T10"), questions.PARTIAL).when(few, questions.FEW)
              .when((t == "T9") & (F.col("n_worse") > 0), questions.NO_ACTIONABLE)
              .when(t == "T9", "Not worse on any comparable topic")
              .when(t == "T5", F.when(empty, "Slice absent").otherwise(questions.THIN_TEST))
              .otherwise(F.when(empty, "Slice absent").otherwise(questions.THIN)))
    return judged.withColumn("reason", reason)


def distribution_gaps(declared: DataFrame, found: DataFrame, keys) -> DataFrame:
    """Groups whose declared and found numbers of tasks differ; empty when they agree."""
    a = declared.groupBy(*keys).agg(F.count("*").alias("declared"))
    b = found.groupBy(*keys).agg(F.count("*").alias("found"))
    both = a.join(b, list(keys), "full").na.fill(0, ["declared", "found"])
    return both.where("declared <> found")


def task_share(tasks: DataFrame, *keys) -> DataFrame:
    """Tasks and answerable tasks per group."""
    return tasks.groupBy(*keys).agg(F.count("*").alias("tasks"),
                                    F.count_if("answerable").alias("answerable"),
                                    m.rate(F.count_if("answerable"), F.count("*")).alias("share"))
