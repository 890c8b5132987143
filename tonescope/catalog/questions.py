"""The ten question templates over every segment of the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescope.catalog.base import on_cells, query
from tonescope.catalog.inferences import PAIRS, TESTED, requested_pairs
from tonescope.functions.measures import COUNT_OF
from tonescope.plans import questions
from tonescope.sources import derived

SEGS = """, segs AS (
    SELECT org AS segment, 'org' AS kind, industry, aspect, total_count, neg_count, neu_count, pos_count FROM cells
    UNION ALL SELECT industry, 'industry', industry, aspect, sum(total_count)::BIGINT, sum(neg_count)::BIGINT,
      sum(neu_count)::BIGINT, sum(pos_count)::BIGINT FROM cells GROUP BY industry, aspect)"""

TOPICS = derived.NON_ACTIONABLE_TOPICS
IN_TOPICS = "('Brand#1', 'Brand#2', 'Brand#3')"


def segments(spark, folder):
    return questions.segment_cells(derived.feedback_cells(spark, folder))


def settled_segments(spark, folder):
    return questions.segment_cells(derived.settled_cells(spark, folder))


@query("question_single_rate", "M-1 C-7", on_cells(SEGS + f"""
    , f AS (SELECT s.segment, a.aspect, coalesce(c.total_count, 0) AS total_count,
        coalesce(c.neg_count, 0) AS neg_count, coalesce(c.neu_count, 0) AS neu_count,
        coalesce(c.pos_count, 0) AS pos_count
      FROM (SELECT DISTINCT segment FROM segs) s CROSS JOIN (SELECT DISTINCT aspect FROM segs) a
      LEFT JOIN segs c ON c.segment = s.segment AND c.aspect = a.aspect)
    SELECT *, CASE WHEN total_count >= 30 THEN neg_count::DOUBLE / total_count END AS neg_rate,
      CASE WHEN total_count >= 30 THEN neu_count::DOUBLE / total_count END AS neu_rate,
      CASE WHEN total_count >= 30 THEN pos_count::DOUBLE / total_count END AS pos_rate,
      total_count < 30 AS abstain, CASE WHEN total_count = 0 THEN '{questions.ABSENT}'
        WHEN total_count < 30 THEN '{questions.THIN}' END AS reason FROM f"""))
def question_single_rate(spark, folder):
    return questions.single_rate(settled_segments(spark, folder))


@query("question_distribution", "M-2 D-7", on_cells(SEGS + f"""
    , t AS (SELECT segment, kind, sum(total_count)::BIGINT AS total_count, sum(neg_count)::BIGINT AS neg_count,
      sum(neu_count)::BIGINT AS neu_count, sum(pos_count)::BIGINT AS pos_count FROM segs GROUP BY ALL)
    SELECT *, neg_count::DOUBLE / total_count AS neg_rate, neu_count::DOUBLE / total_count AS neu_rate,
      pos_count::DOUBLE / total_count AS pos_rate, total_count < 30 AS abstain,
      CASE WHEN total_count < 30 THEN '{questions.THIN}' END AS reason FROM t"""))
def question_distribution(spark, folder):
    return questions.distribution(segments(spark, folder))


@query("question_top_complaints", "M-3 F-1 F-2", on_cells(SEGS + f"""
    , r AS (SELECT segment, aspect, neg_count, rank() OVER (PARTITION BY segment ORDER BY neg_count DESC) AS rank,
      count(*) FILTER (total_count >= 30) OVER (PARTITION BY segment) AS n_topics FROM segs)
    SELECT segment, aspect, rank, neg_count, n_topics, FALSE AS abstain, NULL::VARCHAR AS reason
    FROM r WHERE n_topics >= 3 AND rank <= 3 AND neg_count > 0
    UNION ALL SELECT DISTINCT segment, NULL, NULL, NULL, n_topics, TRUE, '{questions.FEW}'
    FROM r WHERE n_topics < 3"""))
def question_top_complaints(spark, folder):
    return questions.top_complaints(segments(spark, folder))


def higher_sql(count: str) -> str:
    return on_cells(PAIRS.format(k=count) + f"""
    SELECT a, b, aspect, total_a, total_b, neg_a::DOUBLE / nullif(total_a, 0) AS rate_a,
      neg_b::DOUBLE / nullif(total_b, 0) AS rate_b,
      CASE WHEN total_a >= 30 AND total_b >= 30 THEN CASE
        WHEN neg_a::DOUBLE / total_a > neg_b::DOUBLE / total_b THEN 'a'
        WHEN neg_a::DOUBLE / total_a < neg_b::DOUBLE / total_b THEN 'b' ELSE 'equal' END END AS higher,
      total_a < 30 OR total_b < 30 AS abstain, CASE WHEN total_a = 0 OR total_b = 0 THEN '{questions.ABSENT}'
        WHEN total_a < 30 OR total_b < 30 THEN '{questions.THIN}' END AS reason FROM sides""")


@query("question_which_is_higher", "M-4 C-7", higher_sql("neg_count"))
def question_which_is_higher(spark, folder):
    return questions.which_is_higher(requested_pairs(spark, folder), segments(spark, folder))


def by_sentiment(sql) -> str:
    """The same question for every sentiment."""
    return " UNION ALL ".join(f"SELECT '{name}' AS sentiment, * FROM ({sql(count)})" for name, count in COUNT_OF.items())


def every_sentiment(ask) -> DataFrame:
    return reduce(DataFrame.unionByName, [ask(name).withColumn("sentiment", F.lit(name)) for name in COUNT_OF])


@query("question_which_is_higher_by_sentiment", "M-4 I-18", by_sentiment(higher_sql))
def question_which_is_higher_by_sentiment(spark, folder):
    pairs, told = requested_pairs(spark, folder), segments(spark, folder)
    return every_sentiment(lambda name: questions.which_is_higher(pairs, told, sentiment=name))


def difference_sql(count: str) -> str:
    return on_cells(PAIRS.format(k=count) + TESTED + f"""
    SELECT a, b, aspect, total_a, neg_a AS count_a, total_b, neg_b AS count_b, CASE WHEN sufficient THEN z END AS z,
      CASE WHEN sufficient THEN round(p, 9) END AS p_value,
      CASE WHEN sufficient THEN p < 0.05e0 END AS significant, NOT sufficient AS abstain,
      CASE WHEN total_a = 0 OR total_b = 0 THEN '{questions.ABSENT}'
        WHEN NOT sufficient THEN '{questions.THIN_TEST}' END AS reason FROM judged""")


@query("question_significant_difference", "M-5 J-5", difference_sql("neg_count"))
def question_significant_difference(spark, folder):
    told = questions.significant_difference(requested_pairs(spark, folder),
                                            segments(spark, folder))
    return told.withColumn("p_value", F.round("p_value", 9))


@query("question_significant_difference_by_sentiment", "M-5 I-18", by_sentiment(difference_sql))
def question_significant_difference_by_sentiment(spark, folder):
    pairs, told = requested_pairs(spark, folder), segments(spark, folder)
    return every_sentiment(lambda name: questions.significant_difference(pairs, told, sentiment=name).withColumn(
        "p_value", F.round("p_value", 9)))


@query("question_orgs_against_industry", "M-6 E-9", on_cells(f"""
    , i AS (SELECT industry, aspect, sum(neg_count)::DOUBLE / sum(total_count) AS industry_rate,
      count(*) FILTER (total_count >= 30) AS n_orgs FROM cells GROUP BY ALL),
    r AS (SELECT org, industry, aspect, total_count, neg_count, neg_count::DOUBLE / total_count AS neg_rate
      FROM cells WHERE total_count >= 30)
    SELECT org, industry, aspect, total_count, neg_count, neg_rate,
      rank() OVER (PARTITION BY industry, aspect ORDER BY neg_rate DESC) AS rank, industry_rate,
      neg_rate - industry_rate AS vs_industry, n_orgs, n_orgs < 2 AS abstain,
      CASE WHEN n_orgs < 2 THEN '{questions.FEW}' END AS reason FROM r JOIN i USING (industry, aspect)"""))
def question_orgs_against_industry(spark, folder):
    return questions.orgs_against_industry(derived.feedback_cells(spark, folder))


@query("question_biggest_driver", "M-7 A-1 D-1 F-1", on_cells(SEGS + f"""
    , r AS (SELECT segment, aspect, total_count, neg_count, neg_count::DOUBLE / total_count AS neg_rate,
        rank() OVER (PARTITION BY segment ORDER BY neg_count::DOUBLE / total_count DESC) AS rank,
        count(*) OVER (PARTITION BY segment) AS n_topics FROM segs WHERE total_count >= 30)
    SELECT segment, aspect, total_count, neg_count, neg_rate, n_topics, FALSE AS abstain,
      NULL::VARCHAR AS reason FROM r WHERE rank = 1
    UNION ALL SELECT DISTINCT segment, NULL, NULL, NULL, NULL, 0, TRUE, '{questions.THIN}' FROM segs
      WHERE segment NOT IN (SELECT segment FROM r)"""))
def question_biggest_driver(spark, folder):
    return questions.biggest_driver(segments(spark, folder))


@query("question_priorities", "M-8 B-11 D-1", on_cells(SEGS + f"""
    , s AS (SELECT *, total_count::DOUBLE / sum(total_count) OVER (PARTITION BY segment) AS prevalence,
        neg_count::DOUBLE / total_count AS neg_rate FROM segs),
    p AS (SELECT *, prevalence * neg_rate AS priority_score FROM s WHERE neg_count >= 30),
    r AS (SELECT *, rank() OVER (PARTITION BY segment ORDER BY priority_score DESC) AS rank,
        count(*) OVER (PARTITION BY segment) AS n_topics FROM p)
    SELECT segment, aspect, rank, prevalence, neg_rate, neg_count, priority_score,
      aspect NOT IN {IN_TOPICS} AS actionable, n_topics, n_topics < 2 AS abstain,
      CASE WHEN n_topics < 2 THEN '{questions.FEW}' END AS reason FROM r WHERE rank <= 2"""))
def question_priorities(spark, folder):
    return questions.priorities(segments(spark, folder), TOPICS)


GAPS = f"""{SEGS}, pairs AS (SELECT a.s_name AS a, b.s_name AS b
      FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1),
    r AS (SELECT segment, aspect, neg_count::DOUBLE / total_count AS neg_rate,
        rank() OVER (PARTITION BY segment ORDER BY neg_count::DOUBLE / total_count DESC) AS rank
      FROM segs WHERE total_count >= 30),
    gaps AS (SELECT pairs.a, pairs.b, t.aspect, t.rank, t.neg_rate AS rate_a, o.neg_rate AS rate_b,
        (t.neg_rate - o.neg_rate) * 100 AS gap_pp, t.aspect NOT IN {IN_TOPICS} AS actionable
      FROM pairs LEFT JOIN r t ON t.segment = pairs.a AND t.rank <= 3
      LEFT JOIN r o ON o.segment = pairs.b AND o.aspect = t.aspect)"""


def neighbour_pairs(spark, folder):
    orgs = derived.table(spark, folder, "supplier").select("s_suppkey", F.col("s_name").alias("a"))
    following = orgs.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("a").alias("b"))
    return orgs.join(following, "s_suppkey").select("a", "b")


@query("question_pair_gaps", "M-9 C-2 E-8", on_cells(GAPS + " SELECT * FROM gaps"))
def question_pair_gaps(spark, folder):
    return questions.pair_gaps(neighbour_pairs(spark, folder), settled_segments(spark, folder), TOPICS)


@query("question_why_worse", "M-9 F-1 C-2", on_cells(GAPS + f"""
    , best AS (SELECT a, b, aspect, gap_pp, row_number() OVER (PARTITION BY a, b ORDER BY gap_pp DESC, aspect) AS rn
      FROM gaps WHERE actionable AND gap_pp > 0),
    n AS (SELECT a, b, count(rate_b) AS n_compared, count(*) FILTER (gap_pp > 0) AS n_worse FROM gaps GROUP BY ALL),
    t AS (SELECT segment, sum(neg_count)::DOUBLE / sum(total_count) AS rate, sum(neg_count)::BIGINT AS neg
      FROM segs GROUP BY segment)
    SELECT n.a, n.b, ta.rate AS overall_a, tb.rate AS overall_b,
      ta.rate > tb.rate AND ta.neg > tb.neg AS premise, n_compared, n_worse, best.aspect AS fix_first,
      best.gap_pp, best.aspect IS NULL AS abstain,
      CASE WHEN best.aspect IS NULL THEN '{questions.NO_ACTIONABLE}' END AS reason
    FROM n JOIN t ta ON ta.segment = n.a JOIN t tb ON tb.segment = n.b
    LEFT JOIN best ON best.a = n.a AND best.b = n.b AND rn = 1"""))
def question_why_worse(spark, folder):
    return questions.why_worse(neighbour_pairs(spark, folder), settled_segments(spark, folder), TOPICS)


REPORT = """
    , i AS (SELECT industry, aspect, sum(neg_count)::BIGINT AS k, sum(total_count)::BIGINT AS n FROM cells GROUP BY ALL),
    r AS (SELECT *, neg_count::DOUBLE / total_count AS neg_rate,
        rank() OVER (PARTITION BY org ORDER BY neg_count::DOUBLE / total_count DESC) AS rank,
        count(*) OVER (PARTITION BY org) AS n_topics FROM cells WHERE total_count >= 30),
    sides AS (SELECT r.org, r.aspect, r.rank, r.n_topics, r.neg_rate, k::DOUBLE / n AS industry_rate,
        total_count AS total_a, neg_count AS neg_a, n - total_count AS total_b, k - neg_count AS neg_b
      FROM r JOIN i USING (industry, aspect) WHERE rank <= 3)"""


@query("question_report_topics", "M-10 J-3 F-5", on_cells(REPORT + TESTED + f"""
    SELECT org, aspect, rank, n_topics, neg_rate, industry_rate, sufficient, z, round(p, 9) AS p_value,
      p < 0.05e0 AS significant, aspect NOT IN {IN_TOPICS} AS actionable FROM judged"""))
def question_report_topics(spark, folder):
    told = questions.report_topics(derived.settled_cells(spark, folder), TOPICS)
    return told.where("rank IS NOT NULL").select(
        "org", "aspect", "rank", "n_topics", "neg_rate", "industry_rate", "sufficient", "z",
        F.round("p_value", 9).alias("p_value"), "significant", "actionable")


@query("question_full_report", "M-10 D-7 F-5", on_cells(REPORT + f"""
    , m AS (SELECT industry, org, sum(total_count)::BIGINT AS n_reviews, sum(neg_count)::BIGINT AS n_negative,
        sum(neu_count)::BIGINT AS n_neutral, sum(pos_count)::BIGINT AS n_positive,
        count(*) FILTER (total_count >= 30) AS n_topics FROM cells GROUP BY ALL),
    s AS (SELECT org, string_agg(rank || ' ' || aspect, '; ' ORDER BY rank, aspect) AS issues,
        string_agg(aspect, '; ' ORDER BY aspect) FILTER (rank = 1) AS first_place,
        string_agg(rank || ' ' || aspect, '; ' ORDER BY rank, aspect) FILTER (aspect NOT IN {IN_TOPICS}) AS steps
      FROM sides GROUP BY org)
    SELECT industry, org, n_reviews, n_negative, n_neutral, n_positive, n_topics,
      n_negative::DOUBLE / n_reviews AS negative_share, n_neutral::DOUBLE / n_reviews AS neutral_share,
      n_positive::DOUBLE / n_reviews AS positive_share,
      CASE WHEN n_topics >= 3 THEN issues END AS top_issues, coalesce(first_place, '') AS compared,
      CASE WHEN n_topics >= 3 THEN coalesce(steps, '') END AS roadmap,
      CASE WHEN n_topics >= 3 THEN 'full' ELSE 'partial' END AS status,
      CASE WHEN n_reviews < 30 THEN '{questions.THIN}' WHEN n_topics < 3 THEN '{questions.PARTIAL}' END AS reason
    FROM m LEFT JOIN s USING (org)"""))
def question_full_report(spark, folder):
    told = questions.full_report(derived.settled_cells(spark, folder), TOPICS)

    def listed(column):
        line = F.transform(column, lambda x: F.concat_ws(" ", x["rank"].cast("string"),
                                                         x["aspect"]))
        return F.array_join(line, "; ")

    return told.select(
        "industry", "org", "n_reviews", "n_negative", "n_neutral", "n_positive", "n_topics",
        "negative_share", "neutral_share", "positive_share",
        listed("top_issues").alias("top_issues"),
        F.array_join(F.transform("comparisons", lambda x: x["aspect"]), "; ").alias("compared"),
        listed("roadmap").alias("roadmap"), "status", "reason")
