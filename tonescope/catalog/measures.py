"""Summaries, shares and derived measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonescope.catalog.base import on_cells, on_feedback, on_ratings, query
from tonescope.functions import measures as m
from tonescope.operators import agreement, ranking, summaries
from tonescope.schema import SENTIMENTS
from tonescope.sources import derived

RATES = """neg_count::DOUBLE / total_count AS neg_rate, neu_count::DOUBLE / total_count AS neu_rate,
    pos_count::DOUBLE / total_count AS pos_rate"""


@query("summary_by_topic_per_org", "D-1 E-1 E-2 E-3 B-18", on_cells(f"""
    , s AS (SELECT *, sum(total_count) OVER (PARTITION BY org)::BIGINT AS selection_rows FROM cells)
    SELECT org, aspect, total_count, neg_count, neu_count, pos_count, selection_rows, {RATES},
      total_count::DOUBLE / selection_rows AS prevalence,
      (total_count::DOUBLE / selection_rows) * (neg_count::DOUBLE / total_count) AS priority_score
    FROM s WHERE total_count >= 30"""))
def summary_by_topic_per_org(spark, folder):
    return summaries.summarise(derived.feedback(spark, folder), "aspect", ["org"], min_n=30)


@query("summary_by_org", "D-1", on_cells(f"""
    , s AS (SELECT org, sum(total_count)::BIGINT AS total_count, sum(neg_count)::BIGINT AS neg_count,
        sum(neu_count)::BIGINT AS neu_count, sum(pos_count)::BIGINT AS pos_count FROM cells GROUP BY org),
    t AS (SELECT *, (SELECT sum(total_count) FROM s)::BIGINT AS selection_rows FROM s)
    SELECT org, total_count, neg_count, neu_count, pos_count, selection_rows, {RATES},
      total_count::DOUBLE / selection_rows AS prevalence,
      (total_count::DOUBLE / selection_rows) * (neg_count::DOUBLE / total_count) AS priority_score
    FROM t WHERE neg_count >= 30"""))
def summary_by_org(spark, folder):
    return summaries.summarise(derived.feedback(spark, folder), "org", min_n=30,
                               min_n_column="neg_count")


@query("summary_whole_selection", "D-2", on_feedback(f"""
    , s AS (SELECT count(*) AS total_count, count(*) FILTER (sentiment = 'negative') AS neg_count,
      count(*) FILTER (sentiment = 'neutral') AS neu_count,
      count(*) FILTER (sentiment = 'positive') AS pos_count FROM feedback WHERE industry = 'ASIA')
    SELECT *, total_count AS selection_rows, {RATES}, 1e0 AS prevalence,
      neg_count::DOUBLE / total_count AS priority_score FROM s"""))
def summary_whole_selection(spark, folder):
    rows = derived.feedback(spark, folder).where("industry = 'ASIA'")
    return summaries.summarise(rows)


@query("summary_below_floor", "D-3", on_cells("""
    SELECT org, string_agg(aspect, ',' ORDER BY aspect) AS below_min_n FROM cells
    WHERE total_count < 30 GROUP BY org"""))
def summary_below_floor(spark, folder):
    summary = summaries.summary_of_counts(derived.feedback_cells(spark, folder), "aspect", ["org"],
                                          min_n=30)
    return summaries.below_floor(summary, "aspect", ["org"])


@query("count_by_topic", "D-4 M-21", on_feedback("""
    SELECT aspect, count(*) AS count FROM feedback WHERE sentiment = 'negative' GROUP BY aspect"""))
def count_by_topic(spark, folder):
    rows = derived.feedback(spark, folder).where("sentiment = 'negative'")
    return summaries.count_by(rows, "aspect").orderBy(F.desc("count"))


BREAKDOWN = """SELECT {keys}, count(*) FILTER (sentiment = 'positive') AS positive,
    count(*) FILTER (sentiment = 'negative') AS negative,
    count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) AS total FROM feedback"""


@query("breakdown_by_parent", "D-5", on_feedback(
    BREAKDOWN.format(keys="industry, parent_aspect") + " GROUP BY ALL"))
def breakdown_by_parent(spark, folder):
    return summaries.sentiment_breakdown(derived.feedback(spark, folder), "industry",
                                         "parent_aspect")


@query("share_of_negative", "D-6 M-14", on_feedback("""
    SELECT org, count(*) AS n, count(*) FILTER (sentiment = 'negative') AS count,
      count(*) FILTER (sentiment = 'negative')::DOUBLE / count(*) AS share
    FROM feedback WHERE aspect = 'Brand#9' GROUP BY org"""))
def share_of_negative(spark, folder):
    rows = derived.feedback(spark, folder).where("aspect = 'Brand#9'")
    return summaries.share_of(rows, "negative", "org")


@query("share_of_each_sentiment", "D-7 E-11", on_feedback("""
    SELECT org, sentiment, count(*) AS n,
      count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY org) AS share FROM feedback GROUP BY org, sentiment"""))
def share_of_each_sentiment(spark, folder):
    return summaries.value_shares(derived.feedback(spark, folder), "sentiment", ["org"])


@query("cross_tab_counts", "D-8", on_feedback("""
    SELECT aspect, count(*) FILTER (sentiment = 'negative') AS negative,
      count(*) FILTER (sentiment = 'neutral') AS neutral,
      count(*) FILTER (sentiment = 'positive') AS positive FROM feedback GROUP BY aspect"""))
def cross_tab_counts(spark, folder):
    return summaries.cross_tab(derived.feedback(spark, folder), "aspect", "sentiment", SENTIMENTS)


@query("cross_tab_shares", "D-8", on_feedback("""
    SELECT industry, (count(*) FILTER (sentiment = 'negative'))::DOUBLE / count(*) AS negative,
      (count(*) FILTER (sentiment = 'neutral'))::DOUBLE / count(*) AS neutral,
      (count(*) FILTER (sentiment = 'positive'))::DOUBLE / count(*) AS positive
    FROM feedback GROUP BY industry"""))
def cross_tab_shares(spark, folder):
    return summaries.cross_tab(derived.feedback(spark, folder), "industry", "sentiment",
                               SENTIMENTS, normalise=True)


GRID = ", ".join(f"count(*) FILTER (parent_aspect = 'G{i}') AS G{i}" for i in range(5))
GRID_NULL = ", ".join(f"nullif(count(*) FILTER (parent_aspect = 'G{i}'), 0) AS G{i}"
                      for i in range(5))


@query("grid_with_gaps", "D-9", on_feedback(f"""
    SELECT org, {GRID_NULL} FROM feedback WHERE sentiment = 'neutral' GROUP BY org"""))
def grid_with_gaps(spark, folder):
    rows = derived.feedback(spark, folder).where("sentiment = 'neutral'")
    return (rows.groupBy("org").pivot("parent_aspect", [f"G{i}" for i in range(5)])
            .agg(F.count(F.lit(1))))


@query("distinct_counts", "D-10", on_feedback("""
    SELECT industry, count(DISTINCT org) AS orgs, count(DISTINCT aspect) AS aspects,
      count(DISTINCT parent_aspect) AS parents FROM feedback GROUP BY industry"""))
def distinct_counts(spark, folder):
    # distinct over cells: the fact rows are reduced once, then the small table is de-duplicated
    cells = derived.feedback_cells(spark, folder)
    return cells.groupBy("industry").agg(
        F.count_distinct("org").alias("orgs"), F.count_distinct("aspect").alias("aspects"),
        F.count_distinct("parent_aspect").alias("parents"))


@query("orgs_by_size", "D-11", on_cells("""
    , s AS (SELECT industry, org, sum(total_count)::BIGINT AS n FROM cells GROUP BY ALL)
    SELECT industry, org, n, rank() OVER (PARTITION BY industry ORDER BY n DESC) AS rank FROM s"""))
def orgs_by_size(spark, folder):
    sizes = (derived.feedback_cells(spark, folder).groupBy("industry", "org")
             .agg(F.sum("total_count").alias("n")))
    return ranking.wide_rank(sizes, "n", ["industry"])


@query("describe_text_length", "D-12 D-14", """
    SELECT lang, count(*) AS n, round(avg(n_chars::DOUBLE), 6) AS mean, round(stddev_samp(n_chars::DOUBLE), 6) AS sd,
      min(n_chars) AS low, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median,
      quantile_cont(n_chars, 0.75) AS q3, max(n_chars) AS high FROM documents GROUP BY lang""")
def describe_text_length(spark, folder):
    docs = derived.table(spark, folder, "documents").select("lang", "n_chars")
    moments = docs.groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("n_chars").cast("double")), 6).alias("mean"),
        F.round(F.stddev_samp("n_chars"), 6).alias("sd"), F.min("n_chars").alias("low"),
        F.max("n_chars").alias("high"))
    points = ranking.quantiles(docs, "n_chars", [0.25, 0.5, 0.75], ["lang"])
    wide = points.groupBy("lang").agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(a)
                                        for q, a in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    return moments.join(wide, "lang")


@query("weighted_and_plain_mean", "D-13", on_cells("""
    SELECT industry, round(avg(neg_count::DOUBLE / total_count), 9) AS plain_mean,
      sum(neg_count)::DOUBLE / sum(total_count) AS weighted_mean FROM cells GROUP BY industry"""))
def weighted_and_plain_mean(spark, folder):
    cells = derived.feedback_cells(spark, folder)
    # sum(rate * n) is the summed count itself, so the weighted mean stays exact
    return (summaries.with_rates(cells).groupBy("industry")
            .agg(F.round(F.avg("neg_rate"), 9).alias("plain_mean"),
                 m.rate(F.sum("neg_count"), F.sum("total_count")).alias("weighted_mean")))


@query("unit_median_low_high", "D-14", on_ratings("""
    SELECT unit, median(score)::DOUBLE AS median, min(score) AS low, max(score) AS high,
      count(*) AS m, max(score) - min(score) AS spread FROM ratings GROUP BY unit"""))
def unit_median_low_high(spark, folder):
    return agreement.unit_consensus(derived.ratings(spark, folder))


@query("all_levels_in_one_pass", "D-18 H-1", on_feedback("""
    SELECT industry, org, count(*) AS total_count, count(*) FILTER (sentiment = 'negative') AS neg_count,
      count(*) FILTER (sentiment = 'neutral') AS neu_count, count(*) FILTER (sentiment = 'positive') AS pos_count,
      CAST(grouping(industry) * 2 + grouping(org) AS BIGINT) AS level
    FROM feedback GROUP BY ROLLUP (industry, org)"""))
def all_levels_in_one_pass(spark, folder):
    return summaries.levels(derived.feedback(spark, folder), "industry", "org")


@query("cell_size_distribution", "D-22", on_cells("""
    SELECT DISTINCT total_count, count(*) OVER (PARTITION BY total_count) AS n,
      cume_dist() OVER (ORDER BY total_count) AS cum_share FROM cells"""))
def cell_size_distribution(spark, folder):
    return ranking.cumulative_share(derived.feedback_cells(spark, folder), "total_count")


@query("rate_histogram", "D-23", on_cells("""
    SELECT CAST(least(19, floor(neg_count * 20 / total_count)) AS BIGINT) AS bin, count(*) AS n
    FROM cells GROUP BY ALL"""))
def rate_histogram(spark, folder):
    cells = derived.feedback_cells(spark, folder)
    # twenty bins of 0.05 from integer counts, the last one closed at 1
    bin_no = F.floor(m.rate(F.col("neg_count") * 20, "total_count"))
    return (cells.groupBy(F.least(F.lit(19).cast("bigint"), bin_no).alias("bin"))
            .agg(F.count("*").alias("n")))


@query("size_histogram_log", "D-23", on_cells("""
    SELECT length(CAST(total_count AS VARCHAR)) - 1 AS decade, count(*) AS n FROM cells GROUP BY ALL"""
    .replace("length(CAST(total_count AS VARCHAR)) - 1",
             "CAST(length(CAST(total_count AS VARCHAR)) - 1 AS INT)")))
def size_histogram_log(spark, folder):
    cells = derived.feedback_cells(spark, folder)
    return (cells.groupBy((F.length(F.col("total_count").cast("string")) - 1).alias("decade"))
            .agg(F.count("*").alias("n")))


@query("shares_zero_when_empty", "E-4", on_feedback(
    "SELECT *, positive::DOUBLE / total AS pos_share, negative::DOUBLE / total AS neg_share, "
    "neutral::DOUBLE / total AS neu_share FROM ("
    + BREAKDOWN.format(keys="parent_aspect") + " GROUP BY ALL)"))
def shares_zero_when_empty(spark, folder):
    return summaries.add_shares(
        summaries.sentiment_breakdown(derived.feedback(spark, folder), "parent_aspect"))


@query("older_priority", "E-5", on_feedback(
    ", b AS (" + BREAKDOWN.format(keys="org, aspect") + """ GROUP BY ALL),
    s AS (SELECT *, positive::DOUBLE / total AS pos_share, negative::DOUBLE / total AS neg_share,
          neutral::DOUBLE / total AS neu_share FROM b),
    w AS (SELECT *, min(total) OVER p AS tl, max(total) OVER p AS th, min(neg_share) OVER p AS nl,
          max(neg_share) OVER p AS nh FROM s WINDOW p AS (PARTITION BY org))
    SELECT org, aspect, positive, negative, neutral, total, pos_share, neg_share, neu_share,
      CASE WHEN th = tl THEN 0e0 ELSE (total - tl)::DOUBLE / (th - tl) END
      + CASE WHEN nh = nl THEN 0e0 ELSE (neg_share - nl) / (nh - nl) END AS priority FROM w"""))
def older_priority(spark, folder):
    breakdown = summaries.sentiment_breakdown(derived.feedback(spark, folder), "org", "aspect")
    return summaries.add_priority(summaries.add_shares(breakdown), ["org"])


@query("polarisation_by_topic", "E-6 E-7", on_feedback(
    "SELECT *, positive + negative AS pol_volume, coalesce(least(positive, negative)::DOUBLE / "
    "nullif(positive + negative, 0), 0e0) AS polarisation FROM ("
    + BREAKDOWN.format(keys="industry, aspect") + " GROUP BY ALL)"))
def polarisation_by_topic(spark, folder):
    return summaries.add_polarisation(
        summaries.sentiment_breakdown(derived.feedback(spark, folder), "industry", "aspect"))


@query("rate_against_industry", "E-8 E-9", on_cells("""
    , i AS (SELECT industry, aspect, sum(neg_count)::DOUBLE / sum(total_count) AS r
            FROM cells GROUP BY ALL)
    SELECT org, aspect, neg_count::DOUBLE / total_count AS neg_rate, r AS industry_rate,
      neg_count::DOUBLE / total_count - r AS vs_industry,
      (neg_count::DOUBLE / total_count - r) * 100 AS gap_pp
    FROM cells JOIN i USING (industry, aspect) WHERE total_count >= 30"""))
def rate_against_industry(spark, folder):
    cells = derived.feedback_cells(spark, folder)
    whole = (cells.groupBy("industry", "aspect")
             .agg(m.rate(F.sum("neg_count"), F.sum("total_count")).alias("industry_rate")))
    own = summaries.with_rates(summaries.reportable(cells))
    joined = own.join(whole, ["industry", "aspect"])
    return joined.select("org", "aspect", "neg_rate", "industry_rate",
                         (F.col("neg_rate") - F.col("industry_rate")).alias("vs_industry"),
                         m.gap_points("neg_rate", "industry_rate").alias("gap_pp"))


@query("rest_of_industry", "E-10", on_cells("""
    , i AS (SELECT industry, aspect, sum(neg_count)::BIGINT AS k, sum(total_count)::BIGINT AS n
            FROM cells GROUP BY ALL)
    SELECT org, aspect, n - total_count AS rest_total, k - neg_count AS rest_neg
    FROM cells JOIN i USING (industry, aspect)"""))
def rest_of_industry(spark, folder):
    cells = derived.feedback_cells(spark, folder)
    whole = cells.groupBy("industry", "aspect").agg(F.sum("total_count").alias("n"),
                                                    F.sum("neg_count").alias("k"))
    joined = cells.join(whole, ["industry", "aspect"])
    return joined.select("org", "aspect", (F.col("n") - F.col("total_count")).alias("rest_total"),
                         (F.col("k") - F.col("neg_count")).alias("rest_neg"))
