"""Rankings, ties, frontiers, running values and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonescope.catalog.base import on_cells, on_feedback, on_steps, query
from tonescope.functions.measures import rate
from tonescope.operators import inference, ordered, ranking, runlogs, slices, summaries
from tonescope.sources import derived

SCORED = """, scored AS (SELECT industry, org, aspect, total_count, neg_count,
    neg_count::DOUBLE / total_count AS neg_rate FROM cells WHERE total_count >= 30)"""


def _scored(spark, folder):
    cells = summaries.reportable(derived.feedback_cells(spark, folder))
    return cells.select("industry", "org", "aspect", "total_count", "neg_count",
                        rate("neg_count", "total_count").alias("neg_rate"))


@query("rank_top_topics", "F-1 B-17", on_cells(SCORED + """
    SELECT org, aspect, rank, neg_rate, neg_count, total_count FROM (SELECT *,
      rank() OVER (PARTITION BY org ORDER BY neg_rate DESC) AS rank FROM scored) WHERE rank <= 3"""))
def rank_top_topics(spark, folder):
    ranked = ranking.rank_groups(_scored(spark, folder), "neg_rate", ["org"], top_k=3)
    return ranked.select("org", "aspect", "rank", "neg_rate", "neg_count", "total_count")


@query("rank_top_orgs_per_industry", "F-1 G-2", on_cells("""
    , s AS (SELECT industry, org, sum(neg_count)::BIGINT AS neg_count FROM cells GROUP BY ALL)
    SELECT * FROM (SELECT *, rank() OVER (PARTITION BY industry ORDER BY neg_count DESC) AS rank
      FROM s) WHERE rank <= 5"""))
def rank_top_orgs_per_industry(spark, folder):
    sizes = (derived.feedback_cells(spark, folder).groupBy("industry", "org")
             .agg(F.sum("neg_count").alias("neg_count")))
    return ranking.rank_groups(sizes, "neg_count", ["industry"], top_k=5, wide=True)


@query("rank_whole_order", "F-2", on_cells(SCORED + """
    SELECT org, aspect, rank() OVER (PARTITION BY org ORDER BY neg_rate) AS rank,
      count(*) OVER (PARTITION BY org) AS n_groups_available FROM scored"""))
def rank_whole_order(spark, folder):
    ranked = ranking.rank_groups(_scored(spark, folder), "neg_rate", ["org"], top_k=None,
                                 ascending=True)
    return ranked.select("org", "aspect", "rank",
                         F.expr("count(*) OVER (PARTITION BY org)").alias("n_groups_available"))


@query("rank_all_cells", "F-2 G-5", on_cells("""
    SELECT org, aspect, neg_count, rank() OVER (ORDER BY neg_count DESC) AS rank FROM cells"""))
def rank_all_cells(spark, folder):
    cells = derived.feedback_cells(spark, folder).select("org", "aspect", "neg_count")
    return ranking.wide_rank(cells, "neg_count")


@query("rank_after_exclusion", "F-3 B-11", on_cells(SCORED + """
    SELECT org, aspect, rank FROM (SELECT *, rank() OVER (PARTITION BY org ORDER BY neg_rate DESC) AS rank
      FROM scored WHERE aspect NOT IN ('Brand#1', 'Brand#2', 'Brand#3')) WHERE rank <= 3"""))
def rank_after_exclusion(spark, folder):
    ranked = ranking.rank_groups(_scored(spark, folder), "neg_rate", ["org"],
                                 exclude=("aspect", derived.NON_ACTIONABLE_TOPICS))
    return ranked.select("org", "aspect", "rank")


@query("rank_excluded_names", "F-4", on_cells(SCORED + """
    SELECT org, string_agg(aspect, ',' ORDER BY aspect) AS excluded FROM scored
    WHERE aspect IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY org"""))
def rank_excluded_names(spark, folder):
    hit = _scored(spark, folder).where(F.col("aspect").isin(derived.NON_ACTIONABLE_TOPICS))
    return hit.groupBy("org").agg(
        F.array_join(F.array_sort(F.collect_list("aspect")), ",").alias("excluded"))


@query("rank_joint_places", "F-5", on_cells(SCORED + """
    SELECT org, rank, string_agg(aspect, ',' ORDER BY aspect) AS groups, count(*) AS n_groups
    FROM (SELECT *, rank() OVER (PARTITION BY org ORDER BY neg_rate DESC) AS rank FROM scored)
    WHERE rank <= 3 GROUP BY ALL"""))
def rank_joint_places(spark, folder):
    ranked = ranking.rank_groups(_scored(spark, folder), "neg_rate", ["org"], top_k=3)
    return ranking.joint_places(ranked, "aspect", ["org"])


@query("rank_tied_scores", "F-6", on_cells("""
    SELECT org, neg_count::DOUBLE / total_count AS neg_rate, count(*) AS n_groups FROM cells
    GROUP BY ALL HAVING count(*) > 1"""))
def rank_tied_scores(spark, folder):
    rated = summaries.with_rates(derived.feedback_cells(spark, folder))
    return ranking.tied_scores(rated, "neg_rate", ["org"])


@query("cost_score_frontier", "F-7 L-15", on_steps("""
    , a AS (SELECT agent || '-' || seed AS agent, sum(tokens)::BIGINT AS cost, count(DISTINCT run_id) AS score
            FROM steps GROUP BY ALL),
    f AS (SELECT *, max(score) OVER (ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
    SELECT agent, cost, score FROM f WHERE seen IS NULL OR score > seen"""))
def cost_score_frontier(spark, folder):
    steps = derived.logged_steps(spark, folder)
    agents = (steps.groupBy(F.concat_ws("-", "agent", "seed").alias("agent"))
              .agg(F.sum("tokens").alias("cost"), F.count_distinct("run_id").alias("score")))
    return inference.frontier(agents, "cost", "score")


@query("volume_rate_frontier", "F-7 L-15", on_cells("""
    , o AS (SELECT industry, org, sum(total_count)::BIGINT AS total_count, sum(neg_count) / sum(total_count)::DOUBLE AS neg_rate
            FROM cells GROUP BY ALL),
    b AS (SELECT industry, total_count, max(neg_rate) AS best FROM o GROUP BY ALL),
    f AS (SELECT *, max(best) OVER (PARTITION BY industry ORDER BY total_count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            AS seen FROM b)
    SELECT o.* FROM o JOIN f ON o.industry = f.industry AND o.total_count = f.total_count AND neg_rate = best
    WHERE seen IS NULL OR best > seen"""))
def volume_rate_frontier(spark, folder):
    """Per industry the organisations that no organisation with as few labels matches in its negative rate."""
    orgs = derived.feedback_cells(spark, folder).groupBy("industry", "org").agg(
        F.sum("total_count").alias("total_count"), (F.sum("neg_count") / F.sum("total_count")).alias("neg_rate"))
    return inference.frontier(orgs, "total_count", "neg_rate", ["industry"])


@query("tokens_against_budget", "F-8", on_steps("""
    SELECT run_id, idx, sum(tokens) OVER (PARTITION BY run_id ORDER BY idx)::BIGINT AS spent,
      sum(tokens) OVER (PARTITION BY run_id ORDER BY idx) > 50000 AS over_budget FROM steps"""))
def tokens_against_budget(spark, folder):
    steps = derived.run_steps(spark, folder).withColumn("block", F.expr(f"idx div {ordered.BLOCK}"))
    spent = ordered.running_sum(steps, ["run_id"], "block", ["idx"], F.col("tokens"), "spent")
    return spent.select("run_id", "idx", "spent", (F.col("spent") > 50000).alias("over_budget"))


@query("identical_reply_streaks", "F-9", on_steps("""
    , f AS (SELECT *, CASE WHEN lag(tool) OVER w IS DISTINCT FROM tool THEN 1 ELSE 0 END AS fresh
            FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY idx) AS island FROM f)
    SELECT run_id, min(idx) AS first_idx, max(idx) AS last_idx, tool AS reply, count(*) AS streak
    FROM g GROUP BY run_id, island, tool HAVING count(*) >= 2"""))
def identical_reply_streaks(spark, folder):
    steps = derived.run_steps(spark, folder).select("run_id", "idx", F.col("tool").alias("reply"))
    return runlogs.reply_streaks(steps).where("streak >= 2")


@query("best_to_second_margin", "F-10 N-5", on_cells(SCORED + """
    , r AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY neg_rate DESC) AS rn FROM scored)
    SELECT org, max(neg_rate) FILTER (rn = 1) - max(neg_rate) FILTER (rn = 2) AS margin
    FROM r GROUP BY org"""))
def best_to_second_margin(spark, folder):
    return ranking.best_margin(_scored(spark, folder), "neg_rate", ["org"])


@query("worst_topic_of_org", "F-11", on_cells(SCORED + """
    SELECT org, aspect, neg_rate FROM (SELECT *, row_number() OVER
      (PARTITION BY org ORDER BY neg_rate DESC, aspect) AS rn FROM scored) WHERE rn = 1"""))
def worst_topic_of_org(spark, folder):
    return ranking.worst_of(_scored(spark, folder), "aspect", "neg_rate", ["org"])


@query("top_cut_cells", "G-1 G-3", on_cells("""
    SELECT org, aspect, total_count FROM cells ORDER BY total_count DESC, org, aspect LIMIT 20"""))
def top_cut_cells(spark, folder):
    cells = derived.feedback_cells(spark, folder).select("org", "aspect", "total_count")
    return ranking.top_cut(cells, "total_count", 20, ["org", "aspect"])


@query("top_cut_per_industry", "G-2", on_cells("""
    SELECT * FROM (SELECT industry, org, aspect, neg_count, row_number() OVER
      (PARTITION BY industry ORDER BY neg_count DESC, org, aspect) AS position FROM cells)
    WHERE position <= 10"""))
def top_cut_per_industry(spark, folder):
    cells = derived.feedback_cells(spark, folder).select("industry", "org", "aspect", "neg_count")
    return ranking.top_cut_within(cells, "neg_count", 10, ["industry"], ["org", "aspect"])


@query("clamped_top_k", "G-4", on_feedback("""
    SELECT org, least(3, count(DISTINCT aspect)) AS k FROM feedback WHERE sentiment = 'neutral'
    GROUP BY org"""))
def clamped_top_k(spark, folder):
    rows = slices.select_slice(derived.feedback(spark, folder), sentiment="neutral")
    return rows.groupBy("org").agg(
        F.least(F.lit(3).cast("bigint"), F.count_distinct("aspect")).alias("k"))


@query("gaps_nulls_last", "G-5 C-2", on_cells(SCORED + """
    SELECT a.org, a.aspect, (a.neg_rate - b.neg_rate) * 100 AS gap_pp FROM scored a
    LEFT JOIN scored b ON b.org = 'Supplier#000000003' AND a.aspect = b.aspect
    WHERE a.org <> 'Supplier#000000003'"""))
def gaps_nulls_last(spark, folder):
    scored = _scored(spark, folder)
    base = (scored.where("org = 'Supplier#000000003'")
            .select("aspect", F.col("neg_rate").alias("base_rate")))
    others = scored.where("org <> 'Supplier#000000003'")
    gap = ((F.col("neg_rate") - F.col("base_rate")) * 100).alias("gap_pp")
    return (others.join(base, "aspect", "left").select("org", "aspect", gap)
            .orderBy(F.desc_nulls_last("gap_pp")))
