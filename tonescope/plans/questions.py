"""The ten question templates, answered for every segment in one pass over the cell table.

A segment is an organisation or an industry. Every answer carries `abstain` and `reason`: thin and
absent data are different outcomes, so sides that do not exist appear with zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonescope.functions import measures as m
from tonescope.operators import frames, inference, ranking, summaries
from tonescope.schema import COUNT_COLUMNS, MIN_MENTIONS, NON_ACTIONABLE

# Abstention reasons.
THIN = "Cells have less than 30 reviews"
THIN_TEST = "Test cells have less than 10 reviews"
ABSENT = "Industry x aspect pair absent"
FEW = "Too few categories to rank"
NO_ACTIONABLE = "No actionable driver"
PARTIAL = "Partial"


def _segment():
    """A segment holds at most one row per topic, so windows over a segment stay small."""
    return Window.partitionBy("segment")


def segment_cells(cells: DataFrame) -> DataFrame:
    """(segment, kind, industry, aspect, counts): organisations, and industries summed from them."""
    orgs = cells.select(F.col("org").alias("segment"), F.lit("org").alias("kind"), "industry",
                        "aspect", *COUNT_COLUMNS)
    whole = (summaries.roll_up(cells, ["industry", "aspect"])
             .select(F.col("industry").alias("segment"), F.lit("industry").alias("kind"),
                     "industry", "aspect", *COUNT_COLUMNS))
    return orgs.unionByName(whole)


def single_rate(segments: DataFrame, floor: int = MIN_MENTIONS) -> DataFrame:
    """T1: the three rates of every segment x topic of the full frame."""
    frame = frames.full_frame(segments, "segment", "aspect")
    counts = segments.select("segment", "aspect", *COUNT_COLUMNS)
    placed = frames.reindexed(frame, counts, ["segment", "aspect"], COUNT_COLUMNS)
    reason = (F.when(F.col("total_count") == 0, ABSENT)
              .when(F.col("total_count") < floor, THIN))
    told = [F.when(F.col("total_count") >= floor, r).alias(n) for r, n in zip(
        [m.rate(f"{s}_count", "total_count") for s in ("neg", "neu", "pos")],
        ["neg_rate", "neu_rate", "pos_rate"])]
    return placed.select("segment", "aspect", *COUNT_COLUMNS, *told,
                         (F.col("total_count") < floor).alias("abstain"), reason.alias("reason"))


def distribution(segments: DataFrame, floor: int = MIN_MENTIONS) -> DataFrame:
    """T2: the sentiment mix of every segment."""
    totals = summaries.roll_up(segments, ["segment", "kind"])
    thin = F.col("total_count") < floor
    return summaries.with_rates(totals).select(
        "segment", "kind", *COUNT_COLUMNS, "neg_rate", "neu_rate", "pos_rate",
        thin.alias("abstain"), F.when(thin, THIN).alias("reason"))


def _topics_over(floor: int, column: str = "total_count") -> Column:
    return F.count_if(F.col(column) >= floor).over(_segment())


def top_complaints(segments: DataFrame, k: int = 3, floor: int = MIN_MENTIONS) -> DataFrame:
    """T3: topics with the most complaints; abstains where fewer than k topics clear the floor."""
    rated = segments.withColumn("n_topics", _topics_over(floor))
    order = _segment().orderBy(F.desc("neg_count"))
    first = _segment().orderBy("aspect")
    ranked = (rated.withColumn("rank", F.rank().over(order).cast("bigint"))
              .withColumn("_first", F.row_number().over(first)))
    abstain = F.col("n_topics") < k
    kept = ranked.where((~abstain & (F.col("rank") <= k) & (F.col("neg_count") > 0))
                        | (abstain & (F.col("_first") == 1)))
    told = [F.when(~abstain, F.col(c)).alias(c) for c in ("aspect", "rank", "neg_count")]
    return kept.select("segment", *told, "n_topics", abstain.alias("abstain"),
                       F.when(abstain, FEW).alias("reason"))


def which_is_higher(pairs: DataFrame, segments: DataFrame, floor: int = MIN_MENTIONS,
                    sentiment: str = "negative") -> DataFrame:
    """T4: which of two named segments has the higher rate of a sentiment on a topic."""
    sides = inference.pair_sides(pairs, segments, segment="segment", positive=m.COUNT_OF[sentiment])
    absent = (F.col("total_a") == 0) | (F.col("total_b") == 0)
    thin = (F.col("total_a") < floor) | (F.col("total_b") < floor)
    rate_a, rate_b = m.rate("neg_a", "total_a"), m.rate("neg_b", "total_b")
    higher = F.when(rate_a > rate_b, "a").when(rate_b > rate_a, "b").otherwise("equal")
    return sides.select("a", "b", "aspect", "total_a", "total_b", rate_a.alias("rate_a"),
                        rate_b.alias("rate_b"), F.when(~thin, higher).alias("higher"),
                        thin.alias("abstain"),
                        F.when(absent, ABSENT).when(thin, THIN).alias("reason"))


def significant_difference(pairs: DataFrame, segments: DataFrame, strict: bool = True,
                           sentiment: str = "negative") -> DataFrame:
    """T5: z-test between two named segments on a topic and a sentiment; abstains on thin test cells."""
    sides = inference.pair_sides(pairs, segments, segment="segment", positive=m.COUNT_OF[sentiment])
    tested = inference.proportions_test(sides, strict=strict)
    enough = F.coalesce("sufficient", F.lit(False))
    return tested.select(
        "a", "b", "aspect", "total_a", F.col("neg_a").alias("count_a"), "total_b", F.col("neg_b").alias("count_b"),
        F.when(enough, F.col("z")).alias("z"), F.when(enough, F.col("p_value")).alias("p_value"),
        F.when(enough, F.col("significant")).alias("significant"), (~enough).alias("abstain"),
        F.when(F.col("error").isNotNull(), ABSENT).when(~enough, THIN_TEST).alias("reason"))


def orgs_against_industry(cells: DataFrame, floor: int = MIN_MENTIONS) -> DataFrame:
    """T6: every organisation's rate beside its industry's, ranked inside (industry, topic).

    The industry average includes organisations below the floor; an industry may hold any number of
    organisations, so averages are joined and ranks use the wide form.
    """
    scope = ["industry", "aspect"]
    whole = cells.groupBy(*scope).agg(
        m.rate(F.sum("neg_count"), F.sum("total_count")).alias("industry_rate"),
        F.count_if(F.col("total_count") >= floor).alias("n_orgs"))
    rated = (cells.where(F.col("total_count") >= floor)
             .select("org", *scope, "total_count", "neg_count",
                     m.rate("neg_count", "total_count").alias("neg_rate")))
    ranked = ranking.wide_rank(rated, "neg_rate", scope)
    joined = ranked.join(whole, scope)
    abstain = F.col("n_orgs") < 2
    return joined.select("org", *scope, "total_count", "neg_count", "neg_rate", "rank",
                         "industry_rate",
                         (F.col("neg_rate") - F.col("industry_rate")).alias("vs_industry"),
                         "n_orgs", abstain.alias("abstain"), F.when(abstain, FEW).alias("reason"))


def biggest_driver(segments: DataFrame, floor: int = MIN_MENTIONS) -> DataFrame:
    """T7: the topic(s) with the highest negative rate among topics over the floor, ties kept."""
    over = F.col("total_count") >= floor
    # topics over the floor come first; their count tells a segment that has none
    order = _segment().orderBy(F.when(over, 0).otherwise(1),
                            F.when(over, m.rate("neg_count", "total_count")).desc())
    ranked = (segments.withColumn("n_topics", _topics_over(floor))
              .withColumn("_rank", F.rank().over(order))
              .withColumn("_first", F.row_number().over(_segment().orderBy("aspect"))))
    abstain = F.col("n_topics") == 0
    kept = ranked.where((~abstain & (F.col("_rank") == 1)) | (abstain & (F.col("_first") == 1)))
    told = [F.when(~abstain, c).alias(n) for c, n in (
        (F.col("aspect"), "aspect"), (F.col("total_count"), "total_count"),
        (F.col("neg_count"), "neg_count"), (m.rate("neg_count", "total_count"), "neg_rate"))]
    return kept.select("segment", *told, "n_topics", abstain.alias("abstain"),
                       F.when(abstain, THIN).alias("reason"))


def priorities(segments: DataFrame, non_actionable=NON_ACTIONABLE, k: int = 2,
               floor: int = MIN_MENTIONS) -> DataFrame:
    """T8: topics by prevalence x negative rate. The floor is on *negative* reviews.

    All eligible topics are ranked; `actionable` says which of the first k to recommend.
    """
    scored = summaries.summary_of_counts(segments, "aspect", ["segment"], min_n=floor,
                                         min_n_column="neg_count")
    eligible = (scored.withColumn("n_topics", F.count_if("reportable").over(_segment()))
                .where("reportable"))
    ranked = ranking.rank_groups(eligible, "priority_score", ["segment"], top_k=k)
    enough = F.col("n_topics") >= k
    return ranked.select("segment", "aspect", "rank", "prevalence", "neg_rate", "neg_count",
                         "priority_score", m.actionable(topics=non_actionable).alias("actionable"),
                         "n_topics", (~enough).alias("abstain"),
                         F.when(~enough, FEW).alias("reason"))


def _top_topics(segments: DataFrame, k: int, floor: int) -> DataFrame:
    rated = summaries.with_rates(segments.where(F.col("total_count") >= floor))
    return ranking.rank_groups(rated, "neg_rate", ["segment"], top_k=k)


def pair_gaps(pairs: DataFrame, segments: DataFrame, non_actionable=NON_ACTIONABLE, k: int = 3,
              floor: int = MIN_MENTIONS) -> DataFrame:
    """For every pair (a, b): a's top topics, b's rate on each (NULL below the floor), the gap."""
    tops = _top_topics(segments, k, floor).select(
        F.col("segment").alias("a"), "aspect", "rank", F.col("neg_rate").alias("rate_a"))
    other = (summaries.with_rates(segments.where(F.col("total_count") >= floor))
             .select(F.col("segment").alias("b"), "aspect", F.col("neg_rate").alias("rate_b")))
    joined = pairs.join(tops, "a", "left").join(other, ["b", "aspect"], "left")
    return joined.select("a", "b", "aspect", "rank", "rate_a", "rate_b",
                         m.gap_points("rate_a", "rate_b").alias("gap_pp"),
                         m.actionable(topics=non_actionable).alias("actionable"))


def why_worse(pairs: DataFrame, segments: DataFrame, non_actionable=NON_ACTIONABLE, k: int = 3,
              floor: int = MIN_MENTIONS) -> DataFrame:
    """T9: what a should fix first: its widest gap to b on an actionable topic among its top k.

    `premise` says whether a really is worse, in rate and in number of complaints.
    """
    gaps = pair_gaps(pairs, segments, non_actionable, k, floor)
    usable = F.col("actionable") & (F.col("gap_pp") > 0)
    # the smallest (-gap, topic) is the widest gap, first name on a tie
    pick = F.min(F.when(usable, F.struct((-F.col("gap_pp")).alias("g"), "aspect")))
    chosen = gaps.groupBy("a", "b").agg(
        pick.alias("_pick"), F.count("rate_b").alias("n_compared"),
        F.count_if(F.coalesce(F.col("gap_pp") > 0, F.lit(False))).alias("n_worse"))
    totals = summaries.roll_up(segments, ["segment"])

    def side(name):
        return totals.select(F.col("segment").alias(name),
                             m.rate("neg_count", "total_count").alias(f"overall_{name}"),
                             F.col("neg_count").alias(f"neg_{name}"))

    told = chosen.join(side("a"), "a").join(side("b"), "b")
    premise = (F.col("overall_a") > F.col("overall_b")) & (F.col("neg_a") > F.col("neg_b"))
    abstain = F.col("_pick").isNull()
    return told.select("a", "b", "overall_a", "overall_b", premise.alias("premise"),
                       "n_compared", "n_worse", F.col("_pick.aspect").alias("fix_first"),
                       (-F.col("_pick.g")).alias("gap_pp"), abstain.alias("abstain"),
                       F.when(abstain, NO_ACTIONABLE).alias("reason"))


def report_topics(cells: DataFrame, non_actionable=NON_ACTIONABLE, k: int = 3,
                  floor: int = MIN_MENTIONS) -> DataFrame:
    """Every top topic of every organisation, with each joint-first one tested against the rest.

    The quoted industry average includes the organisation; the test excludes it, as the samples
    must not overlap.
    """
    by_org = Window.partitionBy("org")
    over = F.col("total_count") >= floor
    mixed = (cells.withColumn("n_reviews", F.sum("total_count").over(by_org))
             .withColumn("n_negative", F.sum("neg_count").over(by_org))
             .withColumn("n_neutral", F.sum("neu_count").over(by_org))
             .withColumn("n_positive", F.sum("pos_count").over(by_org))
             .withColumn("n_topics", F.count_if(over).over(by_org))
             .withColumn("neg_rate", m.rate("neg_count", "total_count")))
    order = by_org.orderBy(F.when(over, 0).otherwise(1), F.desc("neg_rate"))
    placed = mixed.withColumn("rank", F.when(over, F.rank().over(order)).cast("bigint"))
    whole = cells.groupBy("industry", "aspect").agg(F.sum("total_count").alias("_n"),
                                                    F.sum("neg_count").alias("_k"))
    top = placed.where((F.col("rank") <= k) | (F.col("n_topics") == 0))
    sides = (top.join(whole, ["industry", "aspect"])
             .withColumn("industry_rate", m.rate("_k", "_n"))
             .withColumn("total_a", F.col("total_count")).withColumn("neg_a", F.col("neg_count"))
             .withColumn("total_b", F.col("_n") - F.col("total_count"))
             .withColumn("neg_b", F.col("_k") - F.col("neg_count")).drop("_n", "_k"))
    return (inference.proportions_test(sides)
            .withColumn("actionable", m.actionable(topics=non_actionable)))


def full_report(cells: DataFrame, non_actionable=NON_ACTIONABLE, k: int = 3,
                floor: int = MIN_MENTIONS) -> DataFrame:
    """T10: one row per organisation: mix, top issues, tested joint-first issues, roadmap.

    With fewer than k reportable topics the ranking and the roadmap are withheld (`status`).
    """
    topics = report_topics(cells, non_actionable, k, floor)
    ranked = F.col("rank").isNotNull()
    issue = F.struct("rank", "aspect", "neg_rate", "total_count")
    compared = F.struct("aspect", F.col("neg_rate").alias("rate"), "industry_rate",
                        F.col("rate_b").alias("rest_rate"), "gap_pp", "z", "p_value",
                        "significant", "sufficient")
    step = F.struct("rank", "aspect")
    mix = ["n_reviews", "n_negative", "n_neutral", "n_positive", "n_topics"]
    told = topics.groupBy("industry", "org", *mix).agg(
        F.array_sort(F.collect_list(F.when(ranked, issue))).alias("issues"),
        F.array_sort(F.collect_list(F.when(F.col("rank") == 1, compared))).alias("comparisons"),
        F.array_sort(F.collect_list(F.when(ranked & F.col("actionable"), step))).alias("roadmap"))
    full = F.col("n_topics") >= k
    reason = F.when(F.col("n_reviews") < floor, THIN).when(~full, PARTIAL)
    return told.select(
        "industry", "org", *mix, *[m.rate(f"n_{s}", "n_reviews").alias(f"{s}_share")
                                   for s in ("negative", "neutral", "positive")],
        F.when(full, F.col("issues")).alias("top_issues"), "comparisons",
        F.when(full, F.col("roadmap")).alias("roadmap"),
        F.when(full, "full").otherwise("partial").alias("status"), reason.alias("reason"))
