"""The first generation of questions: component solvers, composites and replay checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescope.functions import measures as m
from tonescope.operators import inference, ranking, slices, summaries
from tonescope.session import cut_lineage

DRIVER_FLOOR = 5


def _wide(cells: DataFrame, *keys) -> DataFrame:
    """A sentiment breakdown read off the cell table."""
    table = cells.groupBy(*keys).agg(F.sum("pos_count").alias("positive"),
                                     F.sum("neg_count").alias("negative"),
                                     F.sum("neu_count").alias("neutral"))
    total = F.col("positive") + F.col("negative") + F.col("neutral")
    return summaries.add_shares(table.withColumn("total", total))


def count_or_share(cells: DataFrame, sentiment_column: str = "neg_count") -> DataFrame:
    """How many labels of a segment x topic have the sentiment, and their share."""
    return cells.select("segment", "aspect", F.col("total_count").alias("n"),
                        F.col(sentiment_column).alias("count"),
                        m.rate(sentiment_column, "total_count").alias("share"))


def top_topics(cells: DataFrame, k: int, by: str = "neg_count") -> DataFrame:
    """The k topics with the most labels (or complaints), cut to exactly k per segment."""
    some = cells.where(F.col(by) > 0).select("segment", "aspect", F.col(by).alias("count"))
    return ranking.top_cut_within(some, "count", k, ["segment"], ["aspect"])


def split(cells: DataFrame, *keys) -> DataFrame:
    return _wide(cells, *keys)


def compare_shares(pairs: DataFrame, cells: DataFrame, sentiment_column: str = "neg_count"):
    """Two shares side by side; an empty side counts as 0 when deciding which is higher."""
    sides = inference.pair_sides(pairs, cells, "segment", positive=sentiment_column)
    a, b = m.rate("neg_a", "total_a"), m.rate("neg_b", "total_b")
    higher = F.when(F.coalesce(a, F.lit(0.0)) > F.coalesce(b, F.lit(0.0)), "a").otherwise("b")
    return sides.select("a", "b", "aspect", a.alias("share_a"), b.alias("share_b"),
                        higher.alias("higher"))


def drivers(cells: DataFrame, k: int = 3, floor: int = DRIVER_FLOOR, table: DataFrame | None = None) -> DataFrame:
    """Topics by negative share with a small volume guard, cut to k per segment. `table`: their split, where there is one."""
    guarded = slices.min_volume(_wide(cells, "segment", "aspect") if table is None else table, floor)
    return ranking.top_cut_within(guarded, "neg_share", k, ["segment"], ["aspect"]).select(
        "segment", "aspect", "neg_share", "total", "position")


def prioritised(cells: DataFrame, k: int = 3, table: DataFrame | None = None) -> DataFrame:
    """Topics by min-max volume plus min-max negative share inside each segment. `table`: as for `drivers`."""
    scored = summaries.add_priority(_wide(cells, "segment", "aspect") if table is None else table, ["segment"])
    return ranking.top_cut_within(scored, "priority", k, ["segment"], ["aspect"]).select(
        "segment", "aspect", "priority", "position")


def composite(cells: DataFrame, homes: DataFrame, kinds=("compare", "recommend", "report")):
    """Several component answers of every organisation as one long table.

    Rows are (segment, component, position, label, value). `homes` maps a segment to its industry,
    whose own answers appear as the industry components.
    """
    own = homes.select("segment").distinct()

    def part(name, df, label, value, position=None):
        # Each component is written by itself: the branches of a union may share tasks, which would hold the sorts of all.
        place = F.lit(1).cast("bigint") if position is None else F.col(position)
        return cut_lineage(df.select("segment", F.lit(name).alias("component"), place.alias("position"),
                                     label.alias("label"), value.cast("double").alias("value")))

    parts = []
    cells, own = cut_lineage(cells), cut_lineage(own)
    of_org = cells.join(own, "segment", "left_semi")
    table = cut_lineage(_wide(cells, "segment", "aspect"))
    if "compare" in kinds:
        driven = cut_lineage(drivers(cells, table=table))
        parts.append(part("org_drivers", driven.join(own, "segment", "left_semi"), F.col("aspect"), F.col("neg_share"),
                          "position"))
        # A few rows per industry, written so that their size is known and the homes aren't dealt by industry.
        industry = cut_lineage(driven.withColumnRenamed("segment", "industry")
                               .join(homes.select("industry").distinct(), "industry", "left_semi"))
        parts.append(part("industry_drivers", homes.join(industry, "industry").drop("industry"), F.col("aspect"),
                          F.col("neg_share"), "position"))
    if "recommend" in kinds or "report" in kinds:
        overview = cut_lineage(split(of_org, "segment"))
        for s in ("pos_share", "neg_share", "neu_share"):
            parts.append(part("overview", overview, F.lit(s), F.col(s)))
    if "report" in kinds:
        parts.append(part("top_complaints", top_topics(of_org, 3), F.col("aspect"),
                          F.col("count"), "position"))
        parts.append(part("priorities", prioritised(of_org, table=table.join(own, "segment", "left_semi")),
                          F.col("aspect"), F.col("priority"), "position"))
    return reduce(DataFrame.unionByName, parts)


def describe(df: DataFrame, group_by: str = "aspect", top_n: int = 5, **fields) -> DataFrame:
    """Labels counted by one dimension under optional filters, largest first."""
    counted = summaries.count_by(slices.keep_equal(df, **fields), group_by)
    return ranking.top_cut(counted, "count", top_n, [group_by])


def infer(df: DataFrame, field: str, a: str, b: str, **fields) -> DataFrame:
    """Chi-squared between two groups of one dimension."""
    rows = slices.keep_equal(df, **fields)
    counts = [F.count_if((F.col(field) == value) & (F.col("sentiment") == label)).alias(
        f"{short}_{side}") for side, value in (("a", a), ("b", b))
        for short, label in (("neg", "negative"), ("neu", "neutral"), ("pos", "positive"))]
    return inference.chi_squared(rows.where(F.col(field).isin(a, b)).agg(*counts))


def scope_report(cells: DataFrame, k: int = 3) -> DataFrame:
    """Mix and top complaints of every scope in one row."""
    mix = split(cells, "segment")
    tops = (top_topics(cells, k).groupBy("segment")
            .agg(F.array_sort(F.collect_list(F.struct("position", "aspect", "count")))
                 .alias("top_complaints")))
    return mix.join(tops, "segment", "left")


def polarised(df: DataFrame, scope, k: int = 3, floor: int = 30) -> DataFrame:
    """The most evenly split topics; neutrals count neither in the score nor in the floor."""
    table = summaries.add_polarisation(summaries.sentiment_breakdown(df, *scope, "aspect"))
    guarded = slices.min_volume(table, floor, "pol_volume")
    return ranking.top_cut_within(guarded, "polarisation", k, scope, ["aspect"])


def fragile_answers(ranked: DataFrame, asked: int, scope=("segment",), value: str = "value"):
    """Rankings that hold fewer rows than asked for, or tie on their score."""
    return (ranked.groupBy(*scope)
            .agg(F.count("*").alias("held"), F.count_distinct(value).alias("scores"))
            .select(*scope, "held", (F.col("held") < asked).alias("short"),
                    (F.col("scores") < F.col("held")).alias("tied")))


def extreme_shares(shares: DataFrame, low: float = 0.1, high: float = 0.95) -> DataFrame:
    return shares.where((F.col("share") < low) | (F.col("share") > high))


def mismatches(got: DataFrame, stored: DataFrame, keys, value: str = "value",
               tolerance: float = 1e-4) -> DataFrame:
    """Answers, flattened to (keys..., value) rows, that differ by more than the tolerance.

    A path present on one side only is a mismatch; NULL equals only NULL.
    """
    a = got.select(*keys, F.col(value).alias("got"), F.lit(1).alias("_g"))
    b = stored.select(*keys, F.col(value).alias("stored"), F.lit(1).alias("_s"))
    both = a.join(b, list(keys), "full")
    near = F.coalesce(F.abs(F.col("got") - F.col("stored")) <= tolerance,
                      F.col("got").isNull() & F.col("stored").isNull())
    return both.where(F.col("_g").isNull() | F.col("_s").isNull() | ~near).drop("_g", "_s")
