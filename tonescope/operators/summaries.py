"""Counting and rates for every slice at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonescope.functions import measures as m
from tonescope.operators.ranking import null_safe_join
from tonescope.schema import COUNT_COLUMNS, MIN_MENTIONS, SENTIMENTS, VOCABULARY_COLUMNS

CELL_KEYS = ["industry", "org", "parent_aspect", "aspect"]


def cells(df: DataFrame, keys=CELL_KEYS) -> DataFrame:
    """The cell table: counts by sentiment per key. Everything downstream reads this."""
    return df.groupBy(*keys).agg(*m.sentiment_counts())


def roll_up(cell_table: DataFrame, keys) -> DataFrame:
    """Cells summed to coarser keys."""
    return cell_table.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNT_COLUMNS])


def with_rates(df: DataFrame) -> DataFrame:
    return df.select("*", *m.rates())


def _with_total(counts: DataFrame, within, bounded: bool, name: str) -> DataFrame:
    """Attach the slice's row total. A window is used only where a slice holds few rows."""
    if not within:
        whole = counts.agg(F.sum("total_count")).scalar()
        return counts.withColumn(name, whole)
    if bounded:
        return counts.withColumn(name, F.sum("total_count").over(Window.partitionBy(*within)))
    totals = counts.groupBy(*within).agg(F.sum("total_count").alias(name))
    return null_safe_join(counts, totals, list(within))


def summary_of_counts(counts: DataFrame, group_by: str | None, within=(), min_n: int | None = None,
                      min_n_column: str = "total_count") -> DataFrame:
    """Rates, prevalence, priority and `reportable` from a table of counts.

    Prevalence divides by the whole selection: rows with a NULL group and groups below the floor
    stay in it. NULL groups leave only afterwards, and nothing is ranked before the floor is known.
    """
    if min_n_column not in COUNT_COLUMNS:
        raise ValueError(f"no count column {min_n_column!r}")
    bounded = group_by is None or group_by in VOCABULARY_COLUMNS
    table = _with_total(counts, within, bounded, "selection_rows")
    if group_by is not None:
        table = table.where(F.col(group_by).isNotNull())
    table = with_rates(table).withColumn("prevalence", m.prevalence())
    floor = F.lit(True) if min_n is None else F.col(min_n_column) >= min_n
    return (table.withColumn("priority_score", m.priority_score())
            .withColumn("reportable", floor))


def summarise(df: DataFrame, group_by: str | None = None, within=(), min_n: int | None = None,
              min_n_column: str = "total_count", keep_below: bool = False) -> DataFrame:
    """One row per group of each slice: counts, rates, prevalence and priority."""
    keys = [*within, *([group_by] if group_by else [])]
    counts = (df.groupBy(*keys) if keys else df.groupBy()).agg(*m.sentiment_counts())
    table = summary_of_counts(counts.where("total_count > 0"), group_by, within, min_n,
                              min_n_column)
    return table if keep_below else table.where("reportable").drop("reportable")


def below_floor(summary: DataFrame, group_by: str, within) -> DataFrame:
    """Groups dropped by the floor, named per slice. Groups come from a small vocabulary."""
    if group_by not in VOCABULARY_COLUMNS:
        return summary.where(~F.col("reportable")).select(*within, group_by)
    names = F.array_join(F.array_sort(F.collect_list(group_by)), ",")
    return (summary.where(~F.col("reportable")).groupBy(*within)
            .agg(names.alias("below_min_n")))


def count_by(df: DataFrame, *keys) -> DataFrame:
    """Rows per group; NULL groups are dropped."""
    kept = df.dropna(subset=list(keys))
    return kept.groupBy(*keys).agg(F.count("*").alias("count"))


def sentiment_breakdown(df: DataFrame, *keys) -> DataFrame:
    """positive / negative / neutral columns with 0 where absent; total counts these three."""
    kept = df.dropna(subset=list(keys)).where(F.col("sentiment").isin(SENTIMENTS))
    return kept.groupBy(*keys).agg(*[m.count_sentiment(s).alias(s)
                                     for s in ("positive", "negative", "neutral")],
                                   F.count("*").alias("total"))


def add_shares(breakdown: DataFrame) -> DataFrame:
    return breakdown.select("*", m.share_or_zero("positive").alias("pos_share"),
                            m.share_or_zero("negative").alias("neg_share"),
                            m.share_or_zero("neutral").alias("neu_share"))


def add_priority(shares: DataFrame, within=()) -> DataFrame:
    """Min-max volume plus min-max negative share, per scope: an aggregate joined back."""
    bounds = [F.min("total").alias("_tl"), F.max("total").alias("_th"),
              F.min("neg_share").alias("_nl"), F.max("neg_share").alias("_nh")]
    if within:
        with_bounds = shares.join(shares.groupBy(*within).agg(*bounds), list(within))
    else:
        edge = shares.agg(F.struct(*bounds)).scalar()
        with_bounds = (shares.withColumn("_b", edge)
                       .select("*", *[F.col(f"_b.{c}").alias(c)
                                      for c in ("_tl", "_th", "_nl", "_nh")]).drop("_b"))
    score = (m.min_max(F.col("total"), F.col("_tl"), F.col("_th"))
             + m.min_max(F.col("neg_share"), F.col("_nl"), F.col("_nh")))
    return with_bounds.withColumn("priority", score).drop("_tl", "_th", "_nl", "_nh")


def add_polarisation(breakdown: DataFrame) -> DataFrame:
    return (breakdown.withColumn("pol_volume", F.col("positive") + F.col("negative"))
            .withColumn("polarisation", m.polarisation()))


def share_of(df: DataFrame, sentiment: str, *keys) -> DataFrame:
    """n, count and share of one sentiment; the share of an empty slice is NULL."""
    if sentiment not in SENTIMENTS:
        raise ValueError(f"sentiment {sentiment!r} is not one of {SENTIMENTS}")
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return (grouped.agg(F.count("*").alias("n"), m.count_sentiment(sentiment).alias("count"))
            .withColumn("share", m.rate("count", "n")))


def value_shares(df: DataFrame, column: str, within=()) -> DataFrame:
    """Relative frequency of each value of `column` inside each slice."""
    counts = (df.where(F.col(column).isNotNull()).groupBy(*within, column)
              .agg(F.count("*").alias("total_count")))
    bounded = column in VOCABULARY_COLUMNS
    return (_with_total(counts, within, bounded, "slice_count")
            .withColumn("share", m.rate("total_count", "slice_count"))
            .withColumnRenamed("total_count", "n").drop("slice_count"))


def cross_tab(df: DataFrame, rows: str, column: str, values: list, normalise: bool = False):
    """Counts of `column` values per row key, or shares of the row total."""
    safe = [str(v) for v in values]
    wide = (df.where(F.col(rows).isNotNull()).groupBy(rows).pivot(column, values)
            .agg(F.count(F.lit(1))).na.fill(0, safe))
    if not normalise:
        return wide
    total = sum((F.col(v) for v in safe), F.lit(0))
    return wide.select(rows, *[m.rate(F.col(v), total).alias(v) for v in safe])


def levels(df: DataFrame, *keys) -> DataFrame:
    """Every level from a hierarchy to the grand total in one pass; NULL marks a rolled-up key."""
    return df.rollup(*keys).agg(*m.sentiment_counts(),
                                F.grouping_id().cast("bigint").alias("level"))


def weighted_mean(df: DataFrame, value: str, weight: str, *keys) -> DataFrame:
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    product = F.sum(F.col(value) * F.col(weight))
    return grouped.agg(F.avg(value).alias("plain_mean"),
                       F.try_divide(product, F.sum(weight)).alias("weighted_mean"))


def reportable(df: DataFrame, floor: int = MIN_MENTIONS) -> DataFrame:
    return df.where(F.col("total_count") >= floor)
