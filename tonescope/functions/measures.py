"""Rates, shares and scores as Column expressions. Division never raises: an empty group is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonescope.schema import NON_ACTIONABLE


#: The count column of each sentiment.
COUNT_OF = {"negative": "neg_count", "neutral": "neu_count", "positive": "pos_count"}


def count_sentiment(label: str, column: str = "sentiment") -> Column:
    return F.count_if(F.col(column) == label)


def sentiment_counts(column: str = "sentiment") -> list[Column]:
    """total, negative, neutral and positive counts; a NULL sentiment counts in the total only."""
    return [F.count("*").alias("total_count"),
            count_sentiment("negative", column).alias("neg_count"),
            count_sentiment("neutral", column).alias("neu_count"),
            count_sentiment("positive", column).alias("pos_count")]


def rate(part: str | Column, whole: str | Column) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.try_divide(part.cast("double"), whole.cast("double"))


def rates(total: str = "total_count") -> list[Column]:
    return [rate(f"{s}_count", total).alias(f"{s}_rate") for s in ("neg", "neu", "pos")]


def prevalence(selection: Column | str = "selection_rows") -> Column:
    return rate("total_count", selection)


def priority_score() -> Column:
    """Share of the selection times its negative rate."""
    return F.col("prevalence") * F.col("neg_rate")


def share_or_zero(part: str, whole: str = "total") -> Column:
    return F.coalesce(rate(part, whole), F.lit(0.0))


def polarisation(positive: str = "positive", negative: str = "negative") -> Column:
    """0.5 for an even split of non-neutral labels, 0 for a one-sided or empty one."""
    both = F.col(positive) + F.col(negative)
    return F.coalesce(rate(F.least(positive, negative), both), F.lit(0.0))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0-1; a zero range gives 0."""
    span = (high - low).cast("double")
    return F.when(span != 0, (value - low).cast("double") / span).otherwise(F.lit(0.0))


def gap_points(a: str | Column, b: str | Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return (a - b) * 100


def actionable(column: str = "aspect", topics=None) -> Column:
    return ~F.col(column).isin(list(NON_ACTIONABLE if topics is None else topics))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
