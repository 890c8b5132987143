"""Ranks, top-k and quantiles.

Two forms of each rank. Where a scope holds one row per topic (a small vocabulary) a plain window
does it. Where it may hold any number of rows (all organisations of an industry), ties are first
collapsed to one row per distinct value in the map-side combine, the distinct values are cut into as
many ranges as their number needs, at approximate quantiles, and a range's offset is added to the rank
inside it. The cut points only balance the work; the ranks are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonescope.session import cut_lineage

#: Distinct values that one task orders with ease, and the parts into which a round cuts a larger range.
BUCKET, WAYS = 100_000, 256


def _order(by: str, ascending: bool):
    return F.col(by).asc() if ascending else F.col(by).desc()


def rank_groups(df: DataFrame, by: str, scope=(), top_k: int | None = 3, ascending: bool = False,
                exclude: tuple[str, list] | None = None, wide: bool = False) -> DataFrame:
    """Competition rank inside each scope: ties share a rank and `rank <= top_k` keeps them all.

    Excluded groups leave before ranks are taken, and so do rows without a value; rows whose scope is NULL form a scope.
    `wide=True` is for scopes of unbounded size and gives the same rows.
    """
    df = df.where(F.col(by).isNotNull())
    if exclude:
        column, names = exclude
        df = df.where(F.coalesce(~F.col(column).isin(list(names)), F.lit(True)))
    if wide:
        return (wide_rank(df, by, scope, ascending) if top_k is None
                else wide_top(df, by, scope, top_k, ascending))
    window = Window.partitionBy(*scope).orderBy(_order(by, ascending))
    ranked = df.withColumn("rank", F.rank().over(window).cast("bigint"))
    return ranked if top_k is None else ranked.where(F.col("rank") <= top_k)


def null_safe_join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Inner join on `keys`, where NULL equals NULL; the keys appear once."""
    named = right.withColumnsRenamed({k: f"_{k}_right" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_right"))
    return left.join(named, same).drop(*[f"_{k}_right" for k in keys])


def _distinct_values(df: DataFrame, by: str, scope) -> DataFrame:
    return (df.where(F.col(by).isNotNull()).groupBy(*scope, by)
            .agg(F.count("*").alias("_n")))


def _largest(values: DataFrame, keys) -> int:
    counted = values.groupBy(*keys).agg(F.count("*").alias("n")) if keys else values.agg(F.count("*").alias("n"))
    return counted.agg(F.max("n")).first()[0] or 0


def in_buckets(values: DataFrame, by: str, scope, most: int = 0) -> tuple[DataFrame, list[str]]:
    """The distinct values of every scope cut into ranges of at most `most` values, and the columns that name a range.

    A round cuts every range into up to WAYS parts at quantiles that come from a mergeable sketch, so the number of ranges
    follows the data: none are cut where a scope is small, and each round takes WAYS times as many values. The names grow
    with the values. `values` is written once a round.
    """
    most = most or BUCKET
    placed, names = cut_lineage(values), []
    points = [i / WAYS for i in range(1, WAYS)]
    while _largest(placed, [*scope, *names]) > most:
        keys = [*scope, *names]
        cuts = F.percentile_approx(by, points, 8 * WAYS)
        if keys:
            placed = null_safe_join(placed, placed.groupBy(*keys).agg(cuts.alias("_cuts")), keys)
        else:
            placed = placed.withColumn("_cuts", placed.agg(cuts).scalar())
        names = [*names, f"_range{len(names)}"]
        placed = cut_lineage(placed.withColumn(names[-1], F.size(F.filter("_cuts", lambda c: c < F.col(by)))).drop("_cuts"))
    return placed, names


def cumulative_counts(df: DataFrame, by: str, scope, ascending: bool, most: int = 0) -> DataFrame:
    """(scope, value, _n, _before): how many rows come strictly before each distinct value.

    Inside a range of values a window counts; a range starts where the ranges before it end.
    """
    scope = list(scope)
    placed, names = in_buckets(_distinct_values(df, by, scope), by, scope, most)
    inside = (Window.partitionBy(*scope, *names).orderBy(_order(by, ascending))
              .rowsBetween(Window.unboundedPreceding, -1))
    told = F.coalesce(F.sum("_n").over(inside), F.lit(0))
    if not names:
        return placed.withColumn("_before", told).select(*scope, by, "_n", "_before")
    sizes = placed.groupBy(*scope, *names).agg(F.sum("_n").alias("_size"))
    earlier = (Window.partitionBy(*scope).orderBy(*[_order(n, ascending) for n in names])
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*scope, *names, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    return (null_safe_join(placed, offsets, [*scope, *names]).withColumn("_before", F.col("_offset") + told)
            .select(*scope, by, "_n", "_before"))


def wide_rank(df: DataFrame, by: str, scope=(), ascending: bool = False) -> DataFrame:
    """Competition rank over scopes of any size."""
    ranks = (cumulative_counts(df, by, scope, ascending)
             .select(*scope, by, (F.col("_before") + 1).cast("bigint").alias("rank")))
    return null_safe_join(df, ranks, [*scope, by])


def wide_top(df: DataFrame, by: str, scope=(), top_k: int = 3, ascending: bool = False):
    """Rows ranked `top_k` or better, ties kept, over scopes of any size.

    Each distinct value stands for at least one row, so the best k distinct values are enough;
    that row_number filter is applied inside every map task before anything is shuffled.
    """
    scope = list(scope)
    best = Window.partitionBy(*scope).orderBy(_order(by, ascending))
    leaders = (_distinct_values(df, by, scope)
               .withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= top_k))
    earlier = best.rowsBetween(Window.unboundedPreceding, -1)
    ranks = (leaders.withColumn("rank", (1 + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
                                .cast("bigint"))
             .where(F.col("rank") <= top_k).select(*scope, by, "rank"))
    return null_safe_join(df, ranks, [*scope, by])


def top_cut(df: DataFrame, by: str, n: int, tie_break, ascending: bool = False) -> DataFrame:
    """Exactly the first n rows; the tie-break makes the cut repeatable."""
    return df.orderBy(_order(by, ascending), *tie_break).limit(n)


def top_cut_within(df: DataFrame, by: str, n: int, scope, tie_break, ascending: bool = False):
    """Exactly the first n rows of every scope; the filter is pushed into the map side."""
    window = Window.partitionBy(*scope).orderBy(_order(by, ascending), *tie_break)
    return (df.withColumn("position", F.row_number().over(window).cast("bigint"))
            .where(F.col("position") <= n))


def joint_places(ranked: DataFrame, group: str, scope) -> DataFrame:
    """Groups sharing a rank, named together. For scopes over a small vocabulary."""
    names = F.array_join(F.array_sort(F.collect_list(group)), ",")
    return ranked.groupBy(*scope, "rank").agg(names.alias("groups"),
                                              F.count("*").alias("n_groups"))


def tied_scores(df: DataFrame, by: str, scope) -> DataFrame:
    """Scores held by more than one group of a scope."""
    return (df.groupBy(*scope, by).agg(F.count("*").alias("n_groups"))
            .where(F.col("n_groups") > 1))


def best_margin(df: DataFrame, by: str, scope) -> DataFrame:
    """Distance between the best and the second-best row of each scope (NULL with one row)."""
    window = Window.partitionBy(*scope).orderBy(F.col(by).desc())
    return (df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= 2)
            .groupBy(*scope)
            .agg((F.max(F.when(F.col("_rn") == 1, F.col(by)))
                  - F.max(F.when(F.col("_rn") == 2, F.col(by)))).alias("margin")))


def worst_of(df: DataFrame, group: str, by: str, scope) -> DataFrame:
    """The group with the highest value; ties go to the alphabetically first."""
    # the lowest of (-value, name) is the highest value with the first name
    pick = F.min(F.struct((-F.col(by)).alias("v"), F.col(group).alias("g")))
    return (df.groupBy(*scope).agg(pick.alias("_p"))
            .select(*scope, F.col("_p.g").alias(group), (-F.col("_p.v")).alias(by)))


def quantiles(df: DataFrame, by: str, points, scope=()) -> DataFrame:
    """Exact quantiles with linear interpolation, for groups of any size.

    Returns one row per (scope, q). Works on counts of distinct values, never on a collected group.
    """
    scope = list(scope)
    spread = cumulative_counts(df, by, scope, True)
    size = F.sum("_n").alias("_total")
    if scope:
        placed = null_safe_join(spread, spread.groupBy(*scope).agg(size), scope)
    else:
        placed = spread.withColumn("_total", spread.agg(size).scalar())
    asked = placed.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    target = (F.col("_total") - 1) * F.col("q")
    last = F.col("_before") + F.col("_n") - 1
    lower, upper = F.floor(target), F.ceil(target)
    is_low = (F.col("_before") <= lower) & (lower <= last)
    is_high = (F.col("_before") <= upper) & (upper <= last)
    value = F.col(by).cast("double")
    picked = (asked.where(is_low | is_high).groupBy(*scope, "q")
              .agg(F.max(F.when(is_low, value)).alias("_lo"),
                   F.max(F.when(is_high, value)).alias("_hi"),
                   F.max(target - lower).alias("_w")))
    return picked.select(*scope, "q",
                         (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")).alias("value"))


def cumulative_share(df: DataFrame, by: str, scope=()) -> DataFrame:
    """Empirical distribution: per distinct value, the share of rows at or below it."""
    scope = list(scope)
    spread = cumulative_counts(df, by, scope, True)
    size = F.sum("_n").alias("_total")
    if scope:
        placed = null_safe_join(spread, spread.groupBy(*scope).agg(size), scope)
    else:
        placed = spread.withColumn("_total", spread.agg(size).scalar())
    at_or_below = (F.col("_before") + F.col("_n")).cast("double")
    return placed.select(*scope, by, F.col("_n").alias("n"),
                         (at_or_below / F.col("_total")).alias("cum_share"))
