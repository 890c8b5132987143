"""Two-proportion tests, chi-squared and correlations over aggregated cells."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonescope.functions.measures import rate
from tonescope.functions.normal import correlation_p, with_p_values
from tonescope.operators.ranking import cumulative_counts
from tonescope.schema import ALPHA, MIN_TEST_CELL

ONE_SIDE_EMPTY = "one side has no reviews, so there is no rate to test"
NO_TEST_NOTE = "both sides are entirely negative or entirely non-negative, so no z-test is defined"


def sufficient(strict: bool = True, floor: int = MIN_TEST_CELL) -> Column:
    """All four cells above the floor (strict) or at least at it."""
    smallest = F.least("neg_a", F.col("total_a") - F.col("neg_a"),
                       "neg_b", F.col("total_b") - F.col("neg_b"))
    return smallest > floor if strict else smallest >= floor


def proportions_test(sides: DataFrame, alternative: str = "two-sided", strict: bool = True):
    """z-test on rows holding total_a, neg_a, total_b, neg_b.

    z and p are NULL, with a note, where the pooled rate is 0 or 1; an empty side gives `error`.
    """
    total = F.col("total_a") + F.col("total_b")
    pooled = rate(F.col("neg_a") + F.col("neg_b"), total)
    spread = F.sqrt(pooled * (1 - pooled)
                    * (rate(F.lit(1), "total_a") + rate(F.lit(1), "total_b")))
    neither_empty = (F.col("total_a") > 0) & (F.col("total_b") > 0)
    defined = neither_empty & (pooled > 0) & (pooled < 1)
    tested = (sides.withColumn("rate_a", rate("neg_a", "total_a"))
              .withColumn("rate_b", rate("neg_b", "total_b"))
              .withColumn("gap_pp", (F.col("rate_a") - F.col("rate_b")) * 100)
              .withColumn("sufficient", F.when(neither_empty, sufficient(strict)))
              .withColumn("z", F.when(defined, F.try_divide(F.col("rate_a") - F.col("rate_b"),
                                                            spread)))
              .withColumn("note", F.when(neither_empty & ~defined, F.lit(NO_TEST_NOTE)))
              .withColumn("error", F.when(~neither_empty, F.lit(ONE_SIDE_EMPTY))))
    with_p = with_p_values(tested, "z", alternative)
    return with_p.withColumn("significant", F.col("p_value") < ALPHA)


def older_proportions_test(sides: DataFrame) -> DataFrame:
    """The earlier contract: zero spread gives z = 0 and p = 1, `higher` is b on a tie."""
    tested = proportions_test(sides).drop("note", "sufficient", "gap_pp", "significant", "p_value")
    filled = tested.withColumn("z", F.when(F.col("error").isNull(),
                                           F.coalesce("z", F.lit(0.0))))
    higher = F.when(F.col("error").isNull(),
                    F.when(F.col("rate_a") > F.col("rate_b"), "a").otherwise("b"))
    return (with_p_values(filled, "z").withColumn("significant", F.col("p_value") < ALPHA)
            .withColumn("higher", higher))


def against_rest(cells: DataFrame, scope=("industry", "aspect"), own=("org",)) -> DataFrame:
    """Each organisation against its industry minus itself, per topic: one test row per cell.

    Industry totals come from an aggregate joined back (one row per scope), not from a window over
    every organisation of an industry. The average including the organisation is returned too.
    """
    scope = list(scope)
    mine = cells.select(*scope, *own, F.col("total_count").alias("total_a"),
                        F.col("neg_count").alias("neg_a"))
    whole = mine.groupBy(*scope).agg(F.sum("total_a").alias("scope_total"),
                                     F.sum("neg_a").alias("scope_neg"))
    sides = (mine.join(whole, scope)
             .withColumn("total_b", F.col("scope_total") - F.col("total_a"))
             .withColumn("neg_b", F.col("scope_neg") - F.col("neg_a"))
             .withColumn("scope_rate", rate("scope_neg", "scope_total")))
    return proportions_test(sides.drop("scope_total", "scope_neg"))


def pair_sides(pairs: DataFrame, cells: DataFrame, segment: str = "org", topic: str = "aspect",
               positive: str = "neg_count") -> DataFrame:
    """Both sides of each requested (a, b, topic); a side without reviews shows as zeros.

    Two equi-joins on (segment, topic): pairs are given, never generated inside a group.
    """
    slim = cells.select(F.col(segment).alias("_s"), F.col(topic).alias("_t"),
                        F.col("total_count").alias("_n"), F.col(positive).alias("_k"))

    def attach(df, name):
        side = slim.select(F.col("_s").alias(name), F.col("_t").alias(topic),
                           F.col("_n").alias(f"total_{name}"), F.col("_k").alias(f"neg_{name}"))
        return (df.join(side, [name, topic], "left")
                .na.fill(0, [f"total_{name}", f"neg_{name}"]))

    return attach(attach(pairs, "a"), "b")


def chi_squared(sides: DataFrame) -> DataFrame:
    """3 sentiments x 2 slices from columns neg/neu/pos_a and neg/neu/pos_b.

    Two degrees of freedom, so p = exp(-chi2 / 2) exactly. A sentiment absent from both slices or
    an empty slice gives `error` and no number.
    """
    labels = ["pos", "neg", "neu"]
    n_a = sum((F.col(f"{s}_a") for s in labels[1:]), F.col("pos_a"))
    n_b = sum((F.col(f"{s}_b") for s in labels[1:]), F.col("pos_b"))
    df = sides.withColumn("n_a", n_a).withColumn("n_b", n_b)
    total = F.col("n_a") + F.col("n_b")
    complete = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    for s in labels:
        complete = complete & (F.col(f"{s}_a") + F.col(f"{s}_b") > 0)

    def term(s, side):
        both = (F.col(f"{s}_a") + F.col(f"{s}_b")).cast("double")
        expected = rate(both * F.col(f"n_{side}"), total)
        gap = F.col(f"{s}_{side}") - expected
        return F.try_divide(gap * gap, expected)

    terms = [term(s, side) for s in labels for side in ("a", "b")]
    chi2 = sum(terms[1:], terms[0])
    error = F.when(~complete, F.lit("a sentiment or a slice has no reviews"))
    return (df.withColumn("chi2", F.when(complete, chi2))
            .withColumn("p_value", F.exp(-F.col("chi2") / 2))
            .withColumn("significant", F.col("p_value") < ALPHA)
            .withColumn("error", error))


def correlation_table(df: DataFrame, columns, keys=()) -> DataFrame:
    """Pearson correlation of every column pair, long form: one aggregate pass."""
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    pairs = list(combinations(columns, 2))
    parts = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), safe_correlation(a, b).alias("r"),
                      F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"))
             for a, b in pairs]
    return (grouped.agg(F.array(*parts).alias("_p")).select(*keys, F.inline("_p")))


def safe_correlation(x: str, y: str) -> Column:
    """Pearson r over complete pairs; NULL when either side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a = F.when(both, F.col(x).cast("double"))
    b = F.when(both, F.col(y).cast("double"))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    # the built-in corr divides by zero on a constant column, which ANSI mode makes an error
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(varies, F.try_divide(F.covar_pop(a, b), spread))


def average_ranks(df: DataFrame, keys, columns) -> DataFrame:
    """Each column's average rank (ties share the mean), for tables of any size.

    `keys` identify a row. All columns are ranked together in one long table (metric, value) and
    come back side by side under their own names.
    """
    items = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
             for c in columns]
    long = df.select(*keys, F.inline(F.array(*items)))
    mean = F.col("_before") + (F.col("_n") + 1) / 2
    ranks = cumulative_counts(long, "value", ["metric"], True).select(
        "metric", "value", mean.cast("double").alias("rank"))
    return (long.join(ranks, ["metric", "value"]).groupBy(*keys)
            .agg(*[F.max(F.when(F.col("metric") == c, F.col("rank"))).alias(c)
                   for c in columns]))


def spearman_table(df: DataFrame, keys, columns) -> DataFrame:
    """Spearman correlation and p-value of every column pair over complete rows."""
    ranked = average_ranks(df.dropna(subset=list(columns)), keys, columns)
    return correlation_table(ranked, columns).select(
        "x", "y", F.col("r").alias("rho"), "n",
        correlation_p("r", F.col("n").cast("double")).alias("p_value"))


def frontier(df: DataFrame, cost: str, score: str, scope=(), most: int = 0) -> DataFrame:
    """Rows that no cheaper (or equally cheap, earlier) row of their scope matches on score.

    Two phases: ties on cost keep their best score, the cost levels are cut into ranges and each range keeps its own
    frontier; a range's frontier then counts from the best score of all cheaper ranges. Rows without cost or score
    are on no frontier.
    """
    from tonescope.operators.ranking import in_buckets, null_safe_join
    scope = list(scope)
    known = df.where(F.col(cost).isNotNull() & F.col(score).isNotNull())
    best, names = in_buckets(known.groupBy(*scope, cost).agg(F.max(score).alias("_best")), cost, scope, most)
    keys = [*scope, *names]
    # Without a scope and in one range, all cost levels (at most BUCKET) are one group.
    cheaper = (Window.partitionBy(*keys or [F.lit(0)]).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    local = best.withColumn("_seen", F.max("_best").over(cheaper)).where("_seen IS NULL OR _best > _seen")
    if names:
        before = (Window.partitionBy(*scope or [F.lit(0)]).orderBy(*names)
                  .rowsBetween(Window.unboundedPreceding, -1))
        tops = best.groupBy(*keys).agg(F.max("_best").alias("_top"))
        tops = tops.select(*keys, F.max("_top").over(before).alias("_above"))
        local = null_safe_join(local, tops, keys).where("_above IS NULL OR _best > _above")
    return null_safe_join(df, local.select(*scope, cost, F.col("_best").alias(score)), [*scope, cost, score])
