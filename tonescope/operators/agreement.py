"""Agreement between raters on an ordinal scale, from (unit, rater, score) rows.

Each unit is first reduced to its counts per score level (at most one number per level, however
many raters it has), so no pair of ratings is ever materialised.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonescope.functions.measures import rate
from tonescope.schema import SPREAD_CUT

SCALE = [0, 1, 2, 3, 4, 5]
#: Units and raters of one dense table in a task.
UNITS, TILE = 1024, 256
#: Of the units that both rated: their number, equal values, values at most 1 apart, squares of each, products.
PAIR_SUMS = ["n_both", "n_equal", "n_near", "square_a", "square_b", "product"]
REPLICATE_BATCH = 50


def score_profile(ratings: DataFrame, scale=SCALE, keys=()) -> DataFrame:
    """Per unit: how many ratings sit at each level (`c0`...), and how many in all (`m`)."""
    counts = [F.count_if(F.col("score") == s).alias(f"c{i}") for i, s in enumerate(scale)]
    return (ratings.where(F.col("score").isNotNull()).groupBy(*keys, "unit")
            .agg(*counts, F.count("*").alias("m")))


def _coincidence(i: int, j: int) -> str:
    """Ordered pairs of levels (i, j) inside a unit, before the division by m - 1."""
    # doubles: the product of two large counts would not fit a bigint
    return f"sum(cast(c{i} AS double) * (c{j} - {int(i == j)}) * w) AS o{i}_{j}"


def _alpha_from(matrix: DataFrame, k: int, keep) -> DataFrame:
    """alpha from columns o<i>_<j> (i <= j) of the coincidence matrix.

    Written as SQL text: with many levels that is far quicker to build than nested Column calls.
    """
    def o(i, j):
        return f"o{min(i, j)}_{max(i, j)}"

    levels = [f"({' + '.join(o(i, j) for j in range(k))}) AS n{i}" for i in range(k)]
    sized = matrix.selectExpr("*", *levels)
    sized = sized.selectExpr("*", f"{' + '.join(f'n{i}' for i in range(k))} AS n")
    pairs = list(combinations(range(k), 2))
    gaps = [f"power({' + '.join(f'n{g}' for g in range(i, j + 1))} - (n{i} + n{j}) / 2, 2D) "
            f"AS d{i}_{j}" for i, j in pairs]
    sized = sized.selectExpr("*", *gaps)
    observed = " + ".join(f"2 * {o(i, j)} * d{i}_{j}" for i, j in pairs)
    expected = " + ".join(f"2 * n{i} * n{j} * d{i}_{j}" for i, j in pairs)
    return sized.selectExpr(*keep, "units", "n AS pairable",
                            f"CASE WHEN n >= 2 THEN 1 - try_divide(({observed}) * (n - 1), "
                            f"{expected}) END AS alpha")


def alpha(ratings: DataFrame, scale=SCALE, keys=()) -> DataFrame:
    """Krippendorff's ordinal alpha; units with fewer than two ratings are left out."""
    return alpha_of_profiles(score_profile(ratings, scale, keys).withColumn("w", F.lit(1)),
                             len(scale), keys)


def alpha_of_profiles(profiles: DataFrame, k: int, keys=()) -> DataFrame:
    """alpha from score profiles with a weight column `w` (how often each profile counts)."""
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    by_size = (profiles.where("m >= 2").groupBy(*keys, "m")
               .agg(*[F.expr(_coincidence(i, j)) for i, j in cells], F.sum("w").alias("units")))
    shares = [F.expr(f"sum(cast(o{i}_{j} AS double) / (m - 1)) AS o{i}_{j}") for i, j in cells]
    grouped = by_size.groupBy(*keys) if keys else by_size.groupBy()
    return _alpha_from(grouped.agg(*shares, F.sum("units").alias("units")), k, keys)


def corrected_alpha(estimate: Column, units: Column, raters: int) -> Column:
    """Small-sample corrected alpha for `units` units and a fixed number of raters."""
    plain = (2 * units * estimate - 1) / (2 * units - 1)
    unbiased = (((raters * units - 1) * plain + 1)
                / ((raters - 1) * plain + (raters * (units - 1) + 1)))
    return ((2 * units - 1) * unbiased + 1) / (2 * units)


def bootstrap_alpha(ratings: DataFrame, replicates: int = 5000, seed: int = 0,
                    scale=SCALE) -> DataFrame:
    """One alpha per replicate, units drawn with replacement.

    Units with the same profile are interchangeable, so a replicate is one multinomial draw over
    distinct profiles: exactly the distribution of drawing n units, at a cost that depends on the
    number of distinct profiles (84 for three raters on six levels), not on the number of units.
    """
    k = len(scale)
    names = [f"c{i}" for i in range(k)]
    kinds = (score_profile(ratings, scale).groupBy(*names, "m")
             .agg(F.count("*").alias("units")))
    # every batch of replicates gets its own copy of the profile table: batches run in parallel
    batches = F.sequence(F.lit(0), F.lit((replicates - 1) // REPLICATE_BATCH))
    copies = kinds.withColumn("batch", F.explode(batches))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(names, kind="stable")
        size = int(ordered["units"].sum())
        share = ordered["units"].to_numpy() / size
        first = int(ordered["batch"].iloc[0]) * REPLICATE_BATCH
        last = min(first + REPLICATE_BATCH, replicates)
        drawn = [ordered.assign(replicate=r, w=np.random.default_rng([seed, r])
                                .multinomial(size, share)) for r in range(first, last)]
        return pd.concat(drawn)[[*names, "m", "replicate", "w"]]

    fields = ", ".join(f"{c} long" for c in [*names, "m"])
    drawn = copies.groupBy("batch").applyInPandas(draw, f"{fields}, replicate int, w long")
    return alpha_of_profiles(drawn.where("w > 0"), k, ["replicate"])


def bootstrap_interval(boot: DataFrame, thresholds=(0.67, 0.80)) -> DataFrame:
    """2.5 and 97.5 percentiles over replicates, and how often alpha reaches each threshold."""
    reach = [F.avg((F.col("alpha") >= t).cast("double")).alias(f"p_at_least_{int(t * 100)}")
             for t in thresholds]
    return boot.agg(F.percentile("alpha", 0.025).alias("low"),
                    F.percentile("alpha", 0.975).alias("high"), *reach)


def one_rating(ratings: DataFrame) -> DataFrame:
    """(unit, rater, score): of repeated ratings of a unit by a rater the highest; none without a score."""
    return (ratings.where(F.col("score").isNotNull() & F.col("rater").isNotNull())
            .groupBy("unit", "rater").agg(F.max("score").alias("score")))


def panel(ratings: DataFrame, raters=None) -> DataFrame:
    """(rater, place): the named raters in their order, or all that rate, by name. Any number of them."""
    if raters is None:
        return ratings.where(F.col("rater").isNotNull()).select("rater", F.col("rater").alias("place")).distinct()
    return ratings.sparkSession.createDataFrame([(r, f"{i:09d}") for i, r in enumerate(raters)],
                                                "rater string, place string")


def _tiles(place: np.ndarray, unit: np.ndarray, value: np.ndarray, levels: bool):
    """Rows of PAIR_SUMS from the ratings of some units, raters taken TILE at a time."""
    names, who = np.unique(place, return_inverse=True)
    scale = np.unique(value) if levels else []
    rows = int(unit.max()) + 1

    def dense(start, weight):
        here = (who >= start) & (who < start + TILE)
        table = np.zeros((rows, min(TILE, len(names) - start)))
        table[unit[here], who[here] - start] = weight[here]
        return table

    ones = np.ones(len(value))
    for i in range(0, len(names), TILE):
        left = [dense(i, w) for w in (ones, value, value * value)]
        for j in range(i, len(names), TILE):
            right = [dense(j, w) for w in (ones, value, value * value)]
            both = left[0].T @ right[0]
            a, b = np.nonzero(both)
            a, b = a[a + i < b + j], b[a + i < b + j]
            equal, near = np.zeros_like(both), np.zeros_like(both)
            for level in scale:
                at = dense(i, (value == level) * 1.0).T
                equal += at @ dense(j, (value == level) * 1.0)
                near += at @ dense(j, (np.abs(value - level) <= 1) * 1.0)
            sums = [both, equal, near, left[2].T @ right[0], left[0].T @ right[2], left[1].T @ right[1]]
            yield [names[a + i], names[b + j], *(m[a, b] for m in sums)]


def pair_sums(values: DataFrame, levels: bool = True) -> DataFrame:
    """Per pair of raters with common units, from (unit, place, value): PAIR_SUMS over the units of both.

    A unit is one row with its ratings; tables of units x raters are multiplied, some units and TILE raters at a time, and
    the sums of tasks are added. No pair of ratings becomes a row, and memory depends neither on the number of units nor on
    that of raters. `levels` counts equal values and those at most 1 apart too; values must be on a scale of some levels.
    """
    units = values.groupBy("unit").agg(F.collect_list("place").alias("places"),
                                       F.collect_list(F.col("value").cast("double")).alias("values"))

    def multiply(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, UNITS):
                part = batch.slice(first, UNITS)
                unit = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(0)).to_numpy())
                place = part.column(0).flatten().to_numpy(zero_copy_only=False)
                for columns in _tiles(place, unit, part.column(1).flatten().to_numpy(), levels):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.string() if n < 2 else pa.float64()) for n, c in enumerate(columns)],
                        names=["a", "b", *PAIR_SUMS])

    made = units.where(F.size("places") > 1).select("places", "values").mapInArrow(
        multiply, "a string, b string, " + ", ".join(f"{c} double" for c in PAIR_SUMS))
    return made.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in PAIR_SUMS])


def _placed(ratings: DataFrame, raters) -> tuple[DataFrame, DataFrame]:
    """The panel, and one rating per unit and rater of it, with the rater's place."""
    listed = panel(ratings, raters)
    return listed, one_rating(ratings).join(listed, "rater")


def _all_pairs(listed: DataFrame, sums: DataFrame, raters) -> DataFrame:
    """Every two named raters once, in their order, with their sums (NULL without units); of all raters, those with units."""
    if raters is None:
        return sums.withColumns({"rater_a": F.col("a"), "rater_b": F.col("b")})
    later = F.sequence(F.col("place").cast("int") + 1, F.lit(len(raters) - 1))
    frame = (listed.where(F.col("place").cast("int") < len(raters) - 1)
             .select(F.col("rater").alias("rater_a"), F.col("place").alias("a"), F.explode(later).alias("nth"))
             .withColumn("b", F.lpad(F.col("nth").cast("string"), 9, "0")))
    names = listed.select(F.col("rater").alias("rater_b"), F.col("place").alias("b"))
    return frame.join(names, "b").join(sums, ["a", "b"], "left")


def rater_pairs(ratings: DataFrame, raters=None) -> DataFrame:
    """Per rater pair: exact and within-one agreement and mean squared difference, for any number of raters.

    A missing rating counts as a disagreement in the agreement shares and is left out of the MSE. Without `raters` the
    pairs are all those that rated a unit in common.
    """
    listed, own = _placed(ratings, raters)
    sums = pair_sums(own.select("unit", "place", F.col("score").alias("value")))
    total = ratings.select("unit").distinct().agg(F.count("*")).scalar()
    n = {c: F.coalesce(c, F.lit(0.0)) for c in PAIR_SUMS}
    square = n["square_a"] + n["square_b"] - 2 * n["product"]
    return (_all_pairs(listed, sums, raters).withColumn("units", total)
            .select("rater_a", "rater_b", n["n_both"].cast("long").alias("n_both"), n["n_equal"].cast("long").alias("n_equal"),
                    rate(n["n_equal"], F.col("units")).alias("exact"), rate(n["n_near"], F.col("units")).alias("within_1"),
                    rate(square, n["n_both"]).alias("mse")))


def mean_pair_agreement(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg("exact").alias("exact"), F.avg("within_1").alias("within_1"))


def _unit_sums(ratings: DataFrame) -> DataFrame:
    score = F.col("score").cast("bigint")
    return (ratings.where(F.col("score").isNotNull()).groupBy("unit")
            .agg(F.count("*").alias("m"), F.sum(score).alias("s1"),
                 F.sum(score * score).alias("s2")))


def mse_against_others(ratings: DataFrame) -> DataFrame:
    """Per rater: mean squared distance to the mean of the unit's other ratings."""
    rated = (ratings.where(F.col("score").isNotNull()).join(_unit_sums(ratings), "unit")
             .where(F.col("m") > 1))
    others = (F.col("s1") - F.col("score")) / (F.col("m") - 1)
    gap = F.col("score") - others
    return rated.groupBy("rater").agg(F.avg(gap * gap).alias("mse_others"),
                                      F.count("*").alias("n"))


def unit_consensus(ratings: DataFrame) -> DataFrame:
    """Median, minimum, maximum and spread per unit."""
    return (ratings.where(F.col("score").isNotNull()).groupBy("unit")
            .agg(F.median("score").alias("median"), F.min("score").alias("low"),
                 F.max("score").alias("high"), F.count("*").alias("m"))
            .withColumn("spread", F.col("high") - F.col("low")))


def wide_spread(ratings: DataFrame, cut: int = SPREAD_CUT) -> DataFrame:
    """Units whose raters differ by `cut` or more."""
    return unit_consensus(ratings).where(F.col("spread") >= cut).select("unit")


def without_wide_spread(ratings: DataFrame, cut: int = SPREAD_CUT) -> DataFrame:
    return ratings.join(wide_spread(ratings, cut), "unit", "left_anti")


def judge_agreement(ratings: DataFrame, judge: DataFrame, raters=None) -> DataFrame:
    """An automated judge against each rater (any number of them) and against the unit median."""
    listed, own = _placed(ratings, raters)
    judged = judge.select("unit", "judge_score")
    gap = F.abs(F.col("judge_score") - F.col("score"))
    hits = own.join(judged, "unit").agg(F.struct(F.count_if(gap == 0).alias("equal"), F.count_if(gap <= 1).alias("near")))
    joined = unit_consensus(ratings).join(judged, "unit", "left")
    j, total = F.col("judge_score"), F.count("*")
    facts = joined.agg(
        total.alias("n_units"), F.avg(j.cast("double")).alias("mean_score"),
        rate(F.count_if(j == F.col("median")), total).alias("median_exact"),
        rate(F.count_if(F.abs(j - F.col("median")) <= 1), total).alias("median_within_1"))
    asked = F.col("n_units") * F.col("raters")
    return (facts.withColumns({"hits": hits.scalar(), "raters": listed.agg(F.count("*")).scalar()})
            .select("n_units", "mean_score", rate(F.col("hits.equal"), asked).alias("pairwise_exact"),
                    rate(F.col("hits.near"), asked).alias("pairwise_within_1"), "median_exact", "median_within_1"))


def judge_against_median(ratings: DataFrame, judge: DataFrame) -> DataFrame:
    """alpha of the two-rater table (judge, unit median); levels may be half steps."""
    pair = unit_consensus(ratings).join(judge.select("unit", "judge_score"), "unit")
    scores = F.array(F.col("judge_score").cast("double"), F.col("median"))
    two = pair.select("unit", F.explode(scores).alias("score"))
    return alpha(two, [i / 2 for i in range(11)])


def judge_references(ratings: DataFrame, judge: DataFrame, raters=None) -> DataFrame:
    """Judge MSE against each rater, each pair mean, the panel mean and the median, for any number of raters.

    Without `raters` the pairs are all those with a judged unit in common. The mean of a pair is over those of the two that rated the unit, so its sum is that of each rater's units alone, less the
    common ones, plus the common ones' squared mean distance: all from sums per rater and per pair.
    """
    listed, own = _placed(ratings, raters)
    judged = judge.where(F.col("judge_score").isNotNull()).select("unit", "judge_score")
    gaps = own.join(judged, "unit").withColumn("value", (F.col("judge_score") - F.col("score")).cast("double"))
    square = F.col("value") * F.col("value")
    alone = listed.join(gaps.groupBy("place").agg(F.sum(square).alias("s"), F.count("*").alias("n")), "place", "left")
    alone = alone.select("place", "rater", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("n", F.lit(0)).alias("n"))
    a, b = (alone.select(F.col("place").alias(x), F.col("s").alias(f"s_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = _all_pairs(listed, pair_sums(gaps.select("unit", "place", "value"), levels=False), raters).join(a, "a").join(b, "b")
    z = {c: F.coalesce(c, F.lit(0.0)) for c in PAIR_SUMS}
    common = (z["square_a"] + z["square_b"] + 2 * z["product"]) / 4
    total = F.col("s_a") + F.col("s_b") - z["square_a"] - z["square_b"] + common
    count = F.col("n_a") + F.col("n_b") - z["n_both"].cast("long")
    paired = pairs.select(F.concat(F.lit("mean("), "rater_a", F.lit(", "), "rater_b", F.lit(")")).alias("reference"),
                          rate(total, count).alias("mse"), count.alias("n"))
    # The mean of the gaps is the gap to the mean.
    means = gaps.groupBy("unit").agg(F.avg("value").alias("gap"))
    middle = unit_consensus(ratings).join(judged, "unit").select((F.col("judge_score") - F.col("median")).alias("gap"))

    def whole(gap: DataFrame, name: str) -> DataFrame:
        return gap.agg(F.avg(F.col("gap") * F.col("gap")).alias("mse"), F.count("gap").alias("n")).select(
            F.lit(name).alias("reference"), "mse", "n")

    return (alone.select(F.col("rater").alias("reference"), rate(F.col("s"), F.col("n")).alias("mse"), "n")
            .unionByName(paired).unionByName(whole(means, "mean(all)")).unionByName(whole(middle, "median")))


def judge_bias(ratings: DataFrame, judge: DataFrame, *keys) -> DataFrame:
    """Mean signed distance of the judge from the unit median, by group."""
    joined = unit_consensus(ratings).join(judge, "unit")
    grouped = joined.groupBy(*keys) if keys else joined.groupBy()
    return grouped.agg(F.avg(F.col("judge_score") - F.col("median")).alias("mean_bias"),
                       F.count("*").alias("n_units"))


def against_intended(scored: DataFrame, *keys, levels: int = len(SCALE)) -> DataFrame:
    """Quadratic-weighted agreement, exact share, RMS distance and bias against intended scores."""
    gap = (F.col("score") - F.col("intended_score")).cast("double")
    square = gap * gap
    grouped = scored.groupBy(*keys) if keys else scored.groupBy()
    return grouped.agg((1 - F.avg(square) / ((levels - 1) ** 2)).alias("w_agree"),
                       F.avg((gap == 0).cast("double")).alias("exact"),
                       F.sqrt(F.avg(square)).alias("imperfection"), F.avg(gap).alias("bias"),
                       F.count("*").alias("n"))


def _deviation(m: Column, s1: Column, s2: Column) -> Column:
    """Population standard deviation from integer sums; 0 for one rating, NULL for none."""
    n, a, b = (c.cast("double") for c in (m, s1, s2))
    inside = n * b - a * a
    return F.when(m > 0, F.sqrt(inside) / m)


def consensuality(ratings: DataFrame) -> DataFrame:
    """Per rater: group disagreement without them minus with them (mean over units).

    Leaving a rater out changes only the units they rated, so the sums over all units are
    corrected by those units alone; nothing is expanded to rater x unit x others.
    """
    sums = _unit_sums(ratings)
    own = F.col("score").cast("bigint")
    full = _deviation(F.col("m"), F.col("s1"), F.col("s2"))
    rest = _deviation(F.col("m") - 1, F.col("s1") - own, F.col("s2") - own * own)
    overall = sums.agg(F.sum(full).alias("all_sum"), F.count("*").alias("all_units"))
    edge = overall.select(F.struct("all_sum", "all_units")).scalar()
    per = (ratings.where(F.col("score").isNotNull()).join(sums, "unit")
           .groupBy("rater").agg(F.sum(full).alias("own_sum"),
                                 F.sum(rest).alias("rest_sum"),
                                 F.count_if(F.col("m") == 1).alias("alone")))
    with_all = per.withColumn("_e", edge)
    total, units = F.col("_e.all_sum"), F.col("_e.all_units")
    without = (total - F.col("own_sum") + F.coalesce("rest_sum", F.lit(0.0))) / (
        units - F.col("alone"))
    return with_all.select("rater", (without - total / units).alias("consensuality"),
                           (total / units).alias("group_disagreement"))


def flag_items(ratings: DataFrame, intended: DataFrame, cut: int = SPREAD_CUT) -> DataFrame:
    """`split`: raters disagree. `off_gold`: they settle away from the intended score."""
    joined = unit_consensus(ratings).join(intended.select("unit", "intended_score"), "unit")
    gap = F.col("median") - F.col("intended_score")
    return joined.select("unit", "intended_score", "median", "spread",
                         gap.alias("gold_gap"), (F.col("spread") >= cut).alias("split"),
                         (F.abs(gap) >= 1).alias("off_gold"))
