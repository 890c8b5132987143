"""Corpus profiling: sparse grids, imputation, thinning, expansion, reconciliation and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonescope.functions import measures as m
from tonescope.operators import frames, summaries
from tonescope.operators.ordered import running_sum
from tonescope.schema import MIN_MENTIONS, SENTIMENTS

# Bounds of a planted rate, closeness of a runner-up, and the size band.
RATE_LIMITS = (0.02, 0.95)
CLOSE_MARGIN = 0.05
SIZE_BAND = (0.6, 1.4)
SHARES = ["neg_share", "neu_share", "pos_share"]


def group_shares(counts: DataFrame) -> DataFrame:
    """neg/neu/pos shares beside the counts of a group."""
    return counts.select("*", *[m.rate(f"{s[:3]}_count", "total_count").alias(s) for s in SHARES])


def imputed_shares(counts: DataFrame, key: str = "industry", topic: str = "aspect") -> DataFrame:
    """Sentiment shares on the full frame, gaps filled from the topic's average and renormalised.

    A missing group takes all three averages, a group lacking one sentiment takes that one.
    `whole_imputed` and `missing_<sentiment>` say what was filled.
    """
    frame = frames.full_frame(counts, key, topic)
    own = group_shares(counts).select(key, topic, "total_count", *SHARES)
    average = group_shares(summaries.roll_up(counts, [topic])).select(
        topic, *[F.col(s).alias(f"avg_{s}") for s in SHARES])
    placed = frame.join(own, [key, topic], "left").join(average, topic)
    whole = F.col("total_count").isNull()
    filled = [F.coalesce(F.nullif(F.col(s), F.lit(0.0)), F.col(f"avg_{s}")) for s in SHARES]
    total = filled[0] + filled[1] + filled[2]
    return placed.select(
        key, topic, F.coalesce("total_count", F.lit(0)).alias("total_count"),
        *[m.rate(f, total).alias(s) for f, s in zip(filled, SHARES)],
        whole.alias("whole_imputed"),
        *[(~whole & (F.col(s) == 0)).alias(f"missing_{s[:3]}") for s in SHARES])


def imputation_list(imputed: DataFrame, key: str = "industry", topic: str = "aspect") -> DataFrame:
    """One row per filled value: the group, and the sentiment (or 'all' for a whole group)."""
    what = F.array_compact(F.array(
        F.when(F.col("whole_imputed"), F.lit("all")),
        *[F.when(F.col(f"missing_{s[:3]}"), F.lit(s)) for s in SENTIMENTS]))
    return imputed.select(key, topic, F.explode(what).alias("imputed"))


def planted_rates(offsets: DataFrame, shares: DataFrame, limits=RATE_LIMITS) -> DataFrame:
    """Negative rate of every offset cell: the industry's share plus the offset, clipped."""
    joined = offsets.join(shares.select("industry", "aspect", "neg_share"), ["industry", "aspect"])
    return joined.withColumn("planted_rate",
                             m.clip(F.col("neg_share") + F.col("offset"), *limits))


def worst_and_close(rates: DataFrame, scope: str, topic: str, value: str,
                    margin: float = CLOSE_MARGIN) -> DataFrame:
    """The worst topic of each scope, and the runners-up closer than `margin` to it.

    A scope holds one row per topic.
    """
    from tonescope.operators.ranking import worst_of
    top = worst_of(rates, topic, value, [scope]).select(
        scope, F.col(topic).alias("worst"), F.col(value).alias("worst_rate"))
    close = (F.col(value) > F.col("worst_rate") - margin) & (F.col(topic) != F.col("worst"))
    return (rates.join(top, scope).groupBy(scope, "worst", "worst_rate")
            .agg(F.array_join(F.array_sort(F.collect_list(F.when(close, F.col(topic)))), ",")
                 .alias("contenders")))


def hash_fraction(*keys: str, seed: int = 42) -> Column:
    """A repeatable number in [0, 1) per key: the same on every cluster and partitioning."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(4294967296.0)


def thin(cells: DataFrame, rate: float, protected: Column, seed: int = 42,
         keys=("industry", "org", "aspect")) -> DataFrame:
    """Drop cells at `rate`, never a protected one; a cell's fate depends on its keys alone."""
    return cells.where(protected | (hash_fraction(*keys, seed=seed) >= rate))


def size_band(volumes: DataFrame, orgs: DataFrame, band=SIZE_BAND) -> DataFrame:
    """Expected per-organisation size range of each (industry, topic)."""
    each = m.rate("total_count", "n_orgs")
    low, high = (F.greatest(F.lit(1), F.floor(each * b)) for b in band)
    return volumes.join(orgs, "industry").select("industry", "aspect", "total_count", "n_orgs",
                                                 low.alias("low"), high.alias("high"))


ID_SLICES = 1024
CHUNK = 100_000  # labels written per task row


def expand_to_labels(cells: DataFrame) -> DataFrame:
    """One row per counted label, with a dense zero-padded id.

    Ids come from each cell's starting offset, so the rows themselves are never sorted or numbered.
    """
    long = cells.unpivot(["industry", "org", "parent_aspect", "aspect"],
                         [f"{s}_count" for s in ("neg", "neu", "pos")], "count_name", "n")
    named = (long.where("n > 0").withColumn(
        "sentiment", F.when(F.col("count_name") == "neg_count", "negative")
        .when(F.col("count_name") == "neu_count", "neutral").otherwise("positive"))
        .withColumn("_slice", F.pmod(F.xxhash64("org"), F.lit(ID_SLICES)))
        .withColumn("_all", F.lit(0)))
    order = ["industry", "org", "aspect", "sentiment"]
    placed = running_sum(named, ["_all"], "_slice", order, F.col("n"), "_end")
    # a very large cell is cut into chunks that are spread over tasks before they become rows
    chunks = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {CHUNK}"))
    spread = (placed.withColumn("_chunk", F.explode(chunks))
              .repartition("industry", "org", "aspect", "sentiment", "_chunk"))
    first = F.col("_chunk") * CHUNK + 1
    inside = F.sequence(first, F.least(F.col("n"), F.col("_chunk") * CHUNK + CHUNK))
    number = F.col("_end") - F.col("n") + F.col("_i")
    return (spread.withColumn("_i", F.explode(inside))
            .select(F.format_string("R%06d", number).alias("review_id"), "industry", "org",
                    "parent_aspect", "aspect", "sentiment"))


def reconcile(labels: DataFrame, declared: DataFrame, keys, floor: int) -> DataFrame:
    """Cells whose labels do not match the declared count, or that sit under the floor."""
    counted = labels.groupBy(*keys).agg(F.count("*").alias("found"))
    both = (declared.select(*keys, F.col("total_count").alias("declared"))
            .join(counted, list(keys), "full").na.fill(0, ["declared", "found"]))
    return both.withColumn("differs", F.col("declared") != F.col("found")).withColumn(
        "under_floor", F.col("found") < floor).where("differs OR under_floor")


def corpus_shares(rows: DataFrame, column: str, corpus: str, names, within=()) -> DataFrame:
    """Share of each value per corpus side by side, with the gap in percentage points."""
    shares = summaries.value_shares(rows, column, [*within, corpus])
    a, b = names
    wide = (shares.groupBy(*within, column).pivot(corpus, list(names)).agg(F.first("share"))
            .na.fill(0.0, list(names)))
    return wide.select(*within, column, F.col(a).alias(f"share_{a}"), F.col(b).alias(f"share_{b}"),
                       ((F.col(b) - F.col(a)) * 100).alias("gap_pp"))


def negative_rates_by_corpus(rows: DataFrame, key: str, corpus: str, names) -> DataFrame:
    """Negative rate of each key per corpus."""
    counts = [F.count_if((F.col(corpus) == n) & (F.col("sentiment") == "negative")).alias(f"k_{n}")
              for n in names]
    totals = [F.count_if(F.col(corpus) == n).alias(f"n_{n}") for n in names]
    return rows.groupBy(key).agg(*counts, *totals).select(
        key, *[m.rate(f"k_{n}", f"n_{n}").alias(f"rate_{n}") for n in names])


def thin_share(cells: DataFrame, *keys, floor: int = MIN_MENTIONS) -> DataFrame:
    """Share of cells under the floor."""
    grouped = cells.groupBy(*keys) if keys else cells.groupBy()
    under = F.count_if(F.col("total_count") < floor)
    return grouped.agg(F.count("*").alias("cells"), under.alias("thin"),
                       m.rate(under, F.count("*")).alias("thin_share"))


def null_pairs(cells: DataFrame, scope, value: str) -> DataFrame:
    """Scopes in which exactly two organisations share one rate."""
    return (cells.groupBy(*scope)
            .agg(F.count_distinct("org").alias("orgs"), F.count_distinct(value).alias("rates"))
            .where((F.col("orgs") == 2) & (F.col("rates") == 1)))


def support_check(groups: DataFrame, other: DataFrame, value: str, size: str) -> DataFrame:
    """Groups outside another corpus's range of values, and groups at exactly 0 or 1."""
    edge = other.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    placed = groups.withColumn("_e", edge)
    outside = (F.col(value) < F.col("_e.lo")) | (F.col(value) > F.col("_e.hi"))
    pinned = (F.col(value) == 0) | (F.col(value) == 1)
    return placed.agg(F.count("*").alias("groups"), F.count_if(outside).alias("outside"),
                      m.rate(F.count_if(outside), F.count("*")).alias("outside_share"),
                      F.count_if(pinned).alias("pinned"),
                      F.max(F.when(pinned, F.col(size))).alias("largest_pinned"))


def vocabulary_gaps(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Labels in the data but not allowed, and allowed but never seen."""
    seen = df.select(F.col(column).alias("label")).distinct()
    extra = seen.join(allowed, "label", "left_anti").withColumn("problem", F.lit("not allowed"))
    missing = allowed.join(seen, "label", "left_anti").withColumn("problem", F.lit("never seen"))
    return extra.unionByName(missing)


def homeless_orgs(df: DataFrame) -> DataFrame:
    """Organisations found in more than one industry."""
    return (df.groupBy("org").agg(F.count_distinct("industry").alias("industries"))
            .where("industries > 1"))


def first_per_group(df: DataFrame, keys, order, columns) -> DataFrame:
    """The first record of each group by an explicit order: an aggregate, no sort of the group."""
    pick = F.min(F.struct(*order, *[c for c in columns if c not in order]))
    return df.groupBy(*keys).agg(pick.alias("_p")).select(
        *keys, *[F.col(f"_p.{c}").alias(c) for c in columns])


def evidence_sample(df: DataFrame, id_column: str, n: int = 3, scope=(), seed: int = 42,
                    text: str = "text", width: int = 300) -> DataFrame:
    """n rows of each slice chosen by hash, with the shown text shortened for display."""
    from tonescope.operators.ranking import top_cut, top_cut_within
    keyed = df.withColumn("_h", hash_fraction(id_column, seed=seed))
    shown = F.substring(text, 1, width)
    if scope:
        cut = top_cut_within(keyed, "_h", n, scope, [id_column], ascending=True).drop("position")
    else:
        cut = top_cut(keyed, "_h", n, [id_column], ascending=True)
    return cut.withColumn(text, shown).drop("_h")
