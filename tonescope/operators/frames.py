"""Full frames over small vocabularies, alignment of series, and absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonescope.session import cut_lineage

VOCABULARY_LIMIT = 10_000


def vocabulary(df: DataFrame, column: str):
    """The sorted distinct labels of a vocabulary column as one array value.

    Meant for topics and the like; a column with more than VOCABULARY_LIMIT labels is an error,
    as its labels would have to travel to every task.
    """
    labels = (df.where(F.col(column).isNotNull()).select(column).distinct()
              .limit(VOCABULARY_LIMIT + 1).agg(F.array_sort(F.collect_list(column)).alias("v")))
    checked = F.when(F.size("v") <= VOCABULARY_LIMIT, F.col("v")).otherwise(
        F.raise_error(F.lit(f"{column} has more than {VOCABULARY_LIMIT} labels")).cast(
            "array<string>"))
    return labels.select(checked.alias("v")).scalar()


def full_frame(df: DataFrame, key: str, column: str) -> DataFrame:
    """Every (key, label) combination: each key row explodes the vocabulary, nothing is crossed."""
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    return keys.withColumn(column, F.explode(vocabulary(df, column)))


def reindexed(frame: DataFrame, values: DataFrame, keys, columns) -> DataFrame:
    """`values` on the frame, 0 where the frame has no match."""
    return frame.join(values, keys, "left").na.fill(0, list(columns))


def absent(frame: DataFrame, present: DataFrame, keys) -> DataFrame:
    """Frame rows that never occur."""
    return frame.join(present.select(*keys).distinct(), keys, "left_anti").select(*keys)


def lacking(rows: DataFrame, key: str, column: str, present: Column) -> DataFrame:
    """(key, label) combinations without a row that is `present`; keys and labels are those of all rows.

    One pass over the rows: each key keeps the set of labels that it has (at most a vocabulary), and only what it lacks is
    exploded.
    """
    here = F.when(present, F.col(column))
    cells = cut_lineage(rows.groupBy(key, column).agg(F.max(here).alias("_here")))
    held = cells.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("_here").alias("_held"))
    return held.select(key, F.explode(F.array_except(vocabulary(cells, column), "_held")).alias(column))


def holes(rows: DataFrame, key: str, column: str, corpora: dict[str, Column]) -> DataFrame:
    """One row: all (key, label) combinations, those present in each corpus, and whether all corpora lack the same ones.

    `corpora` names conditions on the rows; keys and labels are those of all rows. The combinations are counted as keys times
    labels and none is made: what no corpus has is lacking everywhere, so corpora differ only where one has a row. One pass, any
    number of keys and labels.
    """
    seen = rows.groupBy(key, column).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f"_in_{n}") for n, c in corpora.items()])
    whole = F.col(key).isNotNull() & F.col(column).isNotNull()
    first, *others = [F.col(f"_in_{n}") for n in corpora]
    same = F.lit(True)
    for other in others:
        same = same & (first == other)
    return seen.agg((F.count_distinct(key) * F.count_distinct(column)).alias("groups"),
                    *[F.count_if(whole & F.col(f"_in_{n}")).alias(f"present_{n}") for n in corpora],
                    F.coalesce(F.every(same | ~whole), F.lit(True)).alias("same_holes"))


def aligned(series: DataFrame, index: str, name: str, names, value: str) -> DataFrame:
    """One column per named series on the union of their indexes, 0 where a series has no entry."""
    wide = series.groupBy(index).pivot(name, names).agg(F.first(value))
    return wide.na.fill(0).select(index, *[F.col(n).alias(f"{value}_{n}") for n in names])


def variation_distance(shares: DataFrame, index: str, within, corpus: str, a: str, b: str):
    """Total-variation distance between two corpora per slice: half the summed share gaps."""
    wide = (shares.groupBy(*within, index).pivot(corpus, [a, b]).agg(F.first("share"))
            .na.fill(0.0))
    return wide.groupBy(*within).agg((F.sum(F.abs(F.col(a) - F.col(b))) / 2).alias("distance"))
