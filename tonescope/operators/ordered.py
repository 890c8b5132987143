"""Ordered computations that never put a whole group into one task.

Each group is cut into slices by a column that is monotone in the ordering (an hour, a block of
step numbers). A small per-slice aggregate gives each slice its starting offset; the window then
runs inside a slice. The rows are shuffled once, on (keys, slice), for both the join and the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonescope.session import cut_lineage

BLOCK = 100_000  # consecutive step numbers per slice


def _with_offset(df: DataFrame, keys, slice_col: str, total: Column) -> DataFrame:
    """Attach `_offset`: the sum of `total` over all earlier slices of the same group."""
    sizes = df.groupBy(*keys, slice_col).agg(total.alias("_size"))
    earlier = (Window.partitionBy(*keys).orderBy(slice_col)
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, slice_col,
                           F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    return df.join(offsets, [*keys, slice_col])


def number_rows(df: DataFrame, keys, slice_col: str, order, name: str) -> DataFrame:
    """1-based row number within `keys`; `slice_col` must not decrease along `order`."""
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order)
    placed = _with_offset(df, keys, slice_col, F.count("*"))
    return (placed.withColumn(name, (F.col("_offset") + F.row_number().over(inside))
                              .cast("bigint")).drop("_offset"))


def scan(df: DataFrame, keys, slice_col: str, order, number: str, sums: dict[str, Column] | None = None,
         latest: dict[str, Column] | None = None) -> DataFrame:
    """Row numbers, running totals and the latest earlier row of a kind, all in one pass over `df`.

    Adds `number` (1-based within `keys`), for each of `sums` its inclusive running total, and for each condition of `latest`
    the number of the last earlier row that fulfils it (NULL if there is none). The rows are ordered once, inside their slice,
    and written; a row per slice then carries count, totals and latest rows over to the next slice. `slice_col` must not
    decrease along `order`.
    """
    sums, latest = sums or {}, latest or {}
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order)
    so_far, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumns({number: F.row_number().over(inside).cast("bigint"), **{f"_add_{n}": v for n, v in sums.items()}})
    placed = placed.withColumns({f"_hit_{n}": F.when(c, F.col(number)) for n, c in latest.items()})
    placed = cut_lineage(placed.withColumns({
        **{n: F.coalesce(F.sum(f"_add_{n}").over(so_far), F.lit(0)) for n in sums},
        **{n: F.max(f"_hit_{n}").over(before) for n in latest}}))
    slices = placed.groupBy(*keys, slice_col).agg(
        F.count("*").alias("_size"), *[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in sums],
        *[F.max(f"_hit_{n}").alias(f"_top_{n}") for n in latest])
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    carried = slices.select(
        *keys, slice_col, "_offset", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_sum_{n}") for n in sums],
        *[F.max(F.col("_offset") + F.col(f"_top_{n}")).over(earlier).alias(f"_top_{n}") for n in latest])
    told = placed.join(carried, [*keys, slice_col]).withColumns({
        **{n: F.col(f"_sum_{n}") + F.col(n) for n in sums},
        **{n: F.coalesce(F.col("_offset") + F.col(n), F.col(f"_top_{n}")) for n in latest}})
    told = told.withColumn(number, F.col("_offset") + F.col(number))
    return told.drop("_offset", *[f"{p}_{n}" for n in sums for p in ("_add", "_sum")],
                     *[f"{p}_{n}" for n in latest for p in ("_hit", "_top")])


def running_sums(df: DataFrame, keys, slice_col: str, order, values: dict[str, Column]):
    """Inclusive running totals within `keys`, several at once: one offset join serves them all."""
    sizes = df.groupBy(*keys, slice_col).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    earlier = (Window.partitionBy(*keys).orderBy(slice_col)
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, slice_col, *[
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in values])
    inside = (Window.partitionBy(*keys, slice_col).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    placed = df.join(offsets, [*keys, slice_col])
    totals = {n: F.col(f"_before_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0))
              for n, v in values.items()}
    return placed.withColumns(totals).drop(*[f"_before_{n}" for n in values])


def running_sum(df: DataFrame, keys, slice_col: str, order, value: Column, name: str) -> DataFrame:
    """Inclusive running total of `value` within `keys`."""
    return running_sums(df, keys, slice_col, order, {name: value})


def running_max_before(df: DataFrame, keys, slice_col: str, order, value: Column,
                       name: str) -> DataFrame:
    """Largest `value` on earlier rows of the same group, NULL when there is none."""
    tops = df.groupBy(*keys, slice_col).agg(F.max(value).alias("_top"))
    earlier = (Window.partitionBy(*keys).orderBy(slice_col)
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = tops.select(*keys, slice_col, F.max("_top").over(earlier).alias("_carried"))
    inside = (Window.partitionBy(*keys, slice_col).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = df.join(carried, [*keys, slice_col])
    # greatest skips NULLs
    return placed.withColumn(name, F.greatest(F.col("_carried"), F.max(value).over(inside))).drop(
        "_carried")


def previous_row(df: DataFrame, keys, idx: str, columns) -> DataFrame:
    """The same columns one step earlier (`idx - 1`), as `prev_<column>`; NULL on the first step."""
    earlier = df.select(*keys, (F.col(idx) + 1).alias(idx),
                        *[F.col(c).alias(f"prev_{c}") for c in columns])
    return df.join(earlier, [*keys, idx], "left")
