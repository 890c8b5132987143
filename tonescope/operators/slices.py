"""Row selection: filters, complements, guards and notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonescope.schema import FILTER_FIELDS, MIN_MENTIONS


def as_values(field: str, value) -> list[str]:
    """A filter argument as a list of usable labels; anything that could match nothing is an error.

    An empty result must keep meaning "this slice does not exist", so blanks are refused here.
    """
    values = [value] if isinstance(value, str) else value
    usable = (isinstance(values, list) and len(values) > 0
              and all(isinstance(v, str) and v.strip() for v in values))
    if not usable:
        raise ValueError(f"{field}: expected a non-empty label or list of labels, got {value!r}")
    return values


def select_slice(df: DataFrame, *, exclude_org=None, **fields) -> DataFrame:
    """Fields combine with AND, labels inside one field with OR. Rows without an organisation
    survive `exclude_org`, as a missing label never equals an excluded one."""
    unknown = set(fields) - set(FILTER_FIELDS)
    if unknown:
        raise ValueError(f"not filter fields: {sorted(unknown)}")
    tests = [F.col(f).isin(as_values(f, v)) for f, v in fields.items() if v is not None]
    if exclude_org is not None:
        dropped = as_values("exclude_org", exclude_org)
        tests.append(F.coalesce(~F.col("org").isin(dropped), F.lit(True)))
    return df.where(reduce(Column.__and__, tests)) if tests else df


def _all_equal(fields: dict, vocabulary: dict | None) -> Column:
    for field, value in fields.items():
        if vocabulary and field in vocabulary and value not in vocabulary[field]:
            raise ValueError(f"{field}: {value!r} is not one of {sorted(vocabulary[field])}")
    tests = [F.col(f).eqNullSafe(F.lit(v)) for f, v in fields.items()]
    return reduce(Column.__and__, tests, F.lit(True))


def keep_equal(df: DataFrame, vocabulary: dict | None = None, **fields) -> DataFrame:
    """Rows equal on every given field; with a vocabulary, an unknown label is an error."""
    return df.where(_all_equal({k: v for k, v in fields.items() if v is not None}, vocabulary))


def drop_equal(df: DataFrame, vocabulary: dict | None = None, **fields) -> DataFrame:
    """The complement of `keep_equal`: rows with a NULL in a tested field stay."""
    given = {k: v for k, v in fields.items() if v is not None}
    if not given:
        raise ValueError("drop_equal needs at least one field")
    return df.where(~_all_equal(given, vocabulary))


def never_occurring(df: DataFrame, field: str, values: list[str]) -> DataFrame:
    """Labels that occur nowhere in their column: one bounded aggregate, no join."""
    found = F.collect_set(F.when(F.col(field).isin(values), F.col(field)))
    wanted = F.array(*[F.lit(v) for v in values])
    return (df.agg(found.alias("found"))
            .select(F.lit(field).alias("field"),
                    F.explode(F.array_except(wanted, "found")).alias("label")))


def slice_size(df: DataFrame) -> DataFrame:
    """One row; zero is a valid answer."""
    return df.agg(F.count("*").alias("n_rows"))


def min_volume(df: DataFrame, floor: int = MIN_MENTIONS, column: str = "total") -> DataFrame:
    return df.where(F.col(column) >= floor)


def with_labels(df: DataFrame, labels: DataFrame, column: str = "aspect") -> DataFrame:
    """Attach plain names from a (column, label) dimension; unknown labels keep their slug."""
    return (df.join(labels, column, "left")
            .withColumn("label", F.coalesce("label", F.col(column))))


def segment_rows(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows of every named segment. A name is an industry where one has it, else an organisation.

    Each fact row is offered under its industry and its organisation name, and joined once.
    """
    industries = df.select("industry").distinct().withColumnRenamed("industry", "segment")
    as_industry = segments.join(industries, "segment", "left_semi")
    as_org = segments.join(industries, "segment", "left_anti")
    whole = df.join(as_industry, F.col("industry") == F.col("segment"))
    part = df.join(as_org, F.col("org") == F.col("segment"))
    return whole.unionByName(part)


def industry_of(df: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment, industry): itself when it is an industry, else its organisation's industry."""
    homes = df.select("org", "industry").distinct()
    names = (homes.select(F.col("industry").alias("segment"), "industry")
             .unionByName(homes.select(F.col("org").alias("segment"), "industry")).distinct())
    own = F.col("segment") == F.col("industry")
    # an industry name wins over an organisation of the same name
    pick = F.coalesce(F.max(F.when(own, F.col("industry"))), F.min("industry"))
    return segments.join(names, "segment").groupBy("segment").agg(pick.alias("industry"))
