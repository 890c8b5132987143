"""Parsing and text measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonescope.schema import MARKUP_SIGNS, SENTIMENT_CODES, TASK_TYPES


def label_codes(column: str = "label_codes") -> Column:
    """A list literal of `parent.child.sentiment` codes as an array."""
    return F.from_json(F.col(column), "array<string>", {"allowSingleQuotes": "true"})


def explode_labels(reviews: DataFrame) -> DataFrame:
    """One row per label: parent_aspect, aspect and sentiment beside the review's own columns."""
    parts = F.split("code", r"\.")
    codes = F.create_map(*[F.lit(x) for kv in SENTIMENT_CODES.items() for x in kv])
    return (reviews.withColumn("code", F.explode(label_codes()))
            .withColumn("parent_aspect", parts[0]).withColumn("aspect", parts[1])
            .withColumn("sentiment", codes[parts[2]]).drop("code", "label_codes"))


def word_count(column: str = "text") -> Column:
    """Whitespace-separated words; blank text has none."""
    trimmed = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def template_of(column: str = "task_id") -> Column:
    return F.split_part(column, F.lit("-"), F.lit(1))


def seed_of(column: str = "run_dir") -> Column:
    """Seed number at the end of a run name (`..._s2555`)."""
    return F.nullif(F.regexp_extract(column, r"_s(\d+)", 1), F.lit("")).cast("bigint")


def model_of(column: str = "run_dir") -> Column:
    """Model part of a run name: everything before the dated suffix."""
    return F.regexp_extract(column, r"^(.*?)_\d{8}_", 1)


def task_type(template: Column) -> Column:
    """descriptive, diagnostic or prescriptive from a template name (T1..T10)."""
    number = F.substring(template, 2, 9).cast("int")
    out = F.lit(None).cast("string")
    for name, members in TASK_TYPES.items():
        out = F.when(number.isin(members), name).otherwise(out)
    return out


def has_markup(column: str = "answer") -> Column:
    """Whether an answer leaks tool-call markup."""
    found = F.lit(False)
    for sign in MARKUP_SIGNS:
        found = found | F.contains(F.col(column), F.lit(sign))
    return found


def tagged_score(column: str, tag: str = "insight_score") -> Column:
    """The first `<tag>n</tag>` of a reply, 0 to 5, else NULL."""
    found = F.regexp_extract(column, rf"<{tag}>\s*(\d)\s*</{tag}>", 1)
    score = F.nullif(found, F.lit("")).cast("int")
    return F.when(score.between(0, 5), score)
