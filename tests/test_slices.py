import pytest

from tonescope.operators import slices

ROWS = [("I", "A", "x", "negative"), ("I", "A", "y", "positive"), ("I", "B", "x", None),
        ("I", None, "x", "negative"), ("J", "C", None, "neutral"), (None, "C", "y", "neutral")]


def test_fields_and_lists_combine(make):
    rows = make(ROWS)
    assert slices.select_slice(rows, industry="I", aspect=["x", "y"]).count() == 4
    assert slices.select_slice(rows, industry="I", aspect="x", sentiment="negative").count() == 2
    assert slices.select_slice(rows, industry=["J", "I"], aspect="nothing").count() == 0


def test_value_order_and_repeats_do_not_matter(make):
    rows = make(ROWS)
    a = slices.select_slice(rows, org=["A", "B"]).collect()
    b = slices.select_slice(rows, org=["B", "A", "B"]).collect()
    assert sorted(a) == sorted(b)


def test_excluding_an_org_keeps_rows_without_one(make):
    kept = slices.select_slice(make(ROWS), industry="I", exclude_org="A")
    assert {r.org for r in kept.collect()} == {"B", None}


@pytest.mark.parametrize("bad", ["", "  ", {}, [], ["x", ""], [1], 3])
def test_malformed_values_are_errors(make, bad):
    with pytest.raises(ValueError):
        slices.select_slice(make(ROWS), aspect=bad)


def test_unknown_label_differs_from_empty_slice(make):
    rows = make(ROWS)
    gone = slices.never_occurring(rows, "aspect", ["x", "zzz"]).collect()
    assert [(r.field, r.label) for r in gone] == [("aspect", "zzz")]
    assert slices.select_slice(rows, industry="J", aspect="x").count() == 0
    assert slices.never_occurring(rows, "aspect", ["x"]).count() == 0


def test_complement_is_null_safe(make):
    rows = make(ROWS)
    kept, dropped = slices.keep_equal(rows, org="A"), slices.drop_equal(rows, org="A")
    assert kept.count() + dropped.count() == len(ROWS)
    assert None in {r.org for r in dropped.collect()}
    with pytest.raises(ValueError):
        slices.drop_equal(rows)
    with pytest.raises(ValueError):
        slices.keep_equal(rows, {"sentiment": ["negative"]}, sentiment="angry")


def test_a_name_is_an_industry_first(spark, make):
    rows = make([("I", "A", "x", "negative"), ("J", "I", "x", "negative")])
    names = spark.createDataFrame([("I",), ("A",)], "segment string")
    got = {(r.segment, r.org) for r in slices.segment_rows(rows, names).collect()}
    assert got == {("I", "A"), ("A", "A")}
    homes = {r.segment: r.industry for r in slices.industry_of(rows, names).collect()}
    assert homes == {"I": "I", "A": "I"}
