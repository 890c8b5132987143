"""Ranks, counts and frontiers over ranges of values: the same whatever the size of a range."""

import random

import pytest
from pyspark.sql import functions as F

from tonescope.operators import frames, inference, ranking


@pytest.fixture(scope="module")
def values(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, *range(40), 7, 7, 7, 1e9, -3.5])) for _ in range(900)]
    rows += [("one", 5.0)] * 50 + [("hot", float(draw.randrange(3000))) for _ in range(3000)]
    return spark.createDataFrame([(s, None if v is None else float(v)) for s, v in rows], "s string, v double").repartition(5)


@pytest.mark.parametrize("most", [1, 6, 100, 0])
@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("scope", [["s"], []])
def test_counts_before_each_value(values, most, ascending, scope):
    told = ranking.cumulative_counts(values, "v", scope, ascending, most).collect()
    rows = [(r.s if scope else 0, r.v) for r in values.collect() if r.v is not None]
    want = set()
    for s, v in set(rows):
        own = [x for t, x in rows if t == s]
        want.add((s, v, own.count(v), sum(x < v if ascending else x > v for x in own)))
    assert {(r.s if scope else 0, r.v, r._n, r._before) for r in told} == want and len(told) == len(want)


def test_ranges_are_bounded_and_as_many_as_needed(values):
    distinct = values.where("v is not null").groupBy("s", "v").agg(F.count("*").alias("_n"))
    for most in (3, 50, 5000):
        placed, names = ranking.in_buckets(distinct, "v", ["s"], most)
        sizes = placed.groupBy("s", *names).count()
        assert sizes.agg(F.max("count")).first()[0] <= most
    assert names == []   # nothing is cut where nothing is large


@pytest.mark.parametrize("most", [1, 4, 0])
@pytest.mark.parametrize("scope", [["s"], []])
def test_frontier_equals_comparison_of_all(values, most, scope):
    draw = random.Random(7)
    agents = [(draw.choice(["x", "y", None]), i, draw.choice([None, *range(60)]), draw.choice([None, *range(100)]))
              for i in range(400)]
    rows = values.sparkSession.createDataFrame(agents, "s string, i int, cost int, score int")
    got = {r.i for r in inference.frontier(rows, "cost", "score", scope, most).collect()}
    known = [a for a in agents if a[2] is not None and a[3] is not None]
    want = {i for s, i, c, p in known if not any(
        (t == s or not scope) and (d < c and q >= p or d == c and q > p) for t, _, d, q in known)}
    assert got == want


def test_holes_equal_a_frame_of_all_combinations(spark):
    draw = random.Random(9)
    rows = [(draw.choice("abcd"), draw.choice("uvwxyz"), draw.choice(["r", "m", None])) for _ in range(30)]
    rows += [("e", None, "r"), (None, "t", "m"), ("a", "s", None)]
    table = spark.createDataFrame(rows, "k string, label string, corpus string").repartition(3)
    keys, labels = {k for k, _, _ in rows if k}, {x for _, x, _ in rows if x}
    seen = {c: {(k, x) for k, x, d in rows if d == c and k and x} for c in "rm"}
    told = frames.holes(table, "k", "label", {c: F.col("corpus") == c for c in "rm"}).first()
    assert told.groups == len(keys) * len(labels)
    assert (told.present_r, told.present_m, told.same_holes) == (len(seen["r"]), len(seen["m"]), seen["r"] == seen["m"])
    both = frames.holes(table, "k", "label", {"x": F.col("corpus") == "r", "y": F.col("corpus") == "r"}).first()
    assert both.same_holes is True
    gone = {tuple(r) for r in frames.lacking(table, "k", "label", F.col("corpus") == "m").collect()}
    assert gone == {(k, x) for k in keys for x in labels} - seen["m"]


def test_holes_read_the_labels_once(spark):
    from tonescope.catalog import profiles, slices
    folder = "/root/testdata/sf0.001"
    for query in (slices.set_same_holes, profiles.drift_presence):
        plan = query(spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") == 1
