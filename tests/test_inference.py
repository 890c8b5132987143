import math

import pytest
from pyspark.sql import functions as F

from tonescope.functions import normal
from tonescope.operators import inference

SIDES = "total_a long, neg_a long, total_b long, neg_b long"


def test_erfc_is_accurate(spark):
    xs = [i / 20 for i in range(0, 161)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double")
    got = rows.select("x", F.expr(normal.erfc_sql("x")).alias("y")).collect()
    for r in got:
        assert abs(r.y - math.erfc(r.x)) <= 1e-12
    normal.register_sql(spark)
    assert abs(spark.sql("SELECT erfc(1.5D)").first()[0] - math.erfc(1.5)) < 1e-14


def test_known_test_and_its_mirror(spark):
    rows = spark.createDataFrame([(40, 35, 100, 60), (100, 60, 40, 35)], SIDES)
    a, b = inference.proportions_test(rows).collect()
    pooled = 95 / 140
    z = (35 / 40 - 60 / 100) / math.sqrt(pooled * (1 - pooled) * (1 / 40 + 1 / 100))
    assert math.isclose(a.z, z) and math.isclose(b.z, -z)
    assert math.isclose(a.p_value, math.erfc(abs(z) / math.sqrt(2)), abs_tol=1e-12)
    assert a.p_value == b.p_value and a.significant and a.gap_pp == -b.gap_pp


def test_undefined_and_empty_sides(spark):
    rows = spark.createDataFrame([(5, 5, 7, 7), (5, 0, 7, 0), (0, 0, 7, 3)], SIDES)
    every, none, empty = inference.proportions_test(rows).collect()
    for r in (every, none):
        assert r.z is None and r.p_value is None and r.significant is None
        assert r.note and r.error is None and r.gap_pp == 0
    assert empty.error and empty.z is None and empty.sufficient is None


@pytest.mark.parametrize("cells, strict, inclusive", [
    ((25, 10, 30, 15), False, True), ((25, 11, 30, 15), True, True), ((25, 9, 30, 15), False, False)])
def test_cell_floor(spark, cells, strict, inclusive):
    rows = spark.createDataFrame([cells], SIDES)
    got = rows.select(inference.sufficient(True).alias("s"),
                      inference.sufficient(False).alias("i")).first()
    assert (got.s, got.i) == (strict, inclusive)


def test_one_sided_tails(spark):
    rows = spark.createDataFrame([(1.3,), (-1.3,)], "z double")
    up = [r.p_value for r in normal.with_p_values(rows, "z", "larger").collect()]
    down = [r.p_value for r in normal.with_p_values(rows, "z", "smaller").collect()]
    assert math.isclose(up[0], 1 - up[1]) and math.isclose(up[0], down[1])
    assert math.isclose(up[0], math.erfc(1.3 / math.sqrt(2)) / 2, abs_tol=1e-13)


def test_older_contract_on_zero_spread(spark):
    row = inference.older_proportions_test(spark.createDataFrame([(5, 5, 7, 7)], SIDES)).first()
    assert (row.z, row.p_value, row.significant, row.higher) == (0.0, 1.0, False, "b")


def test_org_and_rest_make_the_industry(spark):
    cells = spark.createDataFrame([("I", "A", "x", 40, 20), ("I", "B", "x", 60, 10),
                                   ("I", "C", "y", 10, 1)],
                                  "industry string, org string, aspect string, total_count long, "
                                  "neg_count long")
    got = {r.org: r for r in inference.against_rest(cells).collect()}
    assert (got["A"].total_b, got["A"].neg_b, got["A"].scope_rate) == (60, 10, 0.3)
    assert got["C"].error and got["C"].z is None


def test_chi_squared_at_two_degrees(spark):
    cols = "neg_a long, neu_a long, pos_a long, neg_b long, neu_b long, pos_b long"
    rows = spark.createDataFrame([(10, 20, 30, 20, 20, 10), (1, 0, 5, 2, 0, 5)], cols)
    full, gap = inference.chi_squared(rows).collect()
    table = [(10, 20), (20, 20), (30, 10)]
    chi2 = 0.0
    for a, b in table:
        for seen, n in ((a, 60), (b, 50)):
            expected = (a + b) * n / 110
            chi2 += (seen - expected) ** 2 / expected
    assert math.isclose(full.chi2, chi2) and math.isclose(full.p_value, math.exp(-chi2 / 2))
    assert gap.error and gap.chi2 is None


@pytest.mark.parametrize("t", [0.1, 1.0, 2.5, 12.7])
def test_student_tail(t):
    # closed forms at one and two degrees of freedom, a numeric integral at many
    one, two = 1 - 2 / math.pi * math.atan(t), 1 - t / math.sqrt(2 + t * t)
    assert math.isclose(normal.student_two_sided(t, 1), one, rel_tol=1e-10)
    assert math.isclose(normal.student_two_sided(-t, 2), two, rel_tol=1e-10)
    nu, n = 1000, 200_000
    front = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
    h = t / n
    inside = sum((1 + ((i + 0.5) * h) ** 2 / nu) ** (-(nu + 1) / 2) for i in range(n)) * h * front
    assert math.isclose(normal.student_two_sided(t, nu), 1 - 2 * inside, abs_tol=1e-9)


def test_rank_correlation_with_ties(spark):
    rows = spark.createDataFrame([(i, float(v), float(w)) for i, (v, w) in enumerate(
        [(1, 2), (2, 1), (2, 3), (3, 5), (5, 5), (4, 4)])], "k int, a double, b double")
    got = inference.spearman_table(rows, ["k"], ["a", "b"]).first()
    ra, rb = [1, 2.5, 2.5, 4, 6, 5], [2, 1, 3, 5.5, 5.5, 4]
    ma, mb = sum(ra) / 6, sum(rb) / 6
    cov = sum((x - ma) * (y - mb) for x, y in zip(ra, rb))
    rho = cov / math.sqrt(sum((x - ma) ** 2 for x in ra) * sum((y - mb) ** 2 for y in rb))
    assert math.isclose(got.rho, rho) and got.n == 6
    t = rho * math.sqrt(4 / (1 - rho * rho))
    assert math.isclose(got.p_value, normal.student_two_sided(t, 4), rel_tol=1e-9)


def test_constant_column_has_no_correlation(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    assert rows.agg(inference.safe_correlation("a", "b").alias("r")).first().r is None


def test_frontier_keeps_the_cheaper_of_equals(spark):
    rows = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 3.0), ("c", 3.0, 4.0),
                                  ("d", 4.0, 2.0)], "agent string, cost double, score double")
    assert {r.agent for r in inference.frontier(rows, "cost", "score").collect()} == {"a", "c"}
