"""NULL keys and values get the same answer whichever form of an operator is chosen."""

import pytest

from tonescope.operators import ranking, summaries


@pytest.mark.parametrize("top_k", [None, 2])
@pytest.mark.parametrize("scope", [[], ["industry"]])
def test_wide_and_narrow_ranks_agree(spark, top_k, scope):
    rows = spark.createDataFrame([("x", "a", 3), ("x", "b", 3), ("x", "c", None), (None, "d", 1), (None, "e", 2),
                                  ("y", "f", None), ("y", "g", 9)], "industry string, org string, n int")
    forms = [sorted(map(str, ranking.rank_groups(rows, "n", scope, top_k, wide=wide).select("org", "rank").collect()))
             for wide in (False, True)]
    assert forms[0] == forms[1]
    ranked = {r["org"] for r in ranking.rank_groups(rows, "n", scope, None, wide=True).collect()}
    assert ranked == {"a", "b", "d", "e", "g"}


def test_totals_of_a_null_slice_agree(spark):
    rows = spark.createDataFrame([(None, "a", "o1", 4), (None, "b", "o2", 6), ("x", "a", "o1", 5)],
                                 "industry string, aspect string, org string, total_count long")
    totals = []
    for bounded in (True, False):
        told = summaries._with_total(rows, ["industry"], bounded, "selection_rows")
        totals.append(sorted(map(str, told.select("industry", "aspect", "selection_rows").collect())))
    assert totals[0] == totals[1] and len(totals[0]) == 3


def test_quantiles_of_a_null_scope(spark):
    rows = spark.createDataFrame([(None, float(i)) for i in range(11)] + [("x", 1.0)], "g string, v double")
    got = {r["g"]: r["value"] for r in ranking.quantiles(rows, "v", [0.5], ["g"]).collect()}
    assert got == {None: 5.0, "x": 1.0}
