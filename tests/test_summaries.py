import pytest
from pyspark.sql import functions as F

from tonescope.operators import frames, ranking, summaries


def repeat(industry, org, aspect, negative, total):
    return ([(industry, org, aspect, "negative")] * negative
            + [(industry, org, aspect, "positive")] * (total - negative))


def test_single_rate(make):
    row = summaries.summarise(make(repeat("I", "A", "x", 80, 427))).collect()[0]
    assert (row.total_count, row.neg_count) == (427, 80)
    assert row.neg_rate == 80 / 427 and row.prevalence == 1.0


def test_prevalence_counts_null_groups_and_groups_below_the_floor(make):
    rows = make(repeat("I", "A", "x", 10, 30) + repeat("I", "A", "y", 5, 29)
                + [("I", "A", None, "negative")] * 11)
    got = {r.aspect: r for r in summaries.summarise(rows, "aspect", min_n=30).collect()}
    assert set(got) == {"x"}
    assert got["x"].selection_rows == 70 and got["x"].prevalence == 30 / 70
    assert got["x"].priority_score == (30 / 70) * (10 / 30)
    every = summaries.summarise(rows, "aspect", min_n=30, keep_below=True)
    assert summaries.below_floor(every.withColumn("all", F.lit(1)), "aspect", ["all"]
                                 ).collect()[0].below_min_n == "y"


def test_floor_may_sit_on_another_count(make):
    rows = make(repeat("I", "A", "x", 3, 50) + repeat("I", "A", "y", 6, 8))
    got = summaries.summarise(rows, "aspect", min_n=5, min_n_column="neg_count").collect()
    assert [r.aspect for r in got] == ["y"]
    with pytest.raises(ValueError):
        summaries.summarise(rows, "aspect", min_n=5, min_n_column="neg_rate")


def test_null_sentiment_counts_in_the_total_only(make):
    row = summaries.summarise(make([("I", "A", "x", None), ("I", "A", "x", "negative")])).first()
    assert (row.total_count, row.neg_count, row.neu_count, row.pos_count) == (2, 1, 0, 0)


def test_whole_equals_sum_of_groups(make):
    rows = make(repeat("I", "A", "x", 3, 9) + repeat("I", "B", "y", 2, 4))
    cells = summaries.cells(rows, ["org", "aspect"])
    total = summaries.roll_up(cells, []).first()
    assert (total.total_count, total.neg_count) == (13, 5)


def test_partitioning_does_not_change_results(make):
    rows = make(repeat("I", "A", "x", 3, 9) + repeat("I", "B", "y", 2, 4))
    one = summaries.summarise(rows.coalesce(1), "aspect", ["org"]).collect()
    many = summaries.summarise(rows.repartition(7), "aspect", ["org"]).collect()
    assert sorted(one) == sorted(many)


def test_polarisation_edges(spark):
    table = spark.createDataFrame([("a", 5, 5), ("b", 0, 9), ("c", 0, 0)],
                                  "aspect string, positive long, negative long")
    got = {r.aspect: r.polarisation for r in summaries.add_polarisation(table).collect()}
    assert got == {"a": 0.5, "b": 0.0, "c": 0.0}


def test_priority_with_zero_range_is_zero(spark):
    table = spark.createDataFrame([("a", 7, 0.5), ("b", 7, 0.5)],
                                  "aspect string, total long, neg_share double")
    assert {r.priority for r in summaries.add_priority(table).collect()} == {0.0}


def test_share_of_nothing_is_null(make):
    row = summaries.share_of(make([("I", "A", "x", "negative")]).where("org = 'Z'"),
                             "negative").first()
    assert (row.n, row["count"], row.share) == (0, 0, None)


def test_joint_first_shares_a_rank(spark):
    rows = spark.createDataFrame([("email", 35, 40), ("access", 35, 40), ("phone", 26, 40)],
                                 "aspect string, neg long, n long").selectExpr(
        "aspect", "neg / n AS r")
    ranked = ranking.rank_groups(rows, "r", top_k=3)
    assert {r.aspect: r.rank for r in ranked.collect()} == {"email": 1, "access": 1, "phone": 3}
    places = ranking.joint_places(ranked.withColumn("s", F.lit(1)), "aspect", ["s"]).collect()
    assert {(r.rank, r.groups) for r in places} == {(1, "access,email"), (3, "phone")}


def test_exclusion_comes_before_ranking(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "g string, v long")
    ranked = ranking.rank_groups(rows, "v", top_k=2, exclude=("g", ["a"]))
    assert {r.g: r.rank for r in ranked.collect()} == {"b": 1, "c": 2}


@pytest.mark.parametrize("ascending", [True, False])
def test_wide_ranks_equal_window_ranks(spark, ascending):
    # half of one scope shares a value, as a hot tie would
    rows = spark.range(4000).selectExpr(
        "id", "id % 3 AS s", "CASE WHEN id % 2 = 0 THEN 7D ELSE pmod(id * 7919, 101) / 10D END AS v")
    narrow = ranking.rank_groups(rows, "v", ["s"], None, ascending)
    wide = ranking.wide_rank(rows, "v", ["s"], ascending)
    assert narrow.exceptAll(wide.select(narrow.columns)).count() == 0
    top = ranking.wide_top(rows, "v", ["s"], 5, ascending)
    assert top.select(narrow.columns).exceptAll(narrow.where("rank <= 5")).count() == 0
    assert top.count() == narrow.where("rank <= 5").count()
    whole = ranking.wide_rank(rows, "v", [], ascending)
    plain = ranking.rank_groups(rows, "v", [], None, ascending)
    assert whole.select(plain.columns).exceptAll(plain).count() == 0


def test_exact_quantiles(spark):
    rows = spark.range(101).selectExpr("id % 2 AS s", "id * id AS v")
    got = {(r.s, r.q): r.value for r in ranking.quantiles(rows, "v", [0.0, 0.25, 0.5, 1.0],
                                                          ["s"]).collect()}
    want = {(r.s, q): r[i + 1] for r in rows.groupBy("s").agg(
        *[F.percentile("v", q) for q in (0.0, 0.25, 0.5, 1.0)]).collect()
        for i, q in enumerate((0.0, 0.25, 0.5, 1.0))}
    assert got == want


def test_frame_shows_absent_groups(make):
    rows = make(repeat("I", "A", "x", 1, 2) + repeat("J", "B", "y", 1, 2))
    frame = frames.full_frame(rows, "industry", "aspect")
    assert frame.count() == 4
    gone = {(r.industry, r.aspect) for r in frames.absent(frame, rows, ["industry", "aspect"])
            .collect()}
    assert gone == {("I", "y"), ("J", "x")}


def test_a_vocabulary_that_is_none_is_refused(spark, monkeypatch):
    monkeypatch.setattr(frames, "VOCABULARY_LIMIT", 5)
    rows = spark.range(20).selectExpr("cast(id AS string) AS org", "'I' AS industry")
    with pytest.raises(Exception, match="more than 5 labels"):
        frames.full_frame(rows, "industry", "org").collect()
