from tonescope.operators import summaries
from tonescope.plans import answerability, older, questions


def repeat(industry, org, aspect, negative, total):
    return ([(industry, org, aspect, "negative")] * negative
            + [(industry, org, aspect, "positive")] * (total - negative))


def cells_of(make, *groups):
    rows = [r for g in groups for r in repeat(*g)]
    return summaries.cells(make(rows))


def test_thin_and_absent_are_different(make):
    segs = questions.segment_cells(cells_of(make, ("I", "A", "x", 5, 29), ("I", "A", "y", 9, 30),
                                            ("J", "B", "y", 1, 40)))
    got = {(r.segment, r.aspect): r for r in questions.single_rate(segs).collect()}
    assert got["A", "x"].reason == questions.THIN and got["A", "x"].neg_rate is None
    assert got["B", "x"].reason == questions.ABSENT and got["B", "x"].total_count == 0
    assert got["A", "y"].neg_rate == 9 / 30 and not got["A", "y"].abstain


def test_top_complaints_abstains_below_three_topics(make):
    segs = questions.segment_cells(cells_of(
        make, ("I", "A", "x", 20, 30), ("I", "A", "y", 10, 30), ("I", "A", "z", 10, 31),
        ("I", "B", "x", 5, 50)))
    rows = questions.top_complaints(segs).collect()
    assert {(r.aspect, r["rank"]) for r in rows if r.segment == "A"} == {("x", 1), ("y", 2), ("z", 2)}
    (b,) = [r for r in rows if r.segment == "B"]
    assert b.abstain and b.aspect is None and b.reason == questions.FEW


def test_empty_side_is_visible(spark, make):
    segs = questions.segment_cells(cells_of(make, ("I", "A", "x", 20, 40)))
    pairs = spark.createDataFrame([("A", "Nobody", "x")], "a string, b string, aspect string")
    higher = questions.which_is_higher(pairs, segs).first()
    assert higher.abstain and higher.reason == questions.ABSENT and higher.total_b == 0
    tested = questions.significant_difference(pairs, segs).first()
    assert tested.abstain and tested.z is None and tested.reason == questions.ABSENT


def test_industry_average_includes_small_orgs(make):
    told = questions.orgs_against_industry(cells_of(
        make, ("I", "A", "x", 10, 40), ("I", "B", "x", 20, 40), ("I", "C", "x", 20, 20))).collect()
    assert {r.org for r in told} == {"A", "B"}
    assert all(r.industry_rate == 50 / 100 for r in told)
    assert {r.org: r["rank"] for r in told} == {"B": 1, "A": 2}


def test_driver_keeps_ties_and_reports_none(make):
    segs = questions.segment_cells(cells_of(
        make, ("I", "A", "x", 15, 30), ("I", "A", "y", 20, 40), ("I", "B", "x", 9, 9)))
    rows = questions.biggest_driver(segs).collect()
    assert {r.aspect for r in rows if r.segment == "A"} == {"x", "y"}
    (b,) = [r for r in rows if r.segment == "B"]
    assert b.abstain and b.aspect is None


def test_priority_floor_is_on_negatives(make):
    segs = questions.segment_cells(cells_of(
        make, ("I", "A", "x", 29, 500), ("I", "A", "reviews", 40, 50), ("I", "A", "y", 30, 60)))
    rows = [r for r in questions.priorities(segs).collect() if r.segment == "A"]
    assert [(r.aspect, r["rank"], r.actionable) for r in sorted(rows, key=lambda r: r["rank"])] == [
        ("reviews", 1, False), ("y", 2, True)]
    assert rows[0].prevalence in (50 / 610, 60 / 610)


def test_why_worse_picks_the_widest_actionable_gap(spark, make):
    cells = cells_of(
        make, ("I", "A", "reviews", 38, 40), ("I", "A", "x", 30, 40), ("I", "A", "y", 20, 40),
        ("I", "B", "reviews", 4, 40), ("I", "B", "x", 25, 40), ("I", "B", "y", 10, 40),
        ("I", "C", "x", 39, 40), ("I", "C", "y", 39, 40), ("I", "C", "reviews", 39, 40))
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "a string, b string")
    got = {r.b: r for r in questions.why_worse(pairs, questions.segment_cells(cells)).collect()}
    assert got["B"].fix_first == "y" and got["B"].premise and round(got["B"].gap_pp, 6) == 25
    assert got["C"].abstain and got["C"].reason == questions.NO_ACTIONABLE and not got["C"].premise


def test_report_tests_every_joint_first_topic_against_the_rest(make):
    cells = cells_of(
        make, ("I", "A", "email", 35, 40), ("I", "A", "access", 35, 40), ("I", "A", "phone", 26, 40),
        ("I", "B", "email", 50, 100), ("I", "B", "access", 90, 100), ("I", "B", "phone", 5, 10),
        ("I", "C", "email", 1, 10))
    got = {r.org: r for r in questions.full_report(cells).collect()}
    a = got["A"]
    assert [(i["rank"], i["aspect"]) for i in a.top_issues] == [(1, "access"), (1, "email"), (3, "phone")]
    tested = {c["aspect"]: c for c in a.comparisons}
    assert set(tested) == {"access", "email"}
    assert tested["email"]["industry_rate"] == 86 / 150 and tested["email"]["rest_rate"] == 51 / 110
    assert tested["email"]["significant"] and tested["access"]["sufficient"] is False
    assert a.status == "full" and a.n_reviews == 120
    assert got["B"].status == "partial" and got["B"].roadmap is None and got["B"].top_issues is None
    assert got["C"].status == "partial" and got["C"].reason == questions.THIN


def test_question_text_and_declared_distribution(spark):
    params = spark.createDataFrame(
        [("T1-1", "T1", "Bank", "Other", "speed", "negative"), ("T7-1", "T7", "Bank", None, None, None)],
        "task_id string, template string, a string, b string, aspect string, sentiment string")
    told = {r.task_id: r.question for r in answerability.question_text(params).collect()}
    assert told["T1-1"] == "What proportion of Bank reviews that mention speed are negative?"
    assert told["T7-1"] == ("What is the biggest driver of dissatisfaction at Bank? Rank topics by negative sentiment rate"
                            " and ignore any topics with less than 30 mentions.")
    assert answerability.distribution_gaps(params, params, ["template"]).count() == 0
    assert answerability.distribution_gaps(params, params.limit(1), ["template"]).count() == 1


def test_replay_tolerance(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.5), ("z", None), ("only", 1.0)], "k string, value double")
    b = spark.createDataFrame([("x", 0.50005), ("y", 0.51), ("z", None), ("gone", 1.0)],
                              "k string, value double")
    assert {r.k for r in older.mismatches(a, b, ["k"]).collect()} == {"y", "only", "gone"}


def test_composite_components(make):
    cells = cells_of(make, ("I", "A", "x", 5, 10), ("I", "B", "y", 1, 10))
    segs = questions.segment_cells(cells)
    homes = segs.where("kind = 'org'").select("segment", "industry").distinct()
    got = {(r.segment, r.component, r.position): (r.label, r.value)
           for r in older.composite(segs, homes).collect() if r.component != "overview"}
    assert got["A", "org_drivers", 1] == ("x", 0.5)
    assert got["B", "industry_drivers", 1] == ("x", 0.5)


def test_composite_components_are_written_apart(make):
    """The branches of a union may share tasks: none may still have to sort, rank or aggregate."""
    segs = questions.segment_cells(cells_of(make, ("I", "A", "x", 5, 10), ("I", "B", "y", 1, 10)))
    homes = segs.where("kind = 'org'").select("segment", "industry").distinct()
    plan = older.composite(segs, homes)._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Window", "Sort", "Aggregate", "Exchange"))
