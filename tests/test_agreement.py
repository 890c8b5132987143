import numpy as np
import pytest
from pyspark.sql import functions as F

from tonescope.operators import agreement

# Published ratings of three raters, and of the pilot with the intended score last.
FULL = """T1-E1:555 T1-E2:001 T1-H1:555 T1-H2:000 T1-H3:555 T10-E1:332 T10-E2:333 T10-H1:423
T10-H2:323 T10-H3:323 T2-E1:554 T2-E2:554 T2-H1:454 T2-H2:555 T2-H3:454 T3-E1:555 T3-E2:555
T3-H1:555 T3-H2:555 T3-H3:355 T4-E1:454 T4-E2:444 T4-H1:001 T4-H2:555 T4-H3:555 T5-E1:454
T5-E2:344 T5-H1:200 T5-H2:455 T5-H3:154 T6-E1:434 T6-E2:444 T6-H1:344 T6-H2:555 T6-H3:555
T7-E1:444 T7-E2:454 T7-H1:434 T7-H2:333 T7-H3:455 T8-E1:455 T8-E2:355 T8-H1:454 T8-H2:434
T8-H3:455 T9-E1:122 T9-E2:223 T9-H1:222 T9-H2:222 T9-H3:021""".split()
PILOT = """DIAG-05:5555 DIAG-06:4343 DIAG-07:2454 DIAG-08:1111 PRES-01:4545 PRES-02:0000
PRES-03:4353 PRES-04:4444 PRES-05:2222 PRES-06:4535""".split()
JUDGE = """T1-E1:5 T1-E2:0 T1-H1:5 T1-H2:0 T1-H3:4 T10-E1:3 T10-E2:3 T10-H1:2 T10-H2:2 T10-H3:5
T2-E1:5 T2-E2:5 T2-H1:5 T2-H2:5 T2-H3:5 T3-E1:5 T3-E2:5 T3-H1:5 T3-H2:5 T3-H3:5 T4-E1:5 T4-E2:5
T4-H1:0 T4-H2:5 T4-H3:5 T5-E1:5 T5-E2:5 T5-H1:0 T5-H2:5 T5-H3:5 T6-E1:5 T6-E2:4 T6-H1:5 T6-H2:5
T6-H3:5 T7-E1:5 T7-E2:5 T7-H1:3 T7-H2:3 T7-H3:5 T8-E1:5 T8-E2:5 T8-H1:5 T8-H2:5 T8-H3:5 T9-E1:2
T9-E2:3 T9-H1:2 T9-H2:2 T9-H3:2""".split()
RATERS = ["r1", "r2", "r3"]


def rated(spark, lines):
    rows = [(line.split(":")[0], f"r{i + 1}", int(s)) for line in lines
            for i, s in enumerate(line.split(":")[1][:3])]
    return spark.createDataFrame(rows, "unit string, rater string, score int")


@pytest.fixture(scope="module")
def full(spark):
    return rated(spark, FULL).cache()


def test_published_alphas(spark, full):
    assert round(agreement.alpha(full).first().alpha, 4) == 0.7747
    assert round(agreement.alpha(rated(spark, PILOT)).first().alpha, 4) == 0.6766
    kept = agreement.without_wide_spread(full)
    assert round(agreement.alpha(kept).first().alpha, 4) == 0.8302


def test_pruned_units(full):
    assert {r.unit for r in agreement.wide_spread(full).collect()} == {
        "T10-H1", "T3-H3", "T5-H1", "T5-H3", "T8-E2", "T9-H3"}


def test_pairwise_agreement(full):
    mean = agreement.mean_pair_agreement(agreement.rater_pairs(full, RATERS)).first()
    assert round(mean.exact, 3) == 0.580 and round(mean.within_1, 4) == 0.9333
    kept = agreement.rater_pairs(agreement.without_wide_spread(full), RATERS)
    assert round(agreement.mean_pair_agreement(kept).first().exact, 4) == 0.6364
    assert kept.agg(F.sum("n_equal"), F.sum("n_both")).first() == (84, 132)


def test_judge_agreement(spark, full):
    judge = spark.createDataFrame([(j.split(":")[0], int(j.split(":")[1])) for j in JUDGE],
                                  "unit string, judge_score int")
    kept = agreement.without_wide_spread(full)
    assert round(agreement.judge_agreement(kept, judge, RATERS).first().pairwise_exact, 4) == 0.6061
    assert round(agreement.judge_bias(kept, judge).first().mean_bias, 4) == 0.2727


def test_weighted_agreement_with_intended(spark):
    intended = spark.createDataFrame([(p.split(":")[0], int(p[-1])) for p in PILOT],
                                     "unit string, intended_score int")
    scored = rated(spark, PILOT).join(intended, "unit")
    got = {r.rater: round(r.w_agree, 3) for r in agreement.against_intended(scored, "rater")
           .collect()}
    assert sorted(got.values()) == [0.956, 0.968, 1.0]


def reference_alpha(units):
    """Textbook alpha from lists of ratings per unit."""
    o = np.zeros((6, 6))
    for scores in units:
        for i, a in enumerate(scores):
            for j, b in enumerate(scores):
                if i != j:
                    o[a, b] += 1 / (len(scores) - 1)
    n_c, n = o.sum(1), o.sum()
    cum = np.cumsum(n_c)
    d = np.array([[(cum[max(a, b)] - cum[min(a, b)] + n_c[min(a, b)]
                    - (n_c[a] + n_c[b]) / 2) ** 2 for b in range(6)] for a in range(6)])
    return 1 - (n - 1) * (o * d).sum() / (np.outer(n_c, n_c) * d).sum()


def test_alpha_with_missing_ratings_and_a_hot_unit(spark):
    rng = np.random.default_rng(3)
    units = {f"u{i}": [int(x) for x in rng.integers(0, 6, rng.integers(1, 5))] for i in range(40)}
    units["hot"] = [int(x) for x in rng.integers(2, 5, 60)]   # a third of all ratings on one unit
    rows = [(u, f"r{i}", s) for u, ss in units.items() for i, s in enumerate(ss)]
    got = agreement.alpha(spark.createDataFrame(rows, "unit string, rater string, score int"))
    want = reference_alpha([s for s in units.values() if len(s) > 1])
    assert abs(got.first().alpha - want) < 1e-12


def test_bootstrap_brackets_the_estimate_and_repeats(full):
    boot = agreement.bootstrap_alpha(full, replicates=300, seed=1)
    first, again = (agreement.bootstrap_interval(b).first()
                    for b in (boot, agreement.bootstrap_alpha(full.repartition(5), 300, 1)))
    # sums may run in another order on other partitions; the draws themselves are the same
    assert all(abs(a - b) < 1e-9 for a, b in zip(first, again))
    assert first.low < 0.7747 < first.high
    assert boot.count() == 300 and boot.where("units <> 50").count() == 0
    # brute force: 300 resamples of the unit list
    units = [[int(c) for c in line.split(":")[1]] for line in FULL]
    rng = np.random.default_rng(9)
    brute = [reference_alpha([units[i] for i in rng.integers(0, 50, 50)]) for _ in range(300)]
    assert abs(np.percentile(brute, 2.5) - first.low) < 0.06
    assert abs(np.percentile(brute, 97.5) - first.high) < 0.06


def test_small_sample_correction(spark):
    row = spark.createDataFrame([(0.5, 10)], "a double, n int").select(
        agreement.corrected_alpha(F.col("a"), F.col("n"), 3).alias("c")).first()
    plain = (2 * 10 * 0.5 - 1) / 19
    unbiased = ((30 - 1) * plain + 1) / (2 * plain + 3 * 9 + 1)
    assert abs(row.c - (19 * unbiased + 1) / 20) < 1e-12


def test_consensuality_against_brute_force(spark):
    lines = {"a": [5, 4, 1], "b": [2, 2, 3], "c": [0, None, 4], "d": [None, None, 3]}
    rows = [(u, f"r{i + 1}", s) for u, ss in lines.items() for i, s in enumerate(ss)
            if s is not None]
    got = {r.rater: r.consensuality for r in agreement.consensuality(
        spark.createDataFrame(rows, "unit string, rater string, score int")).collect()}

    def spread(skip):
        kept = [[s for i, s in enumerate(ss) if s is not None and i != skip]
                for ss in lines.values()]
        return np.mean([np.std(k) for k in kept if k])

    for i in range(3):
        assert abs(got[f"r{i + 1}"] - (spread(i) - spread(None))) < 1e-12


@pytest.fixture(scope="module")
def crowd(spark):
    """100 raters, 300 units, most ratings missing, some without a score, one unit rated by all, one pair without a common unit."""
    draw = np.random.default_rng(11)
    table = {(u, r): int(draw.integers(0, 6)) for u in range(300) for r in range(100)
             if u == 7 or draw.random() < 0.08}
    table = {(u, r): s for (u, r), s in table.items() if r < 98 or u % 2 == r % 2}
    rows = [(f"u{u}", f"r{r:02d}", s) for (u, r), s in table.items()]
    rows += [rows[0][:2] + (-1,), ("u5", "r00", None), ("alone", None, 3)]   # repeated, without score, without rater
    judge = {u: int(draw.integers(0, 6)) for u in range(300) if u % 10}
    return (table, spark.createDataFrame(rows, "unit string, rater string, score int"), judge,
            spark.createDataFrame([(f"u{u}", j) for u, j in judge.items()], "unit string, judge_score int"))


@pytest.mark.parametrize("tile", [256, 7])
def test_pairs_of_100_raters(crowd, tile, monkeypatch):
    monkeypatch.setattr(agreement, "TILE", tile)
    monkeypatch.setattr(agreement, "UNITS", 64)
    table, ratings, _, _ = crowd
    units = ratings.select("unit").distinct().count()
    names = [f"r{i:02d}" for i in range(100)]
    got = {(p.rater_a, p.rater_b): p for p in agreement.rater_pairs(ratings, names).collect()}
    assert len(got) == 100 * 99 // 2
    met = {(p.rater_a, p.rater_b): p for p in agreement.rater_pairs(ratings).collect()}
    assert met == {k: p for k, p in got.items() if p.n_both}
    by = [{u: s for (u, r), s in table.items() if r == k} for k in range(100)]
    for a in range(100):
        for b in range(a + 1, 100):
            gaps = [by[a][u] - by[b][u] for u in by[a].keys() & by[b].keys()]
            p = got[f"r{a:02d}", f"r{b:02d}"]
            assert (p.n_both, p.n_equal) == (len(gaps), gaps.count(0))
            assert abs(p.within_1 - sum(abs(g) <= 1 for g in gaps) / units) < 1e-12
            assert p.mse is None if not gaps else abs(p.mse - np.mean(np.square(gaps))) < 1e-12
    assert got["r98", "r99"].n_both == 0 and got["r98", "r99"].exact == 0


def test_judge_against_100_raters(crowd):
    table, ratings, judge, judged = crowd
    got = {r.reference: r for r in agreement.judge_references(ratings, judged, [f"r{i:02d}" for i in range(100)])
           .collect()}
    assert len(got) == 100 + 100 * 99 // 2 + 2
    of = {}
    for (u, r), s in table.items():
        if u in judge:
            of.setdefault(u, {})[r] = s

    def check(name, names):
        gaps = [judge[u] - np.mean([s for r, s in own.items() if r in names]) for u, own in of.items() if names & own.keys()]
        assert got[name].n == len(gaps) and abs(got[name].mse - np.mean(np.square(gaps))) < 1e-9

    check("r03", {3})
    check("mean(r03, r70)", {3, 70})
    check("mean(r98, r99)", {98, 99})
    check("mean(all)", set(range(100)))
    row = agreement.judge_agreement(ratings, judged).first()
    hits = [abs(judge[u] - s) for (u, _), s in table.items() if u in judge]
    assert abs(row.pairwise_exact - hits.count(0) / (100 * row.n_units)) < 1e-12
    assert abs(row.pairwise_within_1 - sum(h <= 1 for h in hits) / (100 * row.n_units)) < 1e-12


def test_pairs_of_nothing(spark, full):
    empty = full.where("false")
    assert agreement.rater_pairs(empty).count() == 0
    assert [p.n_both for p in agreement.rater_pairs(empty, ["r1", "r2"]).collect()] == [0]
