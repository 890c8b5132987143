"""Rater agreement, judge validity and rating logistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonescope.catalog.base import on_ratings, query
from tonescope.functions import text
from tonescope.operators import agreement
from tonescope.sources import derived

RATERS = ["r1", "r2", "r3"]

# alpha by its textbook definition: ordered pairs of ratings inside a unit, weight 1/(m-1)
ALPHA = """, u AS (SELECT {k} unit, count(*) AS m FROM {t} GROUP BY ALL HAVING count(*) >= 2),
    pairs AS (SELECT {ka} a.score AS c, b.score AS k, 1e0 / (u.m - 1) AS w FROM {t} a JOIN {t} b
        ON a.unit = b.unit AND a.rater <> b.rater {on} JOIN u ON u.unit = a.unit {onu}),
    o AS (SELECT {k} c, k, sum(w) AS o FROM pairs GROUP BY ALL),
    nc AS (SELECT {k} c, sum(o) AS n FROM o GROUP BY ALL),
    d AS (SELECT {kx} x.c, y.c AS k, x.n AS nx, y.n AS ny, pow((SELECT sum(z.n) FROM nc z WHERE z.c BETWEEN least(x.c, y.c)
        AND greatest(x.c, y.c) {onz}) - (x.n + y.n) / 2, 2) AS d2 FROM nc x JOIN nc y ON TRUE {ony})"""


def alpha_sql(table: str, keys: str = "") -> str:
    if not keys:
        parts = dict(k="", ka="", on="", onu="", kx="", onz="", ony="")
    else:
        parts = dict(k=f"{keys},", ka=f"a.{keys} AS {keys},", on=f"AND a.{keys} = b.{keys}",
                     onu=f"AND u.{keys} = a.{keys}", kx=f"x.{keys} AS {keys},",
                     onz=f"AND z.{keys} = x.{keys}", ony=f"AND x.{keys} = y.{keys}")
    body = ALPHA.format(t=table, **parts)
    group = f"GROUP BY d.{keys}" if keys else ""
    pick = f"d.{keys} AS {keys}," if keys else ""
    same = f"AND o.{keys} = d.{keys}" if keys else ""
    within = f"WHERE {keys} = d.{keys}" if keys else ""
    return body + f"""
    SELECT {pick} (SELECT count(*) FROM u {within}) AS units,
      round(1 - (sum(coalesce(o.o, 0) * d2) * ((SELECT sum(n) FROM nc {within}) - 1)) / sum(nx * ny * d2), 9) AS alpha
    FROM d LEFT JOIN o ON o.c = d.c AND o.k = d.k {same} {group}"""


def rounded(df):
    return df.withColumn("alpha", F.round("alpha", 9)).drop("pairable")


@query("alpha_ordinal", "K-1", on_ratings(alpha_sql("ratings")))
def alpha_ordinal(spark, folder):
    return rounded(agreement.alpha(derived.ratings(spark, folder)))


@query("alpha_per_template", "K-1", on_ratings(
    ", rt AS (SELECT ratings.*, template FROM ratings JOIN refs USING (unit))"
    + alpha_sql("rt", "template")))
def alpha_per_template(spark, folder):
    rows = derived.ratings(spark, folder).join(
        derived.reference_scores(spark, folder).select("unit", "template"), "unit")
    return rounded(agreement.alpha(rows, keys=["template"]))


@query("alpha_two_label_raters", "K-1", """WITH lr AS (SELECT doc_id AS unit, 'q' AS rater, quality AS score FROM labels
    UNION ALL SELECT doc_id, 't', 1 - toxic FROM labels)""" + alpha_sql("lr"))
def alpha_two_label_raters(spark, folder):
    labels = derived.table(spark, folder, "labels")
    both = F.array(F.struct(F.lit("q").alias("rater"), F.col("quality").alias("score")),
                   F.struct(F.lit("t").alias("rater"), (1 - F.col("toxic")).alias("score")))
    rows = labels.select(F.col("doc_id").alias("unit"), F.inline(both))
    return rounded(agreement.alpha(rows, [0, 1]))


@query("alpha_after_pruning", "K-6 B-13 K-1", on_ratings(
    ", kept AS (SELECT * FROM ratings WHERE unit NOT IN (SELECT unit FROM ratings GROUP BY unit "
    "HAVING max(score) - min(score) >= 2))" + alpha_sql("kept")))
def alpha_after_pruning(spark, folder):
    kept = agreement.without_wide_spread(derived.ratings(spark, folder))
    return rounded(agreement.alpha(kept))


@query("alpha_corrected", "K-3", on_ratings(
    alpha_sql("ratings").replace("    SELECT  (SELECT", "    , base AS (SELECT (SELECT", 1) + """),
    f AS (SELECT units, alpha, (2 * units * alpha - 1) / (2 * units - 1) AS kf FROM base),
    g AS (SELECT units, alpha, ((3 * units - 1) * kf + 1) / (2 * kf + (3 * (units - 1) + 1)) AS ku FROM f)
    SELECT units, alpha, round(((2 * units - 1) * ku + 1) / (2 * units), 6) AS corrected FROM g"""))
def alpha_corrected(spark, folder):
    base = rounded(agreement.alpha(derived.ratings(spark, folder)))
    corrected = agreement.corrected_alpha(F.col("alpha"), F.col("units"), 3)
    return base.withColumn("corrected", F.round(corrected, 6))


@query("alpha_bootstrap", "K-2")
def alpha_bootstrap(spark, folder):
    """Percentile interval over replicates; the draws are random numbers, so SQL has no twin."""
    boot = agreement.bootstrap_alpha(derived.ratings(spark, folder), replicates=1000, seed=0)
    return agreement.bootstrap_interval(boot)


WIDE = """, w AS (SELECT unit, max(score) FILTER (rater = 'r1') AS r1, max(score) FILTER (rater = 'r2') AS r2,
    max(score) FILTER (rater = 'r3') AS r3, median(score)::DOUBLE AS median FROM ratings GROUP BY unit)"""


def pair_sql(a, b):
    return f"""SELECT '{a}' AS rater_a, '{b}' AS rater_b, count({a} - {b}) AS n_both,
      count(*) FILTER ({a} = {b}) AS n_equal, (count(*) FILTER ({a} = {b}))::DOUBLE / count(*) AS exact,
      (count(*) FILTER (abs({a} - {b}) <= 1))::DOUBLE / count(*) AS within_1,
      sum(({a} - {b}) * ({a} - {b}))::DOUBLE / count({a} - {b}) AS mse FROM w"""


PAIR_ROWS = " UNION ALL ".join(pair_sql(a, b) for a, b in (("r1", "r2"), ("r1", "r3"), ("r2", "r3")))


@query("raters_pairwise", "K-4 K-5 C-8", on_ratings(WIDE + " " + PAIR_ROWS))
def raters_pairwise(spark, folder):
    return agreement.rater_pairs(derived.ratings(spark, folder), RATERS)


@query("raters_mean_agreement", "K-4", on_ratings(
    WIDE + f" SELECT round(avg(exact), 9) AS exact, round(avg(within_1), 9) AS within_1 FROM ({PAIR_ROWS})"))
def raters_mean_agreement(spark, folder):
    pairs = agreement.rater_pairs(derived.ratings(spark, folder), RATERS)
    mean = agreement.mean_pair_agreement(pairs)
    return mean.select(*[F.round(c, 9).alias(c) for c in mean.columns])


@query("raters_mse_vs_others", "K-5", on_ratings("""
    SELECT a.rater, round(avg(pow(a.score - o, 2)), 9) AS mse_others, count(*) AS n FROM ratings a JOIN
      (SELECT x.unit, x.rater, avg(y.score::DOUBLE) AS o FROM ratings x JOIN ratings y
       ON x.unit = y.unit AND x.rater <> y.rater GROUP BY ALL) b USING (unit, rater) GROUP BY a.rater"""))
def raters_mse_vs_others(spark, folder):
    told = agreement.mse_against_others(derived.ratings(spark, folder))
    return told.withColumn("mse_others", F.round("mse_others", 9))


@query("units_pruned", "K-6", on_ratings("""
    SELECT unit FROM ratings GROUP BY unit HAVING max(score) - min(score) >= 2"""))
def units_pruned(spark, folder):
    return agreement.wide_spread(derived.ratings(spark, folder))


def judge(spark, folder):
    return derived.reference_scores(spark, folder)


@query("judge_vs_raters", "K-7 C-3", on_ratings(WIDE + """
    , j AS (SELECT w.*, judge_score AS j FROM w LEFT JOIN refs USING (unit))
    SELECT count(*) AS n_units, round(avg(j::DOUBLE), 9) AS mean_score,
      round(((count(*) FILTER (j = r1))::DOUBLE / count(*) + (count(*) FILTER (j = r2))::DOUBLE / count(*)
        + (count(*) FILTER (j = r3))::DOUBLE / count(*)) / 3, 9) AS pairwise_exact,
      round(((count(*) FILTER (abs(j - r1) <= 1))::DOUBLE / count(*) + (count(*) FILTER (abs(j - r2) <= 1))::DOUBLE / count(*)
        + (count(*) FILTER (abs(j - r3) <= 1))::DOUBLE / count(*)) / 3, 9) AS pairwise_within_1,
      (count(*) FILTER (j = median))::DOUBLE / count(*) AS median_exact,
      (count(*) FILTER (abs(j - median) <= 1))::DOUBLE / count(*) AS median_within_1 FROM j"""))
def judge_vs_raters(spark, folder):
    told = agreement.judge_agreement(derived.ratings(spark, folder), judge(spark, folder), RATERS)
    return told.select("n_units", *[F.round(c, 9).alias(c) for c in
                                    ("mean_score", "pairwise_exact", "pairwise_within_1")],
                       "median_exact", "median_within_1")


@query("judge_vs_median_alpha", "K-7 K-1", on_ratings(WIDE + """
    , two AS (SELECT unit, 'j' AS rater, judge_score::DOUBLE AS score FROM w JOIN refs USING (unit)
      UNION ALL SELECT unit, 'm', median FROM w JOIN refs USING (unit))""" + alpha_sql("two")))
def judge_vs_median_alpha(spark, folder):
    return rounded(agreement.judge_against_median(derived.ratings(spark, folder),
                                                  judge(spark, folder)))


def _mean(*cols):
    up = " + ".join(f"coalesce({c}, 0)" for c in cols)
    n = " + ".join(f"({c} IS NOT NULL)::INT" for c in cols)
    return f"({up})::DOUBLE / nullif({n}, 0)"


REFS = [("r1", "r1::DOUBLE"), ("r2", "r2::DOUBLE"), ("r3", "r3::DOUBLE"),
        ("mean(r1, r2)", _mean("r1", "r2")), ("mean(r1, r3)", _mean("r1", "r3")),
        ("mean(r2, r3)", _mean("r2", "r3")), ("mean(all)", _mean("r1", "r2", "r3")),
        ("median", "median")]


@query("judge_mse_references", "K-8", on_ratings(
    WIDE + ", j AS (SELECT w.*, judge_score AS j FROM w JOIN refs USING (unit)) " + " UNION ALL ".join(
        f"SELECT '{n}' AS reference, round(avg((j - {e}) * (j - {e})), 9) AS mse, count(j - {e}) AS n FROM j"
        for n, e in REFS)))
def judge_mse_references(spark, folder):
    told = agreement.judge_references(derived.ratings(spark, folder), judge(spark, folder), RATERS)
    return told.withColumn("mse", F.round("mse", 9))


TYPE_SQL = """CASE WHEN template <= 3 THEN 'descriptive' WHEN template <= 7 THEN 'diagnostic'
    ELSE 'prescriptive' END"""


@query("judge_bias_by_type", "K-9 I-4", on_ratings(WIDE + f"""
    SELECT {TYPE_SQL} AS task_type, round(avg(judge_score - median), 9) AS mean_bias, count(*) AS n_units
    FROM w JOIN refs USING (unit) GROUP BY 1"""))
def judge_bias_by_type(spark, folder):
    typed = judge(spark, folder).withColumn(
        "task_type", text.task_type(F.concat(F.lit("T"), "template")))
    told = agreement.judge_bias(derived.ratings(spark, folder), typed, "task_type")
    return told.withColumn("mean_bias", F.round("mean_bias", 9))


@query("judge_bias_by_template", "K-9", on_ratings(WIDE + """
    SELECT template, round(avg(judge_score - median), 9) AS mean_bias, count(*) AS n_units
    FROM w JOIN refs USING (unit) GROUP BY template"""))
def judge_bias_by_template(spark, folder):
    told = agreement.judge_bias(derived.ratings(spark, folder), judge(spark, folder), "template")
    return told.withColumn("mean_bias", F.round("mean_bias", 9))


INTENDED = """round(1 - avg(pow(s - intended_score, 2)) / 25, 9) AS w_agree,
    round(avg((s = intended_score)::INT::DOUBLE), 9) AS exact, round(sqrt(avg(pow(s - intended_score, 2))), 9) AS imperfection,
    round(avg((s - intended_score)::DOUBLE), 9) AS bias, count(*) AS n"""


def _nine(df, key):
    return df.select(key, *[F.round(c, 9).alias(c) for c in ("w_agree", "exact", "imperfection",
                                                             "bias")], "n")


@query("raters_vs_intended", "K-10", on_ratings(f"""
    SELECT rater, {INTENDED} FROM (SELECT rater, score AS s, intended_score FROM ratings JOIN refs USING (unit))
    GROUP BY rater"""))
def raters_vs_intended(spark, folder):
    scored = derived.ratings(spark, folder).join(judge(spark, folder), "unit")
    return _nine(agreement.against_intended(scored, "rater"), "rater")


@query("panel_vs_intended", "K-10", on_ratings(WIDE + f"""
    SELECT template, {INTENDED} FROM (SELECT template, median AS s, intended_score FROM w JOIN refs USING (unit))
    GROUP BY template"""))
def panel_vs_intended(spark, folder):
    panel = agreement.unit_consensus(derived.ratings(spark, folder)).withColumn(
        "score", F.col("median")).join(judge(spark, folder), "unit")
    return _nine(agreement.against_intended(panel, "template"), "template")


@query("raters_consensuality", "K-11", on_ratings("""
    , g AS (SELECT avg(s) AS g FROM (SELECT unit, stddev_pop(score::DOUBLE) AS s FROM ratings GROUP BY unit)),
    wo AS (SELECT r.rater, x.unit, stddev_pop(x.score::DOUBLE) AS s FROM (SELECT DISTINCT rater FROM ratings) r
      JOIN ratings x ON x.rater <> r.rater GROUP BY ALL)
    SELECT rater, round(avg(s) - (SELECT g FROM g), 9) AS consensuality, round((SELECT g FROM g), 9) AS group_disagreement
    FROM wo GROUP BY rater"""))
def raters_consensuality(spark, folder):
    told = agreement.consensuality(derived.ratings(spark, folder))
    return told.select("rater", F.round("consensuality", 9).alias("consensuality"),
                       F.round("group_disagreement", 9).alias("group_disagreement"))


@query("items_flagged", "K-12", on_ratings("""
    , c AS (SELECT unit, median(score)::DOUBLE AS median, max(score) - min(score) AS spread FROM ratings GROUP BY unit)
    SELECT unit, intended_score, median, spread, median - intended_score AS gold_gap, spread >= 2 AS split,
      abs(median - intended_score) >= 1 AS off_gold FROM c JOIN refs USING (unit)"""))
def items_flagged(spark, folder):
    return agreement.flag_items(derived.ratings(spark, folder), judge(spark, folder))


@query("rater_progress", "D-21 O-4", on_ratings("SELECT rater, count(*) AS n FROM ratings GROUP BY rater"))
def rater_progress(spark, folder):
    return derived.ratings(spark, folder).groupBy("rater").agg(F.count("*").alias("n"))


@query("rater_timing", "D-20 I-15", """
    SELECT user_id AS rater, count(*) AS items, round(sum(CAST(round(value * 100) AS BIGINT)) / 6000e0, 9) AS on_task_min,
      quantile_cont(value, 0.5) AS median_item, max(value) AS slowest_item,
      strftime(min(ts), '%Y-%m-%d %H:%M') AS first_submit, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_submit,
      date_diff('minute', date_trunc('minute', min(ts)), date_trunc('minute', max(ts))) AS span_min
    FROM events GROUP BY user_id""")
def rater_timing(spark, folder):
    from tonescope.operators.runlogs import rater_timing as timing
    events = derived.table(spark, folder, "events").select(
        F.col("user_id").alias("rater"), F.col("value").alias("seconds"), "ts")
    return timing(events)
