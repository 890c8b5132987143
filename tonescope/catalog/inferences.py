"""Significance tests and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonescope.catalog.base import on_cells, on_feedback, on_steps, query
from tonescope.functions.normal import erfc_sql, with_p_values
from tonescope.operators import inference, summaries
from tonescope.sources import derived

ERFC_X = erfc_sql("x")

# the z arithmetic in the same order as the engine, so z compares exactly; p alone is rounded
Z = """CASE WHEN total_a > 0 AND total_b > 0 AND neg_a + neg_b > 0 AND neg_a + neg_b < total_a + total_b THEN
    (neg_a::DOUBLE / total_a - neg_b::DOUBLE / total_b) /
    sqrt(((neg_a + neg_b)::DOUBLE / (total_a + total_b)) * (1 - (neg_a + neg_b)::DOUBLE / (total_a + total_b))
         * (1e0 / total_a + 1e0 / total_b)) END"""

TESTED = f""", tested AS (SELECT *, least(neg_a, total_a - neg_a, neg_b, total_b - neg_b) > 10 AS sufficient,
      {Z} AS z FROM sides),
    scaled AS (SELECT *, abs(z) / 1.4142135623730951e0 AS x FROM tested),
    judged AS (SELECT *, CASE WHEN z IS NOT NULL THEN {ERFC_X} END AS p FROM scaled)"""

REST = """, i AS (SELECT industry, aspect, sum(neg_count)::BIGINT AS k, sum(total_count)::BIGINT AS n
            FROM cells GROUP BY ALL),
    sides AS (SELECT org, aspect, total_count AS total_a, neg_count AS neg_a, n - total_count AS total_b,
            k - neg_count AS neg_b, k::DOUBLE / n AS scope_rate
            FROM cells JOIN i USING (industry, aspect))"""

PAIRS = """, sides AS (SELECT a.s_name AS a, b.s_name AS b, t.aspect, coalesce(ca.total_count, 0) AS total_a,
      coalesce(ca.{k}, 0) AS neg_a, coalesce(cb.total_count, 0) AS total_b, coalesce(cb.{k}, 0) AS neg_b,
      coalesce(ca.neg_count, 0) AS na, coalesce(cb.neg_count, 0) AS nb,
      coalesce(ca.neu_count, 0) AS ua, coalesce(cb.neu_count, 0) AS ub,
      coalesce(ca.pos_count, 0) AS pa, coalesce(cb.pos_count, 0) AS pb
    FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1
    CROSS JOIN (SELECT DISTINCT p_brand AS aspect FROM part) t
    LEFT JOIN cells ca ON ca.org = a.s_name AND ca.aspect = t.aspect
    LEFT JOIN cells cb ON cb.org = b.s_name AND cb.aspect = t.aspect)"""


def requested_pairs(spark, folder):
    """(a, b, aspect): every organisation beside the next one by key, for every topic."""
    orgs = derived.table(spark, folder, "supplier").select("s_suppkey", F.col("s_name").alias("a"))
    following = orgs.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("a").alias("b"))
    from tonescope.operators.frames import vocabulary
    topics = derived.table(spark, folder, "part").select(F.col("p_brand").alias("aspect"))
    return (orgs.join(following, "s_suppkey").select("a", "b")
            .withColumn("aspect", F.explode(vocabulary(topics, "aspect"))))


def tested_columns(df, *keys):
    return df.select(*keys, "total_a", "neg_a", "total_b", "neg_b", "gap_pp", "sufficient", "z",
                     F.round("p_value", 9).alias("p_value"), "significant")


@query("test_org_against_rest", "J-1 J-3 J-5 I-17 P-2", on_cells(REST + TESTED + """
    SELECT org, aspect, total_a, neg_a, total_b, neg_b, scope_rate,
      (neg_a::DOUBLE / total_a - neg_b::DOUBLE / nullif(total_b, 0)) * 100 AS gap_pp,
      CASE WHEN total_b > 0 THEN sufficient END AS sufficient, z, round(p, 9) AS p_value,
      p < 0.05e0 AS significant FROM judged"""))
def test_org_against_rest(spark, folder):
    tested = inference.against_rest(derived.feedback_cells(spark, folder))
    return tested_columns(tested, "org", "aspect", "scope_rate")


@query("test_requested_pairs", "J-4 C-8", on_cells(PAIRS.format(k="neg_count") + TESTED + """
    SELECT a, b, aspect, total_a, neg_a, total_b, neg_b,
      (neg_a::DOUBLE / nullif(total_a, 0) - neg_b::DOUBLE / nullif(total_b, 0)) * 100 AS gap_pp,
      CASE WHEN total_a > 0 AND total_b > 0 THEN sufficient END AS sufficient, z,
      round(p, 9) AS p_value, p < 0.05e0 AS significant FROM judged"""))
def test_requested_pairs(spark, folder):
    sides = inference.pair_sides(requested_pairs(spark, folder),
                                 derived.feedback_cells(spark, folder))
    return tested_columns(inference.proportions_test(sides), "a", "b", "aspect")


@query("test_one_sided", "J-1", on_cells(REST + TESTED + """
    SELECT org, aspect, z, round(CASE WHEN z >= 0 THEN p / 2 ELSE 1 - p / 2 END, 9) AS p_larger,
      round(CASE WHEN z <= 0 THEN p / 2 ELSE 1 - p / 2 END, 9) AS p_smaller
    FROM judged"""))
def test_one_sided(spark, folder):
    tested = inference.against_rest(derived.feedback_cells(spark, folder))
    both = with_p_values(with_p_values(tested, "z", "larger", "p_larger"), "z", "smaller",
                         "p_smaller")
    return both.select("org", "aspect", "z", F.round("p_larger", 9).alias("p_larger"),
                       F.round("p_smaller", 9).alias("p_smaller"))


@query("test_older_contract", "J-2 M-18", on_cells(PAIRS.format(k="pos_count") + TESTED + f"""
    , full_sides AS (SELECT *, total_a > 0 AND total_b > 0 AS ok FROM judged)
    SELECT a, b, aspect, NOT ok AS failed, neg_a::DOUBLE / nullif(total_a, 0) AS p1, neg_b::DOUBLE / nullif(total_b, 0) AS p2,
      CASE WHEN ok THEN coalesce(z, 0e0) END AS z, CASE WHEN ok THEN round(coalesce(p, 1e0), 9) END AS p_value,
      CASE WHEN ok THEN coalesce(p, 1e0) < 0.05e0 END AS significant,
      CASE WHEN NOT ok THEN NULL WHEN neg_a::DOUBLE / total_a > neg_b::DOUBLE / total_b THEN 'a' ELSE 'b' END AS higher
    FROM full_sides"""))
def test_older_contract(spark, folder):
    sides = inference.pair_sides(requested_pairs(spark, folder),
                                 derived.feedback_cells(spark, folder), positive="pos_count")
    tested = inference.older_proportions_test(sides)
    return tested.select("a", "b", "aspect", F.col("error").isNotNull().alias("failed"), F.col("rate_a").alias("p1"),
                         F.col("rate_b").alias("p2"), "z",
                         F.round("p_value", 9).alias("p_value"), "significant", "higher")


@query("test_sufficiency_rules", "J-5", on_cells(PAIRS.format(k="neg_count") + """
    SELECT a, b, aspect, least(neg_a, total_a - neg_a, neg_b, total_b - neg_b) > 10 AS strict,
      least(neg_a, total_a - neg_a, neg_b, total_b - neg_b) >= 10 AS inclusive FROM sides"""))
def test_sufficiency_rules(spark, folder):
    sides = inference.pair_sides(requested_pairs(spark, folder),
                                 derived.feedback_cells(spark, folder))
    return sides.select("a", "b", "aspect", inference.sufficient(True).alias("strict"),
                        inference.sufficient(False).alias("inclusive"))


CHI = []
for _s, _a, _b in (("pos", "pa", "pb"), ("neg", "na", "nb"), ("neu", "ua", "ub")):
    for _side, _n in ((_a, "total_a"), (_b, "total_b")):
        _e = f"((({_a} + {_b}) * {_n})::DOUBLE / (total_a + total_b))"
        CHI.append(f"({_side} - {_e}) * ({_side} - {_e}) / {_e}")


def three_way_sides(spark, folder):
    pairs = requested_pairs(spark, folder)
    sides = pairs
    cells = derived.feedback_cells(spark, folder)
    for side in ("a", "b"):
        slim = cells.select(F.col("org").alias(side), "aspect",
                            *[F.col(f"{s}_count").alias(f"{s}_{side}")
                              for s in ("neg", "neu", "pos")])
        sides = sides.join(slim, [side, "aspect"], "left")
    return sides.na.fill(0)


@query("test_chi_squared", "J-6 M-22", on_cells(PAIRS.format(k="neg_count") + f"""
    , f AS (SELECT *, NOT (total_a > 0 AND total_b > 0 AND na + nb > 0 AND ua + ub > 0 AND pa + pb > 0) AS failed FROM sides),
    t AS (SELECT *, CASE WHEN NOT failed THEN {' + '.join(CHI)} END AS chi2 FROM f)
    SELECT a, b, aspect, failed, total_a AS n_a, total_b AS n_b, chi2, round(exp(-chi2 / 2), 9) AS p_value,
      exp(-chi2 / 2) < 0.05e0 AS significant FROM t"""))
def test_chi_squared(spark, folder):
    tested = inference.chi_squared(three_way_sides(spark, folder))
    return tested.select("a", "b", "aspect", F.col("error").isNotNull().alias("failed"), "n_a", "n_b", "chi2",
                         F.round("p_value", 9).alias("p_value"), "significant")


METRIC_SQL = """, runs AS (SELECT run_id, agent, count(*)::DOUBLE AS steps,
      (count(*) FILTER (status = 'error'))::DOUBLE AS errors, sum(tokens)::DOUBLE AS tokens
      FROM steps GROUP BY ALL)"""


def run_metrics(spark, folder):
    return (derived.logged_steps(spark, folder).groupBy("run_id", "agent")
            .agg(F.count("*").cast("double").alias("steps"),
                 F.count_if(F.col("status") == "error").cast("double").alias("errors"),
                 F.sum("tokens").cast("double").alias("tokens")))


@query("correlation_of_metrics", "J-7", on_steps(METRIC_SQL + """
    SELECT 'steps' AS x, 'errors' AS y, round(corr(steps, errors), 9) AS r, count(*) AS n FROM runs
    UNION ALL SELECT 'steps', 'tokens', round(corr(steps, tokens), 9), count(*) FROM runs
    UNION ALL SELECT 'errors', 'tokens', round(corr(errors, tokens), 9), count(*) FROM runs"""))
def correlation_of_metrics(spark, folder):
    table = inference.correlation_table(run_metrics(spark, folder), ["steps", "errors", "tokens"])
    return table.withColumn("r", F.round("r", 9))


@query("correlation_per_agent", "J-8 L-25", on_steps(METRIC_SQL + """
    SELECT agent, CASE WHEN min(steps) < max(steps) AND min(errors) < max(errors)
      THEN round(corr(steps, errors), 9) END AS pearson_r, count(*) AS n FROM runs GROUP BY agent"""))
def correlation_per_agent(spark, folder):
    return (run_metrics(spark, folder).groupBy("agent")
            .agg(F.round(inference.safe_correlation("steps", "errors"), 9).alias("pearson_r"),
                 F.count("*").alias("n")))


@query("spearman_of_metrics", "J-9 P-4", on_steps(METRIC_SQL + """
    , r AS (SELECT rank() OVER (ORDER BY steps) + (count(*) OVER (PARTITION BY steps) - 1) / 2e0 AS steps,
      rank() OVER (ORDER BY errors) + (count(*) OVER (PARTITION BY errors) - 1) / 2e0 AS errors,
      rank() OVER (ORDER BY tokens) + (count(*) OVER (PARTITION BY tokens) - 1) / 2e0 AS tokens FROM runs)
    SELECT 'steps' AS x, 'errors' AS y, round(corr(steps, errors), 9) AS rho, count(*) AS n FROM r
    UNION ALL SELECT 'steps', 'tokens', round(corr(steps, tokens), 9), count(*) FROM r
    UNION ALL SELECT 'errors', 'tokens', round(corr(errors, tokens), 9), count(*) FROM r"""))
def spearman_of_metrics(spark, folder):
    table = inference.spearman_table(run_metrics(spark, folder), ["run_id"],
                                     ["steps", "errors", "tokens"])
    return table.select("x", "y", F.round("rho", 9).alias("rho"), "n")


@query("spearman_with_p", "J-9 P-4")
def spearman_with_p(spark, folder):
    """As spearman_of_metrics with Student p-values, which SQL cannot express."""
    return inference.spearman_table(run_metrics(spark, folder), ["run_id"],
                                     ["steps", "errors", "tokens"])


@query("mean_and_spread_over_seeds", "J-10 D-19", on_steps("""
    , s AS (SELECT agent, seed, sum(tokens)::DOUBLE / count(*) AS v FROM steps GROUP BY ALL)
    SELECT agent, count(*) AS seeds, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd
    FROM s GROUP BY agent"""))
def mean_and_spread_over_seeds(spark, folder):
    seeds = (derived.logged_steps(spark, folder).groupBy("agent", "seed")
             .agg((F.sum("tokens").cast("double") / F.count("*")).alias("v")))
    return seeds.groupBy("agent").agg(F.count("*").alias("seeds"),
                                      F.round(F.avg("v"), 6).alias("mean"),
                                      F.round(F.stddev_samp("v"), 6).alias("sd"))


@query("rate_gap_of_sentiments", "E-8 D-6", on_feedback("""
    SELECT aspect, (count(*) FILTER (sentiment = 'negative'))::DOUBLE / count(*)
      - (count(*) FILTER (sentiment = 'positive'))::DOUBLE / count(*) AS net FROM feedback GROUP BY ALL"""))
def rate_gap_of_sentiments(spark, folder):
    table = summaries.with_rates(derived.feedback(spark, folder).groupBy("aspect").agg(
        *summaries.m.sentiment_counts()))
    return table.select("aspect", (F.col("neg_rate") - F.col("pos_rate")).alias("net"))
