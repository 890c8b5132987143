"""Answerability over a parameter table, component solvers, older questions and replay checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonescope.catalog.base import on_cells, on_feedback, query
from tonescope.catalog.inferences import PAIRS, requested_pairs
from tonescope.catalog.questions import GAPS, SEGS, TOPICS, segments, settled_segments
from tonescope.functions import measures as m
from tonescope.operators import inference, ranking, slices, summaries
from tonescope.plans import answerability, older, questions
from tonescope.sources import derived

PARAMS = """params AS (
    SELECT t || '-' || a.s_suppkey AS task_id, t AS template,
      CASE WHEN t = 'T6' THEN r_name ELSE a.s_name END AS a, b.s_name AS b,
      'Brand#' || (a.s_suppkey % 25 + 1) AS aspect,
      CASE a.s_suppkey % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS sentiment
    FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 JOIN nation ON a.s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey, (SELECT 'T' || i AS t FROM range(1, 11) q(i)))"""


def parameters(spark, folder):
    """One question of every template per organisation, beside the next organisation by key."""
    orgs = derived.organisations(spark, folder)
    following = orgs.select((F.col("suppkey") - 1).alias("suppkey"), F.col("org").alias("b"))
    names = F.array(*[F.lit(t) for t in answerability.TEMPLATES])
    rows = orgs.join(following, "suppkey").withColumn("template", F.explode(names))
    label = F.element_at(F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")),
                         (F.col("suppkey") % 3 + 1).cast("int"))
    return rows.select(
        F.concat_ws("-", "template", F.col("suppkey").cast("string")).alias("task_id"), "template",
        F.when(F.col("template") == "T6", F.col("industry")).otherwise(F.col("org")).alias("a"),
        "b", F.concat(F.lit("Brand#"), F.col("suppkey") % 25 + 1).alias("aspect"),
        label.alias("sentiment"))


JUDGED = GAPS + f""", {PARAMS},
    hit AS (SELECT segment, aspect, total_count AS n, UNNEST([neg_count, neu_count, pos_count]) AS k,
      UNNEST(['negative', 'neutral', 'positive']) AS sentiment FROM segs),
    facts AS (SELECT segment, min(industry) AS home, sum(total_count)::BIGINT AS n, count(*) FILTER (total_count >= 30) AS topics,
      count(*) FILTER (neg_count >= 30) AS negative_topics FROM segs GROUP BY segment),
    usable AS (SELECT a, b, count(*) FILTER (actionable AND gap_pp > 0) AS u, count(*) FILTER (gap_pp > 0) AS w FROM gaps GROUP BY ALL),
    pres AS (SELECT DISTINCT industry, aspect FROM cells),
    orgs AS (SELECT industry, aspect, count(*) AS orgs FROM cells WHERE total_count >= 30 GROUP BY ALL),
    j AS (SELECT p.*, coalesce(ha.n, 0) AS cell_a, coalesce(ha.k, 0) AS hit_a, coalesce(hb.n, 0) AS cell_b,
        coalesce(hb.k, 0) AS hit_b, coalesce(fa.n, 0) AS n_a, coalesce(fa.topics, 0) AS topics,
        coalesce(fa.negative_topics, 0) AS negative_topics, coalesce(o.orgs, 0) AS orgs,
        coalesce(u.u, 0) AS u, coalesce(u.w, 0) AS w, pa.industry IS NOT NULL AS present_a, pb.industry IS NOT NULL AS present_b
      FROM params p LEFT JOIN hit ha ON ha.segment = p.a AND ha.aspect = p.aspect AND ha.sentiment = p.sentiment
      LEFT JOIN hit hb ON hb.segment = p.b AND hb.aspect = p.aspect AND hb.sentiment = p.sentiment
      LEFT JOIN facts fa ON fa.segment = p.a LEFT JOIN facts fb ON fb.segment = p.b
      LEFT JOIN orgs o ON o.industry = p.a AND o.aspect = p.aspect
      LEFT JOIN usable u ON u.a = p.a AND u.b = p.b AND p.template = 'T9'
      LEFT JOIN pres pa ON pa.industry = fa.home AND pa.aspect = p.aspect
      LEFT JOIN pres pb ON pb.industry = fb.home AND pb.aspect = p.aspect),
    v AS (SELECT *, least(hit_a, cell_a - hit_a, hit_b, cell_b - hit_b) AS smallest_cell,
      CASE template WHEN 'T1' THEN cell_a >= 30 WHEN 'T2' THEN n_a >= 30 WHEN 'T3' THEN topics >= 3
        WHEN 'T4' THEN least(cell_a, cell_b) >= 30
        WHEN 'T5' THEN least(hit_a, cell_a - hit_a, hit_b, cell_b - hit_b) >= 10 WHEN 'T6' THEN orgs >= 2
        WHEN 'T7' THEN topics >= 1 WHEN 'T8' THEN negative_topics >= 2 WHEN 'T9' THEN u > 0
        WHEN 'T10' THEN topics >= 3 END AS answerable FROM j)"""


@query("params_answerability", "M-11 M-12", on_cells(JUDGED + f"""
    SELECT task_id, template, n_a, cell_a, cell_b, smallest_cell, topics, negative_topics, orgs, answerable,
      CASE WHEN answerable THEN NULL
        WHEN (template IN ('T1', 'T4', 'T5', 'T6') AND NOT present_a) OR (template IN ('T4', 'T5') AND NOT present_b)
          THEN '{questions.ABSENT}'
        WHEN template = 'T2' OR (template IN ('T3', 'T7', 'T8', 'T10') AND n_a < 30) THEN '{questions.THIN}'
        WHEN template = 'T10' THEN '{questions.PARTIAL}'
        WHEN template IN ('T3', 'T6', 'T7', 'T8') THEN '{questions.FEW}'
        WHEN template = 'T9' AND w > 0 THEN '{questions.NO_ACTIONABLE}'
        WHEN template = 'T9' THEN 'Not worse on any comparable topic'
        WHEN cell_a = 0 OR (template <> 'T1' AND cell_b = 0) THEN 'Slice absent'
        WHEN template = 'T5' THEN '{questions.THIN_TEST}' ELSE '{questions.THIN}' END AS reason FROM v"""))
def params_answerability(spark, folder):
    cells = derived.settled_cells(spark, folder)
    judged = answerability.evidence(parameters(spark, folder), questions.segment_cells(cells),
                                    cells, TOPICS)
    return answerability.abstention_reason(judged).select(
        "task_id", "template", "n_a", "cell_a", "cell_b", "smallest_cell", "topics",
        "negative_topics", "orgs", "answerable", "reason")


@query("params_task_shares", "M-13", on_cells(JUDGED + """
    SELECT template, count(*) AS tasks, count(*) FILTER (answerable) AS answerable,
      (count(*) FILTER (answerable))::DOUBLE / count(*) AS share FROM v GROUP BY template"""))
def params_task_shares(spark, folder):
    cells = derived.settled_cells(spark, folder)
    judged = answerability.evidence(parameters(spark, folder), questions.segment_cells(cells),
                                    cells, TOPICS)
    return answerability.task_share(judged, "template")


@query("params_declared_vs_found", "M-13 H-4", f"""WITH {PARAMS},
    d AS (SELECT template, count(*) AS declared FROM params GROUP BY template),
    f AS (SELECT template, count(*) AS found FROM params
          WHERE NOT (template = 'T4' AND aspect = 'Brand#4') GROUP BY template)
    SELECT template, declared, found FROM d JOIN f USING (template) WHERE declared <> found""")
def params_declared_vs_found(spark, folder):
    params = parameters(spark, folder)
    found = params.where("NOT (template = 'T4' AND aspect = 'Brand#4')")
    return answerability.distribution_gaps(params, found, ["template"])


QUESTION_TEXT = "CASE template " + " ".join(
    f"WHEN '{t}' THEN '{q}'" for t, q in answerability.TEMPLATES.items()) + " END"


@query("params_question_text", "I-18", f"""WITH {PARAMS}
    SELECT task_id, replace(replace(replace(replace({QUESTION_TEXT}, '{{a}}', a), '{{b}}', b),
      '{{aspect}}', aspect), '{{sentiment}}', sentiment) AS question FROM params""")
def params_question_text(spark, folder):
    return answerability.question_text(parameters(spark, folder)).select("task_id", "question")


@query("solve_count_and_share", "M-14", on_cells(SEGS + """
    SELECT segment, aspect, total_count AS n, neg_count AS count, neg_count::DOUBLE / total_count AS share
    FROM segs"""))
def solve_count_and_share(spark, folder):
    return older.count_or_share(segments(spark, folder))


TOPK = """(SELECT segment, aspect, {by} AS count, row_number() OVER (PARTITION BY segment
    ORDER BY {by} DESC, aspect) AS position FROM segs WHERE {by} > 0)"""


@query("solve_top_topics", "M-15 G-2 G-4", on_cells(SEGS + f"""
    SELECT * FROM {TOPK.format(by='neg_count')} WHERE position <= 3"""))
def solve_top_topics(spark, folder):
    return older.top_topics(segments(spark, folder), 3)


@query("solve_top_volume", "M-15", on_cells(SEGS + f"""
    SELECT * FROM {TOPK.format(by='total_count')} WHERE position <= 3"""))
def solve_top_volume(spark, folder):
    return older.top_topics(segments(spark, folder), 3, "total_count")


SPLIT = """(SELECT {keys}, sum(pos_count)::BIGINT AS positive, sum(neg_count)::BIGINT AS negative,
      sum(neu_count)::BIGINT AS neutral, sum(total_count)::BIGINT AS total,
      sum(pos_count)::DOUBLE / sum(total_count) AS pos_share, sum(neg_count)::DOUBLE / sum(total_count) AS neg_share,
      sum(neu_count)::DOUBLE / sum(total_count) AS neu_share FROM segs GROUP BY ALL)"""


@query("solve_split", "M-16", on_cells(SEGS + f" SELECT * FROM {SPLIT.format(keys='segment')}"))
def solve_split(spark, folder):
    return older.split(segments(spark, folder), "segment")


@query("solve_compare", "M-17", on_cells(PAIRS.format(k="neg_count") + """
    SELECT a, b, aspect, neg_a::DOUBLE / nullif(total_a, 0) AS share_a,
      neg_b::DOUBLE / nullif(total_b, 0) AS share_b,
      CASE WHEN coalesce(neg_a::DOUBLE / nullif(total_a, 0), 0) > coalesce(neg_b::DOUBLE / nullif(total_b, 0), 0)
        THEN 'a' ELSE 'b' END AS higher FROM sides"""))
def solve_compare(spark, folder):
    return older.compare_shares(requested_pairs(spark, folder), segments(spark, folder))


DRIVERS = f"""(SELECT segment, aspect, neg_share, total, row_number() OVER (PARTITION BY segment
    ORDER BY neg_share DESC, aspect) AS position FROM {SPLIT.format(keys='segment, aspect')}
    WHERE total >= 5)"""
PRIORITISED = f"""(SELECT segment, aspect, priority, row_number() OVER (PARTITION BY segment
    ORDER BY priority DESC, aspect) AS position FROM (SELECT segment, aspect,
      CASE WHEN max(total) OVER p = min(total) OVER p THEN 0e0
        ELSE (total - min(total) OVER p)::DOUBLE / (max(total) OVER p - min(total) OVER p) END
      + CASE WHEN max(neg_share) OVER p = min(neg_share) OVER p THEN 0e0
        ELSE (neg_share - min(neg_share) OVER p) / (max(neg_share) OVER p - min(neg_share) OVER p) END AS priority
      FROM {SPLIT.format(keys='segment, aspect')} WINDOW p AS (PARTITION BY segment)))"""


@query("solve_drivers", "M-19 B-15", on_cells(SEGS + f" SELECT * FROM {DRIVERS} WHERE position <= 3"))
def solve_drivers(spark, folder):
    return older.drivers(segments(spark, folder))


@query("solve_prioritise", "M-19 E-5", on_cells(
    SEGS + f" SELECT * FROM {PRIORITISED} WHERE position <= 3"))
def solve_prioritise(spark, folder):
    return older.prioritised(segments(spark, folder))


@query("solve_composite", "M-20", on_cells(SEGS + f"""
    , homes AS (SELECT DISTINCT segment, industry FROM segs WHERE kind = 'org'),
    d AS (SELECT * FROM {DRIVERS} WHERE position <= 3),
    o AS (SELECT * FROM {SPLIT.format(keys='segment')} WHERE segment IN (SELECT segment FROM homes))
    SELECT segment, 'org_drivers' AS component, position, aspect AS label, neg_share AS value FROM d
      WHERE segment IN (SELECT segment FROM homes)
    UNION ALL SELECT homes.segment, 'industry_drivers', position, aspect, neg_share
      FROM d JOIN homes ON d.segment = homes.industry
    UNION ALL SELECT segment, 'overview', 1, 'pos_share', pos_share FROM o
    UNION ALL SELECT segment, 'overview', 1, 'neg_share', neg_share FROM o
    UNION ALL SELECT segment, 'overview', 1, 'neu_share', neu_share FROM o
    UNION ALL SELECT segment, 'top_complaints', position, aspect, count::DOUBLE FROM {TOPK.format(by='neg_count')}
      WHERE position <= 3 AND segment IN (SELECT segment FROM homes)
    UNION ALL SELECT segment, 'priorities', position, aspect, priority FROM {PRIORITISED}
      WHERE position <= 3 AND segment IN (SELECT segment FROM homes)"""))
def solve_composite(spark, folder):
    segs = settled_segments(spark, folder)
    homes = segs.where("kind = 'org'").select("segment", "industry").distinct()
    return older.composite(segs, homes)


@query("describe_scope", "M-21 D-4 B-6", on_feedback("""
    SELECT aspect, count(*) AS count FROM feedback WHERE industry = 'ASIA' AND sentiment = 'negative'
    GROUP BY aspect ORDER BY count DESC, aspect LIMIT 5"""))
def describe_scope(spark, folder):
    return older.describe(derived.feedback(spark, folder), industry="ASIA", sentiment="negative")


@query("infer_two_groups", "M-22 J-6", on_feedback("""
    , c AS (SELECT aspect, sentiment, count(*)::DOUBLE AS o FROM feedback
      WHERE aspect IN ('Brand#4', 'Brand#9') GROUP BY ALL),
    e AS (SELECT *, sum(o) OVER (PARTITION BY aspect) * sum(o) OVER (PARTITION BY sentiment) / sum(o) OVER () AS x FROM c)
    SELECT CAST(sum(o) FILTER (aspect = 'Brand#4') AS BIGINT) AS n_a,
      CAST(sum(o) FILTER (aspect = 'Brand#9') AS BIGINT) AS n_b,
      round(sum((o - x) * (o - x) / x), 9) AS chi2, round(exp(-sum((o - x) * (o - x) / x) / 2), 9) AS p_value,
      exp(-sum((o - x) * (o - x) / x) / 2) < 0.05e0 AS significant FROM e"""))
def infer_two_groups(spark, folder):
    tested = older.infer(derived.feedback(spark, folder), "aspect", "Brand#4", "Brand#9")
    return tested.select("n_a", "n_b", F.round("chi2", 9).alias("chi2"),
                         F.round("p_value", 9).alias("p_value"), "significant")


@query("report_scope", "M-23 M-2 M-3", on_cells(SEGS + f"""
    SELECT s.segment, positive, negative, neutral, total, pos_share, neg_share, neu_share,
      t.top_complaints FROM {SPLIT.format(keys='segment')} s LEFT JOIN (
      SELECT segment, string_agg(position || ' ' || aspect || ' ' || count, '; ' ORDER BY position) AS top_complaints
      FROM {TOPK.format(by='neg_count')} WHERE position <= 3 GROUP BY segment) t USING (segment)"""))
def report_scope(spark, folder):
    told = older.scope_report(segments(spark, folder))
    line = F.transform("top_complaints", lambda x: F.concat_ws(
        " ", x["position"].cast("string"), x["aspect"], x["count"].cast("string")))
    return told.withColumn("top_complaints", F.array_join(line, "; "))


@query("older_complaints_on_source", "M-24 B-1", on_feedback("""
    SELECT org, aspect, count(*) AS count FROM feedback WHERE source = 'O' AND sentiment = 'negative'
    GROUP BY ALL"""))
def older_complaints_on_source(spark, folder):
    rows = slices.select_slice(derived.feedback(spark, folder), source="O", sentiment="negative")
    return summaries.count_by(rows, "org", "aspect")


@query("older_parent_split", "M-25 E-11", on_feedback("""
    SELECT industry, parent_aspect, sentiment, count(*) AS n,
      count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY industry, parent_aspect) AS share
    FROM feedback GROUP BY industry, parent_aspect, sentiment"""))
def older_parent_split(spark, folder):
    return summaries.value_shares(derived.feedback(spark, folder), "sentiment",
                                  ["industry", "parent_aspect"])


@query("older_parent_table", "M-25 B-15 E-4", on_feedback("""
    SELECT org, parent_aspect, count(*) FILTER (sentiment = 'positive') AS positive,
      count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral,
      count(*) AS total, (count(*) FILTER (sentiment = 'positive'))::DOUBLE / count(*) AS pos_share,
      (count(*) FILTER (sentiment = 'negative'))::DOUBLE / count(*) AS neg_share,
      (count(*) FILTER (sentiment = 'neutral'))::DOUBLE / count(*) AS neu_share
    FROM feedback GROUP BY org, parent_aspect HAVING count(*) >= 120"""))
def older_parent_table(spark, folder):
    table = summaries.sentiment_breakdown(derived.feedback(spark, folder), "org", "parent_aspect")
    return summaries.add_shares(slices.min_volume(table, 120))


@query("older_polarised_topics", "M-26 E-6 E-7", on_feedback("""
    , b AS (SELECT industry, aspect, count(*) FILTER (sentiment = 'positive') AS positive,
        count(*) FILTER (sentiment = 'negative') AS negative FROM feedback GROUP BY ALL),
    p AS (SELECT industry, aspect, positive + negative AS pol_volume,
        least(positive, negative)::DOUBLE / (positive + negative) AS polarisation
      FROM b WHERE positive + negative >= 30)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY polarisation DESC, aspect) AS position
      FROM p) WHERE position <= 3"""))
def older_polarised_topics(spark, folder):
    told = older.polarised(derived.feedback(spark, folder), ["industry"])
    return told.select("industry", "aspect", "pol_volume", "polarisation", "position")


@query("older_org_against_peers", "M-27 B-7 D-6", on_cells("""
    , i AS (SELECT industry, aspect, sum(total_count)::BIGINT AS n, sum(neg_count)::BIGINT AS k FROM cells GROUP BY ALL)
    SELECT org, aspect, total_count AS n_org, neg_count::DOUBLE / total_count AS share_org,
      n - total_count AS n_peers, (k - neg_count)::DOUBLE / nullif(n - total_count, 0) AS share_peers
    FROM cells JOIN i USING (industry, aspect)"""))
def older_org_against_peers(spark, folder):
    tested = inference.against_rest(derived.feedback_cells(spark, folder))
    return tested.select("org", "aspect", F.col("total_a").alias("n_org"),
                         F.col("rate_a").alias("share_org"), F.col("total_b").alias("n_peers"),
                         F.col("rate_b").alias("share_peers"))


@query("older_drivers_on_source", "M-28 D-5 G-1", on_feedback("""
    , b AS (SELECT industry, aspect, count(*) AS total, (count(*) FILTER (sentiment = 'negative'))::DOUBLE / count(*) AS neg_share
      FROM feedback WHERE source = 'F' GROUP BY ALL HAVING count(*) >= 30)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY neg_share DESC, aspect) AS position
      FROM b) WHERE position <= 3"""))
def older_drivers_on_source(spark, folder):
    rows = slices.select_slice(derived.feedback(spark, folder), source="F")
    table = summaries.add_shares(slices.min_volume(
        summaries.sentiment_breakdown(rows, "industry", "aspect")))
    return ranking.top_cut_within(table, "neg_share", 3, ["industry"], ["aspect"]).select(
        "industry", "aspect", "total", "neg_share", "position")


@query("answers_fragile", "M-29 F-6", on_cells(SEGS + f"""
    SELECT segment, count(*) AS held, count(*) < 3 AS short, count(DISTINCT neg_share) < count(*) AS tied
    FROM {DRIVERS} WHERE position <= 3 GROUP BY segment"""))
def answers_fragile(spark, folder):
    return older.fragile_answers(older.drivers(segments(spark, folder)), 3, value="neg_share")


@query("answers_extreme_shares", "M-29", on_cells(SEGS + """
    SELECT segment, aspect, total_count AS n, neg_count AS count, neg_count::DOUBLE / total_count AS share
    FROM segs WHERE neg_count::DOUBLE / total_count < 0.1e0 OR neg_count::DOUBLE / total_count > 0.95e0"""))
def answers_extreme_shares(spark, folder):
    return older.extreme_shares(older.count_or_share(segments(spark, folder)))


@query("answers_replayed", "M-30 I-19", on_cells("""
    , stored AS (SELECT org, aspect, CASE WHEN aspect = 'Brand#7' THEN neg_count::DOUBLE / total_count + 0.001e0
        ELSE neg_count::DOUBLE / total_count + 0.00005e0 END AS stored FROM cells WHERE aspect <> 'Brand#8'),
    got AS (SELECT org, aspect, neg_count::DOUBLE / total_count AS got FROM cells)
    SELECT org, aspect, got, stored FROM got FULL JOIN stored USING (org, aspect)
    WHERE got IS NULL OR stored IS NULL OR abs(got - stored) > 0.0001e0"""))
def answers_replayed(spark, folder):
    """Rates recomputed from labels against a stored copy with known defects."""
    fresh = (derived.feedback(spark, folder).groupBy("org", "aspect")
             .agg(*m.sentiment_counts())
             .select("org", "aspect", m.rate("neg_count", "total_count").alias("value")))
    kept = (derived.feedback_cells(spark, folder).where("aspect <> 'Brand#8'")
            .select("org", "aspect", m.rate("neg_count", "total_count").alias("value")))
    shift = F.when(F.col("aspect") == "Brand#7", F.lit(0.001)).otherwise(F.lit(0.00005))
    return older.mismatches(fresh, kept.withColumn("value", F.col("value") + shift),
                            ["org", "aspect"])


