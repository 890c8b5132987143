"""Slicing, guards, joins between feedback tables, and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonescope.catalog.base import on_cells, on_feedback, on_ratings, query
from tonescope.functions import measures as m
from tonescope.operators import agreement, frames, slices, summaries
from tonescope.session import cut_lineage
from tonescope.sources import derived

INDUSTRY = "ASIA"
ORG = "Supplier#000000001"


@query("slice_filter", "B-1 B-5", on_feedback("""
    SELECT source, sentiment, count(*) AS n_rows FROM feedback
    WHERE industry IN ('ASIA', 'EUROPE') AND parent_aspect = 'G2' AND sentiment IN ('negative', 'neutral')
    GROUP BY ALL"""))
def slice_filter(spark, folder):
    rows = slices.select_slice(derived.feedback(spark, folder), industry=["ASIA", "EUROPE"],
                               parent_aspect="G2", sentiment=["negative", "neutral"])
    return rows.groupBy("source", "sentiment").agg(F.count("*").alias("n_rows"))


@query("slice_exclude_org", "B-2", on_feedback(f"""
    SELECT aspect, count(*) AS n_rows FROM feedback
    WHERE industry = 'ASIA' AND (org NOT IN ('{ORG}', 'Supplier#000000002') OR org IS NULL)
    GROUP BY ALL"""))
def slice_exclude_org(spark, folder):
    rows = slices.select_slice(derived.feedback(spark, folder), industry=INDUSTRY,
                               exclude_org=[ORG, "Supplier#000000002"])
    return rows.groupBy("aspect").agg(F.count("*").alias("n_rows"))


@query("slice_unknown_labels", "B-3 B-4 C-9", on_feedback("""
    SELECT 'aspect' AS field, label FROM (VALUES ('Brand#1'), ('Brand#77'), ('nonsense')) v(label)
    WHERE label NOT IN (SELECT aspect FROM feedback)"""))
def slice_unknown_labels(spark, folder):
    return slices.never_occurring(derived.feedback(spark, folder), "aspect",
                                  ["Brand#1", "Brand#77", "nonsense"])


@query("slice_size", "B-5", on_feedback("""
    SELECT count(*) AS n_rows FROM feedback WHERE industry = 'ASIA' AND sentiment = 'neutral'"""))
def slice_size(spark, folder):
    return slices.slice_size(slices.select_slice(derived.feedback(spark, folder),
                                                 industry=INDUSTRY, sentiment="neutral"))


@query("slice_keep_equal", "B-6 B-8", on_feedback("""
    SELECT org, count(*) AS n_rows FROM feedback
    WHERE industry = 'ASIA' AND aspect = 'Brand#5' AND sentiment = 'negative' GROUP BY ALL"""))
def slice_keep_equal(spark, folder):
    rows = slices.keep_equal(derived.feedback(spark, folder),
                             {"sentiment": ["negative", "neutral", "positive"]},
                             industry=INDUSTRY, aspect="Brand#5", sentiment="negative")
    return rows.groupBy("org").agg(F.count("*").alias("n_rows"))


@query("slice_drop_equal", "B-7 B-8", on_feedback(f"""
    SELECT org, sentiment, count(*) AS n_rows FROM feedback
    WHERE NOT coalesce(org = '{ORG}' AND sentiment = 'negative', FALSE) GROUP BY ALL"""))
def slice_drop_equal(spark, folder):
    rows = slices.drop_equal(derived.feedback(spark, folder), org=ORG, sentiment="negative")
    return rows.groupBy("org", "sentiment").agg(F.count("*").alias("n_rows"))


SEGMENTS = """segs AS (SELECT r_name AS segment FROM region WHERE r_regionkey < 2
    UNION ALL SELECT s_name FROM supplier WHERE s_suppkey % 7 = 3)"""


def _segments(spark, folder):
    regions = derived.table(spark, folder, "region").where("r_regionkey < 2")
    orgs = derived.table(spark, folder, "supplier").where("s_suppkey % 7 = 3")
    return (regions.select(F.col("r_name").alias("segment"))
            .unionByName(orgs.select(F.col("s_name").alias("segment"))))


@query("slice_segments", "B-9", on_feedback(f""", {SEGMENTS}
    SELECT segment, aspect, count(*) AS n_rows
    FROM segs JOIN feedback ON segment = industry OR segment = org GROUP BY ALL"""))
def slice_segments(spark, folder):
    # segments are looked up on the cell table: fact rows are read once, before any segment join
    cells = derived.feedback_cells(spark, folder)
    rows = slices.segment_rows(cells, _segments(spark, folder))
    return rows.groupBy("segment", "aspect").agg(F.sum("total_count").alias("n_rows"))


@query("slice_segment_industry", "B-10", on_feedback(f""", {SEGMENTS}
    SELECT DISTINCT segment, industry FROM segs JOIN feedback
    ON segment = industry OR segment = org"""))
def slice_segment_industry(spark, folder):
    return slices.industry_of(derived.feedback_cells(spark, folder), _segments(spark, folder))


@query("slice_non_actionable", "B-11", on_feedback("""
    SELECT aspect, aspect NOT IN ('Brand#1', 'Brand#2', 'Brand#3') AS actionable,
           count(*) AS n_rows FROM feedback GROUP BY ALL"""))
def slice_non_actionable(spark, folder):
    counted = (derived.feedback(spark, folder).groupBy("aspect")
               .agg(F.count("*").alias("n_rows")))
    return counted.withColumn("actionable",
                              m.actionable(topics=derived.NON_ACTIONABLE_TOPICS))


@query("slice_valid_units", "B-12 C-9", on_ratings("""
    SELECT rater, count(*) AS n, sum(score)::BIGINT AS total FROM ratings
    WHERE unit IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL"""))
def slice_valid_units(spark, folder):
    valid = (derived.table(spark, folder, "labels").where("quality = 1")
             .select(F.col("doc_id").alias("unit")))
    kept = derived.ratings(spark, folder).join(valid, "unit", "left_semi")
    return kept.groupBy("rater").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("slice_without_pruned", "B-13 C-9 K-6", on_ratings("""
    SELECT rater, count(*) AS n FROM ratings WHERE unit NOT IN
      (SELECT unit FROM ratings GROUP BY unit HAVING max(score) - min(score) >= 2) GROUP BY ALL"""))
def slice_without_pruned(spark, folder):
    rows = derived.ratings(spark, folder)
    kept = rows.join(agreement.wide_spread(rows), "unit", "left_anti")
    return kept.groupBy("rater").agg(F.count("*").alias("n"))


@query("slice_usable_metric", "B-14", """
    SELECT event_type, count(*) AS n FROM events WHERE value IS NOT NULL AND value > 0
    GROUP BY ALL""")
def slice_usable_metric(spark, folder):
    rows = derived.table(spark, folder, "events").dropna(subset=["value"]).where("value > 0")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query("slice_min_volume", "B-15", on_cells("""
    SELECT org, aspect, total_count FROM cells WHERE total_count >= 30"""))
def slice_min_volume(spark, folder):
    return slices.min_volume(derived.feedback_cells(spark, folder), 30, "total_count").select(
        "org", "aspect", "total_count")


@query("slice_plain_labels", "B-16", on_feedback("""
    SELECT aspect, CASE WHEN min(p_type) IS NULL THEN aspect ELSE min(p_type) END AS label,
           count(*) // max(parts) AS n_rows
    FROM feedback LEFT JOIN (SELECT p_brand, min(p_type) AS p_type, 1 AS parts FROM part GROUP BY ALL)
      ON aspect = p_brand GROUP BY aspect"""))
def slice_plain_labels(spark, folder):
    labels = (derived.table(spark, folder, "part").groupBy(F.col("p_brand").alias("aspect"))
              .agg(F.min("p_type").alias("label")))
    counted = (derived.feedback(spark, folder).groupBy("aspect")
               .agg(F.count("*").alias("n_rows")))
    return slices.with_labels(counted, labels)


@query("join_runs_to_gold", "C-1 A-8", """
    SELECT e.event_type AS tool, g.parity, count(*) AS n FROM events e LEFT JOIN
      (SELECT DISTINCT user_id % 10 AS t, CASE WHEN user_id % 10 % 2 = 0 THEN 'even' ELSE 'odd' END AS parity
       FROM events WHERE user_id % 10 < 8) g ON e.user_id % 10 = g.t GROUP BY ALL""")
def join_runs_to_gold(spark, folder):
    events = derived.table(spark, folder, "events").withColumn("t", F.col("user_id") % 10)
    gold = (events.where("t < 8").select("t").distinct()
            .withColumn("parity", F.when(F.col("t") % 2 == 0, "even").otherwise("odd")))
    # counts per (task, tool) come first, so the join sees a handful of rows per task
    counted = events.groupBy("t", F.col("event_type").alias("tool")).agg(F.count("*").alias("c"))
    return (counted.join(gold, "t", "left").groupBy("tool", "parity")
            .agg(F.sum("c").alias("n")))


@query("join_judge_to_units", "C-3 A-8", on_ratings("""
    SELECT count(*) AS n_units, count(judge_score) AS n_judged, sum(judge_score)::BIGINT AS judged_total
    FROM (SELECT DISTINCT unit FROM ratings) LEFT JOIN refs USING (unit)"""))
def join_judge_to_units(spark, folder):
    units = derived.ratings(spark, folder).select("unit").distinct()
    refs = derived.reference_scores(spark, folder).select("unit", "judge_score")
    return units.join(refs, "unit", "left").agg(
        F.count("*").alias("n_units"), F.count("judge_score").alias("n_judged"),
        F.sum("judge_score").alias("judged_total"))


@query("join_aligned_shares", "C-5", on_feedback("""
    , a AS (SELECT aspect, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM feedback
          WHERE source = 'O' GROUP BY aspect),
    b AS (SELECT aspect, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM feedback
          WHERE source = 'F' AND CAST(substr(aspect, 7) AS INT) % 7 <> 0 GROUP BY aspect)
    SELECT aspect, coalesce(a.s, 0) AS share_real, coalesce(b.s, 0) AS share_made
    FROM a FULL JOIN b USING (aspect)"""))
def join_aligned_shares(spark, folder):
    rows = derived.corpora(spark, folder)
    shares = summaries.value_shares(rows, "aspect", ["corpus"])
    return frames.aligned(shares, "aspect", "corpus", ["real", "made"], "share")


@query("join_full_frame", "C-6 C-7", on_feedback("""
    SELECT i.industry, a.aspect, count(f.industry) AS n
    FROM (SELECT DISTINCT industry FROM feedback) i CROSS JOIN (SELECT DISTINCT aspect FROM feedback) a
    LEFT JOIN feedback f ON f.industry = i.industry AND f.aspect = a.aspect
      AND NOT (CAST(substr(f.aspect, 7) AS INT) % 7 = 0 AND f.source = 'F') AND f.sentiment = 'neutral'
    GROUP BY ALL"""))
def join_full_frame(spark, folder):
    topic = F.substring("aspect", 7, 9).cast("int")
    counted = ~((topic % 7 == 0) & (F.col("source") == "F")) & (F.col("sentiment") == "neutral")
    # The labels are read once; the frame and what stands on it come from the counted cells.
    cells = cut_lineage(derived.feedback(spark, folder).groupBy("industry", "aspect").agg(F.count_if(counted).alias("n")))
    return frames.reindexed(frames.full_frame(cells, "industry", "aspect"), cells, ["industry", "aspect"], ["n"])


@query("join_rater_pairs", "C-8", on_ratings("""
    SELECT a.rater AS rater_a, b.rater AS rater_b, count(*) AS n_both,
           count(*) FILTER (a.score = b.score) AS n_equal
    FROM ratings a JOIN ratings b ON a.unit = b.unit AND a.rater < b.rater GROUP BY ALL"""))
def join_rater_pairs(spark, folder):
    return agreement.rater_pairs(derived.ratings(spark, folder), ["r1", "r2", "r3"]).select(
        "rater_a", "rater_b", "n_both", "n_equal")


@query("set_union_levels", "H-1", on_cells("""
    SELECT 'org' AS level, org AS name, sum(total_count)::BIGINT AS n FROM cells GROUP BY org
    UNION ALL SELECT 'industry', industry, sum(total_count)::BIGINT FROM cells GROUP BY industry"""))
def set_union_levels(spark, folder):
    cells = derived.feedback_cells(spark, folder)
    parts = [cells.groupBy(F.col(k).alias("name")).agg(F.sum("total_count").alias("n"))
             .select(F.lit(k).alias("level"), "name", "n") for k in ("org", "industry")]
    return parts[0].unionByName(parts[1])


@query("set_same_holes", "H-4 N-12", on_feedback("""
    , i AS (SELECT DISTINCT industry FROM feedback), a AS (SELECT DISTINCT aspect FROM feedback),
    frame AS (SELECT * FROM i CROSS JOIN a),
    real AS (SELECT * FROM frame EXCEPT SELECT industry, aspect FROM feedback WHERE source = 'O'),
    made AS (SELECT * FROM frame EXCEPT SELECT industry, aspect FROM feedback
             WHERE source = 'F' AND CAST(substr(aspect, 7) AS INT) % 7 <> 0)
    SELECT (SELECT count(*) FROM real) AS holes_real, (SELECT count(*) FROM made) AS holes_made,
           (SELECT count(*) FROM ((SELECT * FROM real EXCEPT SELECT * FROM made)
             UNION ALL (SELECT * FROM made EXCEPT SELECT * FROM real))) = 0 AS same_holes
    """))
def set_same_holes(spark, folder):
    told = frames.holes(derived.feedback(spark, folder), "industry", "aspect", derived.corpus_marks())
    return told.select(*[(F.col("groups") - F.col(f"present_{n}")).alias(f"holes_{n}") for n in ("real", "made")], "same_holes")


@query("set_distinct_pairs", "H-5", on_feedback("""
    SELECT DISTINCT industry, org FROM feedback"""))
def set_distinct_pairs(spark, folder):
    return derived.feedback_cells(spark, folder).select("industry", "org").distinct()


@query("set_absent_groups", "H-6", on_feedback("""
    SELECT industry, aspect FROM (SELECT DISTINCT industry FROM feedback),
      (SELECT DISTINCT aspect FROM feedback)
    EXCEPT SELECT industry, aspect FROM feedback
    WHERE CAST(substr(aspect, 7) AS INT) % 7 <> 0"""))
def set_absent_groups(spark, folder):
    rows = derived.feedback(spark, folder)
    return frames.lacking(rows, "industry", "aspect", F.substring("aspect", 7, 9).cast("int") % 7 != 0)


