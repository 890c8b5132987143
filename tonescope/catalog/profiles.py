"""Corpus profiling, drift between two corpora, and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonescope.catalog.base import on_cells, on_feedback, query
from tonescope.functions import measures as m
from tonescope.functions import text
from tonescope.operators import frames, inference, profiling, ranking, summaries
from tonescope.sources import derived

CORPORA = """, corpora AS (SELECT *, CASE WHEN source = 'O' THEN 'real' ELSE 'made' END AS corpus FROM feedback
    WHERE source = 'O' OR CAST(substr(aspect, 7) AS INT) % 7 <> 0)"""
NAMES = ["real", "made"]


@query("profile_grid", "N-1 D-8 C-7", on_feedback("""
    SELECT industry, aspect, count(*) AS total_count, count(*) FILTER (sentiment = 'negative') AS neg_count,
      count(*) FILTER (sentiment = 'neutral') AS neu_count, count(*) FILTER (sentiment = 'positive') AS pos_count,
      (count(*) FILTER (sentiment = 'negative'))::DOUBLE / count(*) AS neg_share,
      (count(*) FILTER (sentiment = 'neutral'))::DOUBLE / count(*) AS neu_share,
      (count(*) FILTER (sentiment = 'positive'))::DOUBLE / count(*) AS pos_share
    FROM feedback GROUP BY industry, aspect"""))
def profile_grid(spark, folder):
    return profiling.group_shares(
        summaries.cells(derived.feedback(spark, folder), ["industry", "aspect"]))


def sparse_counts(spark, folder):
    """Cells of organisations with holes: topic 7 missing everywhere but one industry."""
    cells = derived.settled_cells(spark, folder).where(
        "aspect <> 'Brand#7' OR industry = 'ASIA'")
    return cells.select(F.col("org").alias("industry"), "aspect", "total_count", "neg_count",
                        "neu_count", "pos_count")


SPARSE = """, sparse AS (SELECT org AS industry, aspect, total_count, neg_count, neu_count, pos_count FROM cells
      WHERE aspect <> 'Brand#7' OR industry = 'ASIA'),
    avgs AS (SELECT aspect, sum(neg_count)::DOUBLE / sum(total_count) AS an, sum(neu_count)::DOUBLE / sum(total_count) AS au,
      sum(pos_count)::DOUBLE / sum(total_count) AS ap FROM sparse GROUP BY aspect),
    placed AS (SELECT i.industry, a.aspect, s.total_count, s.neg_count, s.neu_count, s.pos_count, an, au, ap,
        coalesce(nullif(s.neg_count::DOUBLE / s.total_count, 0), an) AS fn,
        coalesce(nullif(s.neu_count::DOUBLE / s.total_count, 0), au) AS fu,
        coalesce(nullif(s.pos_count::DOUBLE / s.total_count, 0), ap) AS fp
      FROM (SELECT DISTINCT industry FROM sparse) i CROSS JOIN avgs a
      LEFT JOIN sparse s ON s.industry = i.industry AND s.aspect = a.aspect),
    imputed AS (SELECT industry, aspect, coalesce(total_count, 0) AS total_count, fn / (fn + fu + fp) AS neg_share,
        fu / (fn + fu + fp) AS neu_share, fp / (fn + fu + fp) AS pos_share, total_count IS NULL AS whole_imputed,
        coalesce(neg_count = 0, FALSE) AS missing_neg, coalesce(neu_count = 0, FALSE) AS missing_neu,
        coalesce(pos_count = 0, FALSE) AS missing_pos FROM placed)"""


@query("profile_imputed_shares", "N-2 C-6 C-7", on_cells(SPARSE + " SELECT * FROM imputed"))
def profile_imputed_shares(spark, folder):
    return profiling.imputed_shares(sparse_counts(spark, folder))


@query("profile_imputation_list", "N-3", on_cells(SPARSE + """
    SELECT industry, aspect, 'all' AS imputed FROM imputed WHERE whole_imputed
    UNION ALL SELECT industry, aspect, 'negative' FROM imputed WHERE missing_neg
    UNION ALL SELECT industry, aspect, 'neutral' FROM imputed WHERE missing_neu
    UNION ALL SELECT industry, aspect, 'positive' FROM imputed WHERE missing_pos"""))
def profile_imputation_list(spark, folder):
    return profiling.imputation_list(profiling.imputed_shares(sparse_counts(spark, folder)))


PLANTED = """, g AS (SELECT industry, aspect, sum(neg_count)::DOUBLE / sum(total_count) AS neg_share FROM cells GROUP BY ALL),
    offs AS (SELECT r_name AS industry, s_name AS org, b.aspect,
        [0e0, 0.05e0, -0.05e0, 0.15e0, -0.15e0][(s_suppkey + CAST(substr(b.aspect, 7) AS INT)) % 5 + 1] AS "offset"
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      CROSS JOIN (SELECT DISTINCT p_brand AS aspect FROM part) b),
    planted AS (SELECT industry, org, aspect, "offset", neg_share,
        greatest(0.02e0, least(0.95e0, neg_share + "offset")) AS planted_rate FROM offs JOIN g USING (industry, aspect))"""


def planted(spark, folder):
    shares = profiling.group_shares(
        summaries.roll_up(derived.feedback_cells(spark, folder), ["industry", "aspect"]))
    return profiling.planted_rates(derived.offsets(spark, folder), shares)


@query("profile_planted_rates", "N-4 I-16", on_cells(PLANTED + " SELECT * FROM planted"))
def profile_planted_rates(spark, folder):
    return planted(spark, folder)


@query("profile_worst_and_close", "N-5 F-10 F-11", on_cells(PLANTED + """
    , w AS (SELECT *, first_value(aspect) OVER p AS worst, first_value(planted_rate) OVER p AS worst_rate FROM planted
      WINDOW p AS (PARTITION BY org ORDER BY planted_rate DESC, aspect))
    SELECT org, worst, worst_rate, coalesce(string_agg(aspect, ',' ORDER BY aspect)
      FILTER (planted_rate > worst_rate - 0.05e0 AND aspect <> worst), '') AS contenders
    FROM w GROUP BY org, worst, worst_rate"""))
def profile_worst_and_close(spark, folder):
    return profiling.worst_and_close(planted(spark, folder), "org", "aspect", "planted_rate")


THINNED = """(SELECT * FROM cells WHERE aspect = 'Brand#5' OR
    ('0x' || substr(md5(industry || '|' || org || '|' || aspect || '|42'), 1, 8))::BIGINT / 4294967296e0 >= 0.1e0)"""


def thinned(spark, folder):
    return profiling.thin(derived.feedback_cells(spark, folder), 0.10,
                          F.col("aspect") == "Brand#5")


@query("profile_thinned_cells", "N-6", on_cells(f"""
    SELECT industry, org, aspect, total_count FROM {THINNED}"""))
def profile_thinned_cells(spark, folder):
    return thinned(spark, folder).select("industry", "org", "aspect", "total_count")


@query("profile_retained", "N-13", on_cells(f"""
    SELECT (SELECT count(*) FROM {THINNED}) AS kept, count(*) AS cells,
      (SELECT count(*) FROM {THINNED})::DOUBLE / count(*) AS retained FROM cells"""))
def profile_retained(spark, folder):
    cells = derived.feedback_cells(spark, folder)
    stays = (F.col("aspect") == "Brand#5") | (
        profiling.hash_fraction("industry", "org", "aspect") >= 0.10)
    return cells.agg(F.count_if(stays).alias("kept"), F.count("*").alias("cells"),
                     m.rate(F.count_if(stays), F.count("*")).alias("retained"))


@query("profile_size_band", "N-7", on_cells("""
    , v AS (SELECT industry, aspect, sum(total_count)::BIGINT AS total_count FROM cells GROUP BY ALL),
    o AS (SELECT industry, count(DISTINCT org) AS n_orgs FROM cells GROUP BY industry)
    SELECT industry, aspect, total_count, n_orgs,
      greatest(1, CAST(floor(total_count::DOUBLE / n_orgs * 0.6e0) AS BIGINT)) AS low,
      greatest(1, CAST(floor(total_count::DOUBLE / n_orgs * 1.4e0) AS BIGINT)) AS high FROM v JOIN o USING (industry)"""))
def profile_size_band(spark, folder):
    cells = derived.feedback_cells(spark, folder)
    orgs = cells.groupBy("industry").agg(F.count_distinct("org").alias("n_orgs"))
    return profiling.size_band(summaries.roll_up(cells, ["industry", "aspect"]), orgs)


@query("profile_expanded_labels", "N-8 I-20", on_cells("""
    SELECT sentiment, count(*) AS n_rows, count(*) AS n_ids, count(*) AS n_first FROM feedback GROUP BY sentiment"""))
def profile_expanded_labels(spark, folder):
    labels = profiling.expand_to_labels(derived.feedback_cells(spark, folder))
    dense = F.substring("review_id", 2, 20).cast("bigint")
    return labels.groupBy("sentiment").agg(F.count("*").alias("n_rows"),
                                           F.count_distinct("review_id").alias("n_ids"),
                                           F.count_if(dense >= 1).alias("n_first"))


@query("profile_reconciled", "N-9", on_cells("""
    , d AS (SELECT industry, org, aspect, total_count + CASE WHEN aspect = 'Brand#3' THEN 1 ELSE 0 END AS declared,
      total_count AS found FROM cells)
    SELECT *, declared <> found AS differs, found < 20 AS under_floor FROM d
    WHERE declared <> found OR found < 20"""))
def profile_reconciled(spark, folder):
    labels = derived.feedback(spark, folder)
    wrong = F.when(F.col("aspect") == "Brand#3", 1).otherwise(0)
    declared = derived.feedback_cells(spark, folder).withColumn("total_count",
                                                                F.col("total_count") + wrong)
    return profiling.reconcile(labels, declared, ["industry", "org", "aspect"], 20)


@query("drift_topic_shares", "N-10 D-7 C-5", on_feedback(CORPORA + """
    , s AS (SELECT corpus, aspect, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY corpus) AS share
      FROM corpora GROUP BY corpus, aspect)
    SELECT aspect, coalesce(r.share, 0e0) AS share_real, coalesce(d.share, 0e0) AS share_made,
      (coalesce(d.share, 0e0) - coalesce(r.share, 0e0)) * 100 AS gap_pp
    FROM (SELECT * FROM s WHERE corpus = 'real') r FULL JOIN (SELECT * FROM s WHERE corpus = 'made') d USING (aspect)"""))
def drift_topic_shares(spark, folder):
    return profiling.corpus_shares(derived.corpora(spark, folder), "aspect", "corpus", NAMES)


@query("drift_sentiment_by_industry", "N-10", on_feedback(CORPORA + """
    , s AS (SELECT corpus, industry, sentiment,
        count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY industry, corpus) AS share
      FROM corpora GROUP BY corpus, industry, sentiment)
    SELECT industry, sentiment, coalesce(max(share) FILTER (corpus = 'real'), 0e0) AS share_real,
      coalesce(max(share) FILTER (corpus = 'made'), 0e0) AS share_made,
      (coalesce(max(share) FILTER (corpus = 'made'), 0e0) - coalesce(max(share) FILTER (corpus = 'real'), 0e0)) * 100 AS gap_pp
    FROM s GROUP BY industry, sentiment"""))
def drift_sentiment_by_industry(spark, folder):
    return profiling.corpus_shares(derived.corpora(spark, folder), "sentiment", "corpus", NAMES,
                                   ["industry"])


RATES_BY_CORPUS = CORPORA + """, r AS (SELECT industry,
    (count(*) FILTER (corpus = 'real' AND sentiment = 'negative'))::DOUBLE / count(*) FILTER (corpus = 'real') AS rate_real,
    (count(*) FILTER (corpus = 'made' AND sentiment = 'negative'))::DOUBLE / count(*) FILTER (corpus = 'made') AS rate_made
    FROM corpora GROUP BY industry)"""


@query("drift_negative_rates", "N-11", on_feedback(RATES_BY_CORPUS + " SELECT * FROM r"))
def drift_negative_rates(spark, folder):
    return profiling.negative_rates_by_corpus(derived.corpora(spark, folder), "industry", "corpus",
                                              NAMES)


@query("drift_rank_correlation", "N-11 J-9", on_feedback(RATES_BY_CORPUS + """
    , k AS (SELECT rank() OVER (ORDER BY rate_real) + (count(*) OVER (PARTITION BY rate_real) - 1) / 2e0 AS a,
      rank() OVER (ORDER BY rate_made) + (count(*) OVER (PARTITION BY rate_made) - 1) / 2e0 AS b FROM r)
    SELECT round(corr(a, b), 9) AS rho, count(*) AS n, (SELECT max(abs(rate_made - rate_real)) * 100 FROM r) AS max_gap_pp
    FROM k"""))
def drift_rank_correlation(spark, folder):
    rates = profiling.negative_rates_by_corpus(derived.corpora(spark, folder), "industry", "corpus",
                                               NAMES)
    rho = inference.spearman_table(rates, ["industry"], ["rate_real", "rate_made"])
    widest = rates.agg((F.max(F.abs(F.col("rate_made") - F.col("rate_real"))) * 100)).scalar()
    return rho.select(F.round("rho", 9).alias("rho"), "n", widest.alias("max_gap_pp"))


@query("drift_presence", "N-12 D-9 H-6", on_feedback(CORPORA + """
    , frame AS (SELECT * FROM (SELECT DISTINCT industry FROM feedback) CROSS JOIN (SELECT DISTINCT aspect FROM feedback))
    SELECT count(c.industry) AS present, count(*) AS groups, count(c.industry)::DOUBLE / count(*) AS share_present
    FROM frame f LEFT JOIN (SELECT DISTINCT industry, aspect FROM corpora WHERE corpus = 'made') c
      ON c.industry = f.industry AND c.aspect = f.aspect"""))
def drift_presence(spark, folder):
    told = frames.holes(derived.feedback(spark, folder), "industry", "aspect", {"made": derived.corpus_marks()["made"]})
    return told.select(F.col("present_made").alias("present"), "groups", (F.col("present_made") / F.col("groups")).alias("share_present"))


@query("profile_thin_share", "N-13", on_cells("""
    SELECT industry, count(*) AS cells, count(*) FILTER (total_count < 30) AS thin,
      (count(*) FILTER (total_count < 30))::DOUBLE / count(*) AS thin_share FROM cells GROUP BY industry"""))
def profile_thin_share(spark, folder):
    return profiling.thin_share(derived.feedback_cells(spark, folder), "industry")


@query("drift_variation_distance", "N-14 C-5", on_feedback(CORPORA + """
    , s AS (SELECT corpus, industry, aspect, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY industry, corpus) AS share
      FROM corpora GROUP BY corpus, industry, aspect),
    w AS (SELECT industry, aspect, coalesce(max(share) FILTER (corpus = 'real'), 0) AS a,
      coalesce(max(share) FILTER (corpus = 'made'), 0) AS b FROM s GROUP BY industry, aspect)
    SELECT industry, round(sum(abs(a - b)) / 2, 9) AS distance FROM w GROUP BY industry"""))
def drift_variation_distance(spark, folder):
    rows = derived.corpora(spark, folder)
    shares = summaries.value_shares(rows, "aspect", ["industry", "corpus"])
    distance = frames.variation_distance(shares, "aspect", ["industry"], "corpus", *NAMES)
    return distance.withColumn("distance", F.round("distance", 9))


@query("profile_null_pairs", "N-15", on_cells("""
    , t AS (SELECT 'pair' || (CAST(substr(org, 10) AS BIGINT) // 2) AS pair, aspect, org, neg_count FROM cells)
    SELECT pair, aspect, count(DISTINCT org) AS orgs, count(DISTINCT neg_count) AS rates FROM t GROUP BY pair, aspect
    HAVING count(DISTINCT org) = 2 AND count(DISTINCT neg_count) = 1"""))
def profile_null_pairs(spark, folder):
    """All organisations, two and two by number, on every topic."""
    pair = F.concat(F.lit("pair"), F.expr("cast(substr(org, 10) AS bigint) div 2"))
    return profiling.null_pairs(derived.feedback_cells(spark, folder).withColumn("pair", pair), ["pair", "aspect"], "neg_count")


@query("profile_group_summary", "N-16 D-12 D-13", on_cells("""
    , g AS (SELECT 'org' AS level, neg_count::DOUBLE / total_count AS s, total_count AS n FROM cells
      UNION ALL SELECT 'industry', sum(neg_count)::DOUBLE / sum(total_count), sum(total_count)::BIGINT
      FROM cells GROUP BY industry, aspect)
    SELECT level, count(*) AS groups, round(avg(s), 9) AS mean, round(quantile_cont(s, 0.5), 9) AS median,
      round(stddev_samp(s), 9) AS sd, min(s) AS low, max(s) AS high, quantile_cont(n, 0.5)::DOUBLE AS median_n,
      min(n) AS low_n, max(n) AS high_n FROM g GROUP BY level"""))
def profile_group_summary(spark, folder):
    cells = derived.settled_cells(spark, folder)
    orgs = cells.select(F.lit("org").alias("level"), "neg_count", "total_count")
    whole = summaries.roll_up(cells, ["industry", "aspect"]).select(
        F.lit("industry").alias("level"), "neg_count", "total_count")
    groups = orgs.unionByName(whole).withColumn("s", m.rate("neg_count", "total_count"))
    moments = groups.groupBy("level").agg(
        F.count("*").alias("groups"), F.round(F.avg("s"), 9).alias("mean"),
        F.round(F.stddev_samp("s"), 9).alias("sd"), F.min("s").alias("low"),
        F.max("s").alias("high"), F.min("total_count").alias("low_n"),
        F.max("total_count").alias("high_n"))
    middle = (ranking.quantiles(groups, "s", [0.5], ["level"])
              .select("level", F.round("value", 9).alias("median")))
    middle_n = (ranking.quantiles(groups, "total_count", [0.5], ["level"])
                .select("level", F.col("value").alias("median_n")))
    return moments.join(middle, "level").join(middle_n, "level")


@query("profile_outside_support", "N-17", on_cells("""
    , g AS (SELECT neg_count::DOUBLE / total_count AS s, total_count AS n FROM cells),
    i AS (SELECT sum(neg_count)::DOUBLE / sum(total_count) AS s FROM cells GROUP BY industry, aspect),
    e AS (SELECT min(s) AS lo, max(s) AS hi FROM i)
    SELECT count(*) AS groups, count(*) FILTER (s < lo OR s > hi) AS outside,
      (count(*) FILTER (s < lo OR s > hi))::DOUBLE / count(*) AS outside_share,
      count(*) FILTER (s = 0 OR s = 1) AS pinned, max(n) FILTER (s = 0 OR s = 1) AS largest_pinned FROM g, e"""))
def profile_outside_support(spark, folder):
    cells = derived.feedback_cells(spark, folder)
    own = cells.select(m.rate("neg_count", "total_count").alias("s"), "total_count")
    whole = summaries.roll_up(cells, ["industry", "aspect"]).select(
        m.rate("neg_count", "total_count").alias("s"))
    return profiling.support_check(own, whole, "s", "total_count")


REVIEWS = """WITH reviews AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, text, CAST(doc_id % 50 AS INT) AS org_index,
    lang AS industry, source AS data_source FROM documents),
  codes AS (SELECT reviews.*, 'G' || (doc_id + i) % 5 AS parent_aspect, 'Brand#' || ((doc_id * (i + 1)) % 25 + 1) AS aspect,
      CASE (doc_id + i) % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS sentiment
    FROM reviews, range(0, 3) q(i) WHERE i <= doc_id % 3)"""


@query("reviews_to_labels", "I-1 A-2", REVIEWS + """
    SELECT industry, data_source, parent_aspect, aspect, sentiment, count(*) AS n FROM codes GROUP BY ALL""")
def reviews_to_labels(spark, folder):
    labels = text.explode_labels(derived.raw_reviews(spark, folder))
    return labels.groupBy("industry", "data_source", "parent_aspect", "aspect", "sentiment").agg(
        F.count("*").alias("n"))


@query("reviews_text_measures", "I-2", REVIEWS + r"""
    SELECT id, len(regexp_extract_all(text, '\S+')) AS word_count, length(text) AS text_length,
      doc_id % 3 + 1 AS num_labels FROM reviews""")
def reviews_text_measures(spark, folder):
    reviews = derived.raw_reviews(spark, folder)
    return reviews.select("id", text.word_count().cast("bigint").alias("word_count"),
                          F.length("text").cast("bigint").alias("text_length"),
                          F.size(text.label_codes()).cast("bigint").alias("num_labels"))


@query("profile_reviews", "N-18 D-4 D-10 D-12 I-2", REVIEWS + """
    SELECT r.industry, count(*) AS reviews, sum(doc_id % 3 + 1)::BIGINT AS labels,
      count(DISTINCT org_index) AS orgs, count(DISTINCT data_source) AS sources,
      sum(doc_id % 3 + 1)::DOUBLE / count(*) AS labels_per_review, sum(length(text))::DOUBLE / count(*) AS mean_length
    FROM reviews r GROUP BY r.industry""")
def profile_reviews(spark, folder):
    reviews = derived.raw_reviews(spark, folder)
    labels = F.size(text.label_codes()).cast("bigint")
    return reviews.groupBy("industry").agg(
        F.count("*").alias("reviews"), F.sum(labels).alias("labels"),
        F.count_distinct("org_index").alias("orgs"),
        F.count_distinct("data_source").alias("sources"),
        m.rate(F.sum(labels), F.count("*")).alias("labels_per_review"),
        m.rate(F.sum(F.length("text")), F.count("*")).alias("mean_length"))


@query("profile_source_mix", "N-18 D-4", REVIEWS + """
    SELECT data_source, industry, count(*) AS count FROM reviews GROUP BY ALL""")
def profile_source_mix(spark, folder):
    return summaries.count_by(derived.raw_reviews(spark, folder), "data_source", "industry")


@query("quality_vocabulary", "N-19", on_feedback("""
    SELECT label, 'never seen' AS problem FROM (SELECT 'Brand#' || i AS label FROM range(1, 31) r(i))
      WHERE label NOT IN (SELECT aspect FROM feedback)
    UNION ALL SELECT DISTINCT aspect, 'not allowed' FROM feedback
      WHERE aspect NOT IN (SELECT 'Brand#' || i FROM range(1, 31) r(i))"""))
def quality_vocabulary(spark, folder):
    allowed = spark.range(1, 31).select(F.concat(F.lit("Brand#"), "id").alias("label"))
    return profiling.vocabulary_gaps(derived.feedback_cells(spark, folder), "aspect", allowed)


@query("quality_org_in_one_industry", "N-19", on_feedback("""
    SELECT parent_aspect || '-' || source AS org, count(DISTINCT industry) AS industries FROM feedback
    GROUP BY 1 HAVING count(DISTINCT industry) > 1"""))
def quality_org_in_one_industry(spark, folder):
    rows = derived.feedback(spark, folder)
    return profiling.homeless_orgs(rows.withColumn("org", F.concat_ws("-", "parent_aspect",
                                                                      "source")))


@query("quality_home_of_organisations", "N-19", on_feedback("""
    , f AS (SELECT CASE WHEN l_orderkey % 1000 = 7 THEN 'ASIA' ELSE industry END AS industry, org FROM feedback)
    SELECT org, count(DISTINCT industry) AS industries FROM f GROUP BY 1 HAVING count(DISTINCT industry) > 1"""))
def quality_home_of_organisations(spark, folder):
    """Organisations whose labels name several industries, where one order in a thousand names a wrong one."""
    wrong = F.split_part("review_id", F.lit("-"), F.lit(1)).cast("bigint") % 1000 == 7
    rows = derived.feedback(spark, folder).withColumn("industry", F.when(wrong, "ASIA").otherwise(F.col("industry")))
    return profiling.homeless_orgs(rows)


@query("first_review_per_sentiment", "N-20", on_feedback("""
    SELECT sentiment, industry, org, aspect, source FROM (SELECT *, row_number() OVER (PARTITION BY sentiment
      ORDER BY l_orderkey || '-' || l_linenumber || '-' || l_suppkey, aspect, org, industry, source) AS rn FROM feedback)
    WHERE rn = 1"""))
def first_review_per_sentiment(spark, folder):
    told = profiling.first_per_group(derived.feedback(spark, folder), ["sentiment"],
                                     ["review_id", "aspect", "org", "industry", "source"],
                                     ["review_id", "industry", "org", "aspect", "source"])
    return told.drop("review_id")


@query("evidence_sample", "N-21", """
    SELECT id, industry, text FROM (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS industry,
        substr(text, 1, 300) AS text, row_number() OVER (PARTITION BY lang ORDER BY
          ('0x' || substr(md5(doc_id || '|42'), 1, 8))::BIGINT, CAST(doc_id AS VARCHAR)) AS rn FROM documents)
    WHERE rn <= 3""")
def evidence_sample(spark, folder):
    reviews = derived.raw_reviews(spark, folder).select("id", "industry", "text")
    return profiling.evidence_sample(reviews, "id", 3, ["industry"])
