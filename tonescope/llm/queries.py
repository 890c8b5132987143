"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonescope.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(fn):
    QUERIES[fn.__name__] = fn
    return fn


@registered
def op5_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    from tonescope.llm.winnowing import edited
    return edited(documents(spark, folder))


@registered
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from tonescope.llm.sharding import shard
    return shard(documents(spark, folder), 16)


@registered
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from tonescope.llm.mixing import mix_draws
    return mix_draws(documents(spark, folder)).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.coalesce(F.size("draws"), F.lit(0))).alias("taken"),
        F.transform("draws", lambda d: d["shard"]).alias("shards"))


#: The rules of the query: verdict and rule.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]


@registered
def op1_urlfilter(spark: SparkSession, folder: str) -> DataFrame:
    from tonescope.llm.urlfilter import url_filter
    return url_filter(spark.read.parquet(f"{folder}/pages.parquet"), URL_RULES)


ORACLES["op1_urlfilter"] = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, rule, h, p) AS (VALUES """ + ", ".join(
    f"('{v}', '{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}')" for v, r in URL_RULES) + """),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls u LEFT JOIN fits USING (page_id)
"""


@registered
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tonescope.llm.packing import pack
    return pack(documents(spark, folder))


@registered
def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    from tonescope.llm.substrings import removed
    return removed(documents(spark, folder))


@registered
def op2_neardup(spark: SparkSession, folder: str) -> DataFrame:
    from tonescope.llm.neardup import near_duplicates
    return near_duplicates(documents(spark, folder))


@registered
def op4_importance(spark: SparkSession, folder: str) -> DataFrame:
    from tonescope.llm.importance import resample
    return resample(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@registered
def op3_pagetext(spark: SparkSession, folder: str) -> DataFrame:
    from tonescope.llm.pagetext import main_text
    return main_text(spark.read.parquet(f"{folder}/pages.parquet"))


@registered
def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from tonescope.llm.neighbours import search
    return search(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


@registered
def op11_lines(spark: SparkSession, folder: str) -> DataFrame:
    from tonescope.llm.lines import without_repeated_lines
    return without_repeated_lines(documents(spark, folder)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op11_lines"] = """
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
lines AS (
  SELECT doc_id, u.line, u.nth, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_zip(own, range(len(own)))) AS z FROM texts) t,
       LATERAL (SELECT z[1] AS line, z[2] AS nth) u),
spread AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40
           GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last > doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN spread USING (key) GROUP BY doc_id
"""


def tail_repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten with a periodic end."""
    import zlib
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


@registered
def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    from tonescope.llm.periodic import periodic_runs
    found = periodic_runs(documents(spark, folder), edit=tail_repeated)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return (found.withColumn("best", longest).withColumn("lines", lines)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
                    F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                    F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
                    F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


def letter_lost(doc_id: int | None, word: str) -> str:
    """One occurrence in 31 without one of its letters."""
    import zlib
    h = zlib.crc32(f"{doc_id}:{word}".encode()) if doc_id is not None else 1
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


@registered
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    from tonescope.llm.spelling import variants, word_counts
    return variants(word_counts(documents(spark, folder), edit=letter_lost))
