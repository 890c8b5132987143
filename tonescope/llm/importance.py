"""Quality classifier by importance resampling: target against raw hashed n-gram models, Gumbel top-k.

Words (runs of anything but ASCII white space, A-Z lower-cased) give 1- and 2-grams, hashed into BUCKETS each. The raw model
counts the n-grams of every document; the target model counts those of labelled good ones (quality 1, toxic 0) and is
smoothed towards the raw one. The score of a document is its mean log ratio of target to raw. Log weights are scores on
the scale of the labels: 0 where good and bad labelled documents part best (a lost good one counts COST times a missed bad
one), 10 at the median good one. One document in k, the number of documents with a positive weight, is kept: the k largest
sums of log weight and Gumbel noise, which is a draw without replacement in proportion to weight. The noise is a
hash of doc_id, so reruns agree.

Labels: at most LABELLED rows with the smallest hashes of doc_id are used, those with an even hash for the model, the
others for the scale. Without good labelled documents every weight is 0 and all documents with a word are kept; without bad
ones the scale starts at the good one in a hundred. Null, empty and white-space texts have null scores and are not
kept. Rows repeated whole share score and decision. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescope.llm.common import only, settle
from tonescope.llm.neardup import _Hashes, _mix

BUCKETS = 1 << 16
LABELLED = 20_000
SMOOTHING = 20_000.0
COST = 3.0
BINS = 4_096


def _grams(text: str | None, hashes: _Hashes, buckets: int) -> np.ndarray:
    """Bucket of each 1-gram (below `buckets`) and 2-gram (from there)."""
    words = (text or "").encode().lower().split()
    own = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    two = _mix(own[:-1], own[1:])
    shift = np.uint64(40)
    return np.concatenate([(own >> shift).astype(np.int64) % buckets, (two >> shift).astype(np.int64) % buckets + buckets])


def labelled(labels: DataFrame, most: int = LABELLED) -> dict[int, tuple[bool, bool, bool]]:
    """doc_id: (good, bad, for the model); a document with several labels has the worst of them."""
    per = only(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    key = F.xxhash64(F.lit("label"), "doc_id")
    rows = per.withColumn("key", key).orderBy("key", "doc_id").limit(most).collect()
    return {r["doc_id"]: (r["quality"] == 1 and not r["toxic"], r["quality"] == 0, r["key"] % 2 == 0) for r in rows}


def log_ratios(docs: DataFrame, marks: dict[int, tuple[bool, bool, bool]], buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of target to raw for each bucket; counts of all documents, summed by Spark."""
    held = docs.sparkSession.sparkContext.broadcast({d for d, (good, _, model) in marks.items() if good and model})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, good = _Hashes(), held.value
        raw, target = np.zeros(2 * buckets, np.int64), np.zeros(2 * buckets, np.int64)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = _grams(text.as_py(), hashes, buckets)
                np.add.at(raw, own, 1)
                if doc in good:
                    np.add.at(target, own, 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])],
                                         names=["bucket", "raw", "target"])

    rows = (only(docs, "doc_id", "text").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket")
            .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.zeros(2 * buckets), np.zeros(2 * buckets)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    out = np.zeros(2 * buckets)
    for part in (slice(0, buckets), slice(buckets, 2 * buckets)):
        share = (raw[part] + 0.5) / (raw[part].sum() + 0.5 * buckets)
        goal = (target[part] + SMOOTHING * share) / (target[part].sum() + SMOOTHING)
        out[part] = np.log(goal / share)
    return out


def scores(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id and score (null without a word) of every row."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(ratios), len(ratios) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ratio = _Hashes(), held.value
        for batch in batches:
            out = []
            for text in batch.column(1):
                own = _grams(text.as_py(), hashes, buckets)
                out.append(float(ratio[own].mean()) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def scale(good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Score at which the weight is 0, and weight per score."""
    if not len(good):
        return 0.0, 0.0
    good = np.sort(good)
    zero = float(np.quantile(good, 0.01))
    if len(bad):
        cuts = np.unique(np.concatenate([good, bad]))
        cost = COST * np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
        best = int(np.argmin(cost))
        zero = float(cuts[best] + cuts[max(best - 1, 0)]) / 2
    return zero, 10 / max(float(np.median(good)) - zero, 1e-9)


def largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value: a histogram of BINS bins, again within the bin that holds it, until that is one value."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) / BINS
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        bins = rows.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        above = rows.where(F.col(column) > high).count()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if above + b["n"] >= k:
                low, high = b["low"], b["high"]
                break
            above += b["n"]
    return low


def resample(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, score, log_weight, draw (weight plus noise) and kept of every row."""
    marks = labelled(labels)
    rows = settle(scores(docs, log_ratios(docs, marks)), "scores")
    spark = docs.sparkSession
    held = [(d, good) for d, (good, bad, model) in marks.items() if not model and (good or bad)]
    test = spark.createDataFrame(held, "doc_id long, good boolean")
    seen = rows.where("score is not null").join(test, "doc_id").select("good", "score").dropDuplicates().collect()
    zero, per = scale(np.array([r["score"] for r in seen if r["good"]]),
                      np.array([r["score"] for r in seen if not r["good"]]))
    even = (F.pmod(F.xxhash64(F.lit(seed), F.lit("gumbel"), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weighed = (rows.withColumn("log_weight", (F.col("score") - F.lit(zero)) * F.lit(per))
               .withColumn("draw", F.col("log_weight") - F.log(-F.log(even))))
    words = weighed.where("score is not null")
    k = words.where("log_weight > 0" if per else "true").count()
    least = largest(words, "draw", k) if k else float("inf")
    return weighed.withColumn("kept", F.coalesce(F.col("draw") >= F.lit(least), F.lit(False)))
