"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks of documents.

A document lies in a block of its source by a hash of doc_id. A source that is to give f times its size gives every
block floor(f) times, and the first blocks of a permutation, with a part of one more, for the rest. These block draws
are the quota of the source. The tree halves the output shards again and again and splits the exact quotas of all sources
among both halves by a multivariate-hypergeometric draw. Each shard then takes its number of blocks from the permuted
list of each source, so blocks are disjoint, and is shuffled within itself.

A source may be null (last in order). Null or empty text has size 0 and is never short of its target. Rows repeated
whole fall into the same block. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonescope.llm.common import WORD, only, settle

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
BLOCK_ROWS = 2_000
LEAST_BLOCKS, MOST_BLOCKS = 16, 100_000
SHARD_WORDS = 10_000_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), spread (hash that orders the row in every draw)."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return only(docs, "doc_id", "source", "text").select(
        "doc_id", "source", words.alias("size"), F.xxhash64(F.lit("mix"), "doc_id").alias("spread"))


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, times: int = MOST_TIMES) -> list[float]:
    """Shares of all sizes by weight; a source stops at `times` its size and the excess is shared again."""
    share = [weights[i % len(weights)] for i in range(len(sizes))]
    free, left, out = set(range(len(sizes))), float(sum(sizes)), [0.0] * len(sizes)
    while free:
        scale = left / sum(share[i] for i in free)
        over = {i for i in free if share[i] * scale >= times * sizes[i]}
        if not over:
            for i in free:
                out[i] = share[i] * scale
            break
        for i in over:
            out[i] = float(times * sizes[i])
            left -= out[i]
        free -= over
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int = 0) -> list[list[int]]:
    """Block quotas of each shard: halves of the shards get a multivariate-hypergeometric part of what their node has."""
    draw = np.random.default_rng(seed)

    def split(have: np.ndarray, n: int) -> list[list[int]]:
        if n == 1:
            return [have.tolist()]
        half = n // 2
        left = draw.multivariate_hypergeometric(have, int(have.sum()) * half // n, method="marginals") \
            if have.sum() < 1_000_000_000 else have * half // n
        return split(left, half) + split(have - left, n - half)

    return split(np.asarray(quotas, dtype=np.int64), shards)


def mix_plan(docs: DataFrame, shards: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The sized rows with block and target, and the draws (source_no, block, times, shard, part_of)."""
    spark = docs.sparkSession
    rows = settle(sized(docs), "sized")
    per = (rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("source").asc_nulls_last()).collect())
    goal = targets([r["size"] for r in per])
    plan = spark.createDataFrame(
        [(i, r["source"], r["size"], g, min(MOST_BLOCKS, max(LEAST_BLOCKS, r["n"] // BLOCK_ROWS)))
         for i, (r, g) in enumerate(zip(per, goal))],
        "source_no int, source string, source_size long, target double, blocks long")
    rows = (rows.join(F.broadcast(plan) if len(per) <= 10_000 else plan, rows["source"].eqNullSafe(plan["source"]))
            .select("doc_id", rows["source"], "size", "spread", "source_no", "source_size", "target",
                    F.pmod(F.col("spread"), F.col("blocks")).alias("block")))
    return rows, plan


def mix_draws(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and `draws`, one (draw, shard) for each time it is taken
    (null or empty: never). There are `shards` output shards, more where one would have over SHARD_WORDS words."""
    spark = docs.sparkSession
    rows, plan = mix_plan(docs, shards, seed)
    # Blocks of a source in permuted order; what lies before a block decides whether the broken part takes it.
    order = Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(seed), "block"), "block")
    blocks = settle(
        rows.groupBy("source_no", "block", "source_size", "target").agg(F.sum("size").alias("words"))
        .withColumn("place", F.row_number().over(order) - 1)
        .withColumn("before", F.sum("words").over(order) - F.col("words"))
        .withColumn("times", F.when(F.col("source_size") > 0,
                                    F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0))
        .withColumn("quota", F.greatest(F.lit(0.0), F.col("target") - F.col("times") * F.col("source_size")))
        .withColumn("room", F.col("quota") - F.col("before")), "blocks")
    whole = blocks.where(F.col("room") >= F.col("words"))
    broken = blocks.where((F.col("room") > 0) & (F.col("room") < F.col("words")))
    # In the one broken block of a source: documents in permuted order while they fit, then the one that fits best.
    inner = Window.partitionBy("source_no").orderBy("spread", "doc_id")
    part = settle(
        rows.join(broken.select("source_no", "block", "room"), ["source_no", "block"])
        .withColumn("until", F.sum("size").over(inner)).withColumn("nth", F.row_number().over(inner)), "broken")
    fits = F.col("until") <= F.col("room")
    rest = (part.groupBy("source_no").agg(
        F.coalesce(F.max(F.when(fits, F.col("until"))), F.lit(0)).alias("got"), F.first("room").alias("need")))
    best = (part.where(~fits).join(rest, "source_no")
            .withColumn("miss", F.abs(F.col("need") - F.col("got") - F.col("size")))
            .where(F.col("miss") < F.col("need") - F.col("got"))
            .groupBy("source_no").agg(F.min_by("nth", F.struct("miss", "nth")).alias("nth")))
    chosen = part.where(fits).select("source_no", "nth", "doc_id", "block").unionByName(
        part.join(best, ["source_no", "nth"]).select("source_no", "nth", "doc_id", "block"))
    # The quota of each source in block draws, split exactly among the shards.
    counts = {r["source_no"]: r["n"] for r in blocks.groupBy("source_no").agg(
        F.sum(F.col("times") + (F.col("room") > 0).cast("int")).alias("n")).collect()}
    quotas = [int(counts.get(i, 0)) for i in range(len(counts))]
    shards = max(shards, (plan.agg(F.sum("source_size")).first()[0] or 0) // SHARD_WORDS)
    shares = splitting_tree(quotas, shards, seed) if quotas else []
    ends, at = [], [0] * len(quotas)
    for s, own in enumerate(shares):
        for i, n in enumerate(own):
            if n:
                ends.append((i, at[i], at[i] + n, s))
                at[i] += n
    runs = spark.createDataFrame(ends or [(None,) * 4], "source_no int, low long, high long, shard int")
    drawn = (blocks.withColumn("draws", (F.col("times") + (F.col("room") > 0).cast("int")).cast("int"))
             .where("draws > 0").select("source_no", "block", F.explode(F.sequence(F.lit(1), "draws")).alias("draw"),
                                        "times"))
    permuted = Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(seed + 1), "block", "draw"), "block", "draw")
    drawn = drawn.withColumn("place", F.row_number().over(permuted) - 1)
    drawn = (drawn.join(runs, "source_no").where("place >= low and place < high")
             .select("source_no", "block", "draw", "shard", (F.col("draw") > F.col("times")).alias("extra")))
    partial = broken.select("source_no", "block").withColumn("is_broken", F.lit(True))
    drawn = drawn.join(partial, ["source_no", "block"], "left").withColumn(
        "gated", F.col("extra") & F.coalesce("is_broken", F.lit(False))).drop("is_broken", "extra")
    listed = drawn.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(
        F.struct("draw", "shard", "gated"))).alias("draws"))
    picked = chosen.select("source_no", "block", "doc_id").distinct().withColumn("picked", F.lit(True))
    out = (rows.join(listed, ["source_no", "block"], "left")
           .join(picked, ["source_no", "block", "doc_id"], "left")
           .withColumn("draws", F.filter("draws", lambda d: ~d["gated"] | F.coalesce("picked", F.lit(False)))))
    return out.select("doc_id", "source", "size", "source_size", "target", "draws")


def mix(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """A row for each time a document is taken: doc_id, draw, shard, order (by which a shard is shuffled)."""
    return (mix_draws(docs, shards, seed).select("doc_id", F.explode("draws").alias("d"))
            .select("doc_id", F.col("d.draw").alias("draw"), F.col("d.shard").alias("shard"),
                    F.xxhash64(F.lit(seed), F.col("d.shard"), "doc_id", F.col("d.draw")).alias("order")))
