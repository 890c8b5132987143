"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, overfull ranges subdivided.

The key of a row is a hash of its text, so equal texts lie in one range and go to one shard; only a group that by
itself outweighs a whole shard is sliced (by a hash of doc_id). Law `bytes`: shards are near equal in bytes.

Null text: no bytes, size 1, checksum of the empty string. Rows repeated whole get slots of their own. An empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonescope.llm.common import bounds_search, lookup, only, settle

RANGES_PER_SHARD = 32
SAMPLES_PER_RANGE = 16
ROWS_PER_RANGE = 500_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key (of the text), spread (of the row): all that sharding needs, without the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return only(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"), F.xxhash64(F.lit("spread"), "doc_id").alias("spread"))


def _sample(rows: DataFrame, per_byte: float, seed: int) -> list[int]:
    """Keys drawn with probability in proportion to size; a repeat of a hash, so a lost task draws the same."""
    draw = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "key"), F.lit(1 << 30)) / float(1 << 30))
    return sorted(r[0] for r in rows.where(draw < F.col("size") * per_byte).select("key").collect())


def _splitters(drawn: list[int], parts: int) -> set[int]:
    """Quantiles of the draw; a key drawn three times or more is heavy and gets a range of its own."""
    cuts = {drawn[i * len(drawn) // parts] for i in range(1, parts)} if drawn else set()
    for a, b in zip(drawn, drawn[2:]):
        if a == b:
            cuts |= {a, min(a + 1, 2**63 - 1)}
    return cuts


def plan_ranges(rows: DataFrame, shards: int) -> tuple[list[int], list[tuple[int, int, int]], int]:
    """Bounds, (range, slices, bytes) of every non-empty range, and all bytes.

    A range is overfull at twice the mean. It is sampled again more finely until it is within that or holds a single
    key. The sample has SAMPLES_PER_RANGE keys per range whatever the size of the input.
    """
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(shards * RANGES_PER_SHARD, -(-n // ROWS_PER_RANGE))
    most = 2 * total / parts
    bounds = sorted(_splitters(_sample(rows, parts * SAMPLES_PER_RANGE / max(total, 1), 0), parts))
    seed = 0
    while True:
        seed += 1
        here = bounds_search(bounds, F.col("key"))
        found = (rows.groupBy(here.alias("range"))
                 .agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).collect())
        over = [r for r in found if r["bytes"] > most and r["low"] < r["high"]]
        if not over:
            break
        wanted = {r["range"]: r for r in over}
        inside = rows.where(here.isin(*wanted))
        drawn = _sample(inside, (1 << seed) * parts * SAMPLES_PER_RANGE / total, seed)
        fresh = set()
        for r in over:
            own = [k for k in drawn if r["low"] <= k <= r["high"]]
            fresh |= _splitters(own, max(2, round(2 * r["bytes"] / most))) - {r["low"]}
            if not fresh:
                fresh.add(r["low"] + 1 + (r["high"] - r["low"] - 1) // 2)
        bounds = sorted(set(bounds) | fresh)
    share = total / shards
    return bounds, [(r["range"], 1 if r["bytes"] <= share else -(-r["bytes"] * RANGES_PER_SHARD // int(share)),
                     r["bytes"]) for r in found], total


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard (0 to shards - 1), slot (gapless from 0 in its shard), grown_shard (null)."""
    rows = settle(sized(docs), "sized")
    bounds, ranges, _ = plan_ranges(rows, shards)
    slices = [1] * (len(bounds) + 1)
    for r, n, _ in ranges:
        slices[r] = n
    first, at = [], 0
    for n in slices:
        first.append(at)
        at += n
    here = bounds_search(bounds, F.col("key"))
    piece = lookup(first, F.col("range")) + F.pmod("spread", lookup(slices, F.col("range")))
    placed = rows.withColumn("range", here).withColumn("piece", piece.cast("int"))
    weights = placed.groupBy("piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    shard_of, start_of, turns = [0] * at, [0] * at, [1] * at
    filled = [(0, 0, s) for s in range(shards)]
    mean = max(1, sum(w["n"] for w in weights) // max(len(weights), 1))
    for w in sorted(weights, key=lambda w: (-w["bytes"], w["piece"])):
        size, count, s = heapq.heappop(filled)
        shard_of[w["piece"]], start_of[w["piece"]] = s, count
        turns[w["piece"]] = -(-w["n"] // (2 * mean))
        heapq.heappush(filled, (size + w["bytes"], count + w["n"], s))
    # A piece of many rows (one text may have many copies) is numbered in turns, each in a task of its own.
    placed = placed.withColumn("turn", F.pmod(F.xxhash64("spread"), lookup(turns, F.col("piece"))).cast("int"))
    sizes = placed.groupBy("piece", "turn").agg(F.count(F.lit(1)).alias("n")).collect()
    places, first_turn = [], [0] * at
    by_piece: dict[int, dict[int, int]] = {}
    for r in sizes:
        by_piece.setdefault(r["piece"], {})[r["turn"]] = r["n"]
    for piece in range(at):
        first_turn[piece], slot = len(places), start_of[piece]
        for turn in range(turns[piece]):
            places.append(slot)
            slot += by_piece.get(piece, {}).get(turn, 0)
    start = lookup(places, lookup(first_turn, F.col("piece"), "int") + F.col("turn"))
    rank = F.row_number().over(Window.partitionBy("piece", "turn").orderBy("key", "doc_id", "size", "text_crc32"))
    return placed.withColumn("rank", rank).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        lookup(shard_of, F.col("piece"), "int").alias("shard"), (start + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
