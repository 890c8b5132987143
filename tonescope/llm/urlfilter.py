"""URL filter by a cascade of Bloom filters: exact membership of listed keys among the corpus's keys, without a join.

A rule is `host/path`; it fits its host and all subdomains where the url's path starts with the rule's. The keys of a url
are its host suffixes joined with its path prefixes, of the numbers of labels and the lengths that occur among the rules. The
universe is every distinct key of the corpus. Level 1 holds the listed keys, level 2 the unlisted keys of the universe
that pass level 1, level 3 the listed keys that pass level 2, and so on until a level is empty. For a key of the universe,
the first level that it misses gives its membership exactly. One cascade tells rules from other keys, a second one block
rules from all rules.

The filters go to the executors only while they are within MOST_BITS; beyond, rules are looked up by a shuffled join on
the same keys, with the same result.

Null urls and those without `://` have an empty host and path and fit no rule. A url that no rule fits is allowed, as its
keys are not listed. Repeated rows are judged alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonescope.llm.common import only, settle

MOST_BITS = 1 << 24
HIT_RATE = 0.01


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All keys of a url that a rule of such a number of labels and such a path length could equal, longest first."""
    parts = F.split(host, r"\.")
    keys = []
    for n in labels:
        tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - F.lit(n - 1), F.lit(1)), F.lit(n)), ".")
        for m in lengths:
            keys.append(F.when((F.size(parts) >= n) & (F.length(path) >= m), F.concat(tail, F.substring(path, 1, m))))
    found = F.array_compact(F.array(*keys))
    return F.array_sort(found, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(
        F.length(a) < F.length(b), 1).otherwise(0))


def _positions(one: np.ndarray, two: np.ndarray, level: int, hashes: int, bits: int) -> list[np.ndarray]:
    """Double hashing; the level enters, so that levels fail independently."""
    with np.errstate(over="ignore"):
        a = (one.view(np.uint64) ^ np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(31)
        b = (two.view(np.uint64) + np.uint64(level)) * np.uint64(0x94D049BB133111EB)
        b ^= b >> np.uint64(29)
        return [((a + np.uint64(i) * (b | np.uint64(1))) >> np.uint64(16)) % np.uint64(bits) for i in range(hashes)]


class Cascade:
    """Levels of (bits, number of hashes, packed bits)."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, int, np.ndarray]] = []

    def add(self, keys: DataFrame, n: int, rate: float) -> None:
        """A filter over the n keys: each task sets the bits of its keys, the words are or-ed by Spark."""
        level, bits = len(self.levels), max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 64)
        hashes = max(1, round(bits / n * math.log(2)))

        def words(batches):
            for pdf in batches:
                at = np.unique(np.concatenate(_positions(pdf["one"].to_numpy(), pdf["two"].to_numpy(), level, hashes,
                                                         bits)))
                word, start = np.unique(at >> np.uint64(6), return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
                yield pd.DataFrame({"word": word.astype(np.int64), "value": value.view(np.int64)})

        packed = np.zeros(bits // 64, dtype=np.uint64)
        rows = (keys.select("one", "two").mapInPandas(words, "word long, value long")
                .groupBy("word").agg(F.bit_or("value").alias("value")).toPandas())
        packed[rows["word"].to_numpy()] = rows["value"].to_numpy(dtype=np.int64).view(np.uint64)
        self.levels.append((bits, hashes, packed))

    @property
    def bits(self) -> int:
        return sum(b for b, _, _ in self.levels)

    def passed(self, one: np.ndarray, two: np.ndarray, level: int) -> np.ndarray:
        bits, hashes, packed = self.levels[level]
        hit = np.ones(len(one), dtype=bool)
        for at in _positions(one, two, level, hashes, bits):
            hit &= (packed[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return hit

    def member(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The first level missed decides: an odd one says no, an even one yes; all passed: by the last level."""
        inside = np.full(len(one), len(self.levels) % 2 == 1)
        open_ = np.ones(len(one), dtype=bool)
        for level in range(len(self.levels)):
            miss = open_ & ~self.passed(one, two, level)
            inside[miss] = level % 2 == 1
            open_ &= ~miss
        return inside


def _level_filter(keys: DataFrame, cascade: Cascade) -> DataFrame:
    """Keys that pass the cascade's last level."""
    held, level = keys.sparkSession.sparkContext.broadcast(cascade), len(cascade.levels) - 1

    @F.pandas_udf("boolean")
    def hit(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(held.value.passed(one.to_numpy(), two.to_numpy(), level))

    return keys.where(hit("one", "two"))


def build_cascade(listed: DataFrame, others: DataFrame, most_bits: int = MOST_BITS) -> Cascade | None:
    """Cascade that is exact on the keys of both tables (columns one, two: 128 bits of hash). None: past `most_bits`."""
    cascade, sides = Cascade(), [listed, others]
    counts = [listed.count(), others.count()]
    rate = min(0.5, max(1e-6, 0.7 * counts[0] / max(counts[1], 1)))
    while counts[len(cascade.levels) % 2]:
        side = len(cascade.levels) % 2
        if cascade.bits - counts[side] * math.log(rate) * 2.1 > most_bits:
            return None
        if len(cascade.levels) > 60:
            raise ValueError("a listed and an unlisted key have the same 128-bit hash")
        cascade.add(sides[side], counts[side], rate)
        rate = 0.5 if len(cascade.levels) < 3 else HIT_RATE
        sides[1 - side] = settle(_level_filter(sides[1 - side], cascade), f"level{len(cascade.levels)}")
        counts[1 - side] = sides[1 - side].count()
    return cascade


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("one"), F.xxhash64(F.lit("two"), "key").alias("two"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule (null: none fits) and verdict (`allow`, `block`) of every page; rules: (verdict, rule)."""
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    split = [(r[:r.index("/")], r[r.index("/"):]) for _, r in rules]
    labels = sorted({len(h.split(".")) for h, _ in split}, reverse=True)
    lengths = sorted({len(p) for _, p in split}, reverse=True)
    judged = (only(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
              .withColumn("keys", url_keys(F.col("host"), F.col("path"), labels, lengths)))
    table = spark.createDataFrame([(r, v == "block") for v, r in rules], "key string, blocks boolean")
    universe = settle(_hashed(judged.select(F.explode("keys").alias("key")).distinct()
                              .unionByName(table.select("key")).distinct()), "universe")
    listed = _hashed(table.select("key").distinct())
    blocking = _hashed(table.where("blocks").select("key").distinct())
    is_rule = build_cascade(listed, universe.join(listed.select("key"), "key", "left_anti"), most_bits)
    is_block = build_cascade(blocking, listed.join(blocking.select("key"), "key", "left_anti"), most_bits)
    if is_rule is None or is_block is None:
        every = judged.withColumn("id", F.monotonically_increasing_id())
        every = settle(every, "judged")
        best = (every.select("id", F.explode("keys").alias("key")).join(table, "key").groupBy("id")
                .agg(F.max_by(F.struct("key", "blocks"), F.struct(F.length("key"), "key")).alias("hit")))
        return every.join(best, "id", "left").select(
            "page_id", "host", "path", F.col("hit.key").alias("rule"),
            F.when(F.col("hit.blocks"), "block").otherwise("allow").alias("verdict"))
    held = spark.sparkContext.broadcast((is_rule, is_block))

    @F.pandas_udf("rule string, verdict string")
    def judge(keys: pd.Series, ones: pd.Series, twos: pd.Series) -> pd.DataFrame:
        rule_of, block_of = held.value
        sizes = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
        one = np.concatenate([*ones, np.empty(0, np.int64)]).astype(np.int64)
        two = np.concatenate([*twos, np.empty(0, np.int64)]).astype(np.int64)
        hit = rule_of.member(one, two)
        blocks = block_of.member(one, two)
        row, first = np.unique(np.repeat(np.arange(len(keys)), sizes)[hit], return_index=True)
        where = np.flatnonzero(hit)[first]
        starts = np.cumsum(sizes) - sizes
        out = pd.DataFrame({"rule": pd.Series([None] * len(keys), dtype=object), "verdict": "allow"})
        for r, w in zip(row, where):
            out.at[r, "rule"] = keys.iloc[r][w - starts[r]]
            out.at[r, "verdict"] = "block" if blocks[w] else "allow"
        return out

    return (judged.withColumn("judged", judge("keys", F.transform("keys", lambda k: F.xxhash64(k)),
                                              F.transform("keys", lambda k: F.xxhash64(F.lit("two"), k))))
            .select("page_id", "host", "path", "judged.rule", "judged.verdict"))
