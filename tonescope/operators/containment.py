"""Which of many texts stand whole inside which of many others, without comparing all pairs.

Texts are reduced to prints: the smallest hash of every window of neighbouring n-grams. A text that contains another has all
prints of the other's windows, as these see the same characters. So a needle asks only the haystacks that hold its rarest print;
one with a print that no haystack has is nowhere. What is asked is verified on the texts.

Short needles need shorter grams and windows: TIERS gives them by the needle's length. Haystacks are reduced once for each tier
that the needles have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescope.session import cut_lineage

#: (gram, window) in characters; a needle takes the first tier with gram + window - 1 <= its length. Grams are powers of two.
TIERS = ((16, 17), (4, 5), (4, 1), (2, 1), (1, 1))
#: Prints that are handed to all tasks, so that haystacks give out only those asked for.
HANDED = 100_000
PRINTS = "id string, tier int, print long"


def smallest(text: str, gram: int, window: int) -> np.ndarray:
    """The smallest hashes of all windows of `window` consecutive n-grams of a text, in their order."""
    values = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(values) < gram + window - 1:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        values = (values + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        step = 1
        while step < gram:
            values = (values[:-step] ^ values[:-step] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + values[step:]
            step *= 2
        values ^= values >> np.uint64(31)
        values *= np.uint64(0x94D049BB133111EB)
        values ^= values >> np.uint64(30)
    width = 1
    while 2 * width <= window:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    if width < window:
        values = np.minimum(values[:width - window], values[window - width:])
    return values.view(np.int64)


def windows(text: str, gram: int, window: int) -> np.ndarray:
    """The distinct smallest hashes of all windows."""
    return np.unique(smallest(text, gram, window))


def prints(texts: DataFrame, tiers: list[int] | None = None, wanted: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(id, tier, print) of (id, text): for the given tiers, or for each text the tier of its length.

    With `wanted`, the sorted prints of each tier that are asked for, all others are left out before they leave the task.
    """

    def asked(got: np.ndarray, tier: int, marks: np.ndarray) -> np.ndarray:
        got = got[marks[got >> 20 & 0xFFFF]]
        if not len(got):
            return got
        near = np.minimum(np.searchsorted(wanted[tier], got), len(wanted[tier]) - 1)
        return np.unique(got[wanted[tier][near] == got])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = {}   # 16 bits of every wanted print: most others go by one look
        for tier, own in (wanted or {}).items():
            marks[tier] = np.zeros(1 << 16, bool)
            marks[tier][own >> 20 & 0xFFFF] = True
        for batch in batches:
            rows, of, found, size = [], [], [], 0
            for row, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                own = tiers if tiers is not None else [i for i, t in enumerate(TIERS) if sum(t) - 1 <= len(text)][:1]
                for tier in own:
                    got = windows(text, *TIERS[tier]) if wanted is None else asked(
                        smallest(text, *TIERS[tier]), tier, marks[tier])
                    rows.append(np.full(len(got), row, np.int32))
                    of.append(np.full(len(got), tier, np.int32))
                    found.append(got)
                    size += len(got)
                if size > 1_000_000:
                    yield told(batch.column(0), rows, of, found)
                    rows, of, found, size = [], [], [], 0
            yield told(batch.column(0), rows, of, found)

    def told(names: pa.Array, rows: list[np.ndarray], of: list[np.ndarray], found: list[np.ndarray]) -> pa.RecordBatch:
        none = np.empty(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(np.concatenate([none, *rows]))), pa.array(np.concatenate([none, *of])),
             pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["id", "tier", "print"])

    return texts.select("id", "text").mapInArrow(run, PRINTS)


def held_prints(haystacks: DataFrame, wanted: DataFrame, tiers: list[int]) -> DataFrame:
    """The wanted (tier, print) that each haystack holds. Up to HANDED of them go to all tasks; more are joined."""
    if wanted.count() > HANDED:
        return prints(haystacks, tiers).join(wanted, ["tier", "print"], "left_semi").select("id", "tier", "print")
    rows = wanted.collect()   # at most HANDED pairs of numbers
    lists = {t: np.sort(np.array([r.print for r in rows if r.tier == t], np.int64)) for t in tiers}
    return prints(haystacks, tiers, lists)


def contained(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """(needle_id, haystack_id) for every needle (id, text) that stands whole in a haystack (id, text). Ids are strings.

    Empty and NULL texts, and rows without an id, are contained in nothing and contain nothing. An id with several texts is
    contained, or contains, if one of them does.
    """
    needles = needles.select("id", "text").where("id IS NOT NULL AND text <> ''")
    haystacks = haystacks.select("id", "text").where("id IS NOT NULL AND text <> ''")
    # Equal needles ask once.
    asked = cut_lineage(needles.groupBy("text").agg(F.min("id").alias("lead")))
    own = cut_lineage(prints(asked.select(F.sha2("text", 256).alias("id"), "text")).withColumnRenamed("id", "needle"))
    tiers = sorted(r.tier for r in own.select("tier").distinct().collect())   # one of TIERS each
    wanted = cut_lineage(own.select("tier", "print").distinct())
    held = cut_lineage(held_prints(haystacks, wanted, tiers).withColumnRenamed("id", "haystack_id"))
    spread = held.groupBy("tier", "print").agg(F.count("*").alias("n"))
    rarest = own.join(spread, ["tier", "print"], "left").groupBy("needle", "tier").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "print")).alias("r")).where("r.n > 0").select(
        "needle", "tier", F.col("r.print").alias("print"))
    texts = asked.select(F.sha2("text", 256).alias("needle"), F.col("text").alias("needle_text"))
    pairs = rarest.join(held, ["tier", "print"]).select("needle", "haystack_id").distinct()
    # The short texts travel with the pairs, the long ones only once.
    found = (pairs.join(texts, "needle").join(haystacks.withColumnRenamed("id", "haystack_id"), "haystack_id")
             .where(F.contains("text", "needle_text")).select("needle_text", "haystack_id").distinct())
    members = needles.select(F.col("id").alias("needle_id"), F.col("text").alias("needle_text")).distinct()
    return members.join(found, "needle_text").select("needle_id", "haystack_id").distinct()
