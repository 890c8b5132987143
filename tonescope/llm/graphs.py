"""Connected components by joins: every node finds the smallest id it can reach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescope.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node reachable.

    A round hooks every node onto its smallest neighbour if that is smaller, shortens the chains by pointer doubling and
    contracts the graph to the roots; it ends when no edge is left. Nothing is gathered per node but a minimum.
    """
    maps: list[DataFrame] = []
    left = edges.select("a", "b").where("a <> b")
    n = 2 * left.count()
    while n:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Also the roots themselves are kept, so that every node has an entry.
        hooks = settle(both.groupBy("a").agg(F.min("b").alias("b"))
                       .select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "hooks", n)
        while True:
            # Two hops a time; where the second still moves, chains may be longer.
            onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("onward"))
            further = hooks.select(F.col("node").alias("onward"), F.col("root").alias("further"))
            hopped = settle(hooks.join(onward, "root").join(further, "onward").select(
                "node", F.col("further").alias("root"), (F.col("further") < F.col("onward")).alias("moved")), "hopped", n)
            hooks = hopped.select("node", "root")
            if hopped.where("moved").isEmpty():
                break
        maps.append(hooks)
        to_a = hooks.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        to_b = hooks.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        left = settle(left.join(to_a, "a").join(to_b, "b").where("root_a <> root_b").select(
            F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "left", n)
        n = 2 * left.count()
    if not maps:
        return edges.where("false").select(F.col("a").alias("node"), F.col("a").alias("component"))

    def onto(known: DataFrame, step: DataFrame) -> DataFrame:
        step = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        return known.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))

    return reduce(onto, maps).select("node", F.col("root").alias("component"))
