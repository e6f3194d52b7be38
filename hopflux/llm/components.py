"""Connected components of an edge table by repeated contraction; every round is a few joins and grouped minima."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflux.llm.work import save


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` long pairs to ``(node, component)``, the component being its smallest node.

    Each round every node points to its smallest neighbour (or itself), pointers are followed once more, and the
    edges between the nodes pointed at are what the next round works on.  Nodes that merge leave the edge table, so
    rounds are logarithmic.  Nothing is gathered: a hub is a key of a grouped minimum, combined before the shuffle.
    Self-links and null ends are ignored; an empty table gives an empty result.
    """
    edge = edges.select("a", "b").where("a <> b")
    left = save(edge.union(edge.select("b", "a")).distinct(), "cc-edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        to = save(left.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "cc-min")
        far = save(to.join(to.select(F.col("a").alias("p"), F.col("p").alias("pp")), "p").select("a", F.col("pp").alias("p")), "cc-jump")
        maps.append(far)
        left = save(
            left.join(far, "a").select(F.col("p").alias("x"), F.col("b").alias("a")).join(far, "a").select(F.col("x").alias("a"), F.col("p").alias("b")).where("a <> b").distinct(),
            "cc-edges",
        )
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def follow(done: DataFrame, step: DataFrame) -> DataFrame:
        step = step.select(F.col("a").alias("component"), F.col("p").alias("then"))
        return done.join(step, "component", "left").select("node", F.coalesce("then", "component").alias("component"))

    return reduce(follow, maps[1:], maps[0].select(F.col("a").alias("node"), F.col("p").alias("component")))
