"""An order of the vertices that keeps neighbours together, for graphs whose ids say nothing about where a vertex lies.

The graph is coarsened in steps.  In a step a coin, a hash of the vertex, makes some vertices centres; each other one joins the centre
that it has most edges with (ties by a hash), if there is any.  What has joined becomes one vertex of the next graph, with the edges of all its
members added up.  Each step is a grouping by vertex and joins of what is left, which shrinks by a factor, so all of
them together cost a few times the first.  Once at most ``SMALL`` edges are left, a bound that does not grow with the graph,
the driver orders what is left by breadth-first search from a far end, part by part.  Then the steps are undone: members take the
places of the vertex that they became, one after another, which is a running total of their sizes.

Ranges of that order are the blocks that :mod:`hopflux.operators.blocks` lays out: all of about the same number of edge ends.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflux.operators.edges import running_total
from hopflux.plans.work import current, save, scope, within

#: Edges of the coarse graph that goes to the driver, at most.
SMALL = 100_000
#: One vertex in so many is a centre.
CENTRES = 4


def _coarse_order(tails: np.ndarray, heads: np.ndarray, vertices: np.ndarray) -> np.ndarray:
    """The vertices by breadth-first search, each part from a vertex far from where a first search began."""
    n = len(vertices)
    t, h = np.searchsorted(vertices, tails), np.searchsorted(vertices, heads)
    t, h = np.concatenate([t, h]), np.concatenate([h, t])
    by = np.argsort(t, kind="stable")
    head, first = h[by], np.concatenate([[0], np.cumsum(np.bincount(t, minlength=n))])

    def search(start: int, seen: np.ndarray) -> list[np.ndarray]:
        front, levels = np.array([start]), []
        seen[front] = True
        while len(front):
            levels.append(front)
            ends = [head[first[v] : first[v + 1]] for v in front.tolist()]
            front = np.concatenate(ends)
            front = front[~seen[front]]
            front = front[np.sort(np.unique(front, return_index=True)[1])]  # as a queue would have them: what is cut is one piece
            seen[front] = True
        return levels

    placed, order = np.zeros(n, bool), []
    for v in range(n):
        if not placed[v]:
            far = int(search(v, placed.copy())[-1][0]) if first[v + 1] > first[v] else v
            order += search(far, placed)
    return np.concatenate(order) if order else np.empty(0, np.int64)


def local_order(edges: DataFrame) -> DataFrame:
    """v, place (from 0 on) of every vertex of ``edges`` (tail, head); directions do not matter."""
    spark, outer = edges.sparkSession, current()
    with scope() as own:
        both = edges.where("tail <> head").select(F.least("tail", "head").alias("a"), F.greatest("tail", "head").alias("b"))
        links = save(both.groupBy("a", "b").agg(F.count("*").alias("w")), "links")
        vertices = edges.select(F.explode(F.array("tail", "head")).alias("v")).distinct().withColumn("size", F.lit(1).cast("long"))
        levels, vertices, step = [], save(vertices, "members"), 0
        many = links.count()
        while many > SMALL:
            step += 1
            centre = lambda c: F.pmod(F.xxhash64(F.lit(step), c), F.lit(CENTRES)) == 0  # noqa: B023, E731
            ways = links.select("a", "b", "w").union(links.select(F.col("b"), F.col("a"), "w"))
            choice = ways.where(~centre(F.col("a")) & centre(F.col("b"))).groupBy("a").agg(F.max(F.struct("w", F.xxhash64("a", "b").alias("draw"), F.col("b").alias("to")))["to"].alias("to"))
            joined = save(choice.select(F.col("a").alias("v"), "to"), "joined")
            became = lambda df, c: df.join(joined.select(F.col("v").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
            levels.append(save(vertices.join(joined, "v", "left").select("v", F.coalesce("to", "v").alias("into"), "size"), "level"))
            merged = became(became(links, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
            links = save(merged.groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
            vertices = save(levels[-1].groupBy(F.col("into").alias("v")).agg(F.sum("size").alias("size")), "members")
            many = links.count()
        # vertices that the last graph has no edges of stand by themselves, behind the others
        rest = links.select("a", "b").toPandas()
        ends = np.unique(rest.to_numpy(np.int64))
        ranked = ends[_coarse_order(rest["a"].to_numpy(np.int64), rest["b"].to_numpy(np.int64), ends)]
        ranks = spark.createDataFrame(list(enumerate(ranked.tolist())), "rank long, v long")
        placed = vertices.join(F.broadcast(ranks), "v", "left").withColumn("rank", F.coalesce("rank", F.lit(1 << 62)))
        placed = running_total(placed, ["rank", "v"], "size", "place").select("v", "place")
        for level in reversed(levels):
            inside = level.join(placed.select(F.col("v").alias("into"), F.col("place").alias("at")), "into").withColumn("member", F.when(F.col("v") == F.col("into"), 0).otherwise(1))
            placed = running_total(inside, ["at", "member", "v"], "size", "place").select("v", "place")
        with within(outer):
            placed = save(placed, "order")
    own.free()
    return placed
