"""Explicit paths from a table of links (vertex_idx, associated_idx), in which roots and unreached vertices link to themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflux.plans.work import save


def paths(links: DataFrame, targets: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Rows (target, step, vertex_idx) from each target (step 0) to its root; ``targets`` has a vertex_idx column, default all.

    By doubling: with the links over 1, 2, 4, ... steps, what is known of a path's first steps gives as many more, so the rounds are the
    logarithm of the longest path.  ``limit`` bounds the steps, for link tables that may hold cycles.
    """
    jump = links.select(F.col("vertex_idx").alias("v"), F.col("associated_idx").alias("to")).where("v <> to")
    known, span = [(links if targets is None else targets).select(F.col("vertex_idx").alias("target"), F.lit(0).alias("step"), "vertex_idx")], 1
    while limit is None or span <= limit:
        rows = reduce(DataFrame.union, known)
        more = save(rows.join(jump, rows["vertex_idx"] == jump["v"]).select("target", (F.col("step") + span).alias("step"), F.col("to").alias("vertex_idx")), "paths")
        if more.isEmpty():
            break
        known.append(more)
        jump = save(jump.join(jump.select(F.col("v").alias("to"), F.col("to").alias("far")), "to").select("v", F.col("far").alias("to")), "jump")
        span *= 2
    every = reduce(DataFrame.union, known)
    return every if limit is None else every.where(F.col("step") <= limit)


def as_arrays(rows: DataFrame) -> DataFrame:
    """target, path: each path as one array, the target first."""
    return rows.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "vertex_idx"))), lambda s: s["vertex_idx"]).alias("path"))
