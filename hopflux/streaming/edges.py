from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lightest_edges(stream: DataFrame) -> DataFrame:
    """The lightest edge per (tail, head) of a stream of (tail, head, weight); write it in update or complete mode.

    State is one row per pair of vertices, however many parallel edges arrive.
    """
    return stream.dropna(subset=["tail", "head"]).groupBy("tail", "head").agg(F.min("weight").alias("weight"))


def snapshot(updates: DataFrame) -> DataFrame:
    """The edge table that a log of updates stands for: weights only fall, so the least one of a pair is the latest."""
    return updates.groupBy("tail", "head").agg(F.min("weight").alias("weight"))
