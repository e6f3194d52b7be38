"""Landmarks: vertices whose distances to all others are kept with a layout, so that searches for targets know where these lie.

From a landmark's distances to a vertex and to a target follows what is left from the vertex to the target, at least.  Landmarks are chosen one after the
other, each as far as possible from those before, and each costs one query.  Blocks get the distances of all vertices that they number: of their
own ones, and of vertices of other blocks what their own edges lead to, which is no less than the distance and so does no harm.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflux.operators.blocks import MARKS, PARTS, Block, Layout, kept
from hopflux.operators.shortest_path import LABEL, labels_of, shortest_paths
from hopflux.plans.work import current, save, scope, within


def recalled(chosen: list[int]):
    """A block with the distances that it remembers from each landmark."""

    def run(row: pa.Table, memory: pa.Table) -> pa.Table:
        if not row.num_rows:
            return row.append_column(MARKS, pa.array([], pa.binary()))
        b = Block(row, row.column("block")[0].as_py())
        marks = np.full((len(chosen), b.size), np.inf)
        for source, body in zip(memory.column("source").to_pylist(), memory.column("body")):
            got = np.frombuffer(body.as_py(), LABEL)
            mark = marks[chosen.index(source)]
            mark[got["i"]] = got["d"]
            edge, tail = b.leaving(np.flatnonzero(mark[: b.own] < np.inf))
            far = b.head[edge] >= b.own
            np.minimum.at(mark, b.head[edge[far]], mark[tail[far]] + b.weight[edge[far]])
        return row.append_column(MARKS, pa.array([marks.tobytes()], pa.binary()))

    return run


def with_landmarks(layout: Layout, count: int, landmarks: int = 4) -> Layout:
    """The layout with distances from up to ``landmarks`` landmarks; ``count`` is the number of the graph's vertices.

    Weights must not be negative.  A graph without edges is given back as it is.
    """
    if MARKS in layout.table.columns:
        return layout
    start = layout.vertices.agg(F.min("v")).first()[0]
    if start is None:
        return layout
    outer = current()
    with scope() as own:
        try:
            chosen: list[int] = []
            memories: list[DataFrame] = []
            heard = labels_of(shortest_paths(layout, [start], count, raw=True))
            for _ in range(landmarks):
                least = heard.groupBy("v").agg(F.min("d").alias("d"))
                far = least.agg(F.max_by("v", F.struct("d", "v")), F.max("d")).first()
                if chosen and not far[1]:  # no other vertex is reached: one that is not reached yet
                    far = layout.vertices.join(least, "v", "left_anti").agg(F.max("v")).first()
                if far[0] is None:
                    break
                chosen.append(far[0])
                memories.append(shortest_paths(layout, [far[0]], count, raw=True))
                heard = labels_of(memories[-1]) if len(memories) == 1 else heard.union(labels_of(memories[-1]))
            memory = memories[0]
            for more in memories[1:]:
                memory = memory.union(more)
            with within(outer):  # stays, for blocks that are lost with their executor
                memory = save(memory, "marks")
        finally:
            own.free()
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in layout.table.schema) + f", {MARKS} binary"
    made = layout.table.groupBy("block").cogroup(memory.groupBy("block")).applyInArrow(recalled(chosen), kind)
    table = kept(made.repartition(min(layout.blocks, PARTS), "block"), layout.blocks)
    table.count()
    layout.close()
    return replace(layout, table=table)
