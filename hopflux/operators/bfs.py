"""Breadth-first trees in queue order, level by level over blocks of vertices (:mod:`hopflux.operators.rounds`).

A vertex's parent is the neighbour that a queue would take out first: the one that ranks lowest in its level.  Of the vertices
found in a level, those whose parent ranks lower come first, and under one parent those with smaller ids.  So a vertex's rank in its
level is told by its key: its parent's key and its own id.  Keys grow by an id per level; after ``STEPS`` levels those of the parents
at hand are replaced by their ranks.

A block keeps a bitmap of the vertices that it has found, or has told another block of.  Only the vertices of a level travel, with their
parents' keys, and each is written once, when it is found: a level costs the same however many vertices have been seen.  While all of a
level lies in one block that leads nowhere else, the block goes on by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopflux.operators.blocks import Block, Layout
from hopflux.operators.edges import numbered
from hopflux.operators.rounds import FACT, MEMORY, MESSAGE, RESULT, ROWS, Rounds, table
from hopflux.plans.work import save, scope

#: More keys than this are ranked by ranges instead of in one sorted pass.
ONE_PASS = 1_000_000
#: Ids that a key may hold besides the rank that it begins with.
STEPS = 8
_WIDTH = STEPS + 1
_OFFER = np.dtype([("v", "<i8"), ("pred", "<i8"), ("key", "<i8", (_WIDTH,))])
_FOUND = np.dtype([("v", "<i8"), ("pred", "<i8"), ("level", "<i8"), ("key", "<i8", (_WIDTH,))])
_KEYS = [f"k{i}" for i in range(_WIDTH)]
_TREE = "v long, level int, " + ", ".join(f"{k} long" for k in _KEYS) + ", pred long"


def _least(v: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each vertex the place of its offer with the least key, by vertex."""
    order = np.lexsort((*keys.T[::-1], v))
    v = v[order]
    return order[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else order


def _level(level: int, used: int, alone: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's part of a level: take in what is offered, and offer what it leads to."""

    def run(row: pa.Table, inbox: pa.Table) -> pa.Table:
        if not inbox.num_rows:
            return table([])
        kinds, bodies = inbox.column("kind").to_numpy(), inbox.column("body")
        key = int(inbox.column("block")[0].as_py())
        b, now, filled, out = Block(row, key), level, used, []
        seen = np.zeros(b.size, bool)
        for i in np.flatnonzero(kinds == MEMORY):
            seen = np.unpackbits(np.frombuffer(bodies[int(i)].as_py(), np.uint8), count=b.size).astype(bool)
        offers = np.concatenate([np.frombuffer(bodies[int(i)].as_py(), _OFFER) for i in np.flatnonzero(kinds == MESSAGE)] or [np.empty(0, _OFFER)])
        at, pred, keys = b.local(offers["v"]), offers["pred"], offers["key"]
        while True:
            fresh = ~seen[at]
            at, pred, keys = at[fresh], pred[fresh], keys[fresh]
            first = _least(at, keys)
            at, pred, keys = at[first], pred[first], keys[first].copy()
            if not len(at):
                break
            seen[at] = True
            found = np.empty(len(at), _FOUND)
            found["v"], found["pred"], found["level"], found["key"] = b.names[at], pred, now, keys
            out.append((RESULT, key, 0, 0, 0.0, found.tobytes()))
            keys[:, filled + 1] = b.names[at]
            filled += 1
            if alone:  # all of the level is here, so its order is its ranks
                order = np.lexsort(keys.T[::-1])
                keys = np.zeros_like(keys)
                keys[order, 0] = np.arange(len(order))
                filled = 0
            edge, tail = b.leaving(at)
            spot = np.empty(b.size, np.int64)
            spot[at] = np.arange(len(at))
            head, parent = b.head[edge].astype(np.int64), spot[tail]
            fresh = ~seen[head]
            head, parent = head[fresh], parent[fresh]
            first = _least(head, keys[parent])
            head, parent = head[first], parent[first]
            far = head >= b.own
            now += 1
            if not alone or far.any() or not len(head):
                seen[head[far]] = True
                parents = np.empty(b.size, np.int64)
                parents[head] = parent
                for to, mine in b.by_home(head):
                    made, of = np.empty(len(mine), _OFFER), parents[mine]
                    made["v"], made["pred"], made["key"] = b.ids[mine], b.names[at[of]], keys[of]
                    out.append((MESSAGE, to, 0, 0, 0.0, made.tobytes()))
                break
            at, pred, keys = head, b.names[at[parent]], keys[parent]
        out += [(FACT, key, 0, now, float(filled), b""), (MEMORY, key, 0, 0, 0.0, np.packbits(seen).tobytes())]
        return table(out)

    return run


def _unpacked(bodies: DataFrame, kind: np.dtype, columns: list[str], schema: str) -> DataFrame:
    """Rows of arrays of ``kind`` in (block, body), its key spread over columns."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, body in zip(b.column("block").to_pylist(), b.column("body")):
                got = np.frombuffer(body.as_py(), kind)
                given = {"block": np.full(len(got), block, np.int32)} | {f"k{i}": got["key"][:, i] for i in range(_WIDTH)}
                made = [pa.array(np.ascontiguousarray(given[c] if c in given else got[c])) for c in columns]
                yield pa.RecordBatch.from_arrays([m.cast(pa.int32()) if c == "level" else m for m, c in zip(made, columns)], columns)

    return bodies.select("block", "body").mapInArrow(explode, schema)


def _ranked(keys: DataFrame) -> DataFrame:
    if keys.count() > ONE_PASS:
        return numbered(keys, _KEYS, "rank")
    return keys.withColumn("rank", (F.row_number().over(Window.orderBy(*_KEYS)) - 1).cast("long"))


def _rerank(rounds: Rounds) -> None:
    """Put ranks in place of the keys of the messages under way."""
    columns = ["block", "v", "pred", *_KEYS]
    sent = save(_unpacked(rounds.now.where(F.col("kind") == MESSAGE), _OFFER, columns, "block int, v long, pred long, " + ", ".join(f"{k} long" for k in _KEYS)), "offers")
    ranks = save(_ranked(save(sent.select(*_KEYS).distinct(), "keys")), "ranks")

    def pack(rows: pa.Table) -> pa.Table:
        made = np.zeros(rows.num_rows, _OFFER)
        made["v"], made["pred"], made["key"][:, 0] = (rows.column(c).to_numpy() for c in ("v", "pred", "rank"))
        return table([(MESSAGE, int(rows.column("block")[0].as_py()), 0, 0, 0.0, made.tobytes())])

    rounds.redirect(sent.join(ranks, _KEYS).select("block", "v", "pred", "rank").groupBy("block").applyInArrow(pack, ROWS))


def bfs_tree(layout: Layout, start: int) -> DataFrame:
    """v, level, k0, k1, ... (in whose order a level's vertices are found), pred for every vertex that ``start`` reaches; the start's pred is null.

    ``layout`` is that of distinct edges, without a split of vertices with many edges.
    """
    spark, places = layout.table.sparkSession, layout.places([start])
    root = spark.createDataFrame([(start, 0, *[0] * _WIDTH, None)], _TREE)
    if start not in places:
        return root
    offer = np.zeros(1, _OFFER)
    offer["v"] = places[start]
    home = int(layout.ranges.of(np.array([places[start]]))[0])
    level = used = 0
    try:
        with scope() as own:
            rounds = Rounds(layout, [(MESSAGE, home, 0, 0, 0.0, offer.tobytes())])
            while rounds.active:
                rounds.step(_level(level, used, len(rounds.active) == 1))
                level, used = max(f["v"] for f in rounds.facts), int(max(f["d"] for f in rounds.facts))
                if used == STEPS and rounds.active:
                    _rerank(rounds)
                    used = 0
                rounds.put_together()
            found = _unpacked(rounds.results(), _FOUND, ["v", "level", *_KEYS, "pred"], _TREE)
        return save(found.where("level > 0").union(root), "tree")
    finally:
        own.free()


def bfs_reorder(layout: Layout, start: int, count: int) -> DataFrame:
    """vertex_idx, new_idx: vertices in the order a queue takes them out, then the unreached ones by id."""
    tree = bfs_tree(layout, start)
    every = tree.sparkSession.range(count).withColumnRenamed("id", "v").join(tree, "v", "left")
    order = every.select(F.col("v").alias("vertex_idx"), F.coalesce("level", F.lit(2**31 - 1)).alias("level"), *(F.coalesce(k, F.lit(0)).alias(k) for k in _KEYS))
    return numbered(order, ["level", *_KEYS, "vertex_idx"], "new_idx").select("vertex_idx", "new_idx")
