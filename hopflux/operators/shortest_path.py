"""Shortest paths as a fixpoint over blocks of vertices (:mod:`hopflux.operators.rounds`).

In a round a block relaxes its own edges from the candidates that it has got until nothing inside it changes, nearest vertices first, and
sends to each other block the best of the candidates for its vertices that this round has brought.  So a round takes every path as
far as it stays in its block, and only candidates for other blocks are shuffled.

A label is (distance, hops, predecessor) and smaller labels win in that order, so equal distances are decided alike
however the rounds run, and predecessors never form a cycle, even through edges of weight 0.  Many sources go in one fixpoint.

A block whose edges mostly lead to other blocks sends on much of what it follows, and what is far is seldom final yet.  So a round
follows, nearest first, labels with up to an eighth of the block's edges as edges that leave it, and the block goes on with the rest in the next round,
with what it has been told by then.  Blocks with few edges that leave them follow everything at once.

With a window, blocks do not follow labels beyond a bound that rises by the window whenever no block has anything left below it.

A label's key says how far away what it leads to is at least: its distance, and where the layout knows landmarks
(:mod:`hopflux.operators.landmarks`) and targets are asked for, also what is certainly left to the nearest target.  Order, bounds and windows go by keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflux.operators.blocks import MARKS, Block, Layout
from hopflux.operators.rounds import ALARM, FACT, MEMORY, MESSAGE, Rounds, table
from hopflux.plans.work import save, scope

#: What a block remembers of a vertex that it has a label of; ``open``: changed and not followed yet.  Of other blocks' vertices only those
#: that wait for a higher bound or have edges here are remembered: on graphs without local ids nearly every edge leads to one, and they
#: are sent on only when a label of the block's own has changed.
LABEL = np.dtype([("i", "<i4"), ("own", "?"), ("open", "?"), ("name", "<i8"), ("d", "<f8"), ("hops", "<i4"), ("pred", "<i8")])
_CANDIDATE = np.dtype([("v", "<i8"), ("d", "<f8"), ("hops", "<i4"), ("pred", "<i8")])
#: A candidate where nobody asks for links.
_BARE = np.dtype([("v", "<i8"), ("d", "<f8")])
#: Edges to other blocks that a round follows for a source: this share of the block's edges, and no fewer than ``FEW``.
SHARE, FEW = 8, 1 << 14


#: How a block's part of a round ends.
DONE, MORE, CIRCLE = range(3)
#: Facts that are no target's place: something waits for a higher bound, or the block goes on in the next round.
WAITS, ON = -1, -2


class NegativeCycle(ValueError):
    """A cycle of negative total weight can be reached."""


class _Labels:
    """Labels of one source in one block."""

    def __init__(self, block: Block, track: bool, left: np.ndarray):
        n = block.size
        self.block, self.track, self.left = block, track, left
        self.d, self.hops, self.pred = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.known, self.open = np.zeros(n, bool), np.zeros(n, bool)

    def recall(self, body: bytes) -> None:
        old = np.frombuffer(body, LABEL)
        i = old["i"]
        self.d[i], self.hops[i], self.pred[i], self.open[i], self.known[i] = old["d"], old["hops"], old["pred"], old["open"], True

    def remember(self) -> bytes:
        keep = self.open | (np.diff(self.block.first) > 0)
        keep[: self.block.own] = True
        i = np.flatnonzero(self.known & keep)
        made = np.empty(len(i), LABEL)
        made["i"], made["own"], made["open"], made["name"] = i, i < self.block.own, self.open[i], self.block.names[i]
        made["d"], made["hops"], made["pred"] = self.d[i], self.hops[i], self.pred[i]
        return made.tobytes()

    def key(self, some: np.ndarray) -> np.ndarray:
        return self.d[some] + self.left[some]

    def take(self, v: np.ndarray, d: np.ndarray, hops: np.ndarray, pred: np.ndarray) -> np.ndarray:
        """Keep what is better than the labels so far, (d, hops, pred) in this order or d alone; which vertices changed."""
        better = d < self.d[v]
        if self.track:
            same = d == self.d[v]
            better |= same & ((hops < self.hops[v]) | (hops == self.hops[v]) & (pred < self.pred[v]))
        v, d, hops, pred = v[better], d[better], hops[better], pred[better]
        if len(v) > 1:
            order = np.lexsort((pred, hops, d, v)) if self.track else np.lexsort((d, v))
            v = v[order]
            first = np.empty(len(v), bool)
            first[0], first[1:] = True, v[1:] != v[:-1]
            order, v = order[first], v[first]
            d, hops, pred = d[order], hops[order], pred[order]
        self.d[v], self.hops[v], self.pred[v], self.known[v], self.open[v] = d, hops, pred, True, True
        return v

    def offers(self, some: np.ndarray) -> tuple[np.ndarray, ...]:
        """What some vertices' edges give: heads, distances, hops, predecessors."""
        edge, tail = self.block.leaving(some)
        return self.block.head[edge], self.d[tail] + self.block.weight[edge], self.hops[tail] + 1, self.block.names[tail]

    def turns(self, source: int) -> bool:
        """Whether predecessors run in a circle inside the block."""
        n = self.block.size
        order = np.argsort(self.block.names[: self.block.own], kind="stable")
        names = self.block.names[order]
        if not len(names):
            return False
        at = np.minimum(np.searchsorted(names, self.pred), len(names) - 1)
        root = (self.pred == self.block.names) & (self.block.names == source) & (self.d == 0)
        inside = self.known & (names[at] == self.pred) & ~root & (np.arange(n) < self.block.own)
        jump = np.append(np.where(inside, order[at], n), n)
        for _ in range(n.bit_length() + 1):
            jump = jump[jump]
        return bool((jump != n).any())


def relax(ranges, count: int, track: bool, negative: bool, detect: bool, bound: float, wanted: list[int], reach: np.ndarray | None = None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's part of a round.

    Labels with keys beyond ``bound`` are kept but not followed, nor those beyond the furthest of the places ``wanted`` once the block has labels of
    them all.  ``reach`` has each landmark's distance to the nearest target.
    """
    share, few = SHARE, FEW

    def crossings(b: Block) -> tuple[np.ndarray | None, float]:
        """How many of each vertex's edges leave the block, and how many a round follows."""
        most = max(few, len(b.head) // share)
        out = np.concatenate([[0], np.cumsum(b.head >= b.own)])
        if negative or out[-1] <= most:
            return None, math.inf
        return out[b.first[1:]] - out[b.first[:-1]], most

    def followed(labels: _Labels, b: Block, front: np.ndarray, changed: np.ndarray, goal, source: int, leave: np.ndarray | None, many: float) -> int:
        """Relax until nothing changes (``DONE``), or until ``many`` edges that leave the block have been followed (``MORE``), or a negative
        cycle turns up (``CIRCLE``)."""
        most, steps, look = bound, 0, 32
        # the nearest first, in steps of a mean weight: what is near is final before what is far is looked at
        step = math.inf if negative or not len(b.weight) else max(float(np.nanmean(b.weight)), 0.0) or math.inf
        limit, later = -math.inf if step < math.inf else math.inf, [front]
        if negative and (labels.hops[front[front < b.own]] >= count).any():
            return CIRCLE
        front, crossed = front[:0], 0
        while True:
            if crossed >= many and len(front):
                later.append(front)
                front = front[:0]
            if not len(front):
                rest = np.unique(np.concatenate(later))
                rest = rest[labels.open[rest]]
                if goal is not None:
                    most = min(most, labels.d[goal].max())
                key = labels.key(rest)
                near = (key <= most) & (key < math.inf)
                rest, key = rest[near], key[near]
                if not len(rest):
                    return DONE
                if crossed >= many:
                    return MORE
                limit, later = max(limit, float(key.min()) + step), []
                if leave is not None:
                    order = np.argsort(key, kind="stable")
                    at = int(np.searchsorted(np.cumsum(leave[rest[order]]), many - crossed))
                    limit = min(limit, float(key[order[at]])) if at < len(order) else limit
                near = key <= limit
                front, later = rest[near], [rest[~near]]
            labels.open[front] = False
            crossed += int(leave[front].sum()) if leave is not None else 0
            v, d, hops, pred = labels.offers(front)
            if negative and not detect:
                keep = hops < count
                v, d, hops, pred = v[keep], d[keep], hops[keep], pred[keep]
            front = labels.take(v, d, hops, pred)
            changed[front] = True
            steps += 1
            if negative and (labels.hops[front[front < b.own]] >= count).any():
                return CIRCLE
            if negative and detect and steps == look:
                look *= 2
                if labels.turns(source):
                    return CIRCLE
            if limit < math.inf:
                near = labels.key(front) <= limit
                later.append(front[~near])
                front = front[near]

    def run(row: pa.Table, inbox: pa.Table) -> pa.Table:
        kinds, sources = inbox.column("kind").to_numpy(), inbox.column("source").to_numpy()
        if not len(kinds):
            return table([])
        key = int(inbox.column("block")[0].as_py())
        b, bodies, out = Block(row, key), inbox.column("body"), []
        copies = np.flatnonzero(np.isin(b.ids[b.own :], list(ranges.spread))) + b.own if ranges.spread else np.empty(0, np.int64)
        copies = copies[np.diff(b.first)[copies] > 0] if len(copies) else copies
        goal = b.local(np.array(wanted, np.int64)) if wanted else None
        goals = goal[(goal >= 0) & (goal < b.own)] if wanted else np.empty(0, np.int64)
        goal = goal if wanted and len(goals) == len(goal) else None
        left = np.zeros(b.size) if reach is None else remaining(b, reach, count)
        leave, many = crossings(b)
        for s in np.unique(sources).tolist():
            labels = _Labels(b, track, left)
            for i in np.flatnonzero((sources == s) & (kinds == MEMORY)):
                labels.recall(bodies[int(i)].as_py())
            sent = _CANDIDATE if track else _BARE
            new = [np.frombuffer(bodies[int(i)].as_py(), sent) for i in np.flatnonzero((sources == s) & (kinds == MESSAGE))]
            new = np.concatenate(new) if new else np.empty(0, sent)
            hops, pred = (new["hops"].astype(np.int64), new["pred"]) if track else (np.zeros(len(new), np.int64),) * 2
            at = b.local(new["v"])
            keep = (at >= 0) & ((hops < count) if negative and not detect else True)
            got = labels.take(at[keep], new["d"][keep], hops[keep], pred[keep])
            changed = np.zeros(b.size, bool)
            changed[got] = True
            labels.open &= left < math.inf  # others lead to no target
            waiting = np.flatnonzero(labels.open)
            changed[waiting[waiting >= b.own]] = True  # candidates that were beyond the bound
            end = followed(labels, b, waiting, changed, goal, s, leave, many)
            if end == CIRCLE:
                out.append((ALARM, key, s, 0, 0.0, b""))
                continue
            if end == MORE:
                out.append((FACT, key, s, ON, 0.0, b""))
            some = np.flatnonzero(changed)
            out += [(FACT, key, s, int(b.ids[g]), float(labels.d[g]), b"") for g in goals if labels.known[g]]
            far = some[some >= b.own]
            far = far[~np.isin(far, copies) & (left[far] < math.inf)]
            still = copies[labels.open[copies]]
            labels.open[b.own :] = False
            labels.open[far[labels.key(far) > bound]] = True
            labels.open[still] = True
            far = far[labels.key(far) <= bound]
            labels.open &= left < math.inf
            if labels.open.any():  # what waits for a higher bound
                out.append((FACT, key, s, WAITS, float(labels.key(labels.open).min()), b""))
            out += [(MESSAGE, to, s, 0, 0.0, _candidates(labels, b.ids, part)) for to, part in b.by_home(far)]
            for hub in some[some < b.own][np.isin(b.ids[some[some < b.own]], list(ranges.spread))] if ranges.spread else ():
                body = _candidates(labels, b.ids, np.array([hub]))
                out += [(MESSAGE, to, s, 0, 0.0, body) for to in ranges.spread[int(b.ids[hub])]]
            out.append((MEMORY, key, s, int((some < b.own).sum()), 0.0, labels.remember()))
        return table(out)

    return run


def remaining(b: Block, reach: np.ndarray, count: int) -> np.ndarray:
    """How far it is from each of a block's vertices to the nearest target, at least; infinite where no target can be reached.

    A landmark reaches a target no later by way of a vertex: left >= reach - distance of the vertex from the landmark.  What rounding may have added to
    either, over a path of fewer than ``count`` edges, is taken off.
    """
    marks = b.marks.reshape(len(reach), b.size)
    left = np.zeros(b.size)
    for to, mark in zip(reach, marks, strict=True):
        if to == math.inf:
            left[mark < math.inf] = math.inf
        else:
            known = mark < math.inf
            left[known] = np.maximum(left[known], to - mark[known] - np.finfo(float).eps * count * (to + mark[known]))
    return left


def _candidates(labels: _Labels, ids: np.ndarray, some: np.ndarray) -> bytes:
    made = np.empty(len(some), _CANDIDATE if labels.track else _BARE)
    made["v"], made["d"] = ids[some], labels.d[some]
    if labels.track:
        made["hops"], made["pred"] = labels.hops[some], labels.pred[some]
    return made.tobytes()


_RESULT = "source long, v long, d double, hops long, pred long"


def labels_of(memory: DataFrame) -> DataFrame:
    """Labels of vertices in their own blocks."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, body in zip(b.column("source").to_pylist(), b.column("body")):
                got = np.frombuffer(body.as_py(), LABEL)
                got = got[got["own"]]
                columns = [np.full(len(got), source), got["name"], got["d"], got["hops"].astype(np.int64), got["pred"]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["source", "v", "d", "hops", "pred"])

    return memory.select("source", "body").mapInArrow(explode, _RESULT)


def marks_of(layout: Layout, places: list[int]) -> dict[int, np.ndarray]:
    """Distances of some places, few enough to be named, from each landmark."""
    wanted = np.array(sorted(set(places)), np.int64)
    homes = layout.ranges.of(wanted)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(pa.Table.from_batches([batch.slice(i, 1)]), batch.column("block")[i].as_py())
                own = wanted[homes == b.key]
                at = b.local(own)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(b.marks.reshape(-1, b.size)[:, at].T), pa.list_(pa.float64()))], ["place", "marks"])

    found = layout.table.where(F.col("block").isin(np.unique(homes).tolist())).select("block", "ids", "home", MARKS).mapInArrow(look, "place long, marks array<double>")
    return {r["place"]: np.array(r["marks"]) for r in found.collect()}


def in_cycle(labels: DataFrame, count: int, rounds: int) -> bool:
    """Whether predecessors run in a cycle, by doubling pointers: then some vertex never gets to its root.

    After ``rounds`` rounds most chains are no longer than that, so a look at whether all have ended comes first there.
    """
    jump = save(labels.select("source", "v", "pred"), "jump")

    def twice(jump: DataFrame) -> DataFrame:
        return jump.join(jump.select("source", F.col("v").alias("pred"), F.col("pred").alias("far")), ["source", "pred"]).select("source", "v", F.col("far").alias("pred"))

    soon, most = math.ceil(math.log2(rounds + 1)), math.ceil(math.log2(count + 1))
    for power in range(2, most + 3, 2):
        jump = save(twice(twice(jump)), "jump")
        if power >= min(soon, most) and jump.where("pred <> source").isEmpty():
            return False
    return True


def shortest_paths(layout: Layout, sources: Iterable[int], count: int, track: bool = False, targets: Iterable[int] | None = None, negative: bool = False, detect: bool = True, window: float | None = None, report: dict | None = None, raw: bool = False) -> DataFrame:
    """Labels (source, v, d, hops, pred) of all vertices that the sources reach.

    ``layout`` is that of merged edges (:func:`hopflux.operators.blocks.lay_out`) and ``count`` the number of vertices.  With
    ``targets`` and weights that are not negative, labels beyond the furthest target are not followed.  ``negative`` says
    that weights may be negative: with ``detect`` a reachable negative cycle raises :class:`NegativeCycle`, without it
    no path of ``count`` edges or more is followed.  ``report`` gets the number of rounds and of labels that they wrote.
    ``raw`` gives what the blocks remember instead (block, source, body), for :func:`hopflux.operators.landmarks.recalled`.
    """
    spark, track = layout.table.sparkSession, track or negative
    distinct = sorted(set(sources))
    asked = sorted(set(targets)) if targets is not None and not negative else []
    places = layout.places([*distinct, *asked])
    starts = [(s, places[s]) for s in distinct if s in places]
    # a target without edges is reached by none but itself
    wanted = sorted(places[v] for v in asked) if asked and all(v in places for v in asked) else []
    alone = [(s, s, 0.0, 0, s) for s in distinct if s not in places]
    apart = spark.createDataFrame(alone, _RESULT)
    if not starts:
        return apart
    homes = layout.ranges.of(np.array([p for _, p in starts], np.int64)).tolist()
    first = [(MESSAGE, int(h), int(s), 0, 0.0, (np.array([(p, 0.0, 0, s)], _CANDIDATE) if track else np.array([(p, 0.0)], _BARE)).tobytes()) for (s, p), h in zip(starts, homes)]
    window = None if negative else window
    found: dict[tuple[int, int], float] = {}
    waiting: dict[tuple[int, int], float] = {}
    reach, rise, edge = None, 1.0, window or math.inf
    if wanted and MARKS in layout.table.columns:
        marks = marks_of(layout, [*wanted, *(p for _, p in starts)])
        reach = np.min([marks[p] for p in wanted], axis=0)
        if not window:
            # first what lies hardly beyond the least that the way can take, then twice as much more each time
            with np.errstate(invalid="ignore"):
                least = max((float(np.nanmax([0.0, *np.where(marks[p] < math.inf, reach - marks[p], 0.0)])) for _, p in starts), default=0.0)
            window, rise = (least / 16, 2.0) if 0 < least < math.inf else (None, 1.0)
            edge = least + window if window else math.inf
    look = 8
    try:
        with scope() as own:
            rounds = Rounds(layout, first)
            while rounds.active:
                bound = max(found.values()) if wanted and len(found) == len(wanted) * len(starts) else math.inf
                worked = set(rounds.active)
                rounds.step(relax(layout.ranges, count, track, negative, detect, min(bound, edge), wanted, reach))
                if rounds.alarms:
                    raise NegativeCycle("Negative cycle detected in the graph")
                waiting = {k: d for k, d in waiting.items() if k[0] not in worked}
                on = {f["block"] for f in rounds.facts if f["v"] == ON}
                rounds.active = sorted(on.union(rounds.active))
                for f in rounds.facts:
                    if f["v"] == WAITS:
                        waiting[f["block"], f["source"]] = f["d"]
                    elif f["v"] != ON:
                        found[f["source"], f["v"]] = f["d"]
                if window and not rounds.active:
                    bound = max(found.values()) if wanted and len(found) == len(wanted) * len(starts) else math.inf
                    left = {k: d for k, d in waiting.items() if d <= bound}
                    if left:
                        edge, window = max(edge, min(left.values())) + window, window * rise
                        rounds.active = sorted({k[0] for k, d in left.items() if d <= edge})
                if negative and detect and rounds.number >= look and rounds.active:
                    look *= 2
                    if in_cycle(labels_of(rounds.memory()), count, rounds.number):
                        raise NegativeCycle("Negative cycle detected in the graph")
                rounds.put_together()
        if report is not None:
            report |= {"rounds": rounds.number, "written": rounds.written}
        if raw:
            return save(rounds.dealt().select("block", "source", "body"), "memory")
        return save(labels_of(rounds.memory()).union(apart), "labels")
    finally:
        own.free()
