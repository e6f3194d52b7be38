"""Optimal strategies on transit networks: expected times, the edges worth taking, and volumes, over blocks of stops.

Times: a stop's time is a fold over its out-edges by rising ``t`` = time at the head + travel time: an edge joins as
long as it is no worse than what the stop has, and adds its frequency.  A block holds all edges that leave its stops.  In a round
(:mod:`hopflux.operators.rounds`) it folds the stops anew whose heads got faster, until nothing inside it changes, and
sends the times of those of its stops that other blocks have edges to.

A time is passed on, to the block's own edges and to others, nearest stops first.  It is final once it is no later than the least time that is still to be
passed on plus the stop's shortest line; times that are not yet final would be passed on again.  So of those a round passes on no more than are
sent in an eighth of all messages that the block can send, and the rest waits for what others have found by the next round.  Blocks that
have few readers pass on everything at once.

Volumes: demand flows down the chosen edges by their share of the frequency.  First the chosen edges that carry anything are counted at
their heads; then a stop is released once all of these have brought what they carry, so every stop passes its volume on once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflux.constants import INF, INF_FREQ, MIN_FREQ
from hopflux.operators.blocks import BLOCK_EDGES, Block, Layout, lay_out
from hopflux.operators.rounds import ALARM, FACT, MEMORY, MESSAGE, RESULT, Rounds, table
from hopflux.plans.work import current, save, scope, within

#: Relative improvement below which a time counts as unchanged, so that rounding cannot keep the loop going.
SETTLED = 1e-15
#: Relative difference up to which an option counts as good as the stop's time: what is equal may differ by rounding.
EQUAL = 1e-12
#: Times that a round passes on although they may not be final: this share of what the block can send, and no less than ``FEW``.
SHARE, FEW = 8, 1 << 14
#: Facts of a round: whether the block goes on in the next one.
DONE, ON = range(2)
_NEWS = np.dtype([("v", "<i8"), ("u", "<f8")])
_FLOW = np.dtype([("v", "<i8"), ("amount", "<f8"), ("edges", "<i8")])
#: What a block remembers of a stop while volumes flow.
_STOP = np.dtype([("f", "<f8"), ("amount", "<f8"), ("left", "<i8"), ("reached", "?"), ("done", "?")])
_CHOSEN = np.dtype([("edge_idx", "<i8"), ("tail", "<i8"), ("head", "<i8"), ("freq", "<f8"), ("f_tail", "<f8")])
_LOAD = np.dtype([("edge_idx", "<i8"), ("volume", "<f8")])


def lay_out_lines(edges: DataFrame, n_edges: int, block_edges: int = BLOCK_EDGES) -> Layout:
    """Blocks of clamped and numbered edges; all lines that leave a stop are in one."""
    return lay_out(edges, n_edges, block_edges, ["trav_time", "freq", "edge_idx"], readers=True, split=False)


def _fold(t: np.ndarray, freq: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time, frequency and number of edges used for each run of options that rise by ``t``; all runs take their next option at once."""
    n = len(sizes)
    u, f, used = np.full(n, INF), np.zeros(n), np.zeros(n, np.int64)
    going, k = np.arange(n), 0
    while len(going):
        going = going[sizes[going] > k]
        at = first[going] + k
        joins = u[going] >= t[at]
        going, at = going[joins], at[joins]
        known = np.where((u[going] < INF) | (f[going] > 0), f[going] * u[going], 1.0)
        u[going] = (known + freq[at] * t[at]) / (f[going] + freq[at])
        f[going] += freq[at]
        used[going] += 1
        k += 1
    return u, f, used


class _Stops:
    """A block with the times that it knows, of its own stops and of those that its edges lead to."""

    def __init__(self, row: pa.Table, key: int, destination: int):
        self.block = b = Block(row, key)
        self.u, self.known = np.full(b.size, np.inf), np.zeros(b.size, bool)
        #: Stops of the block whose times have not been passed on.
        self.open = np.zeros(b.size, bool)
        self.destination = destination

    def recall(self, body: bytes) -> None:
        bits = -(-self.block.size // 8)
        flags = np.unpackbits(np.frombuffer(body[: 2 * bits], np.uint8).reshape(2, bits), axis=1, count=self.block.size).astype(bool)
        self.known, self.open, self.u = flags[0].copy(), flags[1].copy(), np.frombuffer(body[2 * bits :], np.float64).copy()

    def remember(self) -> bytes:
        return np.packbits(self.known).tobytes() + np.packbits(self.open).tobytes() + self.u.tobytes()

    def learn(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Keep times that are better than those known; which stops got faster."""
        better = ~self.known[at] | (u < self.u[at] * (1 - SETTLED))
        at = at[better]
        self.u[at], self.known[at] = u[better], True
        return at

    def folded(self, tails: np.ndarray) -> tuple[np.ndarray, ...]:
        """For some stops (with an option) their edges by rising time, where each stop's begin, how many, time, frequency, number used."""
        b = self.block
        edge, tail = b.leaving(tails)
        open_ = self.known[b.head[edge]]
        edge, tail = edge[open_], tail[open_]
        t = self.u[b.head[edge]] + b.trav_time[edge]
        order = np.lexsort((b.edge_idx[edge], t, tail))
        edge, tail, t = edge[order], tail[order], t[order]
        stops, first, sizes = np.unique(tail, return_index=True, return_counts=True)
        return (stops, edge, first, sizes, *_fold(t, b.freq[edge], first, sizes))

    def leave(self) -> np.ndarray:
        """Own stops that have lines; the destination's are not taken."""
        own = np.arange(self.block.own)
        return own[(np.diff(self.block.first)[: self.block.own] > 0) & (self.block.ids[: self.block.own] != self.destination)]


def _news(b: Block, u: np.ndarray, told: np.ndarray, back: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Times for each block that has edges to the stops that are ``told``; ``back`` are the numbers of the stops with readers."""
    some = told[back]
    readers, at = b.back_block[some], back[some]
    order = np.argsort(readers, kind="stable")
    readers, at = readers[order], at[order]
    starts = np.flatnonzero(np.append(True, readers[1:] != readers[:-1])) if len(at) else np.empty(0, np.int64)
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
        to, some = readers[low], at[low:high]
        made = np.empty(len(some), _NEWS)
        made["v"], made["u"] = b.ids[some], u[some]
        yield int(to), made.tobytes()


def _times(destination: int, most: int, bound: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's part of a round, of at most ``most`` steps.  Times that other blocks have still to tell are no less than ``bound``."""
    share, few = SHARE, FEW

    def run(row: pa.Table, inbox: pa.Table) -> pa.Table:
        if not inbox.num_rows:
            return table([])
        kinds, bodies, key = inbox.column("kind").to_numpy(), inbox.column("body"), int(inbox.column("block")[0].as_py())
        stops = _Stops(row, key, destination)
        b = stops.block
        for i in np.flatnonzero(kinds == MEMORY):
            stops.recall(bodies[int(i)].as_py())
        news = np.concatenate([np.frombuffer(bodies[int(i)].as_py(), _NEWS) for i in np.flatnonzero(kinds == MESSAGE)] or [np.empty(0, _NEWS)])
        at = b.local(news["v"])
        front = stops.learn(at[at >= 0], news["u"][at >= 0])
        stops.open[front[front < b.own]] = True
        front = front[front >= b.own]
        # edges by head, to find whose options changed
        tail_of = np.repeat(np.arange(b.size), np.diff(b.first))
        by_head = np.argsort(b.head, kind="stable")
        into = np.concatenate([[0], np.cumsum(np.bincount(b.head, minlength=b.size))])
        shortest = np.zeros(b.size)
        lined = np.flatnonzero(np.diff(b.first))
        shortest[lined] = np.minimum.reduceat(b.trav_time, b.first[lined]) if len(lined) else 0.0
        shortest[b.ids == destination] = 0.0
        back = b.local(b.back_v)
        readers = np.bincount(back, minlength=b.size)
        many = max(few, len(back) // share) if len(back) > few else math.inf
        told, later, sent, passed, steps = np.zeros(b.size, bool), [np.flatnonzero(stops.open)], 0, 0, 0
        while True:
            if not len(front):
                rest = np.unique(np.concatenate(later))
                rest = rest[stops.open[rest]]
                if not len(rest):
                    break
                # final as far as this block can tell, and an eighth at least
                final = stops.u[rest] - shortest[rest]
                order = np.argsort(final, kind="stable")
                rest, final = rest[order], final[order]
                take = max(int(np.searchsorted(final, stops.u[rest].min(), side="right")), -(-len(rest) // 8))
                if many < math.inf:
                    room = int(np.searchsorted(np.cumsum(readers[rest]), many - sent)) + 1 if sent < many else 0
                    take = max(min(take, room), int(np.searchsorted(final, bound, side="right")))
                    if not take:
                        break
                front, later = rest[:take], [rest[take:]]
                stops.open[front], told[front] = False, True
                sent, passed = sent + int(readers[front].sum()), passed + len(front)
            steps += 1
            if steps > most:
                return table([(ALARM, key, 0, 0, 0.0, b"")])
            sizes = into[front + 1] - into[front]
            ends = np.cumsum(sizes)
            spots = np.arange(ends[-1]) + np.repeat(into[front] - ends + sizes, sizes)
            tails = np.unique(tail_of[by_head[spots]])
            tails = tails[b.ids[tails] != destination]
            stop, _, _, _, u, _, _ = stops.folded(tails)
            front = stops.learn(stop, u)
            stops.open[front] = True
            later.append(front)
            front = front[:0]
        out = [(MESSAGE, to, 0, 0, 0.0, body) for to, body in _news(b, stops.u, told, back)]
        under_way = stops.u[stops.open | told & (readers > 0)]
        if len(under_way):
            out.append((FACT, key, 0, ON if stops.open.any() else DONE, float(under_way.min()), b""))
        return table([*out, (MEMORY, key, 0, passed, 0.0, stops.remember())])

    return run


def _choose(destination: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The edges that each stop uses as results (v = 0), the times (v = 1), and for the volumes which edges these are and each stop's frequency."""

    def run(row: pa.Table, inbox: pa.Table) -> pa.Table:
        key = int((inbox if inbox.num_rows else row).column("block")[0].as_py())
        stops = _Stops(row, key, destination)
        b = stops.block
        for i in np.flatnonzero(inbox.column("kind").to_numpy() == MEMORY):
            stops.recall(inbox.column("body")[int(i)].as_py())
        stop, edge, first, sizes, u, f, used = stops.folded(stops.leave())
        place, tail = np.arange(len(edge)) - np.repeat(first, sizes), np.repeat(stop, sizes)
        state = np.zeros(b.size, _STOP)
        state["f"][stop] = f
        best, at_head = np.repeat(u, sizes), stops.u[b.head[edge]]
        # ties that rounding has put behind the stop's time; only towards stops that are nearer, so that they close no circle, and none without
        # waiting, which would not share what the stop carries but take it all
        taken, also = place < np.repeat(used, sizes), (at_head + b.trav_time[edge] <= best * (1 + EQUAL)) & (at_head < best)
        also &= ~taken & (b.freq[edge] < INF_FREQ)
        np.add.at(state["f"], tail[also], b.freq[edge[also]])
        state["f"][stop] = np.maximum(state["f"][stop], MIN_FREQ)
        edge, tail = edge[taken | also], tail[taken | also]
        chosen = np.empty(len(edge), _CHOSEN)
        chosen["edge_idx"], chosen["tail"], chosen["head"] = b.edge_idx[edge], b.ids[tail], b.ids[b.head[edge]]
        chosen["freq"], chosen["f_tail"] = b.freq[edge], state["f"][tail]
        known = np.flatnonzero(stops.known[: b.own])
        times = np.empty(len(known), _NEWS)
        times["v"], times["u"] = b.ids[known], stops.u[known]
        on = np.zeros(len(b.head), bool)
        on[edge] = True
        state["left"] = 0
        return table([(RESULT, key, 0, 0, 0.0, chosen.tobytes()), (RESULT, key, 0, 1, 0.0, times.tobytes()), (MEMORY, key, 0, 0, 0.0, np.packbits(on).tobytes() + state.tobytes())])

    return run


class _Flow:
    """A block while volumes flow: which of its edges are chosen, and its stops' states."""

    def __init__(self, row: pa.Table, inbox: pa.Table):
        kinds, bodies = inbox.column("kind").to_numpy(), inbox.column("body")
        self.key = int(inbox.column("block")[0].as_py())
        self.block = b = Block(row, self.key)
        self.bits = -(-len(b.head) // 8)
        body = next((bodies[int(i)].as_py() for i in np.flatnonzero(kinds == MEMORY)), None)
        self.on = np.zeros(len(b.head), bool) if body is None else np.unpackbits(np.frombuffer(body[: self.bits], np.uint8), count=len(b.head)).astype(bool)
        self.state = np.zeros(b.size, _STOP) if body is None else np.frombuffer(body[self.bits :], _STOP).copy()
        got = np.concatenate([np.frombuffer(bodies[int(i)].as_py(), _FLOW) for i in np.flatnonzero(kinds == MESSAGE)] or [np.empty(0, _FLOW)])
        at = b.local(got["v"])
        self.at, self.amount, self.edges = at[at >= 0], got["amount"][at >= 0], got["edges"][at >= 0]

    def used(self, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge, tail = self.block.leaving(stops)
        return edge[self.on[edge]], tail[self.on[edge]]

    def messages(self, amount: np.ndarray, edges: np.ndarray) -> Iterator[tuple]:
        """What has come together for stops of other blocks."""
        b = self.block
        far = b.own + np.flatnonzero(edges[b.own :])
        for to, some in b.by_home(far):
            made = np.empty(len(some), _FLOW)
            made["v"], made["amount"], made["edges"] = b.ids[some], amount[some], edges[some]
            yield MESSAGE, to, 0, 0, 0.0, made.tobytes()

    def memory(self) -> tuple:
        left = int((self.state["reached"] & ~self.state["done"])[: self.block.own].sum())
        return MEMORY, self.key, 0, left, 0.0, np.packbits(self.on).tobytes() + self.state.tobytes()


def _count(row: pa.Table, inbox: pa.Table) -> pa.Table:
    """Which stops the demand reaches, and over how many edges."""
    if not inbox.num_rows:
        return table([])
    flow = _Flow(row, inbox)
    state, own = flow.state, flow.block.own
    np.add.at(state["left"], flow.at, flow.edges)
    edges, front = np.zeros(flow.block.size, np.int64), np.unique(flow.at)
    while True:
        front = front[~state["reached"][front]]
        if not len(front):
            break
        state["reached"][front] = True
        edge, _ = flow.used(front)
        heads = flow.block.head[edge]
        np.add.at(edges, heads, 1)
        front = np.unique(heads[heads < own]).astype(np.int64)
    state["left"][:own] += edges[:own]
    return table([*flow.messages(np.zeros(flow.block.size), edges), flow.memory()])


def _release(row: pa.Table, inbox: pa.Table) -> pa.Table:
    """Pass on the volumes of stops that have got all of theirs."""
    if not inbox.num_rows:
        return table([])
    flow = _Flow(row, inbox)
    b, state, own = flow.block, flow.state, flow.block.own
    np.add.at(state["amount"], flow.at, flow.amount)
    np.subtract.at(state["left"], flow.at, flow.edges)
    amount, edges, out = np.zeros(b.size), np.zeros(b.size, np.int64), []
    front = np.unique(flow.at)
    while True:
        front = front[(state["left"][front] == 0) & ~state["done"][front]]
        if not len(front):
            break
        state["done"][front] = True
        edge, tail = flow.used(front)
        load = np.empty(len(edge), _LOAD)
        load["edge_idx"], load["volume"] = b.edge_idx[edge], state["amount"][tail] * b.freq[edge] / state["f"][tail]
        out.append((RESULT, flow.key, 0, 2, 0.0, load.tobytes()))
        heads = b.head[edge]
        near = heads < own
        np.add.at(state["amount"], heads[near], load["volume"][near])
        np.subtract.at(state["left"], heads[near], 1)
        np.add.at(amount, heads[~near], load["volume"][~near])
        np.add.at(edges, heads[~near], 1)
        front = np.unique(heads[near]).astype(np.int64)
    return table([*out, *flow.messages(amount, edges), flow.memory()])


def _rows(results: DataFrame, number: int, kind: np.dtype) -> DataFrame:
    """Rows of the results of one sort."""
    columns = list(kind.names)
    schema = ", ".join(f"{c} {'double' if kind[c].kind == 'f' else 'long'}" for c in columns)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(0):
                got = np.frombuffer(body.as_py(), kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[c])) for c in columns], columns)

    return results.where(F.col("v") == number).select("body").mapInArrow(explode, schema)


def assign(layout: Layout, destination: int, count: int, demand: list[tuple[int, float]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Times (v, u), chosen edges (edge_idx, tail, head, freq, f_tail) towards ``destination``, and volumes (edge_idx, volume) of ``demand`` (origin, volume).

    Of repeated origins the last one counts; origins that cannot reach the destination load nothing.
    """
    spark = layout.table.sparkSession
    asked = {int(o): float(v) for o, v in demand}
    places = layout.places([destination, *asked])
    if destination not in places:
        none = spark.createDataFrame([], "edge_idx long, tail long, head long, freq double, f_tail double")
        return spark.createDataFrame([(destination, 0.0)], "v long, u double"), none, none.select("edge_idx", F.lit(0.0).alias("volume"))
    home = lambda v: int(layout.ranges.of(np.array([v]))[0])
    outer = current()
    try:
        with scope() as own:
            rounds = Rounds(layout, [(MESSAGE, home(destination), 0, 0, 0.0, np.array([(destination, 0.0)], _NEWS).tobytes())])
            bound, most = 0.0, SHARE * (2 * count + 1)  # what one step passed on takes as many as shares
            while rounds.active:
                rounds.step(_times(destination, most, bound))
                if rounds.alarms or rounds.number > most:
                    raise RuntimeError(f"times still change after {most} steps")
                rounds.active = sorted({f["block"] for f in rounds.facts if f["v"] == ON}.union(rounds.active))
                bound = min((f["d"] for f in rounds.facts), default=math.inf)
                rounds.put_together()
            rounds.step(_choose(destination), everyone=True)
            results = rounds.results()
            with within(outer):  # for the caller, beyond these rounds
                times, chosen = save(_rows(results, 1, _NEWS), "times"), save(_rows(results, 0, _CHOSEN), "chosen")
            reached = {r["v"] for r in times.where(F.col("v").isin(list(asked))).collect()}
            starts = [(v, x) for v, x in asked.items() if x > 0 and v in reached]
            for run, edges in ((_count, 0), (_release, 0)):
                rounds.send([(MESSAGE, home(v), 0, 0, 0.0, np.array([(v, x if run is _release else 0.0, edges)], _FLOW).tobytes()) for v, x in starts])
                while rounds.active:
                    rounds.step(run)
                    rounds.put_together()
            stuck = rounds.memory().agg(F.sum("v")).first()[0] if starts else 0
            with within(outer):
                volumes = save(_rows(rounds.results(), 2, _LOAD) if not stuck else _by_levels(chosen, starts, count), "volumes")
        return times, chosen, volumes
    finally:
        own.free()


def _by_levels(chosen: DataFrame, starts: list[tuple[int, float]], count: int) -> DataFrame:
    """Volumes where stops without any waiting or travel time between them choose each other: pushed on step by step."""
    front = save(chosen.sparkSession.createDataFrame(starts, "v long, amount double"), "front")
    flows = [chosen.select("edge_idx", F.lit(0.0).alias("volume")).where("false")]
    for _ in range(count + 1):
        if front.isEmpty():
            break
        moved = save(front.join(chosen, front["v"] == chosen["tail"]).select("edge_idx", "head", (F.col("amount") * F.col("freq") / F.col("f_tail")).alias("volume")), "flow")
        flows.append(moved.select("edge_idx", "volume"))
        front = moved.groupBy(F.col("head").alias("v")).agg(F.sum("volume").alias("amount")).where("amount > 0")
    every = flows[0]
    for more in flows[1:]:
        every = every.union(more)
    return every.groupBy("edge_idx").agg(F.sum("volume").alias("volume"))
