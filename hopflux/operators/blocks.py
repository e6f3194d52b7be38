"""Graphs laid out in blocks: a block is one row that holds the edges leaving a range of vertices, as arrays.

Vertices have places.  A place is the vertex's own id, or its number in an order that keeps neighbours together
(:mod:`hopflux.operators.locality`).  Blocks are ranges of places with about ``block_edges`` edge ends each; where a range ends comes
from running totals of the vertices' degrees, added up by ranges, so no task sees all of them.  A vertex with more edges than a block
holds has them dealt to further blocks by a hash of their heads, and its own block passes on to them what it finds out about it.

In a block vertices are numbered: its own first, by place, then those of other blocks that its edges lead to.  Edges are sorted by tail.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopflux.operators.edges import running_total
from hopflux.plans.work import save

#: Edges of a block, about.  It bounds a task's memory whatever the graph's size: 180 to 230 MB of Python as measured.
BLOCK_EDGES = 1 << 18
#: Partitions of a layout at most; beyond it they hold several blocks each.
PARTS = 10_000
#: Blocks that are held in memory, for each core.
HELD = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Arrays that every block has, and the types of values that edges may have.
ARRAYS = {"ids": np.int64, "names": np.int64, "home": np.int32, "first": np.int64, "head": np.int32, "back_v": np.int64, "back_block": np.int32}
VALUES = {"weight": np.float64, "trav_time": np.float64, "freq": np.float64, "edge_idx": np.int64}
#: Distances of a block's vertices from landmarks, one landmark after the other (:mod:`hopflux.operators.landmarks`).
MARKS = "marks"
VALUES |= {MARKS: np.float64}


@dataclass
class Ranges:
    """First places of the blocks after the first, the blocks' keys, and the further blocks of vertices with very many edges."""

    starts: np.ndarray
    keys: np.ndarray
    spread: dict[int, list[int]] = field(default_factory=dict)

    def of(self, places: np.ndarray) -> np.ndarray:
        return self.keys[np.searchsorted(self.starts, places, side="right")]

    def of_edges(self, tails: np.ndarray, heads: np.ndarray) -> np.ndarray:
        block = self.of(tails)
        for v, more in self.spread.items():
            at = np.flatnonzero(tails == v)
            deal = (heads[at].astype(np.uint64) * _MIX >> np.uint64(40)).astype(np.int64) % len(more)
            block[at] = np.array(more, np.int32)[deal]
        return block


@dataclass
class Layout:
    """``table`` (block, arrays), kept with one block to a task, and ``vertices`` (v, place)."""

    table: DataFrame
    vertices: DataFrame
    ranges: Ranges
    blocks: int

    def places(self, names: Sequence[int]) -> dict[int, int]:
        """Places of some vertices; those without edges have none."""
        asked = self.vertices.where(F.col("v").isin([int(x) for x in set(names)])).collect()
        return {r["v"]: r["place"] for r in asked}

    def close(self) -> None:
        self.table.unpersist()

    def write(self, path: str) -> None:
        """Write the layout to a folder, a partition for each block, from which later sessions take it up again."""
        spark = self.table.sparkSession
        facts = [("start", i, int(x)) for i, x in enumerate(self.ranges.starts)] + [("key", i, int(x)) for i, x in enumerate(self.ranges.keys)]
        facts += [("spread", v, k) for v, more in self.ranges.spread.items() for k in more] + [("blocks", 0, self.blocks)]
        self.table.write.partitionBy("block").parquet(f"{path}/blocks")
        self.vertices.write.parquet(f"{path}/vertices")
        spark.createDataFrame(facts, "kind string, at long, value long").write.parquet(f"{path}/ranges")


def kept(table: DataFrame, blocks: int) -> DataFrame:
    """Blocks kept by the executors: in memory as long as there are few for each core, else on their disks, so that what they take of an
    executor's memory does not grow with the graph."""
    few = blocks <= HELD * table.sparkSession.sparkContext.defaultParallelism
    return table.persist(StorageLevel.MEMORY_AND_DISK_DESER if few else StorageLevel.DISK_ONLY)


def open_layout(spark: SparkSession, path: str, keep: bool = True) -> Layout:
    """A layout that :meth:`Layout.write` has written.  With ``keep`` the executors keep its blocks once read, else each round reads
    the partitions of the blocks that work in it."""
    facts: dict[str, list[tuple[int, int]]] = {}
    for r in spark.read.parquet(f"{path}/ranges").orderBy("kind", "at", "value").collect():
        facts.setdefault(r["kind"], []).append((r["at"], r["value"]))
    ranges = Ranges(np.array([x for _, x in facts.get("start", [])], np.int64), np.array([x for _, x in facts["key"]], np.int32))
    for v, k in facts.get("spread", []):
        ranges.spread.setdefault(v, []).append(k)
    count = facts["blocks"][0][1]
    table = spark.read.parquet(f"{path}/blocks")
    table = table.select("block", *(c for c in table.columns if c != "block"))
    return Layout(kept(table.repartition(min(count, PARTS), "block"), count) if keep else table, spark.read.parquet(f"{path}/vertices"), ranges, count)


class Block:
    """The arrays of one block."""

    def __init__(self, row: pa.Table, key: int):
        self.key, self.found = key, row.num_rows > 0
        for name in row.column_names[1:]:
            body = row.column(name)[0].as_py() if self.found else b""
            setattr(self, name, np.frombuffer(body, ARRAYS.get(name) or VALUES[name]))
        self.size = len(self.ids)
        self.own = int(np.count_nonzero(self.home == key))
        if not self.found:
            self.first = np.zeros(1, np.int64)

    def local(self, places: np.ndarray) -> np.ndarray:
        """Numbers of places in the block, -1 for those that it does not know."""
        at = np.full(len(places), -1)
        for low, part in ((0, self.ids[: self.own]), (self.own, self.ids[self.own :])):
            if len(part):
                spot = np.minimum(np.searchsorted(part, places), len(part) - 1)
                at = np.where(part[spot] == places, spot + low, at)
        return at

    def by_home(self, some: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Vertices by the blocks that they belong to."""
        home = self.home[some]
        order = np.argsort(home, kind="stable")
        some, home = some[order], home[order]
        starts = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(some) else np.empty(0, np.int64)
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(some)]):
            yield int(home[low]), some[low:high]

    def leaving(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges that leave some vertices, and which of these each leaves."""
        first = self.first[some]
        sizes = self.first[some + 1] - first
        ends = np.cumsum(sizes)
        edge = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)
        return edge, np.repeat(some, sizes)


def _builder(ranges: Ranges, values: Sequence[str]):
    """Rows of one block (its vertices, without a head, and its edges) to its arrays."""
    names = ["ids", "names", "home", "first", "head", "back_v", "back_block", *values]
    schema = pa.schema([("block", pa.int32()), *((n, pa.binary()) for n in names)])

    def build(rows: pa.Table) -> pa.Table:
        block = int(rows.column("block")[0].as_py())
        column = {c: rows.column(c) for c in rows.column_names}
        is_edge = column["head"].is_valid().to_numpy()
        edges, listed = rows.filter(pa.array(is_edge)), rows.filter(pa.array(~is_edge))
        back = listed.filter(listed.column("reader").is_valid())
        back = np.unique(np.stack([back.column("tail").to_numpy(), back.column("reader").to_numpy().astype(np.int64)]), axis=1)
        listed = listed.filter(listed.column("reader").is_null())
        tail, head = edges.column("tail").to_numpy(), edges.column("head").to_numpy()
        v, name = listed.column("tail").to_numpy(), listed.column("name").to_numpy()
        order = np.argsort(v, kind="stable")
        v, name = v[order], name[order]
        mine = ranges.of(v) == block
        own, copies = v[mine], v[~mine]
        far = np.union1d(copies, np.setdiff1d(head, own))
        ids = np.concatenate([own, far])
        home = ranges.of(ids)
        names_of = np.zeros(len(ids), np.int64)
        names_of[: len(own)] = name[mine]
        names_of[len(own) + np.searchsorted(far, copies)] = name[~mine]

        def number(x: np.ndarray) -> np.ndarray:
            at = np.searchsorted(own, x)
            if not len(own):
                return np.searchsorted(far, x)
            inside = own[np.minimum(at, len(own) - 1)] == x
            return np.where(inside, at, len(own) + np.searchsorted(far, x))

        t, h = number(tail), number(head)
        order = np.lexsort((h, t))
        first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(ids)))])
        made = {"ids": ids, "names": names_of, "home": home, "first": first, "head": h[order], "back_v": back[0], "back_block": back[1]}
        made |= {n: edges.column(n).to_numpy()[order] for n in values}
        body = [np.ascontiguousarray(made[n], ARRAYS.get(n) or VALUES[n]).tobytes() for n in names]
        return pa.Table.from_arrays([pa.array([block], pa.int32()), *(pa.array([b], pa.binary()) for b in body)], schema=schema)

    return build, "block int, " + ", ".join(f"{n} binary" for n in names)


def _keys(spark, count: int, parts: int) -> np.ndarray:
    """Keys of blocks that Spark's hash deals evenly to the partitions."""
    if parts == 1:
        return np.arange(count, dtype=np.int32)
    each = -(-count // parts)
    tries = spark.range(parts * (each + 3 * int(parts**0.5) + 60)).select(F.col("id").cast("int").alias("key"))
    dealt = tries.select("key", F.pmod(F.hash("key"), F.lit(parts)).alias("part")).groupBy("part").agg(F.slice(F.array_sort(F.collect_list("key")), 1, each).alias("keys")).orderBy("part")
    rows = [r["keys"] for r in dealt.collect()]
    keys = [keys[i] for i in range(each) for keys in rows if i < len(keys)]
    return np.array(keys[:count], np.int32)


def _halo(named: DataFrame, vertices: DataFrame, place_edges, text: str, ranges: Ranges, values: list[str], depth: int, n_edges: int) -> Iterator[DataFrame]:
    """Edges (block, tail, head and values) of vertices around each block, and these vertices (block, tail, name)."""

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, head = b.column(0).to_numpy(), b.column(1).to_numpy()
            out = ranges.of(head) != block
            pairs = np.unique(np.stack([block[out].astype(np.int64), head[out]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int32()), pa.array(pairs[1])], ["block", "tail"])

    inner, known, most = named.select("tail", "head", *values).mapInArrow(place_edges, text), None, n_edges // 4
    few = named.where(~F.col("tail").isin(list(ranges.spread))) if ranges.spread else named
    for _ in range(depth):
        ring = inner.select("block", "head").mapInArrow(outside, "block int, tail long").distinct()
        ring = save(ring if known is None else ring.join(known, ["block", "tail"], "left_anti"), "ring")
        inner = save(ring.join(few, "tail").select("block", "tail", "head", *values), "halo")
        most -= inner.count()
        if most < 0:
            break
        known = ring if known is None else known.union(ring)
        yield inner
        yield ring.join(vertices.select(F.col("place").alias("tail"), F.col("v").alias("name")), "tail").select("block", "tail", "name")


def lay_out(edges: DataFrame, n_edges: int, block_edges: int = BLOCK_EDGES, values: Sequence[str] = ("weight",), order: DataFrame | None = None, readers: bool = False, split: bool = True, halo: int = 0) -> Layout:
    """Deal merged edges (tail, head and ``values``) to blocks.

    ``order`` (v, place) gives the vertices' places, by default their ids.  With ``readers`` a block also knows which other blocks have edges
    to its vertices.  Without ``split`` all edges of a vertex stay in its block.  With a ``halo`` a block also holds the edges that leave
    vertices at most so many edges outside of it, as long as these are few (a quarter of all), so that paths along a ragged border
    need not go to and fro between blocks.
    """
    spark = edges.sparkSession
    wanted = max(1, -(-n_edges // block_edges))
    if wanted > 1:  # whole waves of tasks
        cores = spark.sparkContext.defaultParallelism
        wanted = -(-wanted // cores) * cores if block_edges == BLOCK_EDGES else wanted
    named = edges.select("tail", "head", *values)
    if order is not None:
        for end in ("tail", "head"):
            named = named.join(order.select(F.col("v").alias(end), F.col("place").alias(f"{end}_place")), end)
        named = named.select(F.col("tail_place").alias("tail"), F.col("head_place").alias("head"), *values, F.col("tail").alias("tail_name"), F.col("head").alias("head_name"))
        ends = named.select(F.explode(F.array(F.struct(F.col("tail").alias("place"), F.col("tail_name").alias("v")), F.struct(F.col("head").alias("place"), F.col("head_name").alias("v")))).alias("x"))
    else:
        ends = named.select(F.explode(F.array(F.struct(F.col("tail").alias("place"), F.col("tail").alias("v")), F.struct(F.col("head").alias("place"), F.col("head").alias("v")))).alias("x"))
    vertices = ends.groupBy("x.place", "x.v").agg(F.count("*").alias("ends"))
    starts, spread = np.empty(0, np.int64), []
    if wanted > 1:
        per = max(1, -(-2 * n_edges // wanted))
        vertices = save(running_total(vertices, ["place"], "ends", "before"), "vertices")
        borders = vertices.groupBy(F.floor(F.col("before") / per).alias("range")).agg(F.min("place").alias("start")).select("start").toPandas()["start"]
        starts = np.sort(borders.to_numpy(np.int64))[1:]  # as many numbers as blocks, here and below
        many = named.where(F.lit(split)).groupBy("tail").agg(F.count("*").alias("c")).where(F.col("c") > block_edges)
        spread = [(r["tail"], -(-r["c"] // block_edges)) for r in many.collect()]
    else:
        vertices = save(vertices, "vertices")
    count = len(starts) + 1 + sum(c for _, c in spread)
    parts = min(count, PARTS)
    keys = _keys(spark, count, parts)
    ranges, at = Ranges(starts, keys[: len(starts) + 1]), len(starts) + 1
    for v, more in spread:
        ranges.spread[v] = keys[at : at + more].tolist()
        at += more
    columns = ["block", "tail", "head", "name", "reader", *values]
    kinds = {"block": "int", "reader": "int", "edge_idx": "long"} | {c: "long" for c in ("tail", "head", "name")}
    text = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns)
    schema = pa.schema([(c, {"int": pa.int32(), "long": pa.int64()}.get(kinds.get(c, ""), pa.float64())) for c in columns])

    def place_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tail, head = b.column("tail").to_numpy(), b.column("head").to_numpy()
            block = ranges.of_edges(tail, head)
            n, given = b.num_rows, {c: b.column(c) for c in ("tail", "head", *values)}
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()) if c == "block" else given.get(c, pa.nulls(n, schema.field(c).type)) for c in columns], schema=schema)
            if readers:
                home = ranges.of(head)
                pairs = np.unique(np.stack([head, home, block])[:, home != block], axis=1)
                m = pairs.shape[1]
                made = {"block": pa.array(pairs[1], pa.int32()), "tail": pa.array(pairs[0]), "reader": pa.array(pairs[2], pa.int32())}
                yield pa.RecordBatch.from_arrays([made.get(c, pa.nulls(m, schema.field(c).type)) for c in columns], schema=schema)

    def place_vertices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, name = b.column("place").to_numpy(), b.column("v").to_numpy()
            more = [(k, p, n) for p, n in zip(v.tolist(), name.tolist()) if p in ranges.spread for k in ranges.spread[p]] if ranges.spread else []
            block, v, name = (np.concatenate([x, np.array([m[i] for m in more], np.int64)]) for i, x in enumerate((ranges.of(v), v, name)))
            made = {"block": pa.array(block, pa.int32()), "tail": pa.array(v), "name": pa.array(name)}
            yield pa.RecordBatch.from_arrays([made.get(c, pa.nulls(len(v), schema.field(c).type)) for c in columns], schema=schema)

    rows = named.select("tail", "head", *values).mapInArrow(place_edges, text).union(vertices.select("place", "v").mapInArrow(place_vertices, text))
    for extra in _halo(named, vertices, place_edges, text, ranges, list(values), halo, n_edges) if count > 1 else ():
        rows = rows.union(extra.select(*(F.col(c).cast(kinds.get(c, "double")) if c in extra.columns else F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in columns)))
    build, kind = _builder(ranges, values)
    table = rows.repartition(parts, "block").groupBy("block").applyInArrow(build, kind)
    return Layout(kept(table.repartition(parts, "block"), count), vertices.select("v", "place"), ranges, count)
