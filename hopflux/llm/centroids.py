"""Centroid clustering with Hamerly's bounds, in exact integers.

A vector's components become integers, ``floor(scale * x)``.  In each round every vector goes to the nearest centroid (squared distance,
ties to the smaller number), and every centroid that has vectors becomes the floor of their mean.  Between rounds a vector keeps one
upper bound of the distance to its own centroid and one lower bound of that to any other.  Centroids' drifts loosen both; as long as the upper
one stays below the lower one (or below half the way to the nearest other centroid) no other centroid can be nearest, and nothing
is computed.  Otherwise the upper bound is made exact, and if that does not settle it the vector is held against all centroids, in integers.
Bounds are doubles rounded outwards, so rounding never decides anything.

The integer vectors are a table in buckets, written once; the bounds are a small table in the same buckets, written in each round.  Their
join needs no shuffle, and vectors are only read.  What goes to the driver in a round are the k centroids and how the sums of their vectors
change: only vectors that change their centroid contribute.

Rows with a null vector, a wrong number of components, or a component that is null or not finite are left out.  Rows alike, with one
id or with a null id are rows of their own.  Components beyond 2 ** 62 count as that; a distance that no long holds is
given as the largest long, though it is compared exactly.  Fewer rows than ``k`` give fewer centroids, an empty table gives an empty result.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflux.llm.work import bucketed, save, scope

_LIMIT, _LONG = 1 << 62, (1 << 63) - 1
#: Below this magnitude 64-bit integers hold the squared distance of vectors of up to 1,024 components.
_SMALL = 1 << 25
_STATE = "row long, cluster int, upper double, lower double, distance long, moved array<long>, n int"
_SCHEMA = pa.schema([("row", pa.int64()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("distance", pa.int64()), ("moved", pa.list_(pa.int64())), ("n", pa.int32())])
#: Sums leave a task in two parts, so that neither the sums of a task nor those of all tasks leave a long or a decimal.
_PART = 31


def kept_vectors(table: DataFrame, scale: int = 1024, dims: int = 64) -> DataFrame:
    """vec_id, v (array<long>): the vectors that take part, in integers."""
    x = F.col("embedding")
    whole = F.size(x) == dims
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    cut = lambda c: F.greatest(F.least(c.cast("double") * scale, F.lit(float(_LIMIT))), F.lit(-float(_LIMIT)))
    return table.where(x.isNotNull() & whole & finite).select("vec_id", F.transform(x, lambda c: F.floor(cut(c)).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = 8, seed: int = 3) -> list[list[int]]:
    """The k vectors whose ids have the smallest SHA-256, in that order (ties by id and components)."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["v"]) for r in vectors.select(draw.alias("draw"), "v").orderBy("draw", "v").limit(k).collect()]


def _numpy(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _squared(v: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Exact squared distances; Python's integers where 64 bits might not do."""
    big = max(map(abs, centroid), default=0) >= _SMALL or (len(v) and (v.max() >= _SMALL or v.min() <= -_SMALL))
    d = v.astype(object) - np.array(centroid, object) if big else v - np.array(centroid, np.int64)
    return (d * d).sum(axis=1)


def _root_up(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(np.nextafter(squared.astype(np.float64), np.inf)), np.inf)


def _root_down(squared: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(np.maximum(np.nextafter(squared.astype(np.float64), -np.inf), 0)), -np.inf), 0)


def _root(squared: int, up: bool) -> float:
    one = np.array([squared], object)
    return float((_root_up if up else _root_down)(one)[0])


def _scan(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, its squared distance and that of the second nearest (infinite if there is none)."""
    every = [_squared(v, c) for c in centroids]
    kind = object if any(e.dtype == object for e in every) else np.int64
    d = np.stack([e.astype(kind) for e in every], axis=1)
    best = np.argmin(d, axis=1)  # the first of equals
    at = np.arange(len(v))
    own = d[at, best]
    if len(centroids) == 1:
        return best, own, np.full(len(v), np.inf)
    rest = d.astype(object) if kind is object else d.copy()
    rest[at, best] = rest.max() + 1
    return best, own, rest.min(axis=1)


class _Drift:
    """How far each centroid moved, rounded up, and for each the most that any other moved and half the way to its nearest neighbour."""

    def __init__(self, before: list[list[int]], now: list[list[int]]):
        k = len(now)
        moved = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(before, now, strict=True)]
        self.own = np.array([_root(m, True) if m else 0.0 for m in moved])
        self.others = np.array([max((self.own[j] for j in range(k) if j != i), default=0.0) for i in range(k)])
        near = [min((sum((a - b) ** 2 for a, b in zip(now[i], now[j], strict=True)) for j in range(k) if j != i), default=None) for i in range(k)]
        self.half = np.array([np.inf if n is None else np.nextafter(_root(n, False) / 2, 0) for n in near])


def _assign(before: list[list[int]] | None, now: list[list[int]], last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One round over vectors joined with their bounds; ``last`` makes every distance exact.

    Gives a row of bounds per vector, and per batch and centroid one row with the change of the sum of its vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, drift = len(now[0]), _Drift(before, now) if before else None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            row, v = b.column("row").to_numpy(), _numpy(b.column("v"), dims)
            if drift is None:
                old = np.full(n, -1)
                cluster, upper, lower, ask = old.copy(), np.zeros(n), np.zeros(n), np.ones(n, bool)
            else:
                old = b.column("cluster").to_numpy().astype(np.int64)
                cluster = old.copy()
                upper = np.nextafter(b.column("upper").to_numpy() + drift.own[old], np.inf)
                lower = np.nextafter(b.column("lower").to_numpy() - drift.others[old], -np.inf)
                ask = upper >= np.maximum(lower, drift.half[old])
            exact = np.zeros(n, object)
            for c in np.unique(cluster[cluster >= 0]).tolist():
                at = np.flatnonzero((cluster == c) & (ask | last))
                if len(at):
                    exact[at] = _squared(v[at], now[c])
                    upper[at] = _root_up(exact[at])
            if drift is not None:
                ask &= upper >= np.maximum(lower, drift.half[old])
            at = np.flatnonzero(ask)
            if len(at):
                cluster[at], exact[at], second = _scan(v[at], now)
                upper[at], lower[at] = _root_up(exact[at]), _root_down(second)
            distance = pa.array([min(int(x), _LONG) for x in exact], pa.int64()) if last else pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), distance, pa.nulls(n, _SCHEMA.field("moved").type), pa.nulls(n, pa.int32())], schema=_SCHEMA)
            yield from _moves(int(row[0]), v, old, cluster)

    return run


def _moves(row: int, v: np.ndarray, old: np.ndarray, cluster: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, moved, n): what vectors that change their centroid add to the sums of the new one and take from the old one's."""
    went = np.flatnonzero(old != cluster)
    both = [(c, sign, went[side[went] == c]) for side, sign in ((old, -1), (cluster, 1)) for c in np.unique(side[went]).tolist() if c >= 0]
    rows = []
    for c, sign, at in both:
        high = v[at] >> _PART
        low = v[at] - (high << _PART)
        rows.append((c, (sign * np.concatenate([low.sum(axis=0), high.sum(axis=0)])).tolist(), sign * len(at)))
    if rows:
        n = len(rows)
        none = pa.nulls(n, pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), none, none, pa.nulls(n, pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.int32())], schema=_SCHEMA)


def _changes(state: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Per centroid the change of its count and of its vectors' sums, added up where the rows are."""
    total = [F.sum(F.col("moved")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(2 * dims)]
    rows = state.where("moved is not null").groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect()
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) + (int(r[f"s{dims + i}"]) << _PART) for i in range(dims)]) for r in rows}


def cluster_vectors(table: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that takes part after ``rounds`` rounds, and the final centroids."""
    spark = table.sparkSession
    vectors = kept_vectors(table, scale, dims)
    now = first_centroids(vectors, k, seed)
    if not now:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), []
    sums, before, state = [(0, [0] * dims) for _ in now], None, None
    try:
        with scope() as own:
            whole = bucketed(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors", "row")
            for number in range(rounds + 1):
                given = whole.select("row", "v")
                if state is not None:
                    bounds = state.where("moved is null").select("row", "cluster", "upper", "lower")
                    given = given.join(bounds.hint("merge"), "row").select("row", "v", "cluster", "upper", "lower")
                last = number == rounds or now == before  # centroids that stay give the same vectors from then on
                state = bucketed(given.mapInArrow(_assign(before, now, last), _STATE), "bounds", "row", deal=False)
                if last:
                    break
                for c, (n, moved) in _changes(state, dims).items():
                    sums[c] = sums[c][0] + n, [a + b for a, b in zip(sums[c][1], moved, strict=True)]
                before, now = now, [[x // n for x in s] if n else c for c, (n, s) in zip(now, sums, strict=True)]
        found = state.where("moved is null").select("row", "cluster", "distance").join(whole.select("row", "vec_id").hint("merge"), "row")
        return save(found.select("vec_id", "cluster", "distance"), "clusters"), now
    finally:
        own.free()


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``found`` with cluster_inertia, inertia and centroid_sha256, of which there are as many as centroids."""
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    named = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(i, min(sums.get(i, 0), _LONG), min(sum(sums.values()), _LONG), named(c)) for i, c in enumerate(centroids)]
    each = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
