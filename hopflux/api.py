"""The four path engines: prepare a graph once, then run queries on it.

Results are DataFrames: ``(vertex_idx, path_length)``, ``(vertex_idx, predecessor)`` and so on.  ``return_series`` and
``return_array`` bring a result to the driver for callers that want pandas or NumPy.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopflux.constants import UNREACHABLE
from hopflux.functions import or_infinity
from hopflux.operators import bfs, blocks, hyperpath, locality, shortest_path
from hopflux.operators import edges as ops
from hopflux.operators import paths as path_ops
from hopflux.operators.landmarks import with_landmarks
from hopflux.plans.work import save
from hopflux.sources.frames import ROLES, to_spark


def _validate(frame: DataFrame, names: dict[str, str], no_negative: Sequence[str] = (), finite: Sequence[str] = ()) -> None:
    """Raise on columns that are missing or of the wrong type, missing values, and values out of range, in that order."""
    for name in names.values():
        if name not in frame.columns:
            raise KeyError(f"edge column '{name}' not found in graph edges dataframe")
    roles = frame.select(*(F.col(f"`{name}`").alias(role) for role, name in names.items()))
    numeric = [r for r in names if isinstance(roles.schema[r].dataType, T.NumericType)]
    found = ops.check_values(roles, numeric)
    for role, name in names.items():
        empty = found.missing[role] if role in numeric else roles.where(F.col(role).isNull()).count()
        if empty:
            raise ValueError(f"edges[{name}] column contains missing value")
    for role in ("tail", "head"):
        if not isinstance(roles.schema[role].dataType, T.IntegralType):
            raise TypeError(f"edges[{names[role]}] column should be of integer type")
    for role, name in names.items():
        if role not in numeric:
            raise TypeError(f"edges[{name}] column should be of numeric type")
        if role in no_negative and found.negative[role]:
            raise ValueError(f"edges[{name}] should be nonnegative")
        if role in finite and found.infinite[role]:
            raise ValueError(f"edges[{name}] should be finite")


def _as_array(values: DataFrame, key: str, column: str, dtype) -> np.ndarray:
    got = values.select(key, column).toPandas().sort_values(key)
    return got[column].to_numpy(dtype)


#: Edges that a block of neighbours looks beyond its border.
HALO = 4


class _Graph:
    """Common to the engines on merged edges.  What they keep in memory goes with :meth:`close` or at the end of a ``with`` block."""

    #: Edges of a block, see :mod:`hopflux.operators.blocks`.
    block_edges = blocks.BLOCK_EDGES
    #: What blocks are ranges of: "ids", or "neighbours" for graphs in which vertices with near ids are no neighbours.
    block_order = "ids"

    def __init__(self, edges, names: dict[str, str], orientation: str, permute: bool, verbose: bool):
        if orientation not in ("in", "out"):
            raise ValueError("orientation should be either 'in' or 'out'")
        frame = to_spark(edges, list(names.values()))
        for name in names.values():
            if name not in frame.columns:
                raise KeyError(f"edge column '{name}' not found in graph edges dataframe")
        for role in ("tail", "head"):
            if not isinstance(frame.schema[names[role]].dataType, T.NumericType):
                raise TypeError(f"edges[{names[role]}] column should be of integer type")
        self._orientation, self._permute, self._links = orientation, permute, None
        given = frame.select(*(F.col(f"`{n}`").cast(ROLES[r]).alias(r) for r, n in names.items()))
        self._edges = save(ops.min_weight_edges(given) if "weight" in names else ops.distinct_edges(given), "edges")
        facts = self._edges.agg(F.count("*").alias("n"), F.max(F.greatest("tail", "head")).alias("top"), *([F.coalesce(F.min("weight") < 0, F.lit(False)).alias("neg")] if "weight" in names else [])).first()
        self._n_edges, self._has_negative = facts["n"], "weight" in names and facts["neg"]
        self._vertex_set = ops.vertices(self._edges).persist() if permute else None
        self._n_vertices = self._vertex_set.count() if permute else 0 if facts["top"] is None else facts["top"] + 1
        if verbose:
            print(f"{ops.removed_count(given).first()[0]} parallel edge(s) removed")
        #: Edges in the direction of the walk, and what queries keep of them until :meth:`close`.
        self._walked = self._edges if orientation == "out" else ops.flipped(self._edges)
        self._kept: list = [self._vertex_set] if permute else []
        self._layout: blocks.Layout | None = None

    def close(self) -> None:
        """Let go of what is kept in memory; a later query prepares it again."""
        for kept in self._kept:
            kept.unpersist()
        if self._layout:
            self._layout.close()
        self._layout = None

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()

    edges = property(lambda self: self._edges)
    n_edges = property(lambda self: self._n_edges)
    n_vertices = property(lambda self: self._n_vertices)
    orientation = property(lambda self: self._orientation)
    permute = property(lambda self: self._permute)
    #: Links of the last run with path tracking, (vertex_idx, associated_idx); None without.
    path_links = property(lambda self: self._links)

    def get_vertices(self) -> DataFrame:
        """vertex_idx: the vertices that edges name, sorted."""
        return ops.vertices(self._edges).orderBy("vertex_idx")

    def _known(self, vertex: int, word: str = "positive") -> int:
        if vertex < 0:
            raise ValueError(f"argument 'vertex_idx={vertex}' must be {word}")
        inside = not self._vertex_set.where(F.col("vertex_idx") == int(vertex)).isEmpty() if self._permute else vertex < self._n_vertices
        if not inside:
            raise ValueError(f"vertex {vertex} not found in graph")
        return int(vertex)

    def _full(self, values: DataFrame) -> DataFrame:
        """One row per vertex of the graph: the dense range, or with ``permute`` the vertices that edges name."""
        return self._vertex_set.join(values, "vertex_idx", "left") if self._permute else ops.dense(values, self._n_vertices)

    def _link(self, values: DataFrame, column: str) -> None:
        self._links = save(self._full(values).select("vertex_idx", F.coalesce(column, "vertex_idx").alias("associated_idx")), "links")

    def get_path(self, vertex_idx: int) -> np.ndarray | None:
        """The path of a vertex, itself first and the root last; an unreached vertex's path is itself.  None without tracking."""
        if self._links is None:
            warnings.warn("Current path_links attribute is None. Use the 'path_tracking=True' option when running the algorithm.", UserWarning, stacklevel=2)
            return None
        one = self._links.where(F.col("vertex_idx") == int(vertex_idx)).select("vertex_idx")
        rows = path_ops.paths(self._links, one, limit=max(1, self._n_vertices)).orderBy("step").collect()
        return np.array([r["vertex_idx"] for r in rows], np.int64)

    def get_paths(self) -> DataFrame:
        """target, path: the paths of all vertices as arrays (needs path tracking)."""
        return path_ops.as_arrays(path_ops.paths(self._links, limit=max(1, self._n_vertices)))

    def _lengths(self, labels: DataFrame, return_inf: bool, return_series: bool, return_array: bool):
        one = self._full(labels.select(F.col("v").alias("vertex_idx"), "d")).select("vertex_idx", or_infinity(F.col("d"), return_inf).alias("path_length"))
        if return_series:
            return one.orderBy("vertex_idx").toPandas().set_index("vertex_idx")["path_length"]
        return _as_array(one, "vertex_idx", "path_length", np.float64) if return_array else one

    def _laid_out(self, *values: str) -> blocks.Layout:
        if self._layout is None:
            order = locality.local_order(self._edges) if self.block_order == "neighbours" and self._n_edges > self.block_edges else None
            self._layout = blocks.lay_out(self._walked, self._n_edges, self.block_edges, values, order, split=bool(values), halo=HALO if order is not None and values else 0)
        return self._layout

    def _batch(self, sources: Sequence[int], **how) -> DataFrame:
        for s in sources:
            self._known(s)
        return shortest_path.shortest_paths(self._laid_out("weight"), sources, self._n_vertices, negative=self._has_negative, **how)


class Dijkstra(_Graph):
    """Shortest paths from (orientation ``out``) or to (``in``) a vertex, weights not negative.

    ``lazy`` is accepted and has no effect: there is one way to run it.
    """

    def __init__(self, edges, tail: str = "tail", head: str = "head", weight: str = "weight", orientation: str = "out", check_edges: bool = False, permute: bool = False, verbose: bool = False, lazy: bool = True):
        names = {"tail": tail, "head": head, "weight": weight}
        if check_edges:
            edges = _checked_frame(edges, names)
            _validate(edges, names, no_negative=["weight"], finite=["weight"])
        super().__init__(edges, names, orientation, permute, verbose)
        self._lazy = lazy

    lazy = property(lambda self: self._lazy)

    def run(self, vertex_idx: int, path_tracking: bool = False, return_inf: bool = True, return_series: bool = False, heap_length_ratio: float = 1.0, termination_nodes: Sequence[int] | None = None, return_array: bool = False):
        """``(vertex_idx, path_length)``; with ``termination_nodes`` ``(position, vertex_idx, path_length)`` in the caller's order.

        ``heap_length_ratio`` is checked and has no effect.
        """
        vertex = self._known(vertex_idx)
        if type(heap_length_ratio) is not float or heap_length_ratio <= 0.0:
            raise (ValueError if type(heap_length_ratio) is float else TypeError)(f"heap_length_ratio is a positive float, not {heap_length_ratio!r}")
        targets = None if termination_nodes is None else self._targets(termination_nodes)
        self._links = None
        labels = self._batch([vertex], track=path_tracking, targets=targets)
        if path_tracking:
            self._link(labels.select(F.col("v").alias("vertex_idx"), F.col("pred").alias("associated_idx")), "associated_idx")
        if targets is None:
            return self._lengths(labels, return_inf, return_series, return_array)
        asked = labels.sparkSession.createDataFrame(list(enumerate(targets)), "position long, vertex_idx long")
        got = asked.join(labels.select(F.col("v").alias("vertex_idx"), "d"), "vertex_idx", "left").select("position", "vertex_idx", or_infinity(F.col("d"), return_inf).alias("path_length")).orderBy("position")
        if return_series:
            return got.toPandas().set_index("vertex_idx")["path_length"]
        return _as_array(got, "position", "path_length", np.float64) if return_array else got

    def add_landmarks(self, landmarks: int = 4) -> None:
        """Keep the distances from some far-off vertices with the edges: later runs with ``termination_nodes`` head for these.

        Costs one query and eight bytes a vertex for each landmark.  Results stay the same.
        """
        if self._n_edges and not self._has_negative:
            self._layout = with_landmarks(self._laid_out("weight"), self._n_vertices, landmarks)

    def _targets(self, nodes) -> list[int]:
        """The asked vertices as numbers, each of them in the graph."""
        try:
            given = [x.item() if isinstance(x, np.generic) else x for x in nodes]
            asked = [x if isinstance(x, (list, tuple, np.ndarray)) else int(x) for x in given]
        except (ValueError, TypeError, OverflowError) as problem:
            raise TypeError("termination_nodes is a list of vertex numbers") from problem
        if not asked or any(not isinstance(x, int) for x in asked):
            raise ValueError("termination_nodes is one list with at least one vertex")
        if any(x != y for x, y in zip(asked, given, strict=True)):
            raise TypeError("termination_nodes is a list of vertex numbers")
        if self._permute:
            wanted = self._vertex_set.sparkSession.createDataFrame([(x,) for x in sorted(set(asked))], "vertex_idx long")
            absent = wanted.join(self._vertex_set, "vertex_idx", "left_anti").first()
        else:
            absent = next(((x,) for x in asked if not 0 <= x < self._n_vertices), None)
        if absent:
            raise ValueError(f"termination node {absent[0]} not found in graph")
        return asked

    def run_many(self, sources: Sequence[int], path_tracking: bool = False) -> DataFrame:
        """``(source, vertex_idx, path_length[, associated_idx])`` of all reached vertices, for all sources in one fixpoint."""
        labels = self._batch(sources, track=path_tracking)
        return labels.select("source", F.col("v").alias("vertex_idx"), F.col("d").alias("path_length"), *([F.col("pred").alias("associated_idx")] if path_tracking else []))


class BellmanFord(_Graph):
    """Shortest paths with weights of either sign; a negative cycle that a query can reach raises ``ValueError``."""

    def __init__(self, edges, tail: str = "tail", head: str = "head", weight: str = "weight", orientation: str = "out", check_edges: bool = False, permute: bool = False, verbose: bool = False):
        names = {"tail": tail, "head": head, "weight": weight}
        if check_edges:
            edges = _checked_frame(edges, names)
            _validate(edges, names, finite=["weight"])
        super().__init__(edges, names, orientation, permute, verbose)
        self._cycle = False

    def run(self, vertex_idx: int, path_tracking: bool = False, return_inf: bool = True, return_series: bool = False, detect_negative_cycles: bool = True, return_array: bool = False):
        vertex = self._known(vertex_idx)
        self._links, self._cycle = None, False
        try:
            labels = self._batch([vertex], track=path_tracking, detect=detect_negative_cycles or not self._has_negative)
        except shortest_path.NegativeCycle:
            self._cycle = True
            raise
        if path_tracking:
            self._link(labels.select(F.col("v").alias("vertex_idx"), F.col("pred").alias("associated_idx")), "associated_idx")
        return self._lengths(labels, return_inf, return_series, return_array)

    def has_negative_cycle(self) -> bool:
        """Whether the last run found a negative cycle."""
        return self._cycle


class BFS(_Graph):
    """Breadth-first trees: the predecessor of every vertex on a path with the fewest edges, found in queue order."""

    UNREACHABLE = UNREACHABLE

    def __init__(self, edges, tail: str = "tail", head: str = "head", orientation: str = "out", check_edges: bool = False, permute: bool = False, verbose: bool = False, sentinel: int = UNREACHABLE):
        if isinstance(sentinel, bool) or not isinstance(sentinel, (int, np.integer)):
            raise TypeError(f"argument 'sentinel={sentinel}' must be an integer")
        if sentinel >= 0:
            raise ValueError(f"argument 'sentinel={sentinel}' must be negative")
        if sentinel < -(2**31):
            raise ValueError(f"argument 'sentinel={sentinel}' must fit 32 bits")
        names = {"tail": tail, "head": head}
        if check_edges:
            edges = _checked_frame(edges, names)
            _validate(edges, names)
        super().__init__(edges, names, orientation, permute, verbose)
        self._sentinel = int(sentinel)

    def run(self, vertex_idx: int, path_tracking: bool = False, return_series: bool = False, return_array: bool = False):
        """``(vertex_idx, predecessor)``; the sentinel marks the start and what it does not reach."""
        vertex = self._known(vertex_idx, "non-negative")
        tree = bfs.bfs_tree(self._laid_out(), vertex).select(F.col("v").alias("vertex_idx"), "pred")
        self._links = None
        if path_tracking:
            self._link(tree, "pred")
        one = self._full(tree).select("vertex_idx", F.coalesce("pred", F.lit(self._sentinel)).cast("int").alias("predecessor"))
        if return_series:
            return one.orderBy("vertex_idx").toPandas().set_index("vertex_idx")["predecessor"]
        return _as_array(one, "vertex_idx", "predecessor", np.int32) if return_array else one

    def reorder(self, vertex_idx: int) -> DataFrame:
        """``(vertex_idx, new_idx)``: the order in which a queue visits the vertices, unreached ones last."""
        return bfs.bfs_reorder(self._laid_out(), self._known(vertex_idx, "non-negative"), self._n_vertices)


class HyperpathGenerating:
    """Optimal strategies to a destination in a transit network, and the volumes that demand puts on its edges.

    Parallel edges are lines of their own and stay apart.  Edges are numbered in table order unless they have an
    ``edge_idx`` column.
    """

    #: Edges of a block, see :mod:`hopflux.operators.blocks`.
    block_edges = blocks.BLOCK_EDGES

    def __init__(self, edges, tail: str = "tail", head: str = "head", trav_time: str = "trav_time", freq: str = "freq", check_edges: bool = False, orientation: str = "in"):
        if orientation not in ("in", "out"):
            raise AssertionError("orientation should be either 'in' or 'out'")
        names = {"tail": tail, "head": head, "trav_time": trav_time, "freq": freq}
        frame = _checked_frame(edges, names, "edge_idx") if check_edges else to_spark(edges, [*names.values(), "edge_idx"])
        if check_edges:
            _validate(frame, names, no_negative=["trav_time", "freq"])
        for name in names.values():
            if name not in frame.columns:
                raise KeyError(f"edge column '{name}' not found in graph edges dataframe")
        given = frame.select(*(["edge_idx"] if "edge_idx" in frame.columns else []), *(F.col(f"`{n}`").cast(ROLES[r]).alias(r) for r, n in names.items()))
        self._edges = save(ops.clamped_edges(ops.with_edge_idx(given)), "edges")
        self._orientation = orientation
        self.edge_count = self._edges.count()
        self.vertex_count = ops.vertex_count(self._edges)
        #: (vertex_idx, u_i) and (edge_idx, tail, head, trav_time, freq, volume) of the last run.
        self.u_i_vec: DataFrame | None = None
        self._layout: blocks.Layout | None = None
        self.edges: DataFrame = self._edges.withColumn("volume", F.lit(0.0))

    def close(self) -> None:
        """Let go of what is kept in memory; a later query prepares it again."""
        if self._layout:
            self._layout.close()
        self._layout = None

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def run(self, origin, destination: int, volume, return_inf: bool = False) -> None:
        """Assign ``volume`` from ``origin`` (numbers, or lists of equal length) to ``destination``.

        Of a repeated origin the last volume counts; an origin that cannot reach the destination loads nothing.
        """
        if self._orientation == "out":
            raise NotImplementedError("one-to-all assignment is not implemented; use orientation 'in'")
        origins = list(origin) if isinstance(origin, (list, tuple, np.ndarray)) else [origin]
        volumes = list(volume) if isinstance(volume, (list, tuple, np.ndarray)) else [volume]
        assert len(origins) == len(volumes), "as many volumes as origins are needed"
        for v in [*origins, destination]:
            assert isinstance(v, (int, np.integer)) and not isinstance(v, bool) and 0 <= v < self.vertex_count, f"vertex {v} is not valid"
        assert all(isinstance(v, (float, np.floating)) and v >= 0.0 for v in volumes), "volumes must be floats that are not negative"
        assert isinstance(return_inf, bool)
        if self._layout is None:
            self._layout = hyperpath.lay_out_lines(self._edges, self.edge_count, self.block_edges)
        times, chosen, loaded = hyperpath.assign(self._layout, int(destination), self.vertex_count, list(zip(origins, volumes, strict=True)))
        every = ops.dense(times.select(F.col("v").alias("vertex_idx"), "u"), self.vertex_count)
        self.u_i_vec = every.select("vertex_idx", or_infinity(F.col("u"), return_inf).alias("u_i"))
        self.chosen = chosen.select("edge_idx")
        self.edges = self._edges.join(loaded, "edge_idx", "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def _checked_frame(edges, names: dict[str, str], *more: str) -> DataFrame:
    """A frame to validate; anything that is no table is refused."""
    import pandas as pd
    import pyarrow as pa

    if not isinstance(edges, (DataFrame, pd.DataFrame, pa.Table)) and type(edges).__module__.split(".")[0] != "polars":
        raise TypeError("edges should be a pandas DataFrame (or a Spark, Arrow or Polars one)")
    return to_spark(edges, [*names.values(), *more])
