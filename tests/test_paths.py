"""Engines on small graphs with known answers."""

import heapq
import math
import random
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopflux import BFS, INF, BellmanFord, Dijkstra, HyperpathGenerating
from hopflux.sources import GraphImporter, SiouxFalls, create_sf_network, edge_frame, generate_random_network, grid_network, read_edges, sioux_falls, standardize_graph_dataframe, transit_example

INFINITY = float("inf")


def graph(*edges, columns=("tail", "head", "weight")):
    return pd.DataFrame([dict(zip(columns, e)) for e in edges], columns=list(columns))


BRAESS = graph((0, 1, 1.0), (0, 2, 2.0), (1, 2, 0.0), (1, 3, 2.0), (2, 3, 1.0))
README = graph((0, 1, 1.0), (0, 2, 4.0), (1, 2, 2.0), (2, 3, 1.5), (2, 4, 3.0), (3, 4, 1.0))


def plain_dijkstra(edges, source, n):
    best, out = {}, {}
    for t, h, w in edges:
        out.setdefault(t, []).append((h, w))
    queue = [(0.0, source)]
    while queue:
        d, v = heapq.heappop(queue)
        if v not in best:
            best[v] = d
            for h, w in out.get(v, []):
                heapq.heappush(queue, (d + w, h))
    return [best.get(v, INFINITY) for v in range(n)]


@pytest.mark.parametrize("orientation, vertex, want", [("out", 0, [0, 1, 1, 2]), ("out", 2, [INFINITY, INFINITY, 0, 1]), ("in", 3, [2, 1, 1, 0]), ("in", 2, [1, 0, 0, INFINITY])])
def test_braess(spark, orientation, vertex, want):
    assert Dijkstra(BRAESS, orientation=orientation).run(vertex, return_array=True).tolist() == want


def test_readme_graph_with_paths(spark):
    engine = Dijkstra(README, check_edges=True, lazy=False)
    assert (engine.n_edges, engine.n_vertices, engine.orientation, engine.permute, engine.lazy) == (6, 5, "out", False, False)
    assert [r[0] for r in engine.get_vertices().collect()] == [0, 1, 2, 3, 4]
    assert engine.run(0, path_tracking=True, return_array=True).tolist() == [0, 1, 3, 4.5, 5.5]
    assert engine.get_path(4).tolist() == [4, 3, 2, 1, 0]
    paths = {r["target"]: r["path"] for r in engine.get_paths().collect()}
    assert paths == {0: [0], 1: [1, 0], 2: [2, 1, 0], 3: [3, 2, 1, 0], 4: [4, 3, 2, 1, 0]}
    got = engine.run(0, termination_nodes=[3, 1, 3])
    assert [tuple(r) for r in got.collect()] == [(0, 3, 4.5), (1, 1, 1.0), (2, 3, 4.5)]
    with pytest.warns(UserWarning):
        assert engine.get_path(4) is None


def test_unreached_vertices(spark):
    engine = Dijkstra(README, orientation="in")
    assert engine.run(0, return_array=True, path_tracking=True).tolist() == [0] + [INFINITY] * 4
    assert engine.get_path(3).tolist() == [3]
    assert engine.run(0, return_inf=False, return_array=True).tolist() == [0] + [INF] * 4


def test_sparse_ids(spark):
    sparse = BRAESS.assign(tail=BRAESS["tail"] * 10, head=BRAESS["head"] * 10)
    want = {0: 0, 10: 1, 20: 1, 30: 2}
    engine = Dijkstra(sparse, permute=True)
    assert engine.n_vertices == 4
    assert engine.run(0, path_tracking=True, return_series=True).to_dict() == want
    assert engine.get_path(30).tolist() == [30, 20, 10, 0]
    full = Dijkstra(sparse).run(0, return_array=True)
    assert len(full) == 31 and {i: d for i, d in enumerate(full) if d < INFINITY} == want
    assert engine.run(0, termination_nodes=[30, 10], return_array=True).tolist() == [2, 1]
    with pytest.raises(ValueError, match="not found"):
        engine.run(5)
    with pytest.raises(ValueError, match="not found"):
        engine.run(0, termination_nodes=[5])


def test_parallel_edges_loops_and_missing_ends(spark, capsys):
    edges = pd.DataFrame({"tail": [0, 0, 1, 1, None], "head": [1, 1, 2, 1, 2], "weight": [5.0, 3.0, 2.0, 1.0, 1.0]})
    edges = edges.astype({"tail": "Int64"})
    engine = Dijkstra(edges, verbose=True)
    assert "1 parallel edge(s) removed" in capsys.readouterr().out
    assert engine.n_edges == 3 and engine.run(0, return_array=True).tolist() == [0, 3, 5]


def test_empty_table(spark):
    none = pd.DataFrame({"tail": np.array([], np.int64), "head": np.array([], np.int64), "weight": np.array([], float)})
    for engine in (Dijkstra(none), BellmanFord(none), BFS(none)):
        assert (engine.n_edges, engine.n_vertices) == (0, 0)
        with pytest.raises(ValueError, match="not found"):
            engine.run(0)


def test_random_graph_against_a_heap(spark):
    rng = random.Random(124)
    edges = list({(rng.randrange(60), rng.randrange(60)): rng.random() for _ in range(300)}.items())
    rows = [(t, h, w) for (t, h), w in edges]
    frame = graph(*rows)
    n = max(max(t, h) for t, h, _ in rows) + 1
    want = plain_dijkstra(rows, 3, n)
    engine = Dijkstra(frame)
    assert np.allclose(engine.run(3, return_array=True, path_tracking=True), want)
    weight = {(t, h): w for t, h, w in rows}
    for r in engine.get_paths().collect():
        hops = r["path"][::-1]
        if want[r["target"]] < INFINITY:
            assert hops[0] == 3 and np.isclose(sum(weight[x] for x in zip(hops, hops[1:])), want[r["target"]])
    assert np.allclose(BellmanFord(frame).run(3, return_array=True), want)
    back = Dijkstra(graph(*((h, t, w) for t, h, w in rows)), orientation="in").run(3, return_array=True)
    assert np.allclose(back, want)
    some = [1, 7, 30]
    assert np.allclose(engine.run(3, termination_nodes=some, return_array=True), [want[x] for x in some])
    many = {(r["source"], r["vertex_idx"]): r["path_length"] for r in engine.run_many([3, 5]).collect()}
    both = plain_dijkstra(rows, 5, n)
    assert all(np.isclose(many.get((s, v), INFINITY), w[v]) or w[v] == many.get((s, v), INFINITY) for s, w in ((3, want), (5, both)) for v in range(n))


@pytest.mark.parametrize("block_edges", [20])
def test_many_small_blocks(spark, monkeypatch, block_edges):
    """A hub with more edges than a block holds, vertices without edges out, zero weights; several sources; either direction."""
    monkeypatch.setattr(Dijkstra, "block_edges", block_edges)
    rng = random.Random(block_edges)
    best = {(7, h): float(rng.randrange(5)) for h in range(30)}
    best |= {(rng.randrange(30), rng.randrange(40)): float(rng.randrange(4)) for _ in range(60)}
    rows = [(t, h, w) for (t, h), w in best.items()]
    n = max(max(t, h) for t, h, _ in rows) + 1
    engine = Dijkstra(graph(*rows))
    got = engine.run(3, return_array=True, path_tracking=True)
    assert got.tolist() == plain_dijkstra(rows, 3, n)
    for r in engine.get_paths().collect():
        hops = r["path"][::-1]
        assert hops == [r["target"]] or sum(best[x] for x in zip(hops, hops[1:])) == got[r["target"]]
    many = {(r["source"], r["vertex_idx"]): r["path_length"] for r in engine.run_many([7, 3, 39]).collect()}
    assert all(many.get((s, v), INFINITY) == d for s in (7, 3, 39) for v, d in enumerate(plain_dijkstra(rows, s, n)))
    assert Dijkstra(graph(*((h, t, w) for t, h, w in rows)), orientation="in").run(3, return_array=True).tolist() == got.tolist()
    reached = [v for v in range(n) if got[v] < INFINITY]
    assert engine.run(3, termination_nodes=reached[-3:], return_array=True).tolist() == got[reached[-3:]].tolist()
    engine.close()
    assert engine.run(3, return_array=True).tolist() == got.tolist()


def test_chain_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(BellmanFord, "block_edges", 100)
    chain = [(i, i + 1, -1.0) for i in range(999)]
    with BellmanFord(graph(*chain)) as engine:
        assert engine.run(0, return_array=True).tolist() == [-float(i) for i in range(1000)]
    with BellmanFord(graph(*chain, (999, 0, 998.0))) as engine, pytest.raises(ValueError, match="Negative cycle"):
        engine.run(500)
    with BellmanFord(graph(*chain, (999, 0, 999.0))) as engine:
        assert engine.run(0, return_array=True)[999] == -999.0


def test_negative_weights(spark):
    engine = BellmanFord(graph((0, 1, 1.0), (0, 2, 4.0), (1, 2, -2.0), (1, 3, 5.0), (2, 3, 1.0), (3, 4, 3.0)))
    assert engine.run(0, path_tracking=True, return_array=True).tolist() == [0, 1, -1, 0, 3]
    assert engine.get_path(4).tolist() == [4, 3, 2, 1, 0] and not engine.has_negative_cycle()


CYCLE = [(0, 1, 1.0), (1, 2, -2.0), (2, 0, -1.0), (2, 3, 1.0)]


@pytest.mark.parametrize("block_edges", [2, 1 << 20])
@pytest.mark.parametrize("edges, orientation, vertex", [(CYCLE, "out", 0), (CYCLE, "in", 3), ([(0, 0, -1.0)], "out", 0), ([(0, 1, 1.0), (1, 2, -3.0), (2, 3, 1.0), (3, 1, -1.0), (4, 5, 2.0), (4, 0, -5.0), (5, 4, -3.0)], "in", 5)])
def test_negative_cycle_raises(spark, monkeypatch, edges, orientation, vertex, block_edges):
    monkeypatch.setattr(BellmanFord, "block_edges", block_edges)
    engine = BellmanFord(graph(*edges), orientation=orientation)
    with pytest.raises(ValueError, match="Negative cycle"):
        engine.run(vertex)
    assert engine.has_negative_cycle()
    assert len(engine.run(vertex, detect_negative_cycles=False, return_array=True)) == engine.n_vertices
    assert not engine.has_negative_cycle()


def test_negative_cycle_out_of_reach(spark):
    engine = BellmanFord(graph((0, 1, 1.0), (1, 2, -1.0), (2, 0, -2.0), (10, 11, 5.0), (11, 12, 3.0)), orientation="in")
    got = engine.run(12, return_array=True)
    assert got[12] == 0 and got[0] == INFINITY


def plain_bfs(edges, start, n):
    out = {}
    for t, h in sorted(set(edges)):
        out.setdefault(t, []).append(h)
    pred, queue = [-9999] * n, [start]
    seen = {start}
    for v in queue:
        for h in out.get(v, []):
            if h not in seen:
                seen.add(h)
                pred[h] = v
                queue.append(h)
    return pred, queue + [v for v in range(n) if v not in seen]


def test_bfs_follows_queue_order(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(150)]
    n = max(map(max, edges)) + 1
    want, order = plain_bfs(edges, 4, n)
    engine = BFS(graph(*edges, columns=("tail", "head")), check_edges=True)
    assert engine.run(4, return_array=True).tolist() == want
    assert [r[0] for r in engine.reorder(4).orderBy("new_idx").collect()] == order
    back, _ = plain_bfs([(h, t) for t, h in edges], 4, n)
    assert BFS(graph(*edges, columns=("tail", "head")), orientation="in").run(4, return_array=True).tolist() == back


@pytest.mark.parametrize("one_pass", [1, 1_000_000])
def test_bfs_in_small_blocks(spark, monkeypatch, one_pass):
    """Deep trees over many blocks: keys are replaced by ranks on the way, of many or of few."""
    from hopflux.operators import bfs

    monkeypatch.setattr(BFS, "block_edges", 25)
    monkeypatch.setattr(bfs, "ONE_PASS", one_pass)
    monkeypatch.setattr(bfs, "STEPS", 3)
    rng = random.Random(6)
    edges = list({(i, min(70, max(0, i + rng.choice([-2, -1, 1, 2, 3])))) for i in range(70) for _ in range(3)} | {(5, h) for h in range(40, 45)})
    n = max(map(max, edges)) + 1
    want, order = plain_bfs(edges, 4, n)
    engine = BFS(graph(*edges, columns=("tail", "head")))
    assert engine.run(4, return_array=True).tolist() == want
    assert [r[0] for r in engine.reorder(4).orderBy("new_idx").collect()] == order


def test_bfs_of_a_chain(spark, monkeypatch):
    """A thousand levels, in as many rounds as the chain has blocks, or about."""
    monkeypatch.setattr(BFS, "block_edges", 300)
    chain = [(i, i + 1) for i in range(1000)]
    start = time.time()
    assert BFS(graph(*chain, columns=("tail", "head"))).run(0, return_array=True).tolist() == [-9999, *range(1000)]
    assert time.time() - start < 60


def test_bfs_details(spark):
    line = BFS(graph((0, 1), (1, 2), (2, 3), (5, 6), columns=("tail", "head")), sentinel=-1)
    assert line.run(0, path_tracking=True, return_array=True).tolist() == [-1, 0, 1, 2, -1, -1, -1]
    assert line.get_path(3).tolist() == [3, 2, 1, 0] and line.get_path(6).tolist() == [6]
    assert BFS.UNREACHABLE == -9999
    with pytest.raises(ValueError, match="must be non-negative"):
        line.run(-1)


@pytest.mark.parametrize("sentinel, error", [(0, ValueError), (1, ValueError), (-9999.5, TypeError), (-(10**15), ValueError)])
def test_bfs_sentinel(spark, sentinel, error):
    with pytest.raises(error):
        BFS(graph((0, 1), columns=("tail", "head")), sentinel=sentinel)


@pytest.mark.parametrize(
    "edges, error, text",
    [
        ([[0, 1, 1.0]], TypeError, "pandas DataFrame"),
        (README.rename(columns={"head": "to"}), KeyError, "not found in graph edges dataframe"),
        (README.assign(weight=[1, None, 1, 1, 1, 1]), ValueError, "missing value"),
        (README.assign(tail=README["tail"].astype(float)), TypeError, "should be of integer type"),
        (README.assign(weight=list("abcdef")), TypeError, "should be of numeric type"),
        (README.assign(weight=-1.0), ValueError, "nonnegative"),
        (README.assign(weight=INFINITY), ValueError, "should be finite"),
    ],
)
def test_checks(spark, edges, error, text):
    with pytest.raises(error, match=text):
        Dijkstra(edges, check_edges=True)


def test_arguments(spark):
    engine = Dijkstra(README)
    for bad, error in ((dict(vertex_idx=-1), ValueError), (dict(vertex_idx=99), ValueError), (dict(vertex_idx=0, heap_length_ratio=1), TypeError), (dict(vertex_idx=0, heap_length_ratio=0.0), ValueError), (dict(vertex_idx=0, termination_nodes=[]), ValueError), (dict(vertex_idx=0, termination_nodes=[[1]]), ValueError), (dict(vertex_idx=0, termination_nodes=["a"]), TypeError), (dict(vertex_idx=0, termination_nodes=[9]), ValueError)):
        with pytest.raises(error):
            engine.run(**bad)
    with pytest.raises(ValueError, match="orientation"):
        Dijkstra(README, orientation="up")


def test_transit_example(spark):
    edges, _ = transit_example(spark)
    engine = HyperpathGenerating(edges, check_edges=True)
    engine.run(0, 12, 1.0)
    got = engine.edges.join(edges.select("edge_idx", "volume_ref"), "edge_idx").toPandas()
    assert np.allclose(got["volume"], got["volume_ref"], atol=1e-6)
    u = engine.u_i_vec.orderBy("vertex_idx").toPandas()["u_i"]
    assert np.allclose(u, [1665, 1470, 1500, 1144.28572, 480, 1050, 1050, 690, 600, 240, 240, 690, 0, 0, 0, 0], rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("freqs", [(2.0, 1.0)])
def test_parallel_lines_share(spark, freqs):
    edges = pd.DataFrame({"tail": [0, 0], "head": [1, 1], "trav_time": [1.0, 1.0], "freq": list(freqs)})
    engine = HyperpathGenerating(edges)
    engine.run([0], 1, [1.0])
    assert np.allclose(engine.edges.orderBy("edge_idx").toPandas()["volume"], [2 / 3, 1 / 3])


@pytest.mark.parametrize("first, times", [(INFINITY, [5.0, 302.5, 0.0]), (2 / 600, [305.0, 302.5, 0.0])])
def test_dwelling_and_changing(spark, first, times):
    edges = pd.DataFrame({"tail": [0, 0, 1], "head": [2, 1, 2], "trav_time": [5.0, 2.5, 2.5], "freq": [first, INFINITY, 2 / 600]})
    engine = HyperpathGenerating(edges)
    engine.run(0, 2, 1.0)
    assert np.allclose(engine.edges.orderBy("edge_idx").toPandas()["volume"], [1, 0, 0])
    assert np.allclose(engine.u_i_vec.orderBy("vertex_idx").toPandas()["u_i"], times)


@pytest.mark.parametrize("block_edges", [7, 1 << 20])
def test_strategies_in_blocks(spark, monkeypatch, block_edges):
    """A stop with more lines than a block holds, lines of no waiting, several origins: small blocks change nothing."""
    rng = random.Random(9)
    rows = [(0, rng.choice([1, 2]), rng.uniform(1, 30), rng.uniform(0.01, 0.3)) for _ in range(40)] + [(1, 2, 5.0, 0.1), (1, 3, 9.0, INFINITY), (2, 3, 4.0, 0.2), (3, 0, 1.0, 1.0)]
    rows += [(rng.randrange(4, 12), rng.randrange(12), rng.uniform(1, 9), rng.uniform(0.05, 1)) for _ in range(40)]
    monkeypatch.setattr(HyperpathGenerating, "block_edges", block_edges)
    with HyperpathGenerating(pd.DataFrame(rows, columns=["tail", "head", "trav_time", "freq"])) as engine:
        engine.run([0, 5, 7, 5], 3, [1.0, 9.0, 2.0, 4.0])
        volume = engine.edges.orderBy("edge_idx").toPandas()["volume"].to_numpy()
        u = engine.u_i_vec.orderBy("vertex_idx").toPandas()["u_i"].to_numpy()
    flow = {0: 1.0, 5: 4.0, 7: 2.0}
    for v in range(12):
        if v != 3 and u[v] < INF:
            out = sum(volume[i] for i, r in enumerate(rows) if r[0] == v)
            assert np.isclose(out, flow.get(v, 0.0) + sum(volume[i] for i, r in enumerate(rows) if r[1] == v))
    assert np.isclose(sum(volume[i] for i, r in enumerate(rows) if r[1] == 3), 7.0)
    for v in range(12):  # a stop's time is the best of its options in rising order
        options = sorted((u[h] + t, min(q, 1e20)) for a, h, t, q in rows if a == v and u[h] < INF)
        if v != 3 and options:
            best, known, f = INF, 1.0, 0.0
            for t, q in options:
                if best >= t:
                    known, f = known + q * t, f + q
                    best = known / f
            assert np.isclose(u[v], best)


def test_chain_of_stops(spark, monkeypatch):
    """A thousand stops one after another, over several blocks."""
    monkeypatch.setattr(HyperpathGenerating, "block_edges", 300)
    rows = [(i, i + 1, 1.0, 0.5) for i in range(1000)]
    start = time.time()
    with HyperpathGenerating(pd.DataFrame(rows, columns=["tail", "head", "trav_time", "freq"])) as engine:
        engine.run(0, 1000, 2.0)
        assert engine.edges.agg({"volume": "min"}).first()[0] == engine.edges.agg({"volume": "max"}).first()[0] == 2.0
        assert np.allclose(engine.u_i_vec.orderBy("vertex_idx").toPandas()["u_i"], [3.0 * (1000 - i) for i in range(1001)])
    assert time.time() - start < 60


def test_times_are_passed_on_when_final(spark, monkeypatch):
    """Stops with many lines between blocks: times are passed on nearest first, so hardly any more than once, and rounds may leave some to the next."""
    from hopflux.operators import hyperpath, rounds

    monkeypatch.setattr(hyperpath, "FEW", 20, raising=False)
    rng, n, made = random.Random(17), 400, []
    rows = [(rng.randrange(n), rng.randrange(n), float(rng.randint(1, 50)), rng.choice([0.02, 0.05, 0.12])) for _ in range(8000)]
    begin = rounds.Rounds.__init__
    monkeypatch.setattr(rounds.Rounds, "__init__", lambda self, *a: (begin(self, *a), made.append(self))[0])
    got = []
    for block_edges in (10_000, 1_500):
        with HyperpathGenerating(pd.DataFrame(rows, columns=["tail", "head", "trav_time", "freq"])) as engine:
            engine.block_edges = block_edges
            engine.run(5, 1, 1.0)
            got.append((engine.u_i_vec.orderBy("vertex_idx").toPandas()["u_i"], engine.edges.orderBy("edge_idx").toPandas()["volume"]))
    (one, one_volumes), (several, volumes) = got
    assert np.allclose(one, several, rtol=1e-12) and np.allclose(one_volumes, volumes)
    assert math.isclose(volumes[[t == 5 for t, *_ in rows]].sum(), 1.0)
    for each in made:
        assert each.written <= 3 * n


def test_readers_are_listed_once(spark):
    """Which blocks have edges to a vertex is told once for each block, however the rows of its edges come."""
    from hopflux.operators.blocks import Block
    from hopflux.operators.hyperpath import lay_out_lines

    rows = [(v % 40, 0, 1.0, 1.0, v) for v in range(400)]
    edges = spark.createDataFrame(rows, "tail long, head long, trav_time double, freq double, edge_idx long").repartition(8)
    layout = lay_out_lines(edges, 400, 100)
    found = [Block(pa.Table.from_pylist([r.asDict()]), r["block"]) for r in layout.table.collect()]
    pairs = [(b.key, int(v), int(k)) for b in found for v, k in zip(b.back_v, b.back_block)]
    assert len(found) > 1 and len(pairs) == len(set(pairs)) == len(found) - 1
    assert sorted(int(e) for b in found for e in b.edge_idx) == list(range(400))
    layout.close()


def test_stops_that_choose_each_other(spark):
    """Lines without waiting or travel time between two stops: volumes still end."""
    rows = [(0, 1, 0.0, INFINITY), (1, 0, 0.0, INFINITY), (1, 2, 5e8, 0.1), (0, 2, 5e8, 0.1)]
    with HyperpathGenerating(pd.DataFrame(rows, columns=["tail", "head", "trav_time", "freq"])) as engine:
        engine.run(0, 2, 1.0)
        assert engine.edges.agg({"volume": "sum"}).first()[0] >= 1.0


def test_hyperpath_arguments_and_unreached(spark):
    edges = pd.DataFrame({"tail": [0, 2], "head": [1, 3], "trav_time": [1.0, 1.0], "freq": [1.0, 1.0]})
    engine = HyperpathGenerating(edges)
    engine.run([2, 0, 0], 1, [5.0, 9.0, 1.0])
    assert engine.edges.orderBy("edge_idx").toPandas()["volume"].tolist() == [1.0, 0.0]
    assert engine.u_i_vec.orderBy("vertex_idx").toPandas()["u_i"].tolist()[2:] == [INF, INF]
    with pytest.raises(NotImplementedError):
        HyperpathGenerating(edges, orientation="out").run(0, 1, 1.0)
    with pytest.raises(AssertionError):
        HyperpathGenerating(edges, orientation="x")
    for bad in ((0, 9, 1.0), (0, 1, -1.0), ([0, 2], 1, [1.0]), (0.5, 1, 1.0)):
        with pytest.raises(AssertionError):
            engine.run(*bad)


def test_equal_options_that_rounding_sets_apart(spark):
    """A line as good as waiting for the other one is taken, also where 1 / freq + time comes out a little smaller."""
    freq, time = next((f / 100, float(t)) for f in (2, 4, 5, 10) for t in range(1, 50) if (1.0 + f / 100 * t) / (f / 100) < t + 100 // f)
    other = time + round(1 / freq)
    with HyperpathGenerating(graph((0, 1, time, freq), (0, 1, other, freq), columns=("tail", "head", "trav_time", "freq"))) as engine:
        engine.run(0, 1, 1.0)
        assert sorted(r["edge_idx"] for r in engine.chosen.collect()) == [0, 1]
        assert [r["volume"] for r in engine.edges.orderBy("edge_idx").collect()] == [0.5, 0.5]
        assert engine.u_i_vec.where("vertex_idx = 0").first()["u_i"] == pytest.approx(other)


def test_work_tables_belong_to_their_scope(spark):
    from hopflux.plans.work import save, scope

    outer = save(spark.range(3).toDF("x"), "outer")
    with scope() as own:
        inner = save(spark.range(4).toDF("x"), "inner")
    assert inner.count() == 4
    own.free()
    with pytest.raises(Exception, match="(?i)not_exist|not exist"):
        inner.collect()
    assert outer.count() == 3


def test_inputs_of_every_kind(spark, tmp_path):
    small = README.astype({"tail": "uint32", "head": "uint32", "weight": "float32"})
    kinds = [small, README.convert_dtypes(dtype_backend="pyarrow"), pa.Table.from_pandas(README), spark.createDataFrame(README), README.assign(extra="x", head=README["head"].astype("int64[pyarrow]"))]
    for edges in kinds:
        assert np.allclose(Dijkstra(edges, check_edges=True).run(0, return_array=True), [0, 1, 3, 4.5, 5.5])
    with pytest.warns(UserWarning):
        assert Dijkstra(README.to_dict("list")).n_edges == 6
    renamed = README.rename(columns={"tail": "from", "head": "to", "weight": "cost"})
    assert Dijkstra(renamed, tail="from", head="to", weight="cost").run(0, return_array=True)[4] == 5.5
    renamed.to_parquet(tmp_path / "e.parquet")
    loaded = read_edges(str(tmp_path / "e.parquet"), spark, tail="from", head="to", weight="cost")
    assert loaded.columns == ["tail", "head", "weight"] and loaded.count() == 6
    with pytest.raises(KeyError):
        edge_frame(renamed, tail="nowhere")
    assert standardize_graph_dataframe(renamed, "from", "to", trav_time="cost").dtypes == [("tail", "bigint"), ("head", "bigint"), ("trav_time", "double")]


def test_polars_input(spark):
    pl = pytest.importorskip("polars")
    assert Dijkstra(pl.from_pandas(README)).n_edges == 6


def test_generator_and_road_network(spark):
    a, b = (generate_random_network(n_edges=50, n_verts=9, seed=3).collect() for _ in range(2))
    assert a == b and len(a) == 50 and all(0 <= r["tail"] < 9 and 0 <= r["weight"] < 1 for r in a)
    signed = generate_random_network(n_edges=40, allow_negative_weights=True, negative_weight_ratio=0.25).collect()
    assert sum(r["weight"] < 0 for r in signed) == 10
    for bad in (dict(negative_weight_ratio=2.0), dict(negative_weight_ratio=float("nan")), dict(weight_range=(1.0, 0.5))):
        with pytest.raises(ValueError):
            generate_random_network(**bad)
    assert np.isclose(create_sf_network().agg({"volume_ref": "sum"}).first()[0], 5.0, atol=1)
    assert SiouxFalls().edges.count() == 76
    importer = GraphImporter.from_dataframe(README, weight="weight")
    assert importer.to_numpy_edges(["tail", "weight"]).shape == (6, 2)
    roads = sioux_falls(spark)
    assert roads.count() == 76 and Dijkstra(roads, weight="trav_time").n_vertices == 24
    rows = [(r["tail"], r["head"], r["trav_time"]) for r in roads.collect()]
    assert np.allclose(Dijkstra(roads, weight="trav_time").run(0, return_array=True), plain_dijkstra(rows, 0, 24))


def test_grid(spark, monkeypatch):
    monkeypatch.setattr(Dijkstra, "block_edges", 60)
    rows = [tuple(r) for r in grid_network(7, 9, spark=spark).collect()]
    assert len(rows) == 2 * (6 * 9 + 7 * 8) and all(1 <= w < 2 for _, _, w in rows)
    with Dijkstra(grid_network(7, 9)) as engine:
        assert np.allclose(engine.run(31, return_array=True), plain_dijkstra(rows, 31, 63))


def test_blocks_of_neighbours(spark, monkeypatch):
    """A grid whose crossings have lost their order needs about as many rounds as one in order, once neighbours are found."""
    from hopflux.operators import blocks, locality, shortest_path

    monkeypatch.setattr(locality, "SMALL", 4000)
    side, n = 120, 14_400
    shuffled = list(range(n))
    random.Random(4).shuffle(shuffled)
    grid = [tuple(r) for r in grid_network(side, side, spark=spark).collect()]
    lost = [(shuffled[t], shuffled[h], w) for t, h, w in grid]
    rounds = {}
    for name, rows, source in (("ordered", grid, 7260), ("found", lost, shuffled[7260])):
        frame = spark.createDataFrame(pd.DataFrame(rows, columns=["tail", "head", "weight"]))
        order = locality.local_order(frame) if name == "found" else None
        if order is not None:
            placed = order.collect()
            assert sorted(r["place"] for r in placed) == list(range(n)) == sorted(r["v"] for r in placed)
        layout = blocks.lay_out(frame, len(rows), 12_000, order=order, halo=4 if order is not None else 0)
        report = {}
        got = {r["v"]: r["d"] for r in shortest_path.shortest_paths(layout, [source], n, track=True, report=report).collect()}
        want = plain_dijkstra(rows, source, n)
        assert all(np.isclose(got[v], want[v]) for v in range(n))
        rounds[name] = report["rounds"]
        layout.close()
    assert rounds["found"] <= 3 * rounds["ordered"], rounds  # on 300 by 300 in eight blocks 10 against 7


def test_order_by_neighbours_of_odd_graphs(spark, monkeypatch):
    """Loops, vertices apart, a hub and negative weights: labels and links do not depend on how blocks are cut."""
    from hopflux.operators import locality

    monkeypatch.setattr(locality, "SMALL", 5)
    rng = random.Random(8)
    best = {(7, h): float(rng.randrange(1, 5)) for h in range(30)}
    best |= {(rng.randrange(30), rng.randrange(40)): float(rng.randrange(1, 4)) for _ in range(60)} | {(3, 3): 1.0, (50, 51): 2.0, (60, 60): 1.0}
    rows = [(t, h, w) for (t, h), w in best.items()]
    for order in ("ids", "neighbours"):
        with Dijkstra(graph(*rows)) as engine:
            engine.block_edges, engine.block_order = 20, order
            assert engine.run(3, return_array=True, path_tracking=True).tolist() == plain_dijkstra(rows, 3, 61)
            links = [tuple(r) for r in engine.path_links.orderBy("vertex_idx").collect()]
        if order == "ids":
            first = links
    assert links == first
    with BFS(graph(*((t, h) for t, h, _ in rows), columns=("tail", "head"))) as engine:
        engine.block_edges, engine.block_order = 20, "neighbours"
        assert engine.run(3, return_array=True).tolist() == plain_bfs([(t, h) for t, h, _ in rows], 3, 61)[0]


def test_layout_on_disk(spark, tmp_path):
    """A written layout answers again; unless it is kept in memory, a round reads the partitions of its own blocks."""
    from hopflux.operators import blocks, shortest_path

    rows = [tuple(r) for r in grid_network(9, 9, spark=spark).collect()] + [(40, h, 1.5) for h in range(60)]
    best = {}
    for t, h, w in rows:
        best[t, h] = min(w, best.get((t, h), w))
    rows = [(t, h, w) for (t, h), w in best.items()]
    layout = blocks.lay_out(spark.createDataFrame(rows, "tail long, head long, weight double"), len(rows), 50)
    assert layout.ranges.spread
    layout.write(str(tmp_path / "streets"))
    layout.close()
    want = plain_dijkstra(rows, 3, 81)
    for keep in (True, False):
        again = blocks.open_layout(spark, str(tmp_path / "streets"), keep)
        got = {r["v"]: r["d"] for r in shortest_path.shortest_paths(again, [3], 81).collect()}
        assert all(np.isclose(got[v], want[v]) for v in range(81))
    one = again.table.where(F.col("block").isin([int(again.ranges.keys[0])]))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block", plan)


def test_windows(spark):
    """With a window labels are the same, and blocks do not follow what later turns out too long."""
    from hopflux.operators import blocks, shortest_path

    rows = [tuple(r) for r in grid_network(12, 12, spark=spark).collect()]
    layout = blocks.lay_out(spark.createDataFrame(rows, "tail long, head long, weight double"), len(rows), 90)
    want = plain_dijkstra(rows, 70, 144)
    for window in (None, 4.0):
        got = {r["v"]: r["d"] for r in shortest_path.shortest_paths(layout, [70], 144, window=window).collect()}
        assert all(np.isclose(got[v], want[v]) for v in range(144))
    some = {r["v"]: r["d"] for r in shortest_path.shortest_paths(layout, [70], 144, targets=[71, 58], window=2.0).collect()}
    assert np.isclose(some[71], want[71]) and np.isclose(some[58], want[58]) and len(some) < 144
    layout.close()


def test_landmarks(spark, tmp_path):
    """Searches that head for targets find the same labels on the way and write fewer; also from a layout on disk."""
    from hopflux.operators import blocks
    from hopflux.operators.landmarks import with_landmarks
    from hopflux.operators.shortest_path import shortest_paths

    side = 30
    rows = [tuple(r) for r in grid_network(side, side, spark=spark).collect()]
    edges = spark.createDataFrame(rows, "tail long, head long, weight double")
    plain = blocks.lay_out(edges, len(rows), 500)
    aware = with_landmarks(blocks.lay_out(edges, len(rows), 500), side * side, 2)
    assert with_landmarks(aware, side * side) is aware
    aware.write(str(tmp_path / "aware"))
    again = blocks.open_layout(spark, str(tmp_path / "aware"))
    source = side * 15 + 5
    want = plain_dijkstra(rows, source, side * side)
    target, reports = side * 16 + 13, {}
    for name, layout in (("plain", plain), ("aware", aware), ("again", again)):
        reports[name] = {}
        got = {r["v"]: r for r in shortest_paths(layout, [source], side * side, track=True, targets=[target], report=reports[name]).collect()}
        assert math.isclose(got[target]["d"], want[target], rel_tol=1e-12)
        v, total = target, 0.0
        weights = {(t, h): w for t, h, w in rows}
        while v != source:
            total += weights[got[v]["pred"], v]
            v = got[v]["pred"]
        assert math.isclose(total, want[target], rel_tol=1e-12)
    assert reports["aware"]["written"] < 0.7 * reports["plain"]["written"] and reports["again"] == reports["aware"], reports
    several = [target, 3, source, target]
    got = {r["v"]: r["d"] for r in shortest_paths(aware, [source, 0], side * side, targets=several).where("source = " + str(source)).collect()}
    assert all(math.isclose(got[t], want[t], rel_tol=1e-12, abs_tol=1e-12) for t in several)


def test_landmarks_of_odd_graphs(spark):
    """One-way streets, parts that cannot be reached, edges of weight 0, hubs, and graphs without edges."""
    rng = random.Random(31)
    rows = [(rng.randrange(60), rng.randrange(60), float(rng.choice([0, 0, 1, 2, 5]))) for _ in range(110)] + [(3, h, 4.0) for h in range(60)]
    with Dijkstra(graph(*rows)) as engine:
        engine.block_edges = 50
        engine.add_landmarks(2)
        source = rows[0][0]
        want = plain_dijkstra(rows, source, engine.n_vertices)
        targets = rng.sample(range(engine.n_vertices), 6)
        for some in (targets, targets[:1]):
            assert engine.run(source, termination_nodes=some, return_array=True).tolist() == [want[t] for t in some]
    two = Dijkstra(graph((0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0)))
    two.block_edges = 1
    two.add_landmarks(3)
    assert two.run(0, termination_nodes=[3, 1], return_array=True).tolist() == [math.inf, 1.0]
    assert two.run(0, termination_nodes=[3], return_array=True).tolist() == [math.inf]


def test_workers_need_no_copy_of_the_package(tmp_path):
    """An application that starts elsewhere, in which only the driver knows where the package is."""
    import subprocess
    import sys
    from pathlib import Path

    script = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from hopflux import BFS, BellmanFord, Dijkstra, HyperpathGenerating
e = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0)], "tail long, head long, weight double")
assert Dijkstra(e).run(0, return_array=True).tolist() == [0, 2, 5] == BellmanFord(e).run(0, return_array=True).tolist()
assert BFS(e).run(0, return_array=True).tolist() == [-9999, 0, 1]
h = HyperpathGenerating(e.withColumnRenamed("weight", "trav_time").selectExpr("*", "1.0D AS freq"))
h.run(0, 2, 1.0)
assert h.edges.agg({"volume": "sum"}).first()[0] == 2.0
print("all right")
"""
    here = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script, here], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all right" in done.stdout, done.stderr[-2000:]


def test_blocks_stay_small(spark):
    """Blocks of the queries in several blocks do not grow with the graph."""
    from hopflux.operators.blocks import BLOCK_EDGES
    from hopflux.queries import _in_blocks

    assert BLOCK_EDGES <= 1 << 18
    with Dijkstra(README) as engine:
        assert _in_blocks(engine, 10**9).block_edges == BLOCK_EDGES
    with Dijkstra(README) as engine:
        assert _in_blocks(engine, 600).block_edges == 100


def test_blocks_forget_what_they_have_sent(spark):
    """Vertices of other blocks are not remembered, of which a block of a graph without local ids has about as many as edges."""
    from hopflux.operators.shortest_path import LABEL, shortest_paths

    n = 400
    edges = [(0, v, float(v % 7 + 1)) for v in range(1, n)] + [(v, (v * 37 + 11) % n, 2.0) for v in range(1, n)]
    with Dijkstra(graph(*edges)) as engine:
        engine.block_edges = 100
        got = engine.run(0, path_tracking=True, return_array=True)
        assert got.tolist() == plain_dijkstra(edges, 0, n)
        raw = shortest_paths(engine._laid_out("weight"), [0], n, raw=True).collect()
    labels = np.concatenate([np.frombuffer(r["body"], LABEL) for r in raw])
    assert labels["own"].sum() == n
    assert (~labels["own"]).sum() <= 8  # the copies of vertex 0 in blocks of its further edges


def test_what_blocks_remember_stays_apart(spark, monkeypatch):
    """However often it is put together, no file, and so no task that writes or reads one, has that of many blocks."""
    from hopflux.operators import rounds
    from hopflux.operators.shortest_path import shortest_paths

    monkeypatch.setattr(rounds, "TABLES", 3)
    together, most = rounds.Rounds.put_together, []
    in_a_file = lambda df: df.groupBy(F.input_file_name()).agg(F.countDistinct("block").alias("c")).agg(F.max("c")).first()[0]

    def watched(self):
        before = self.tables
        together(self)
        if self.tables is not before:
            most.append(in_a_file(self.tables[0]))

    monkeypatch.setattr(rounds.Rounds, "put_together", watched)
    n = 120
    with Dijkstra(graph(*((v, v + 1, 1.0) for v in range(n - 1)))) as engine:
        engine.block_edges = 10
        raw = shortest_paths(engine._laid_out("weight"), [0], n, raw=True)
        assert raw.count() == engine._layout.blocks > 10
        assert in_a_file(raw) == 1
    assert len(most) > 2 and set(most) == {1}


@pytest.mark.parametrize("held, memory", [(8, True), (1, False)])
def test_many_blocks_lie_on_disk(spark, monkeypatch, held, memory):
    """Few blocks for each core are held in memory, more on disk, also those with landmarks; the answers are the same."""
    from hopflux.operators import blocks

    monkeypatch.setattr(blocks, "HELD", held, raising=False)
    edges = [(v, v + 1, 1.0) for v in range(79)]
    with Dijkstra(graph(*edges)) as engine:
        engine.block_edges = 10
        assert 4 < engine._laid_out("weight").blocks <= 32
        assert engine._layout.table.storageLevel.useMemory == memory
        engine.add_landmarks(1)
        assert engine._layout.table.storageLevel.useMemory == memory and engine._layout.table.storageLevel.useDisk
        assert engine.run(3, termination_nodes=[70, 2], return_array=True).tolist() == [67.0, math.inf]


def test_rounds_follow_what_is_near(monkeypatch):
    """A block whose edges lead to other blocks follows the nearest labels and leaves the others to the next round."""
    from hopflux.operators import shortest_path as sp
    from hopflux.operators.blocks import ARRAYS, VALUES, Ranges
    from hopflux.operators.rounds import FACT, MEMORY, MESSAGE, table

    monkeypatch.setattr(sp, "FEW", 10)
    ids, n = np.arange(200), 100
    made = {"ids": ids, "names": ids, "home": ids // n, "first": np.minimum(np.arange(201), n), "head": ids[n:], "back_v": [], "back_block": [], "weight": np.ones(n)}
    row = pa.table({"block": pa.array([0], pa.int32()), **{k: pa.array([np.asarray(v, ARRAYS.get(k) or VALUES[k]).tobytes()]) for k, v in made.items()}})
    first = np.array([(v, 99.0 - v, 1, 0) for v in range(n)], sp._CANDIDATE)
    run = sp.relax(Ranges(np.array([n]), np.array([0, 1], np.int32)), 200, True, False, True, INFINITY, [])
    inbox, sent, rounds = [(MESSAGE, 0, 0, 0, 0.0, first.tobytes())], [], 0
    while inbox:
        out = run(row, table(inbox)).to_pylist()
        got = np.concatenate([np.frombuffer(r["body"], sp._CANDIDATE) for r in out if r["kind"] == MESSAGE])
        assert len(got) <= 13  # ten, or an eighth of the block's edges, and one more
        sent += got.tolist()
        on = any(r["kind"] == FACT and r["v"] == sp.ON for r in out)
        inbox, rounds = [tuple(r.values()) for r in out if r["kind"] == MEMORY and on], rounds + 1
    assert sorted(sent) == [(v + n, 100.0 - v, 2, v) for v in range(n)]
    assert 8 <= rounds <= 10


def test_rounds_that_leave_something_to_the_next(spark, monkeypatch):
    """Labels are the same however little a round follows, also those of a hub that is dealt to further blocks."""
    from hopflux.operators import shortest_path

    monkeypatch.setattr(shortest_path, "FEW", 10)
    monkeypatch.setattr(shortest_path, "SHARE", 32)
    rng = random.Random(5)
    n, best = 120, {(0, h): 90.0 for h in range(1, 110)}
    best |= {(rng.randrange(n), rng.randrange(n)): rng.uniform(1, 100) for _ in range(400)}
    rows = [(t, h, w) for (t, h), w in best.items()]
    want = plain_dijkstra(rows, 0, n)
    with Dijkstra(graph(*rows)) as engine:
        engine.block_edges = 90
        assert engine.run(0, path_tracking=True, return_array=True).tolist() == want
        assert engine._layout.ranges.spread
        assert engine.run(0, termination_nodes=[7, 42], return_array=True).tolist() == [want[7], want[42]]


def test_long_paths(spark):
    """Ten thousand links in a row, by doubling; a table of links with a cycle ends at the limit."""
    from hopflux.operators import paths

    n = 10_000
    links = spark.range(n).select(F.col("id").alias("vertex_idx"), F.greatest(F.col("id") - 1, F.lit(0)).alias("associated_idx"))
    one = spark.createDataFrame([(n - 1,)], "vertex_idx long")
    rows = paths.paths(links, one).collect()
    assert sorted((r["step"], r["vertex_idx"]) for r in rows) == [(i, n - 1 - i) for i in range(n)]
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "vertex_idx long, associated_idx long")
    assert sorted((r["target"], r["step"]) for r in paths.paths(ring, limit=5).collect()) == [(v, s) for v in range(3) for s in range(6)]


def test_stream_of_edges(spark, tmp_path):
    from hopflux.streaming import lightest_edges, snapshot

    README.iloc[:3].to_parquet(tmp_path / "a.parquet")
    README.iloc[:4].assign(weight=0.5).to_parquet(tmp_path / "b.parquet")
    stream = spark.readStream.schema("tail long, head long, weight double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = lightest_edges(stream).writeStream.outputMode("update").format("memory").queryName("edge_updates").start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in snapshot(spark.table("edge_updates")).collect()}
    assert got == {(0, 1, 0.5), (0, 2, 0.5), (1, 2, 0.5), (2, 3, 0.5)}
