"""Registered queries of the graph engine and the same questions in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopflux import views
from hopflux.api import BFS, BellmanFord, Dijkstra, HyperpathGenerating
from hopflux.operators import edges as ops
from hopflux.operators import paths
from hopflux.sources import read_edges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The vertex that queries start from or go to, and a list of targets with a repeat.
ROOT = 1
TARGETS = [7, 42, 3, 7]
SOURCES = [1, 2, 3]

# ---- views in SQL --------------------------------------------------------------------------------------------------

_LINE = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
PAIRS = f"p AS MATERIALIZED (SELECT * FROM (SELECT *, l_partkey AS tail, LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS head FROM lineitem) WHERE head IS NOT NULL)"
PART = PAIRS + ", e AS MATERIALIZED (SELECT tail, head, min(l_extendedprice / 1000) AS weight FROM p GROUP BY tail, head)"
SPARSE = PAIRS + ", e AS MATERIALIZED (SELECT tail * 1000 AS tail, head * 1000 AS head, min(l_extendedprice / 1000) AS weight FROM p GROUP BY ALL)"
DAG = PAIRS + ", e AS MATERIALIZED (SELECT tail, head, min((l_discount - 0.05::DOUBLE) * l_extendedprice / 1000) AS weight FROM p WHERE tail < head GROUP BY tail, head)"
ORDERS = "e AS MATERIALIZED (SELECT * FROM (SELECT o_orderkey AS tail, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS head, o_totalprice / 1000 AS weight FROM orders) WHERE head IS NOT NULL)"
TRADE = "g AS MATERIALIZED (SELECT s_nationkey::BIGINT AS tail, c_nationkey::BIGINT AS head, l_extendedprice / 1000 AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"
TRANSIT = PAIRS + f", g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY l_orderkey, {_LINE}) - 1 AS edge_idx, tail, head, l_quantity AS trav_time, l_discount + 0.02::DOUBLE AS freq FROM p WHERE tail <> head)"
_FLIP = ", f AS MATERIALIZED (SELECT head AS tail, tail AS head, weight FROM e)"


def _distances(edges: str, root: int = ROOT, name: str = "sp") -> str:
    return (
        f"{name}(v, d) USING KEY (v) AS (SELECT {root}::BIGINT, 0.0::DOUBLE UNION SELECT x.head, min(s.d + x.weight) FROM {name} s JOIN {edges} x ON x.tail = s.v "
        f"LEFT JOIN recurring.{name} k ON k.v = x.head WHERE s.d + x.weight < coalesce(k.d, 'infinity'::DOUBLE) GROUP BY x.head)"
    )


def _labels(edges: str, root: int = ROOT) -> str:
    return (
        f"lb(v, d, h, p) USING KEY (v) AS (SELECT {root}::BIGINT, 0.0::DOUBLE, 0::BIGINT, {root}::BIGINT UNION "
        f"SELECT c.v, c.l.d, c.l.h, c.l.p FROM (SELECT x.head AS v, min({{'d': s.d + x.weight, 'h': s.h + 1, 'p': s.v}}) AS l FROM lb s JOIN {edges} x ON x.tail = s.v GROUP BY x.head) c "
        "LEFT JOIN recurring.lb k ON k.v = c.v WHERE k.v IS NULL OR c.l < {'d': k.d, 'h': k.h, 'p': k.p})"
    )


def _tree(edges: str, root: int = ROOT) -> str:
    return (
        f"b(v, lv, rk, pred) USING KEY (v) AS (SELECT {root}::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT UNION "
        f"SELECT head, lv, row_number() OVER (ORDER BY prk, head) - 1, pred FROM (SELECT x.head, max(b.lv) + 1 AS lv, min(b.rk) AS prk, arg_min(x.tail, b.rk) AS pred FROM b JOIN {edges} x ON x.tail = b.v "
        "WHERE NOT EXISTS (SELECT 1 FROM recurring.b k WHERE k.v = x.head) GROUP BY x.head))"
    )


_DENSE = "r AS (SELECT unnest(range((SELECT max(greatest(tail, head)) + 1 FROM e))) AS v)"
_TIMES = (
    f"u(v, u) USING KEY (v) AS (SELECT {ROOT}::BIGINT, 0.0::DOUBLE UNION SELECT n.tail, n.nu FROM (SELECT tail, min(pu) AS nu FROM (SELECT tail, (1 + sum(f * t) OVER w) / (sum(f) OVER w) AS pu FROM "
    f"(SELECT g.tail, g.freq AS f, k.u + g.trav_time AS t, g.edge_idx FROM g JOIN recurring.u k ON k.v = g.head WHERE g.tail <> {ROOT}) WINDOW w AS (PARTITION BY tail ORDER BY t, edge_idx ROWS UNBOUNDED PRECEDING)) GROUP BY tail) n "
    "LEFT JOIN recurring.u o ON o.v = n.tail WHERE (o.v IS NULL OR n.nu < o.u * (1 - 1e-14)) AND EXISTS (SELECT 1 FROM u))"
)
_USED = f", used AS MATERIALIZED (SELECT g.*, freq / sum(freq) OVER (PARTITION BY tail) AS share FROM g JOIN u a ON a.v = g.tail JOIN u b ON b.v = g.head WHERE g.tail <> {ROOT} AND b.u + g.trav_time <= a.u * (1 + 1e-12))"


def query(oracle: str):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


# ---- edge tables ---------------------------------------------------------------------------------------------------


@query(f"WITH {TRADE} SELECT tail, head, min(weight) AS weight FROM g GROUP BY tail, head")
def edges_min_weight(spark, sf_dir):
    return ops.min_weight_edges(views.g_trade(spark, sf_dir))


@query(f"WITH {TRADE} SELECT DISTINCT tail, head FROM g")
def edges_distinct(spark, sf_dir):
    return ops.distinct_edges(views.g_trade(spark, sf_dir))


@query(f"WITH {TRADE} SELECT count(*) - count(DISTINCT (tail, head)) AS n_removed FROM g")
def edges_removed_count(spark, sf_dir):
    return ops.removed_count(views.g_trade(spark, sf_dir))


@query(f"WITH {SPARSE} SELECT tail AS vertex_idx FROM e UNION SELECT head FROM e")
def vertices(spark, sf_dir):
    return ops.vertices(views.g_sparse(spark, sf_dir))


@query(f"WITH {SPARSE} SELECT v AS vert_idx_old, row_number() OVER (ORDER BY v) - 1 AS vert_idx_new FROM (SELECT tail AS v FROM e UNION SELECT head FROM e)")
def permutation(spark, sf_dir):
    return ops.permutation(views.g_sparse(spark, sf_dir))


@query(f"WITH {SPARSE}, n AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT tail AS v FROM e UNION SELECT head FROM e)) SELECT a.i AS tail, b.i AS head, weight FROM e JOIN n a ON a.v = tail JOIN n b ON b.v = head")
def permuted_edges(spark, sf_dir):
    edges = views.g_sparse(spark, sf_dir)
    return ops.permuted_edges(edges, ops.permutation(edges))


@query(f"WITH {TRANSIT} SELECT edge_idx, least(greatest((trav_time - 25) * 1e-13, 1e-12), 1.7976931348623157e308) AS trav_time, least(greatest(CASE WHEN freq > 0.1 THEN 'infinity'::DOUBLE ELSE freq - 0.05 END, 1e-20), 1e20) AS freq FROM g")
def edges_clamped(spark, sf_dir):
    wild = views.g_transit(spark, sf_dir).withColumns({"trav_time": (F.col("trav_time") - 25) * 1e-13, "freq": F.when(F.col("freq") > 0.1, float("inf")).otherwise(F.col("freq") - 0.05)})
    return ops.clamped_edges(wild).select("edge_idx", "trav_time", "freq")


@query(f"WITH {DAG} SELECT count(*) FILTER (weight IS NULL OR isnan(weight)) AS n_null, count(*) FILTER (weight < 0) AS n_negative, count(*) FILTER (isinf(weight) OR isnan(weight)) AS n_nonfinite FROM e")
def edge_checks(spark, sf_dir):
    found = ops.check_values(views.g_dag_neg(spark, sf_dir), ["weight"])
    return spark.createDataFrame([(found.missing["weight"], found.negative["weight"], found.infinite["weight"])], "n_null long, n_negative long, n_nonfinite long")


@query(f"WITH {PART}, {_DENSE}, d AS (SELECT v, count(tail) AS degree FROM r LEFT JOIN e ON tail = v GROUP BY v) SELECT v AS vertex_idx, degree, coalesce(sum(degree) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM d")
def degree_offsets(spark, sf_dir):
    return ops.offsets(views.g_part(spark, sf_dir))


@query(f"WITH {PART}, {_DENSE}, d AS (SELECT v, count(head) AS degree FROM r LEFT JOIN e ON head = v GROUP BY v) SELECT v AS vertex_idx, degree, coalesce(sum(degree) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM d")
def degree_offsets_in(spark, sf_dir):
    return ops.offsets(ops.flipped(views.g_part(spark, sf_dir)))


# ---- shortest paths ------------------------------------------------------------------------------------------------


def _reached(lengths: DataFrame) -> DataFrame:
    return lengths.where(F.col("path_length") < float("inf"))


@query(f"WITH RECURSIVE {PART}, {_distances('e')} SELECT v AS vertex_idx, d AS path_length FROM sp")
def sssp(spark, sf_dir):
    return _reached(Dijkstra(views.g_part(spark, sf_dir)).run(ROOT))


@query(f"WITH RECURSIVE {PART}{_FLIP}, {_distances('f')} SELECT v AS vertex_idx, d AS path_length FROM sp")
def stsp(spark, sf_dir):
    return _reached(Dijkstra(views.g_part(spark, sf_dir), orientation="in").run(ROOT))


def _with_links(engine, lengths: DataFrame) -> DataFrame:
    return _reached(lengths).join(engine.path_links, "vertex_idx").select("vertex_idx", "associated_idx", "path_length")


@query(f"WITH RECURSIVE {PART}, {_labels('e')} SELECT v AS vertex_idx, p AS associated_idx, d AS path_length FROM lb")
def sssp_links(spark, sf_dir):
    engine = Dijkstra(views.g_part(spark, sf_dir))
    return _with_links(engine, engine.run(ROOT, path_tracking=True))


@query(f"WITH RECURSIVE {PART}{_FLIP}, {_labels('f')} SELECT v AS vertex_idx, p AS associated_idx, d AS path_length FROM lb")
def stsp_links(spark, sf_dir):
    engine = Dijkstra(views.g_part(spark, sf_dir), orientation="in")
    return _with_links(engine, engine.run(ROOT, path_tracking=True))


_ASKED = f"t AS (SELECT unnest(range({len(TARGETS)})) AS position, unnest({TARGETS}::BIGINT[]) AS vertex_idx)"


@query(f"WITH RECURSIVE {PART}, {_distances('e')}, {_ASKED} SELECT position, vertex_idx, d AS path_length FROM t JOIN sp ON v = vertex_idx")
def sssp_targets(spark, sf_dir):
    return Dijkstra(views.g_part(spark, sf_dir)).run(ROOT, termination_nodes=TARGETS)


@query(f"WITH RECURSIVE {PART}{_FLIP}, {_distances('f')}, {_ASKED} SELECT position, vertex_idx, d AS path_length FROM t JOIN sp ON v = vertex_idx")
def stsp_targets(spark, sf_dir):
    return Dijkstra(views.g_part(spark, sf_dir), orientation="in").run(ROOT, termination_nodes=TARGETS)


def _targets_with_paths(engine) -> DataFrame:
    got = engine.run(ROOT, path_tracking=True, termination_nodes=TARGETS)
    return got.join(engine.path_links, "vertex_idx").select("position", "vertex_idx", "associated_idx", "path_length")


@query(f"WITH RECURSIVE {PART}, {_labels('e')}, {_ASKED} SELECT position, vertex_idx, p AS associated_idx, d AS path_length FROM t JOIN lb ON v = vertex_idx")
def sssp_targets_links(spark, sf_dir):
    return _targets_with_paths(Dijkstra(views.g_part(spark, sf_dir)))


@query(f"WITH RECURSIVE {PART}{_FLIP}, {_labels('f')}, {_ASKED} SELECT position, vertex_idx, p AS associated_idx, d AS path_length FROM t JOIN lb ON v = vertex_idx")
def stsp_targets_links(spark, sf_dir):
    return _targets_with_paths(Dijkstra(views.g_part(spark, sf_dir), orientation="in"))


@query(f"WITH RECURSIVE {ORDERS}, {_DENSE}, {_distances('e', 0)} SELECT r.v AS vertex_idx, coalesce(d, 1.7976931348623157e308) AS path_length FROM r LEFT JOIN sp ON sp.v = r.v")
def sssp_dense_max(spark, sf_dir):
    return Dijkstra(views.g_orders(spark, sf_dir)).run(0, return_inf=False)


@query(f"WITH RECURSIVE {ORDERS}, {_DENSE}, {_distances('e', 0)} SELECT r.v AS vertex_idx, coalesce(d, 'infinity'::DOUBLE) AS path_length FROM r LEFT JOIN sp ON sp.v = r.v")
def sssp_dense_inf(spark, sf_dir):
    return Dijkstra(views.g_orders(spark, sf_dir)).run(0)


@query(f"WITH RECURSIVE {SPARSE}, {_distances('e', 1000)} SELECT v AS vertex_idx, d AS path_length FROM sp")
def sssp_permuted(spark, sf_dir):
    return _reached(Dijkstra(views.g_sparse(spark, sf_dir), permute=True).run(1000))


@query(
    f"WITH RECURSIVE {PART}, sp(source, v, d) USING KEY (source, v) AS (SELECT s, s, 0.0::DOUBLE FROM (SELECT unnest({SOURCES}::BIGINT[]) AS s) UNION SELECT s.source, x.head, min(s.d + x.weight) FROM sp s JOIN e x ON x.tail = s.v "
    "LEFT JOIN recurring.sp k ON k.v = x.head AND k.source = s.source WHERE s.d + x.weight < coalesce(k.d, 'infinity'::DOUBLE) GROUP BY s.source, x.head) SELECT source, v AS vertex_idx, d AS path_length FROM sp"
)
def sssp_multi_source(spark, sf_dir):
    return Dijkstra(views.g_part(spark, sf_dir)).run_many(SOURCES)


@query(f"WITH RECURSIVE {DAG}, {_distances('e')} SELECT v AS vertex_idx, d AS path_length FROM sp")
def bf_sssp(spark, sf_dir):
    return _reached(BellmanFord(views.g_dag_neg(spark, sf_dir)).run(ROOT))


@query(f"WITH RECURSIVE {DAG}{_FLIP}, {_distances('f', 150)} SELECT v AS vertex_idx, d AS path_length FROM sp")
def bf_stsp(spark, sf_dir):
    return _reached(BellmanFord(views.g_dag_neg(spark, sf_dir), orientation="in").run(150))


@query(f"WITH RECURSIVE {DAG}, {_labels('e')} SELECT v AS vertex_idx, p AS associated_idx, d AS path_length FROM lb")
def bf_sssp_links(spark, sf_dir):
    engine = BellmanFord(views.g_dag_neg(spark, sf_dir))
    return _with_links(engine, engine.run(ROOT, path_tracking=True))


@query(f"WITH RECURSIVE {DAG}{_FLIP}, {_labels('f', 150)} SELECT v AS vertex_idx, p AS associated_idx, d AS path_length FROM lb")
def bf_stsp_links(spark, sf_dir):
    engine = BellmanFord(views.g_dag_neg(spark, sf_dir), orientation="in")
    return _with_links(engine, engine.run(150, path_tracking=True))


#: Without the edge back there is no cycle, so the lightest one is that edge and the shortest path to where it leaves.
_BACK = "o AS (SELECT head AS tail, {} - weight AS weight FROM e WHERE tail = 1 ORDER BY head LIMIT 1)"
_CYCLE = f"WITH RECURSIVE {DAG}, {_distances('e')}, {_BACK} SELECT d + weight < 0 AS has_negative_cycle FROM o JOIN sp ON sp.v = o.tail"


def _has_cycle(spark, sf_dir, orientation: str, extra: float) -> DataFrame:
    with BellmanFord(views.g_back(spark, sf_dir, extra), orientation=orientation) as engine:
        try:
            engine.run(ROOT)
        except ValueError:
            pass
        return spark.createDataFrame([(engine.has_negative_cycle(),)], "has_negative_cycle boolean")


@query(_CYCLE.format(-1.0))
def bf_negative_cycle(spark, sf_dir):
    return _has_cycle(spark, sf_dir, "out", -1.0)


@query(_CYCLE.format(-1.0))
def bf_negative_cycle_in(spark, sf_dir):
    return _has_cycle(spark, sf_dir, "in", -1.0)


@query(_CYCLE.format(1e6))
def bf_cycle_of_positive_weight(spark, sf_dir):
    return _has_cycle(spark, sf_dir, "out", 1e6)


# ---- breadth-first trees -------------------------------------------------------------------------------------------

_PRED = "SELECT r.v AS vertex_idx, coalesce(pred, {})::INTEGER AS predecessor FROM r LEFT JOIN b ON b.v = r.v"


@query(f"WITH RECURSIVE {PART}, {_DENSE}, {_tree('e')} {_PRED.format(-9999)}")
def bfs_out(spark, sf_dir):
    return BFS(views.g_part(spark, sf_dir)).run(ROOT)


@query(f"WITH RECURSIVE {PART}{_FLIP}, {_DENSE}, {_tree('f')} {_PRED.format(-9999)}")
def bfs_in(spark, sf_dir):
    return BFS(views.g_part(spark, sf_dir), orientation="in").run(ROOT)


@query(f"WITH RECURSIVE {ORDERS}, {_DENSE}, {_tree('e', 0)} {_PRED.format(-1)}")
def bfs_sentinel(spark, sf_dir):
    return BFS(views.g_orders(spark, sf_dir), sentinel=-1).run(0)


@query(f"WITH RECURSIVE {PART}, {_DENSE}, {_tree('e')} SELECT r.v AS vertex_idx, row_number() OVER (ORDER BY lv NULLS LAST, rk NULLS LAST, r.v) - 1 AS new_idx FROM r LEFT JOIN b ON b.v = r.v")
def bfs_reorder(spark, sf_dir):
    return BFS(views.g_part(spark, sf_dir)).reorder(ROOT)


# ---- paths ---------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {PART}, {_labels('e')}, w(step, v) AS (SELECT 0::BIGINT, {TARGETS[0]}::BIGINT UNION ALL SELECT step + 1, p FROM w JOIN lb USING (v) WHERE p <> v) SELECT step, v AS vertex_idx FROM w")
def path_to_vertex(spark, sf_dir):
    engine = Dijkstra(views.g_part(spark, sf_dir))
    engine.run(ROOT, path_tracking=True)
    one = spark.createDataFrame([(TARGETS[0],)], "vertex_idx long")
    return paths.paths(engine.path_links, one).select(F.col("step").cast("long").alias("step"), "vertex_idx")


@query(f"WITH RECURSIVE {PART}, {_labels('e')}, w(target, step, v) AS (SELECT v, 0::BIGINT, v FROM lb UNION ALL SELECT target, step + 1, p FROM w JOIN lb USING (v) WHERE p <> v) SELECT target, step, v AS vertex_idx FROM w")
def paths_all(spark, sf_dir):
    engine = Dijkstra(views.g_part(spark, sf_dir))
    reached = _reached(engine.run(ROOT, path_tracking=True)).select("vertex_idx")
    return paths.paths(engine.path_links, reached).select("target", F.col("step").cast("long").alias("step"), "vertex_idx")


# ---- the same in several blocks ------------------------------------------------------------------------------------


def _in_blocks(engine, n_edges: int, order: str = "ids"):
    """An engine that deals its edges to six blocks at least, at any scale, so that they have to exchange what they find; blocks stay as small as usual."""
    engine.block_edges = min(engine.block_edges, max(1, n_edges // 6))
    engine.block_order = order
    return engine


@query(ORACLES["sssp_links"])
def sssp_links_in_blocks(spark, sf_dir):
    engine = Dijkstra(views.g_part(spark, sf_dir))
    with _in_blocks(engine, engine.n_edges):
        return _with_links(engine, engine.run(ROOT, path_tracking=True))


@query(ORACLES["stsp_targets"])
def stsp_targets_in_blocks(spark, sf_dir):
    engine = Dijkstra(views.g_part(spark, sf_dir), orientation="in")
    with _in_blocks(engine, engine.n_edges):
        return engine.run(ROOT, termination_nodes=TARGETS)


@query(ORACLES["sssp_targets_links"])
def sssp_targets_by_landmarks(spark, sf_dir):
    """Searches that head for their targets."""
    engine = Dijkstra(views.g_part(spark, sf_dir))
    with _in_blocks(engine, engine.n_edges):
        engine.add_landmarks(2)
        return _targets_with_paths(engine)


@query(ORACLES["sssp_dense_inf"])
def sssp_by_neighbours(spark, sf_dir):
    """Blocks of neighbouring orders, in an order of the vertices that is found from the edges."""
    engine = Dijkstra(views.g_orders(spark, sf_dir))
    with _in_blocks(engine, engine.n_edges, "neighbours"):
        return engine.run(0)


@query(ORACLES["bf_sssp_links"])
def bf_sssp_links_in_blocks(spark, sf_dir):
    engine = BellmanFord(views.g_dag_neg(spark, sf_dir))
    with _in_blocks(engine, engine.n_edges):
        return _with_links(engine, engine.run(ROOT, path_tracking=True))


@query(ORACLES["bfs_reorder"])
def bfs_reorder_in_blocks(spark, sf_dir):
    engine = BFS(views.g_part(spark, sf_dir))
    with _in_blocks(engine, engine.n_edges):
        return engine.reorder(ROOT)


# ---- sources --------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey::BIGINT AS tail, n_regionkey::BIGINT AS head, count(*)::DOUBLE AS weight FROM nation GROUP BY ALL")
def read_edges_by_role(spark, sf_dir):
    """Edges from a file by the names of its columns; the weight is that of merged rows."""
    found = read_edges(f"{sf_dir}/nation.parquet", spark, tail="n_nationkey", head="n_regionkey")
    return found.groupBy("tail", "head").agg(F.count("*").cast("double").alias("weight"))


# ---- transit -------------------------------------------------------------------------------------------------------

ORIGIN = 5


def _assigned(spark, sf_dir) -> HyperpathGenerating:
    engine = HyperpathGenerating(views.g_transit(spark, sf_dir))
    engine.run(ORIGIN, ROOT, 1.0)
    return engine


@query(f"WITH RECURSIVE {TRANSIT}, {_TIMES} SELECT v AS vertex_idx, round(u, 6) AS u_i FROM u")
def hyperpath_times(spark, sf_dir):
    times = _assigned(spark, sf_dir).u_i_vec
    return times.where(F.col("u_i") < 1e300).select("vertex_idx", F.round("u_i", 6).alias("u_i"))


@query(f"WITH RECURSIVE {TRANSIT}, {_TIMES}{_USED} SELECT edge_idx FROM used")
def hyperpath_edges(spark, sf_dir):
    return _assigned(spark, sf_dir).chosen


@query(
    f"WITH RECURSIVE {TRANSIT}, {_TIMES}{_USED}, fl(v, a, lv) AS (SELECT {ORIGIN}::BIGINT, 1.0::DOUBLE, 0 UNION ALL SELECT head, sum(a * share), lv + 1 FROM fl JOIN used ON tail = v GROUP BY head, lv) "
    "SELECT g.edge_idx, round(coalesce(x.volume, 0.0), 6) AS volume FROM g LEFT JOIN (SELECT edge_idx, sum(a * share) AS volume FROM fl JOIN used ON tail = v GROUP BY edge_idx) x USING (edge_idx)"
)
def hyperpath_volumes(spark, sf_dir):
    return _assigned(spark, sf_dir).edges.select("edge_idx", F.round("volume", 6).alias("volume"))


@query(ORACLES["hyperpath_volumes"])
def hyperpath_volumes_in_blocks(spark, sf_dir):
    engine = HyperpathGenerating(views.g_transit(spark, sf_dir))
    with _in_blocks(engine, engine.edge_count):
        engine.run(ORIGIN, ROOT, 1.0)
    return engine.edges.select("edge_idx", F.round("volume", 6).alias("volume"))


@query(
    f"WITH RECURSIVE {TRANSIT}, {_TIMES}{_USED}, d(v, a) AS (VALUES (5::BIGINT, 2.5::DOUBLE), (9, 1.0)), fl(v, a, lv) AS (SELECT v, a, 0 FROM d UNION ALL SELECT head, sum(a * share), lv + 1 FROM fl JOIN used ON tail = v GROUP BY head, lv) "
    "SELECT edge_idx, round(sum(a * share), 6) AS volume FROM fl JOIN used ON tail = v GROUP BY edge_idx"
)
def hyperpath_demand(spark, sf_dir):
    """Several origins; of the repeated one the last volume counts."""
    engine = HyperpathGenerating(views.g_transit(spark, sf_dir))
    engine.run([5, 9, 5], ROOT, [4.0, 1.0, 2.5])
    return engine.edges.where("volume > 0").select("edge_idx", F.round("volume", 6).alias("volume"))
