"""Two published example networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

INFINITE = float("inf")

# The road network of Sioux Falls, as tail, head and travel time.
SIOUX_FALLS = """
0 1 6.00081623735432
0 2 4.008690750207941
1 0 6.000834122995382
1 5 6.573598255386801
2 0 4.008586653499848
2 3 4.2694018322732905
2 11 4.0201791556206405
3 2 4.271267755875735
3 4 2.3153741062577957
3 10 7.1333004801798925
4 3 2.317072228350169
4 5 9.99822520770989
4 8 9.651310705326
5 1 6.599517667370174
5 4 10.020702556347622
5 7 14.690955002063726
6 7 5.55216038110299
6 17 2.0622256872131777
7 5 14.824159517828813
7 6 5.5014129625630845
7 8 15.17470751467586
7 15 10.729473525552692
8 4 9.670154559500556
8 7 15.03786950444767
8 9 5.682533051602025
9 8 5.717243386296829
9 10 12.405689451182845
9 14 13.722370282505468
9 15 20.084809978398383
9 16 16.308017150740422
10 3 7.223024555194135
10 9 12.203254534036494
10 11 13.590227634461067
10 13 13.691285688495954
11 2 4.019790487445956
11 10 13.735155648868584
11 12 3.022796543682372
12 11 3.023479671561587
12 23 17.661007722734873
13 10 13.842645045035516
13 14 12.23433912804607
13 22 9.079344311718367
14 9 13.811560451025963
14 13 12.374604857173304
14 18 4.326212079332104
14 21 9.08814367305963
15 7 10.778811570380917
15 9 20.236275698759837
15 16 9.501458490999475
15 17 3.1634648042599296
16 9 16.308017150740422
16 15 9.472854415655233
16 18 7.436626799094368
17 6 2.063186385018009
17 15 3.1658348757764214
17 19 4.2593710873324016
18 14 4.335530792063869
18 16 7.41227403532956
18 19 9.459063508153196
19 17 4.260230067055197
19 18 9.515249398501572
19 20 8.165660812781299
19 21 7.713130000305229
20 19 8.081635689665607
20 21 4.213505826088517
20 23 11.924059828422909
21 14 9.057167182746477
21 19 7.713130000305229
21 20 4.201049855811011
21 22 12.36580549583202
22 13 9.065966544087727
22 21 12.243138489387317
22 23 3.759304188401893
23 12 17.617020723058587
23 20 11.752579405401582
23 22 3.722946742102766
"""


def sioux_falls(spark: SparkSession) -> DataFrame:
    """76 edges (tail, head, trav_time) between 24 vertices."""
    rows = [(int(a), int(b), float(c)) for a, b, c in (line.split() for line in SIOUX_FALLS.split("\n") if line)]
    return spark.createDataFrame(rows, "tail long, head long, trav_time double")


class SiouxFalls:
    """The road network of Sioux Falls; ``edges`` has its table."""

    def __init__(self, spark: SparkSession | None = None):
        self._spark = spark

    @property
    def edges(self) -> DataFrame:
        return sioux_falls(self._spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())


def transit_edges(dwell_time: float, board_alight_ratio: float) -> list[tuple[int, int, float, float, float]]:
    """Edges (tail, head, trav_time, freq, volume_ref) of the example of Spiess and Florian (1989), in their order.

    Four lines run from stop A (vertex 0) over X (3) and Y (7) to B (12); the other vertices are places of boarding and
    alighting.  A line that leaves every h seconds has frequency 2 / h, as the mean wait is half the headway.
    """
    step = board_alight_ratio * dwell_time
    every = lambda minutes: 2.0 / (60.0 * minutes)
    one, two, three, four = every(12), every(12), every(30), every(6)
    # The network's edges and the published volumes for one trip from 0 to 12.
    return [
        (0, 2, step, one, 0.5),
        (0, 1, step, two, 0.5),
        (2, 15, 25.0 * 60.0, INFINITE, 0.5),
        (1, 5, 7.0 * 60.0, INFINITE, 0.5),
        (5, 3, step, INFINITE, 0.0),
        (5, 6, dwell_time, INFINITE, 0.5),
        (5, 4, dwell_time, three, 0.0),
        (3, 6, step, two, 0.0),
        (3, 4, step, three, 0.0),
        (6, 11, 6.0 * 60.0, INFINITE, 0.5),
        (4, 9, 4.0 * 60.0, INFINITE, 0.0),
        (9, 7, step, INFINITE, 0.0),
        (11, 7, step, INFINITE, 0.0),
        (11, 10, dwell_time, three, 0.0833333333333),
        (11, 8, dwell_time, four, 0.4166666666666),
        (9, 8, dwell_time, four, 0.0),
        (9, 10, dwell_time, INFINITE, 0.0),
        (7, 10, step, three, 0.0),
        (7, 8, step, four, 0.0),
        (10, 14, 4.0 * 60.0, INFINITE, 0.0833333333333),
        (8, 13, 10.0 * 60.0, INFINITE, 0.4166666666666),
        (15, 12, step, INFINITE, 0.5),
        (14, 12, step, INFINITE, 0.0833333333333),
        (13, 12, step, INFINITE, 0.4166666666666),
    ]


def transit_example(spark: SparkSession, dwell_time: float = 0.0, board_alight_ratio: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The transit example's edges (with ``edge_idx``) and its demand (origin_vertex_id, destination_vertex_id, demand)."""
    rows = [(i, *e) for i, e in enumerate(transit_edges(dwell_time, board_alight_ratio))]
    edges = spark.createDataFrame(rows, "edge_idx long, tail long, head long, trav_time double, freq double, volume_ref double")
    return edges, spark.createDataFrame([(0, 12, 1.0)], "origin_vertex_id long, destination_vertex_id long, demand double")


def create_sf_network(dwell_time: float = 1e-6, board_alight_ratio: float = 0.5, spark: SparkSession | None = None) -> DataFrame:
    """The transit example's edges: tail, head, trav_time, freq, volume_ref, and edge_idx for their order."""
    return transit_example(spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), dwell_time, board_alight_ratio)[0]
