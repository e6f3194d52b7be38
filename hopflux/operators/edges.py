"""Relational operators on edge tables: merging parallels, vertex sets, numbering, checks, offsets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopflux.constants import INF, INF_FREQ, MIN_FREQ, MIN_TIME
from hopflux.functions import clamp, finite, missing
from hopflux.plans.work import save


def known_ends(edges: DataFrame) -> DataFrame:
    """Edges with both ends; a row without one is no edge."""
    return edges.dropna(subset=["tail", "head"])


def min_weight_edges(edges: DataFrame) -> DataFrame:
    """One edge per (tail, head), the lightest; missing weights are skipped where there is another."""
    weight = F.when(~F.isnan("weight"), F.col("weight"))
    return known_ends(edges).groupBy("tail", "head").agg(F.min(weight).alias("weight"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    return known_ends(edges).select("tail", "head").distinct()


def removed_count(edges: DataFrame) -> DataFrame:
    """n_removed: how many rows merging parallel edges takes away."""
    per = known_ends(edges).groupBy("tail", "head").agg(F.count("*").alias("c"))
    return per.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("n_removed"))


def vertices(edges: DataFrame) -> DataFrame:
    """vertex_idx: every vertex that an edge names, once."""
    return edges.select(F.explode(F.array("tail", "head")).alias("vertex_idx")).where("vertex_idx is not null").distinct()


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows from 0 without gaps in ``order``, without bringing them to one place.

    Rows are dealt by ranges and numbered inside them; a range starts where the ones before it end.
    """
    dealt = save(df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = dealt.groupBy("_piece").agg(F.count("*").alias("_n")).select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_piece").orderBy(*order)))
    return within.join(starts, "_piece").withColumn(name, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_piece", "_rank", "_start")


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` over all rows before each one in ``order``, added up by ranges like :func:`numbered`."""
    dealt = save(df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()), "ranges")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    starts = dealt.groupBy("_piece").agg(F.sum(value).alias("_n")).select("_piece", total("_n", Window.orderBy("_piece")).alias("_start"))  # one row per range
    within = dealt.withColumn("_in", total(value, Window.partitionBy("_piece").orderBy(*order)))
    return within.join(starts, "_piece").withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop("_piece", "_in", "_start")


def permutation(edges: DataFrame) -> DataFrame:
    """vert_idx_old, vert_idx_new: the vertices numbered from 0 in their order."""
    return numbered(vertices(edges).withColumnRenamed("vertex_idx", "vert_idx_old"), ["vert_idx_old"], "vert_idx_new")


def permuted_edges(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Edges with their ends renumbered by :func:`permutation`."""
    rest = [c for c in edges.columns if c not in ("tail", "head")]
    for end in ("tail", "head"):
        edges = edges.join(numbers.select(F.col("vert_idx_old").alias(end), F.col("vert_idx_new").alias(f"new_{end}")), end)
    return edges.select(F.col("new_tail").alias("tail"), F.col("new_head").alias("head"), *rest)


def vertex_count(edges: DataFrame) -> int:
    """Size of the dense vertex range 0 to the largest id; 0 without edges."""
    top = edges.agg(F.max(F.greatest("tail", "head"))).first()[0]
    return 0 if top is None else top + 1


def clamped_edges(edges: DataFrame) -> DataFrame:
    """Transit edges with times and frequencies brought into the model's bounds."""
    return edges.withColumns({"trav_time": clamp(F.col("trav_time"), MIN_TIME, INF), "freq": clamp(F.col("freq"), MIN_FREQ, INF_FREQ)})


def with_edge_idx(edges: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Number the edges: in ``order`` if given, else as the rows come (the caller's table order)."""
    if "edge_idx" in edges.columns:
        return edges
    if order:
        return numbered(edges, order, "edge_idx")
    placed = edges.withColumn("_row", F.monotonically_increasing_id())
    return numbered(placed, ["_row"], "edge_idx").drop("_row")


def offsets(edges: DataFrame) -> DataFrame:
    """vertex_idx, degree, offset: out-degrees over the dense range and their running start, as in a sparse row layout.

    Swap tail and head for the column layout.
    """
    count = vertex_count(edges)
    degrees = edges.groupBy(F.col("tail").alias("vertex_idx")).agg(F.count("*").alias("degree"))
    rows = edges.sparkSession.range(count).withColumnRenamed("id", "vertex_idx").join(degrees, "vertex_idx", "left").select("vertex_idx", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    return running_total(rows, ["vertex_idx"], "degree", "offset")


@dataclass
class Checks:
    """What one pass over the edges finds about their values."""

    missing: dict[str, int]
    negative: dict[str, int]
    infinite: dict[str, int]


def check_values(edges: DataFrame, columns: list[str]) -> Checks:
    """Counts of missing, negative and non-finite values per column, in one job."""
    kinds = dict(edges.dtypes)
    real = {c: kinds[c] in ("double", "float") for c in columns}
    value = {c: F.col(c) for c in columns}
    wanted = []
    for c in columns:
        wanted.append(F.count_if(missing(value[c], real[c])).alias(f"m_{c}"))
        wanted.append(F.count_if(value[c] < 0).alias(f"n_{c}"))
        wanted.append((F.count_if(~finite(value[c].cast("double"))) if real[c] else F.lit(0)).alias(f"i_{c}"))
    row = edges.agg(*wanted).first()
    return Checks(*({c: row[f"{k}_{c}"] for c in columns} for k in "mni"))


def flipped(edges: DataFrame) -> DataFrame:
    """Edges the other way round: what leaves a vertex now enters it."""
    rest = [c for c in edges.columns if c not in ("tail", "head")]
    return edges.select(F.col("head").alias("tail"), F.col("tail").alias("head"), *rest)


def dense(values: DataFrame, count: int, key: str = "vertex_idx") -> DataFrame:
    """One row for each of 0 to ``count`` - 1; columns are null where ``values`` has no such vertex."""
    return values.sparkSession.range(count).withColumnRenamed("id", key).join(values, key, "left")
