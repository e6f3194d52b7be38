"""Graphs seen in the star schema: parts bought one after the other, orders of a customer, trade between nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopflux.operators.edges import min_weight_edges, numbered

#: Lines of an order in a total order: line numbers repeat.
LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive parts of each order, one row per pair of lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE, "l_quantity", "l_discount")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*LINE))
    return lines.withColumn("head", after).where("head is not null").withColumn("tail", F.col("l_partkey"))


def g_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_weight_edges(part_pairs(spark, sf_dir).select("tail", "head", (F.col("l_extendedprice") / 1000).alias("weight")))


def g_dag_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = part_pairs(spark, sf_dir).where("tail < head")
    return min_weight_edges(pairs.select("tail", "head", ((F.col("l_discount") - 0.05) * F.col("l_extendedprice") / 1000).alias("weight")))


def g_back(spark: SparkSession, sf_dir: str, extra: float) -> DataFrame:
    """g_dag_neg and an edge back to vertex 1 from the smallest vertex after it, ``extra`` above the negative weight of the edge there."""
    dag = g_dag_neg(spark, sf_dir)
    out = dag.where("tail = 1").agg(F.min(F.struct("head", "weight")).alias("e"))
    return dag.union(out.select(F.col("e.head").alias("tail"), F.lit(1).cast("long").alias("head"), (F.lit(extra) - F.col("e.weight")).alias("weight")))


def g_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g_part(spark, sf_dir).withColumns({"tail": F.col("tail") * 1000, "head": F.col("head") * 1000})


def g_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tail"), after.alias("head"), (F.col("o_totalprice") / 1000).alias("weight")).where("head is not null")


def g_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier's nation to customer's nation, one row per line sold: many parallel edges."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    sold = lines.join(orders, "l_orderkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return sold.select(F.col("s_nationkey").cast("long").alias("tail"), F.col("c_nationkey").cast("long").alias("head"), (F.col("l_extendedprice") / 1000).alias("weight"))


def g_transit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = part_pairs(spark, sf_dir).where("tail <> head")
    placed = numbered(pairs.select("l_orderkey", *LINE, "tail", "head", "l_quantity", "l_discount"), ["l_orderkey", *LINE], "edge_idx")
    return placed.select("edge_idx", "tail", "head", F.col("l_quantity").alias("trav_time"), (F.col("l_discount") + 0.02).alias("freq"))
