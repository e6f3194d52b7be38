"""Edge tables of any kind as Spark DataFrames with canonical columns."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Canonical roles and their types.
ROLES: Mapping[str, str] = {"tail": "long", "head": "long", "weight": "double", "trav_time": "double", "freq": "double"}


def to_spark(edges, columns: list[str] | None = None) -> DataFrame:
    """A Spark, pandas (NumPy or Arrow backed), Polars or Arrow table, or anything pandas can read (with a warning).

    Only ``columns`` that exist are carried over, so wide tables do not cross to the JVM.
    """
    if isinstance(edges, DataFrame):
        return edges
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    kind = type(edges).__module__.split(".")[0]
    if kind == "polars":
        edges = edges.to_arrow()
    if not isinstance(edges, pa.Table):
        import pandas as pd

        if not isinstance(edges, pd.DataFrame):
            warnings.warn(f"edges of type {type(edges).__name__} are converted with pandas.DataFrame", UserWarning, stacklevel=3)
            edges = pd.DataFrame(edges)
        keep = [c for c in columns or edges.columns if c in edges.columns]
        edges = pa.Table.from_pandas(edges[list(dict.fromkeys(keep))], preserve_index=False)
    else:
        edges = edges.select([c for c in dict.fromkeys(columns or edges.column_names) if c in edges.column_names])
    # Spark has no unsigned types and no half floats
    plain = {pa.uint8(): pa.int64(), pa.uint16(): pa.int64(), pa.uint32(): pa.int64(), pa.uint64(): pa.int64(), pa.float16(): pa.float32(), pa.null(): pa.float64()}
    schema = pa.schema([pa.field(f.name, plain.get(f.type, f.type)) for f in edges.schema])
    edges = edges.cast(schema)
    if edges.num_rows == 0:
        return spark.createDataFrame([], T.StructType([T.StructField(f.name, T.LongType() if pa.types.is_integer(f.type) else T.StringType() if pa.types.is_string(f.type) else T.DoubleType()) for f in schema]))
    return spark.createDataFrame(edges)


def edge_frame(edges, **names: str) -> DataFrame:
    """The role columns of ``edges``, cast and renamed: ``edge_frame(df, tail="from", head="to", weight="cost")``."""
    frame = to_spark(edges, list(names.values()))
    for name in names.values():
        if name not in frame.columns:
            raise KeyError(f"edge column '{name}' not found in graph edges dataframe")
    return frame.select(*(F.col(f"`{name}`").cast(ROLES[role]).alias(role) for role, name in names.items()))


def standardize_graph_dataframe(edges, tail: str = "tail", head: str = "head", weight: str | None = None, trav_time: str | None = None, freq: str | None = None) -> DataFrame:
    """:func:`edge_frame` with the roles as arguments; those that are None are left out."""
    names = {"tail": tail, "head": head, "weight": weight, "trav_time": trav_time, "freq": freq}
    return edge_frame(edges, **{role: name for role, name in names.items() if name})


def read_edges(path: str, spark: SparkSession | None = None, source: str = "parquet", **names: str) -> DataFrame:
    """Edges from files, e.g. ``read_edges(path, tail="source", head="target", weight="tt")``; only these columns are read."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    reader = spark.read.format(source)
    if source == "csv":
        reader = reader.option("header", True)
    return edge_frame(reader.load(path), **names)


class GraphImporter:
    """Edges of any kind of table, as a Spark table with canonical columns or as a pandas one."""

    def __init__(self, edges: DataFrame):
        self.edges = edges

    @staticmethod
    def from_dataframe(edges, tail: str = "tail", head: str = "head", weight: str | None = None, trav_time: str | None = None, freq: str | None = None) -> GraphImporter:
        return GraphImporter(standardize_graph_dataframe(edges, tail, head, weight, trav_time, freq))

    def to_numpy_edges(self, columns: list[str] | None = None):
        """A pandas table of these canonical columns; the whole edge table comes to the driver."""
        return self.edges.select(*(columns or self.edges.columns)).toPandas()
