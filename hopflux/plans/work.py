"""Work tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A work table belongs to the innermost :func:`scope` that is open when it is written, and goes when that scope is freed; tables
without one stay until the application ends, since results that read them may be lazy.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is set (tests, one machine) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        own = "file://" + tempfile.mkdtemp(prefix="hopflux-work-")
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_hopflux_work"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scope:
    """Work tables of one owner, who frees them once nothing lazy reads them any more."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        #: Names of those that stand in the catalog, see :func:`bucketed`.
        self.names: list[tuple[SparkSession, str]] = []

    def free(self) -> None:
        from pyspark import SparkContext

        paths, self.paths = self.paths, []
        names, self.names = self.names, []
        for spark, name in names if SparkContext._active_spark_context is not None else []:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = SparkContext._jvm
        if jvm is not None and paths:
            conf = jvm.org.apache.hadoop.conf.Configuration() if SparkContext._active_spark_context is None else SparkContext._active_spark_context._jsc.hadoopConfiguration()
            for path in paths:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)


_rest = Scope()
_open: contextvars.ContextVar[Scope] = contextvars.ContextVar("scope", default=_rest)


@atexit.register
def _free_rest() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        _rest.free()


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    """Work tables written in this block belong to the scope that it gives; leaving the block does not free them."""
    own = Scope()
    token = _open.set(own)
    try:
        yield own
    finally:
        _open.reset(token)


@contextlib.contextmanager
def within(given: Scope) -> Iterator[Scope]:
    """:func:`scope` with a scope that is there already."""
    token = _open.set(given)
    try:
        yield given
    finally:
        _open.reset(token)


def current() -> Scope:
    """The innermost scope that is open."""
    return _open.get()


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a work table and return the table: cuts lineage and survives lost executors."""
    return save_at(df, name)[0]


def save_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`save`, and the path of the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hopflux-{name}-{uuid.uuid4().hex}"
    _open.get().paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, name: str, key: str, deal: bool = True) -> DataFrame:
    """A work table in as many buckets of ``key`` as the session has shuffle partitions.

    Two such tables are joined on the key without a shuffle.  Without ``deal`` the rows are taken to lie by bucket already, as after
    such a join, and only sorted.
    """
    spark = df.sparkSession
    count, own = int(spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/hopflux-{name}-{own}", f"`{spark.catalog.currentDatabase()}`.`hopflux_{name}_{own}`"
    _open.get().paths.append(path)
    _open.get().names.append((spark, table))
    dealt = df.repartition(count, key) if deal else df
    dealt.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(count, key).sortBy(key).saveAsTable(table)
    return spark.table(table)
