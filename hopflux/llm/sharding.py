"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number in (0, 1) for a key from a hash of both; the key goes to the shard with the largest
``weight / -ln(draw)``.  A key's draws do not depend on the other shards, so a further shard only takes keys to itself and a
removed one only gives its own away.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hopflux.llm.work import save


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """Shard of a key (a string column; null counts as the empty key), from the shards' positive weights; ties go to the larger number."""
    if not weights or any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    key = F.coalesce(key, F.lit(""))

    def draw(shard: int) -> Column:
        head = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 12)
        return (F.conv(head, 16, 10).cast("double") + 0.5) / float(1 << 48)

    return F.greatest(*(F.struct((F.lit(float(w)) / -F.ln(draw(s))).alias("v"), F.lit(s).alias("s")) for s, w in weights.items()))["s"] if len(weights) > 1 else F.lit(next(iter(weights)))


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in ``order``.

    Rows are dealt by ranges of ``order`` and numbered within the pieces; pieces start where earlier ones end.  The only
    gathered numbers are one per piece and group.
    """
    dealt = save(df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()), "ranges")
    piece = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(group, "_piece").agg(F.count("*").alias("_n")).select(group, "_piece", F.coalesce(F.sum("_n").over(piece), F.lit(0)).alias("_start"))
    within = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_piece", group).orderBy(*order)))
    return within.join(starts, ["_piece", group]).withColumn(name, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_piece", "_rank", "_start")


def shard(docs: DataFrame, weights: Mapping[int, float], id_col: str = "doc_id", text_col: str = "text", more: Mapping[int, float] | None = None) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, shard, slot, and grown_shard if ``more`` gives the shards after a change.

    ``weights`` maps shard numbers to weights.  size: UTF-8 bytes of the text plus 1.  slot: place within the shard, without
    gaps, by doc_id (then size and checksum).

    Null or empty text: size 1, checksum 0.  A null id is the empty key, so all such rows share a shard; repeated rows share
    theirs too and get slots of their own.  An empty table gives an empty result.  Only the two named columns are read, so
    further columns may have any name.  Texts are not shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.col("doc_id").cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("shard", rendezvous(key, weights).cast("int"))
    if more:
        rows = rows.withColumn("grown_shard", rendezvous(key, more).cast("int"))
    return numbered(rows, "shard", ["doc_id", "size", "text_crc32"], "slot")
