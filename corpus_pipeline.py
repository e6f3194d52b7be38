"""The corpus pipeline: documents in, packed training sequences out, each stage written as Parquet and read again.

What a stage returns may be read at any time: tables that it reads stay until the application ends, or, in :func:`run`, until
the stage's documents are written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopflux.llm import decontamination, line_dedup, neardup, packing, toxicity
from hopflux.llm.queries import tokenizer_path
from hopflux.llm.text import text_hash
from hopflux.llm.work import current, save, scope, shared_dir, within

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; the model is fitted on labelled rows of ``docs``."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of words go; a document of which nothing is left goes too, one that was empty before stays."""
    cut = line_dedup.dedup_lines(docs)
    cut = cut.where((F.col("cut_words") == 0) | (F.trim("text") != ""))
    return cut.withColumn("n_chars", F.when(F.col("cut_words") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def _row_key(text: Column) -> tuple[Column, Column]:
    """What tells rows apart: the id (null as the least one) and a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_kid"), text.alias("_th")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity of 0.8 or more) stays, the one with the smallest id.

    Rows stay or go by the operator's ``kept``.  Of kept rows alike in id and words one stays (the least text by hash); differing texts under
    one id both stay if the id is kept.  A row without an id stays only if no row with an id has its words.
    """
    outer = current()
    with scope() as own:
        found = neardup.near_duplicates(docs, percent=80)
        kept = found.where("kept").groupBy("doc_id", "h1", "h2").agg(F.min("text_hash").alias("th"))
        with within(outer):  # the decisions stay, a few numbers a row; what led to them goes
            kept = save(kept.select(*_row_key(F.col("th"))).distinct(), "kept")
    own.free()
    return docs.select("*", *_row_key(text_hash(F.col("text")))).join(kept.hint("merge"), ["_kid", "_th"]).dropDuplicates(["_kid", "_th"]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows contaminate go; rows with one id or none are judged each by its own text."""
    outer = current()
    with scope() as own:
        judged = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        with within(outer):
            bad = save(judged.where("contaminated").select(*_row_key(F.col("text_hash"))).distinct(), "contaminated")
    own.free()
    return docs.select("*", *_row_key(text_hash(F.col("text")))).join(bad.hint("merge"), ["_kid", "_th"], "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, with their ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: Fitted models, hashes and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs, outer = spark.read.parquet(f"{sf_dir}/documents.parquet"), current()
    for name, step in STAGES[:-1]:
        with scope() as own:
            made = step(spark, docs, sf_dir)
            with within(outer):
                docs = save_stage(spark, made, name)
        own.free()
    return STAGES[-1][1](spark, docs, sf_dir)


def save_stage(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """Write a stage's documents to the shared folder, apart from the work tables of stages."""
    path = f"{shared_dir(spark)}/hopflux-stage-{name}-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)
