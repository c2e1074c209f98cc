"""A pipeline from raw documents to a training mix, in five stages.

Each stage is written as Parquet in the shared folder and reread by the next. All but the
last return the columns of ``documents``, whatever these are; the last adds what the mix takes.

A decision holds for a row. Where ``doc_id`` is null or repeated in a stage's input, that stage
tells rows apart by numbers of its own, dealt out in the order of ``doc_id`` (null first), so
that the smallest or largest id still stays; rows with one id are rejected each by its own text.
Null texts count as empty: they are clean, copies of each other, near copies of nothing, hold
no benchmark item, and have size 0, so the mix takes none. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heaploom.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from heaploom.llm.common import drop_keys
from heaploom.plans.staging import free, scratch, stage


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``_row`` that tells rows apart: doc_id where that does."""
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    return stage(docs.orderBy(F.asc_nulls_first("doc_id")).withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")


def _stage_of(rejected: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that leaves out the rows whose ``_row`` is among those that ``rejected`` returns."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        columns = [F.col(f"`{c}`") for c in docs.columns]
        with scratch() as kept:
            rows = _numbered(docs)
            gone = stage(rejected(spark, rows, sf_dir).select("_row").distinct(), "pipeline-gone")
            kept += [rows, gone]
            return drop_keys(rows, "_row", gone, gone.count()).select(*columns)

    run.__doc__ = rejected.__doc__
    return run


@_stage_of
def drop_toxic(spark: SparkSession, rows: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject stay. It learns from labelled rows of the input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(rows, toxicity.learnable(labels))
    return toxicity.score(rows, model, key="_row").where("predicted = 1")


@_stage_of
def drop_copies(spark: SparkSession, rows: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return exact_dedup.exact_dedup(rows, key="_row").where("not kept")


@_stage_of
def drop_near_copies(spark: SparkSession, rows: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at Jaccard 0.8 over five-word shingles stays: the smallest id."""
    return near_dedup.near_duplicates(rows, size=5, percent=80, key="_row").where("not kept")


@_stage_of
def drop_leaks(spark: SparkSession, rows: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found stay."""
    return decontaminate.find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_row")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``size`` in words and ``taken`` words, repeats counted.

    These two replace columns of the same names.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("size", "taken")]
    return mixing.mixed(_numbered(docs), key="_row").select(*columns, "size", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Toxicity and near-duplicate search are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        with scratch() as kept:
            made = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(made)
        free(docs)
        docs = made
    return docs
