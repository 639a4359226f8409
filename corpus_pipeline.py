"""A training-corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, mixing.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the next one's documents. All but the last return the columns of
``documents``. SQL cannot express the exact joins and the dependent rounding at any useful speed, so ``ORACLE_SQL`` is None; ``tests/llm`` hold stages against brute force.

A stage's intermediate tables are its own: they are removed when the next stage starts, since its result is written then, and tables of other queries are left alone. ``run`` also
removes each stage's result once the next one is written; only the last stays.

Defined cases, in all stages: null, empty and blank texts fail the rules of the first stage, as do texts of fewer than 50 words; a null source is a host and a source of its own;
repeated rows count each for itself in the rules, lose their equal lines but the first's, and of what is left one row of a class stays; a null id sorts first; extra columns and columns
with the names of measures pass through; an empty table gives an empty table with the same columns (and ``copy`` at the end).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.llm import decontaminate, line_dedup, mixing, near_duplicates, quality
from earlywarn.llm.storage import materialize, owned, release
from earlywarn.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(name: str, function: Stage) -> tuple[str, Stage]:
    """A stage that owns its intermediate tables. The first leaves those of earlier runs, whose results may not be written."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = getattr(spark.sparkContext, "_earlywarn_stage", [])
        if function is not quality_rules:
            release(spark, left)
        with owned(spark) as mine:
            out = function(spark, docs, sf_dir)
        spark.sparkContext._earlywarn_stage = mine
        return out

    return name, run_stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict let pass."""
    return quality.quality_filter(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; ``n_chars`` follows the text."""
    return line_dedup.remove_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as the mix takes it, numbered by ``copy``."""
    return mixing.mixed_documents(docs)


STAGES = [
    _stage("quality rules", quality_rules),
    _stage("line dedup", line_deduplication),
    _stage("near duplicates", near_duplicate_removal),
    _stage("decontamination", benchmark_decontamination),
    _stage("mixing", source_mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents."""
    ship(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with owned(spark) as written:
            docs = materialize(out)
        release(spark, before)
        before = written
    release(spark, spark.sparkContext._earlywarn_stage)
    return docs
