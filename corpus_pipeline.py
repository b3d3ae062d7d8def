"""From raw documents to a mixed training set: five stages, each on what the one before kept.

1. quality rules: documents that fail, or whose host fails, go
2. line dedup: boilerplate lines of a host go
3. near-duplicates: one document of each component stays
4. decontamination: documents that hold a benchmark item go
5. mixing: every document gets the rate at which it is to be read
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring.llm.decontaminate import without_contaminated
from labelspring.llm.lines import without_boilerplate
from labelspring.llm.minhash import without_near_duplicates
from labelspring.llm.mixing import mixed
from labelspring.llm.quality import good_documents
from labelspring.sources.scratch import drop_table, new_path, write_table

#: Shares of the mixed tokens by domain.
TARGETS = {"good": 0.85, "plain": 0.13, "toxic": 0.02}


def domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the labelled documents."""
    return labels.select(
        "doc_id",
        F.when(F.col("toxic") == 1, "toxic")
        .when(F.col("quality") == 1, "good")
        .when(F.col("quality") == 0, "plain")
        .alias("domain"),
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_boilerplate(docs).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixed(docs, labelled, TARGETS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

#: Near-duplicates and alignments have no practical SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each is written and read again, then its input is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        docs = write_table(stage(spark, docs, sf_dir), path)
        if before:
            drop_table(spark, before)
        before = path
    return docs
