"""The given tables in the shapes the library works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring.functions.columns import UNLABELLED
from labelspring.functions.keyed import keyed_hash
from labelspring.operators.sampling import make_pairs


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``row_id, TEXT`` of every document."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("TEXT")
    )


def document_labels(spark: SparkSession, folder: str) -> DataFrame:
    """``row_id, LABEL`` of the labelled documents."""
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("LABEL")
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """``row_id, TEXT, LABEL`` of the documents with a quality label."""
    joined = documents(spark, folder).join(document_labels(spark, folder), "row_id")
    return joined.select("row_id", "TEXT", "LABEL")


def unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    """``row_id, TEXT, LABEL`` of the other documents, ``LABEL`` -1."""
    rest = documents(spark, folder).join(document_labels(spark, folder), "row_id", "left_anti")
    return rest.withColumn("LABEL", F.lit(UNLABELLED))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``row_id, LABEL, emb`` of the precomputed vectors, in two classes."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") >= 5).cast("int").alias("LABEL"),
        F.col("embedding").alias("emb"),
    )


def vector_pairs(spark: SparkSession, folder: str, n: int = 3000) -> DataFrame:
    return make_pairs(vectors(spark, folder), n)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """``row_id, score, y``: a forest-like score of every document, ``y`` NULL if unlabelled.

    Scores are multiples of 1/200, so they tie and hit the thresholds exactly.
    """
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"))
    marked = rows.join(
        document_labels(spark, folder).withColumnRenamed("LABEL", "y"), "row_id", "left"
    )
    draw = F.pmod(keyed_hash(F.col("row_id"), "score"), F.lit(201))
    return marked.select("row_id", (draw / F.lit(200.0)).alias("score"), "y")
