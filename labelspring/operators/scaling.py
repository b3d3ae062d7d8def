"""Standard scaling by the population standard deviation."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaler_stats(df: DataFrame, vector: str = "emb") -> DataFrame:
    """``dim, mean, std``: one row for each dimension, population std, 1 if constant.

    A single aggregation over whole vectors; no vector is exploded into rows.
    """
    summary = df.select(array_to_vector(vector).alias("_v")).agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col("_v")).alias("s")
    )
    arrays = summary.select(
        F.col("s.count").alias("n"),
        vector_to_array("s.mean").alias("mean"),
        vector_to_array("s.variance").alias("variance"),
    )
    cells = arrays.select("n", F.posexplode(F.arrays_zip("mean", "variance")))
    std = F.sqrt(F.col("col.variance") * (F.col("n") - 1) / F.col("n"))
    return cells.select(
        F.col("pos").alias("dim"),
        F.col("col.mean").alias("mean"),
        F.when(std > 0, std).otherwise(F.lit(1.0)).alias("std"),
    )


def fit_scaler(
    df: DataFrame, n: int, input_col: str, output_col: str
) -> PipelineModel:
    """Scaler model for ``n`` training rows.

    Spark's scaler divides by the sample std; the second stage turns that into
    the population std. A constant dimension becomes 0.
    """
    sample = StandardScaler(
        withMean=True, withStd=True, inputCol=input_col, outputCol=f"{output_col}_sample"
    ).fit(df)
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    population = ElementwiseProduct(
        scalingVec=[factor] * sample.mean.size,
        inputCol=f"{output_col}_sample",
        outputCol=output_col,
    )
    return PipelineModel([sample, population])
