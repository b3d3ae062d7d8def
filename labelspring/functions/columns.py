"""Scalar rules on text, labels and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNLABELLED = -1

# Texts that the pandas CSV reader takes as missing by default.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]


def text_as_string(text: Column) -> Column:
    """Text with every missing marker replaced by the string ``nan``."""
    return F.when(text.isNull() | text.isin(MISSING_TEXTS), F.lit("nan")).otherwise(text)


def strict_long(column: Column, name: str) -> Column:
    """Integer value of a CSV field; a missing or non-numeric one fails the job."""
    missing = F.raise_error(F.lit(f"{name} is missing")).cast("bigint")
    return F.coalesce(column.cast("decimal(38,10)").cast("bigint"), missing)


def sentinel_label(df: DataFrame, has_label: bool = True) -> DataFrame:
    """Integer ``LABEL``; -1 in every row when ``has_label`` is false."""
    label = F.col("LABEL").cast("int") if has_label else F.lit(UNLABELLED)
    return df.withColumn("LABEL", label)


def clip_score(score: Column) -> Column:
    """Score limited to [0, 1]. NaN stays NaN: Spark ranks it above all numbers."""
    score = score.cast("double")
    return F.when(F.isnan(score), score).otherwise(
        F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    )


def label_by_cut(score: Column, cut: float = 0.5) -> Column:
    """1 where the score reaches the cut, else 0; NaN never reaches it."""
    return F.when(F.isnan(score), 0).otherwise((score >= F.lit(float(cut))).cast("int"))


def confidence_label(score: Column, threshold: float) -> Column:
    """1 for a confident positive, 0 for a confident negative, NULL between.

    The lower bound is computed in double arithmetic, so at 0.85 a score of
    0.15 is confident and at 0.90 a score of 0.10 is not.
    """
    if not 0.5 < threshold <= 1.0:
        raise ValueError(f"threshold must be in (0.5, 1], got {threshold}")
    return (
        F.when(F.isnan(score), F.lit(None).cast("int"))
        .when(score >= F.lit(float(threshold)), 1)
        .when(score <= F.lit(1.0 - threshold), 0)
    )


def four_decimals(value: Column) -> Column:
    """Metric as text with four decimals, for reports only."""
    return F.format_string("%.4f", value)
