"""Readers and writers of labelled text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring.functions.columns import UNLABELLED, strict_long, text_as_string
from labelspring.operators.linear import LinearModel
from labelspring.operators.projection import Projection
from labelspring.sources.published import publish, published


def _read_rows(spark: SparkSession, path: str, format: str) -> DataFrame:
    if format == "parquet":
        return spark.read.parquet(path)
    if format != "csv":
        raise ValueError(f"unknown format {format!r}, expected 'csv' or 'parquet'")
    # Columns are matched by the header's names and stay text, so nothing is inferred.
    return spark.read.csv(
        path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST"
    )


def read_labelled(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """``row_id, TEXT, LABEL``. A missing or non-numeric id or label fails the job.

    A CSV file with quoted line breaks is read by one task: pass many files, or
    convert to Parquet once and read that.
    """
    return _read_rows(spark, path, format).select(
        strict_long(F.col("row_id"), "row_id").alias("row_id"),
        text_as_string(F.col("TEXT")).alias("TEXT"),
        strict_long(F.col("LABEL"), "LABEL").cast("int").alias("LABEL"),
    )


def read_unlabelled(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """``row_id, TEXT, LABEL`` with ``LABEL`` -1 where the file has none.

    A label that is not a number counts as none.
    """
    rows = _read_rows(spark, path, format)
    label = F.lit(UNLABELLED)
    if "LABEL" in rows.columns:
        label = F.coalesce(F.col("LABEL").try_cast("decimal(38,10)").cast("int"), label)
    return rows.select(
        strict_long(F.col("row_id"), "row_id").alias("row_id"),
        text_as_string(F.col("TEXT")).alias("TEXT"),
        label.alias("LABEL"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Rows of a freshly read table, over all cores if its files fill only some.

    For small inputs before work that is heavy for each row. An input with a
    partition for every core is left as it was read, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; quotes doubled, blanks and line breaks inside fields kept."""
    df.write.mode("overwrite").csv(
        path,
        header=True,
        quote='"',
        escape='"',
        quoteAll=True,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_predictions(df: DataFrame, path: str) -> None:
    """``row_id, LABEL`` as CSV, in the order of the ids."""
    ordered = df.select("row_id", "LABEL").orderBy("row_id")
    ordered.write.mode("overwrite").csv(path, header=True)


def write_scores(oof: DataFrame, path: str) -> None:
    """Out-of-fold scores as Parquet, one folder for each fold."""
    oof.write.mode("overwrite").partitionBy("fold").parquet(path)


def append_metrics(metrics: DataFrame, path: str, run: str | None = None) -> None:
    """Add metric rows to the run log.

    With the name of a ``run`` the log has it as a column, and the rows take the place
    of those that the same run wrote before, so a job that is repeated leaves one copy.
    The other runs' rows are not touched, and rows are put in place only when all are
    written. A table without rows replaces nothing. One log is written with names or
    without, not both; a name should not be a number, since readers guess its type.
    """
    if run is None:
        metrics.write.mode("append").parquet(path)
        return
    named = metrics.withColumn("run", F.lit(run)).write.mode("overwrite").partitionBy("run")
    named.option("partitionOverwriteMode", "dynamic").parquet(path)


def class_balance(df: DataFrame) -> DataFrame:
    """One row: number of rows, positives and negatives."""
    label = F.col("LABEL")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(label == 1).alias("n_pos"),
        F.count_if(label == 0).alias("n_neg"),
    )


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Ids that occur more than once, with their count. The joins need there to be none."""
    return df.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def require_unique_ids(df: DataFrame) -> DataFrame:
    """The same rows, or an error that names a repeated id."""
    repeated = duplicate_ids(df).first()
    if repeated is not None:
        raise ValueError(f"row_id {repeated['row_id']} occurs {repeated['n']} times")
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table or model was saved under the path."""
    try:
        spark.read.format("binaryFile").load(path).limit(0).collect()
    except Exception as error:  # a missing path is an analysis error
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def save_model(
    spark: SparkSession, path: str, projection: Projection, model: PipelineModel | LinearModel
) -> None:
    """Keep a fitted encoder projection and its scaler and regressor."""
    projection.save(spark, f"{path}/projection")
    if isinstance(model, LinearModel):
        model.save(spark, f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> tuple[Projection, PipelineModel | LinearModel]:
    trees = path_exists(spark, f"{path}/model/metadata")
    return (
        Projection.load(spark, f"{path}/projection"),
        PipelineModel.load(f"{path}/model") if trees else LinearModel.load(spark, f"{path}/model"),
    )


def fingerprint(df: DataFrame) -> str:
    """Number of rows, and a sum of hashes that changes with any value of them."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hashes"),
    ).first()
    return f"{row['n']}:{row['hashes']}"


def cached_projection(
    spark: SparkSession, path: str | None, fit: Callable[[], Projection], facts: str = ""
) -> Projection:
    """The projection saved under ``path`` with the same ``facts``, or that of ``fit()``.

    ``facts`` names all that the fit depends on. A saved projection with others is
    fitted again and replaced, as a whole: a run that ends while it saves leaves the
    projection that was there, and no reader meets half of one.
    """
    at = published(spark, path) if path is not None else None
    if at is not None:
        projection, known = Projection.load_with_facts(spark, at)
        if known == facts:
            return projection
    projection = fit()
    if path is not None:
        publish(spark, path, lambda aside: projection.save(spark, aside, facts))
    return projection
