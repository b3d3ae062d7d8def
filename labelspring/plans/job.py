"""A whole run: two files in, labels and a run log out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring.operators.encoders import hashed_encode
from labelspring.plans.evaluate import cross_validate
from labelspring.plans.settings import Settings
from labelspring.plans.training import fit_predict
from labelspring.sources.scratch import drop_table, new_path, write_table
from labelspring.sources.tables import (
    append_metrics,
    read_labelled,
    read_unlabelled,
    spread,
    write_predictions,
)


def run_job(
    spark: SparkSession,
    train: str,
    test: str,
    out: str,
    overrides: list[str] | None = None,
    encode: Callable[[DataFrame], DataFrame] = hashed_encode,
    format: str = "csv",
    validate: bool = False,
    run: str | None = None,
) -> DataFrame:
    """Read both tables, encode, train, label the unlabelled rows, and write it all.

    Below ``out`` stand ``result`` (``row_id, LABEL`` as CSV) and the run log:
    ``rounds``, ``epochs`` and, with ``validate``, ``folds`` with the metrics of a
    cross-validation, ``fold_rounds`` and ``fold_epochs`` with its sizes and losses. The
    log is added to, the result replaced. With the name of a ``run`` its rows of the
    log take the place of those it wrote before. Returns ``row_id, LABEL`` as read
    from the result.
    """
    settings = Settings().overridden(overrides or [])
    path = new_path(spark, "encoded")
    fitted = None
    try:
        labelled, unlabelled = (
            write_table(encode(spread(rows)).drop("TEXT"), f"{path}/{name}")
            for name, rows in (
                ("labelled", read_labelled(spark, train, format)),
                ("unlabelled", read_unlabelled(spark, test, format)),
            )
        )
        fitted, predicted = fit_predict(labelled, unlabelled, settings)
        write_predictions(predicted, f"{out}/result")
        if fitted.rounds is not None:
            append_metrics(fitted.rounds.coalesce(1), f"{out}/rounds", run)
        append_metrics(fitted.epoch_log().coalesce(1), f"{out}/epochs", run)
        if validate:
            result = cross_validate(labelled, unlabelled, settings)
            append_metrics(result.per_fold(), f"{out}/folds", run)
            append_metrics(result.rounds().coalesce(1), f"{out}/fold_rounds", run)
            append_metrics(result.epochs().coalesce(1), f"{out}/fold_epochs", run)
            result.release()
    finally:
        if fitted is not None:
            fitted.release()
        drop_table(spark, path)
    written = spark.read.csv(f"{out}/result", header=True, schema="row_id long, LABEL int")
    return written.select("row_id", F.col("LABEL"))
