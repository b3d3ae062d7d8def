"""Scaler and regressor, fitted together with Spark ML on 0/1 labels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from labelspring.functions.columns import clip_score
from labelspring.functions.keyed import DEFAULT_SEED, keyed_order
from labelspring.operators.forest import forest_score, is_scaled_forest
from labelspring.operators.linear import LinearModel, linear_score
from labelspring.operators.rank import hashed_rank
from labelspring.operators.scaling import fit_scaler

#: Partitions of the rows a model is fitted on. Part of the result of the tree models.
FIT_PARTITIONS = 16
#: Bins of a feature of the tree models.
MAX_BINS = 32
#: Memory in each task for the node statistics of one pass. It cuts a level of a forest on many
#: rows into more passes and has no part in the result, since every node looks at all features.
NODE_MB = 256

COLUMNS = {"featuresCol": "_scaled", "labelCol": "LABEL", "predictionCol": "_prediction"}


def _forest(label_std: float, seed: int, trees: int = 200, depth: int = 30, **params):
    settings = {
        "numTrees": trees,
        "maxDepth": depth,
        "featureSubsetStrategy": "all",
        "subsamplingRate": 1.0,
        "minInstancesPerNode": 1,
        "seed": seed,
        "maxBins": MAX_BINS,
        "maxMemoryInMB": NODE_MB,
        "cacheNodeIds": True,  # deep trees: keep each row's node instead of walking down
    }
    return RandomForestRegressor(**COLUMNS, **{**settings, **params})


def _boosting(label_std: float, seed: int, stages: int = 200, depth: int = 3, **params):
    settings = {
        "maxIter": stages,
        "maxDepth": depth,
        "stepSize": 0.1,
        "seed": seed,
        "maxBins": MAX_BINS,
        "maxMemoryInMB": NODE_MB,
    }
    return GBTRegressor(**COLUMNS, **{**settings, **params})


def _elastic(
    label_std: float,
    seed: int,
    alpha: float = 0.01,
    l1_ratio: float = 0.5,
    iterations: int = 5000,
    **params,
):
    # Spark divides the L2 part of the penalty by the std of the label.
    l1 = alpha * l1_ratio
    strength = l1 + alpha * (1.0 - l1_ratio) * (label_std or 1.0)
    settings = {
        "regParam": strength,
        "elasticNetParam": l1 / strength if strength else 0.0,
        "maxIter": iterations,
        "standardization": False,
    }
    return LinearRegression(**COLUMNS, **{**settings, **params})


REGRESSORS = {"rf": _forest, "gbm": _boosting, "elastic": _elastic}


def make_regressor(
    name: str, label_std: float = 1.0, seed: int = DEFAULT_SEED, **params
):
    """Unfitted regressor by name; the names are the keys of ``REGRESSORS``."""
    if name not in REGRESSORS:
        raise ValueError(f"unknown model {name!r}, expected one of {sorted(REGRESSORS)}")
    return REGRESSORS[name](label_std, seed, **params)


def canonical_layout(df: DataFrame, partitions: int = FIT_PARTITIONS) -> DataFrame:
    """The same rows in the same partitions and order, whatever they were before.

    Tree learning samples by partition and position, so without this the same
    training set could give another forest. The number of partitions is part of
    the layout, so it does not follow the session's settings.
    """
    return df.repartition(partitions, "row_id").sortWithinPartitions("row_id")


def bounded_rows(df: DataFrame, most: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """At most about ``most`` rows, with each class's share of them unchanged.

    For callers who want a part: no query and no default of the settings does.
    A class keeps its first rows in a hashed order, one of them at least. Only ids
    are ranked; the ids that stay are as few as ``most`` says, so they are broadcast.
    """
    n = df.count()
    if n <= most:
        return df
    ids = df.select("row_id", "LABEL")
    ranked = hashed_rank(
        ids, keyed_order(F.col("row_id"), "fit", seed), by=("LABEL",), name="_idx", size="_m"
    )
    quota = F.greatest(F.round(F.col("_m") * F.lit(most / n)), F.lit(1))
    kept = ranked.filter(F.col("_idx") < quota).select("row_id")
    return df.join(F.broadcast(kept), "row_id", "left_semi")


def fit_model(
    train: DataFrame,
    model: str = "rf",
    vector: str = "feat",
    partitions: int = FIT_PARTITIONS,
    seed: int = DEFAULT_SEED,
    fit_rows: int | None = None,
    **params,
) -> PipelineModel:
    """Fit scaler and regressor on all rows of ``train(row_id, LABEL, <vector>)``.

    Only a caller who names ``fit_rows`` gets a stratified part of more rows than that.
    """
    rows = train.select(
        "row_id", F.col("LABEL").cast("double").alias("LABEL"), F.col(vector).alias("_vector")
    )
    if fit_rows is not None:
        rows = bounded_rows(rows, fit_rows, seed)
    laid_out = (
        canonical_layout(rows, partitions)
        .withColumn("_features", array_to_vector("_vector"))
        .drop("_vector")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        facts = laid_out.agg(
            F.count(F.lit(1)).alias("n"), F.stddev_samp("LABEL").alias("label_std")
        ).first()
        if not facts["n"]:
            raise ValueError("there are no labelled rows to fit on")
        scaler = fit_scaler(laid_out, facts["n"], "_features", "_scaled")
        regressor = make_regressor(model, facts["label_std"] or 0.0, seed, **params)
        fitted = regressor.fit(scaler.transform(laid_out))
        return PipelineModel([*scaler.stages, fitted])
    finally:
        laid_out.unpersist()


def scores_moved(fitted: PipelineModel | LinearModel) -> bool:
    """Whether :func:`score_rows` takes ``moved`` with this model."""
    return isinstance(fitted, LinearModel) or is_scaled_forest(fitted)


def score_rows(
    df: DataFrame,
    fitted: PipelineModel | LinearModel,
    vector: str = "feat",
    moved: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Add ``score``, the prediction clipped to [0, 1].

    ``moved`` changes the vectors of a batch before a linear model or a forest scores them.
    """
    if isinstance(fitted, LinearModel):
        return linear_score(df, fitted, vector, moved)
    prediction = forest_score(df, fitted, vector, moved)
    if prediction is not None:
        predicted = df.withColumn("_prediction", prediction)
    elif moved is not None:
        raise ValueError("only a linear model or a forest scores vectors that are moved")
    else:
        predicted = fitted.transform(df.withColumn("_features", array_to_vector(vector)))
    return predicted.select(*df.columns, clip_score(F.col("_prediction")).alias("score"))
