"""The elastic net from sums over groups of rows, without going back to the rows.

Scaler and elastic net depend on the rows only through their number and the sums
of the vectors, the labels and their products. One aggregation gets these sums
for any number of groups. Sums can be added and taken away: the training set of a
fold is all rows less the fold, that of a round is the labelled rows and the
pseudo-labelled ones. What reaches the driver is as large as a group's matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partial sums of the tasks are added in so many shards first.
SHARDS = 64
SUMS_SCHEMA = "shard int, g int, n double, y double, yy double, sums array<double>"
STORED_SCHEMA = "intercept double, weights array<double>"
#: A dimension whose variance is below this share of its square mean is constant.
FLAT = 1e-13


@dataclass(frozen=True)
class Moments:
    """Number of rows, and the sums of labels, vectors and their products."""

    n: float
    y: float
    yy: float
    x: np.ndarray
    xy: np.ndarray
    xx: np.ndarray

    @classmethod
    def none(cls, width: int) -> Moments:
        return cls(0.0, 0.0, 0.0, np.zeros(width), np.zeros(width), np.zeros((width, width)))

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Moments:
        return cls(float(len(y)), float(y.sum()), float((y * y).sum()), x.sum(axis=0), x.T @ y, x.T @ x)

    def __add__(self, other: Moments) -> Moments:
        return Moments(*(a + b for a, b in zip(self._parts(), other._parts(), strict=True)))

    def __sub__(self, other: Moments) -> Moments:
        return Moments(*(a - b for a, b in zip(self._parts(), other._parts(), strict=True)))

    def _parts(self) -> tuple:
        return self.n, self.y, self.yy, self.x, self.xy, self.xx


def _summed(
    rows: DataFrame,
    vector: str,
    groups: int,
    width: int,
    parts: Callable[[pd.DataFrame, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]],
    moved: Callable[[np.ndarray], np.ndarray] | None = None,
) -> list[Moments]:
    """The sums of each group; ``parts`` names group, rows and labels in a batch.

    ``moved`` changes the vectors of a batch before they are summed.
    """
    upper = np.triu_indices(width)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        found: dict[int, Moments] = {}
        for frame in frames:
            if frame.empty:
                continue
            x = np.stack(frame[vector].to_numpy()).astype(np.float64)
            x = x if moved is None else moved(x)
            for g, at, y in parts(frame, x):
                if len(at):
                    found[g] = found.get(g, Moments.none(width)) + Moments.of(x[at], y)
        shard = TaskContext.get().partitionId() % SHARDS
        lines = [
            (shard, g, m.n, m.y, m.yy, np.concatenate([m.x, m.xy, m.xx[upper]]))
            for g, m in found.items()
        ]
        names = [field.split()[0] for field in SUMS_SCHEMA.split(", ")]
        yield pd.DataFrame(lines, columns=names)

    sums = rows.mapInPandas(partial, SUMS_SCHEMA).withColumn("sums", array_to_vector("sums"))
    for by in (["shard", "g"], ["g"]):
        sums = sums.groupBy(*by).agg(
            *[F.sum(c).alias(c) for c in ("n", "y", "yy")], Summarizer.sum(F.col("sums")).alias("sums")
        )
    out = [Moments.none(width) for _ in range(groups)]
    for row in sums.withColumn("sums", vector_to_array("sums")).collect():
        flat, xx = np.array(row["sums"]), np.zeros((width, width))
        xx[upper] = flat[2 * width :]
        xx = xx + np.triu(xx, 1).T
        out[row["g"]] = Moments(row["n"], row["y"], row["yy"], flat[:width], flat[width : 2 * width], xx)
    return out


def group_moments(
    rows: DataFrame,
    members: Column,
    groups: int,
    width: int,
    vector: str = "feat",
    moved: Callable[[np.ndarray], np.ndarray] | None = None,
) -> list[Moments]:
    """Sums of ``vector`` and ``LABEL`` for each group, from one pass over the rows.

    ``members`` is an array of the groups in ``[0, groups)`` that a row belongs to.
    ``moved`` changes the vectors of a batch in the Python worker that sums them, where
    a function on the column would need a worker of its own beside it.
    """

    def parts(frame, x):
        held = frame["_members"].to_numpy()
        at = np.repeat(np.arange(len(held)), [len(m) for m in held])
        group = np.concatenate([np.asarray(m, np.int64) for m in held]) if len(at) else at
        y = frame["LABEL"].to_numpy(np.float64)
        for g in np.unique(group):
            mine = at[group == g]
            yield int(g), mine, y[mine]

    narrow = rows.select(F.col("LABEL").cast("double").alias("LABEL"), vector, members.alias("_members"))
    return _summed(narrow, vector, groups, width, parts, moved)


@dataclass(frozen=True)
class LinearModel:
    """A score that is linear in the vector; the scaler is part of the weights."""

    weights: np.ndarray
    intercept: float

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(float(self.intercept), [float(w) for w in self.weights])]
        spark.createDataFrame(row, STORED_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        row = spark.read.schema(STORED_SCHEMA).parquet(path).first()
        return cls(np.array(row["weights"]), row["intercept"])


def _clipped(models: list[LinearModel], x: np.ndarray) -> np.ndarray:
    """Scores of the rows under each model, limited to [0, 1]; one column a model.

    They are rounded to twelve decimals, so that equal vectors tie in any batch.
    """
    weights = np.stack([m.weights for m in models], axis=1)
    scores = x @ weights + np.array([m.intercept for m in models])
    return np.clip(np.round(scores, 12), 0.0, 1.0)


def pseudo_moments(
    rows: DataFrame, models: list[LinearModel], thresholds: list[float], vector: str = "feat"
) -> list[Moments]:
    """Sums of the rows that each model is confident about, with its pseudo-labels.

    All models score a row in the same pass, and none of the scores is written.
    """
    sent = rows.sparkSession.sparkContext.broadcast((models, thresholds))

    def parts(frame, x):
        models, thresholds = sent.value
        scores = _clipped(models, x)
        for g, threshold in enumerate(thresholds):
            score = scores[:, g]
            at = np.flatnonzero((score >= threshold) | (score <= 1.0 - threshold))
            yield g, at, (score[at] >= threshold).astype(np.float64)

    return _summed(rows.select(vector), vector, len(models), len(models[0].weights), parts)


def solve_elastic(
    sums: Moments, alpha: float = 0.01, l1_ratio: float = 0.5, iterations: int = 5000, tol: float = 1e-12
) -> LinearModel:
    """Population scaling and the elastic net, by coordinate descent on the scaled products.

    A constant dimension gets no weight. Ends when no coefficient moves by ``tol``.
    """
    if not sums.n:
        raise ValueError("there are no labelled rows to fit on")
    mean, level = sums.x / sums.n, sums.y / sums.n
    squares = np.diag(sums.xx) / sums.n
    variance = squares - mean * mean
    flat = variance <= FLAT * squares
    std = np.sqrt(np.where(flat, 1.0, variance))
    gram = (sums.xx / sums.n - np.outer(mean, mean)) / np.outer(std, std)
    slope = (sums.xy / sums.n - mean * level) / std
    gram[flat, :], gram[:, flat], slope[flat] = 0.0, 0.0, 0.0
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    weights = np.zeros(len(mean))
    live = np.flatnonzero(~flat)
    for _ in range(iterations):
        most = 0.0
        for j in live:
            before = weights[j]
            pull = slope[j] - gram[j] @ weights + gram[j, j] * before
            weights[j] = np.sign(pull) * max(abs(pull) - l1, 0.0) / (gram[j, j] + l2)
            most = max(most, abs(weights[j] - before))
        if most <= tol:
            break
    raw = weights / std
    return LinearModel(raw, float(level - raw @ mean))


def fit_linear(
    train: DataFrame,
    width: int,
    vector: str = "feat",
    moved: Callable[[np.ndarray], np.ndarray] | None = None,
    **params,
) -> LinearModel:
    """Scaler and elastic net on all rows of ``train(LABEL, <vector>)``, from one aggregation."""
    everything = F.array(F.lit(0))
    return solve_elastic(group_moments(train, everything, 1, width, vector, moved)[0], **params)


def linear_scores(
    df: DataFrame,
    models: list[LinearModel],
    vector: str = "feat",
    name: str = "scores",
    moved: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Add ``name``: the scores of each row under all models, as an array.

    ``moved`` changes the vectors of a batch first, in the same Python worker. Marked as
    not deterministic, so that a filter on the scores does not work them out again.
    """
    sent = df.sparkSession.sparkContext.broadcast(models)

    def score(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return vectors
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        return pd.Series(list(_clipped(sent.value, x if moved is None else moved(x))))

    scored = F.pandas_udf(score, "array<double>").asNondeterministic()
    return df.withColumn(name, scored(F.col(vector)))


def linear_score(
    df: DataFrame,
    model: LinearModel,
    vector: str = "feat",
    moved: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Add ``score``, the model's score in [0, 1]."""
    scored = linear_scores(df, [model], vector, "_scores", moved)
    return scored.withColumn("score", F.col("_scores")[0]).drop("_scores")
