"""Linear fine-tuning of frozen vectors.

A square matrix W, the identity at first, is trained by gradient descent under
the same objectives as the encoder it stands in for. Each epoch is one Spark
job: tasks turn their pairs or batches into partial gradients, which are summed
in two levels. Only the summed gradient, as large as W, reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring.functions.keyed import DEFAULT_SEED, draw_below, keyed_draws
from labelspring.functions.vectors import with_unit_length
from labelspring.operators.losses import RANKING_SCALE, gather_batches
from labelspring.operators.sampling import attach_pair_values, batches, make_pairs
from labelspring.sources.scratch import drop_table, new_path, write_table

GRADIENT_SCHEMA = "shard int, total double, n long, grad array<double>"
FOLD_GRADIENT_SCHEMA = "shard int, fold int, total double, n long, grad array<double>"
SHARDS = 64

STORED_SCHEMA = "i int, w array<double>, epoch int, note array<string>"
EPOCH_SCHEMA = "stage string, epoch int, loss double, grad_norm double, n long"


@dataclass
class Projection:
    """The matrix and one metrics row for each epoch that led to it."""

    weights: np.ndarray
    epochs: list[tuple] = field(default_factory=list)

    @classmethod
    def identity(cls, width: int) -> Projection:
        return cls(np.eye(width))

    @property
    def is_identity(self) -> bool:
        return np.array_equal(self.weights, np.eye(len(self.weights)))

    def epoch_table(self, spark: SparkSession) -> DataFrame:
        """``stage, epoch, loss, grad_norm, n``: the mean loss before each step."""
        return spark.createDataFrame(self.epochs, EPOCH_SCHEMA)

    def save(self, spark: SparkSession, path: str, facts: str | None = None) -> None:
        """Keep the matrix, its epochs, and ``facts`` about what it was fitted to."""
        rows = [(i, row.tolist(), None, None) for i, row in enumerate(self.weights)]
        rows += [(None, None, i, list(map(str, e))) for i, e in enumerate(self.epochs)]
        rows.append((None, None, None, [facts or ""]))
        spark.createDataFrame(rows, STORED_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Projection:
        return cls.load_with_facts(spark, path)[0]

    @classmethod
    def load_with_facts(cls, spark: SparkSession, path: str) -> tuple[Projection, str]:
        rows = spark.read.schema(STORED_SCHEMA).parquet(path).collect()
        weights = sorted((r["i"], r["w"]) for r in rows if r["i"] is not None)
        epochs = [
            (stage, int(epoch), float(loss), float(size), int(n))
            for _, (stage, epoch, loss, size, n) in sorted(
                (r["epoch"], r["note"]) for r in rows if r["epoch"] is not None
            )
        ]
        facts = [r["note"][0] for r in rows if r["i"] is None and r["epoch"] is None and r["note"]]
        return cls(np.array([w for _, w in weights]), epochs), (facts or [""])[0]


def moved_vectors(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """W times each row, at unit length; zero rows stay zero."""
    moved = x @ weights.T
    length = np.linalg.norm(moved, axis=1, keepdims=True)
    moved /= np.where(length > 0, length, 1.0)
    return moved


def apply_projection(
    df: DataFrame,
    projection: Projection,
    vector: str = "emb",
    name: str = "feat",
    dtype: str = "float",
) -> DataFrame:
    """Add ``name``: W times the vector, unit length. Zero vectors stay zero."""
    if projection.is_identity:
        unit = with_unit_length(df, vector, "_unit")
        return unit.withColumn(name, F.col("_unit").cast(f"array<{dtype}>")).drop("_unit")
    weights = df.sparkSession.sparkContext.broadcast(projection.weights)
    target = np.float32 if dtype == "float" else np.float64

    @F.pandas_udf(f"array<{dtype}>")
    def project(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return vectors
        moved = moved_vectors(np.stack(vectors.to_numpy()).astype(np.float64), weights.value)
        return pd.Series(list(moved.astype(target)))

    return df.withColumn(name, project(F.col(vector)))


def _sum_gradients(partials: DataFrame) -> tuple[float, int, np.ndarray]:
    """Add the tasks' partial gradients, first within shards, then over them."""

    def level(df, by):
        return df.groupBy(*by).agg(
            F.sum("total").alias("total"),
            F.sum("n").alias("n"),
            Summarizer.sum(F.col("grad")).alias("grad"),
        )

    vectors = partials.withColumn("grad", array_to_vector("grad"))
    row = (
        level(level(vectors, ["shard"]), [])
        .select("total", "n", vector_to_array("grad").alias("grad"))
        .first()
    )
    if not row["n"]:
        raise ValueError("there are no rows to train the projection on")
    width = int(round(len(row["grad"]) ** 0.5))
    return row["total"], row["n"], np.array(row["grad"]).reshape(width, width)


def batch_pair_gradient(
    a: np.ndarray, b: np.ndarray, label: np.ndarray, w: np.ndarray
) -> tuple[float, np.ndarray]:
    """Summed cosine pair loss of some pairs at W, and its gradient."""
    u, v = a @ w.T, b @ w.T
    nu = np.linalg.norm(u, axis=1, keepdims=True)
    nv = np.linalg.norm(v, axis=1, keepdims=True)
    dead = (nu == 0) | (nv == 0)
    nu, nv = np.where(nu == 0, 1.0, nu), np.where(nv == 0, 1.0, nv)
    u, v = u / nu, v / nv
    c = (u * v).sum(axis=1, keepdims=True)
    error = c - label[:, None]
    slope = np.where(dead, 0.0, 2.0 * error)
    grad = (slope * (v - c * u) / nu).T @ a + (slope * (u - c * v) / nv).T @ b
    return float((error**2).sum()), grad


def pair_gradient(pairs: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray, int]:
    """Mean cosine pair loss at W, its gradient, and the number of pairs."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def partial(frames):
        from pyspark import TaskContext

        w = shared.value
        total, n, grad = 0.0, 0, np.zeros_like(w)
        for frame in frames:
            if frame.empty:
                continue
            a = np.stack(frame["emb_a"].to_numpy()).astype(np.float64)
            b = np.stack(frame["emb_b"].to_numpy()).astype(np.float64)
            part, slope = batch_pair_gradient(a, b, frame["label"].to_numpy(dtype=np.float64), w)
            grad += slope
            total += part
            n += len(frame)
        shard = TaskContext.get().partitionId() % SHARDS
        yield pd.DataFrame(
            {"shard": [shard], "total": [total], "n": [n], "grad": [grad.ravel()]}
        )

    partials = pairs.select("emb_a", "emb_b", "label").mapInPandas(partial, GRADIENT_SCHEMA)
    total, n, grad = _sum_gradients(partials)
    shared.destroy()
    return total / n, grad / n, n


def _batch_ranking(
    a: np.ndarray, b: np.ndarray, w: np.ndarray, scale: float
) -> tuple[float, np.ndarray]:
    """Summed ranking loss of one batch's two views at W, and its gradient."""
    u, v = a @ w.T, b @ w.T
    nu = np.linalg.norm(u, axis=1, keepdims=True)
    nv = np.linalg.norm(v, axis=1, keepdims=True)
    live_u, live_v = nu > 0, nv > 0
    nu, nv = np.where(live_u, nu, 1.0), np.where(live_v, nv, 1.0)
    u, v = u / nu, v / nv
    s = scale * (u @ v.T)
    top = s.max(axis=1, keepdims=True)
    share = np.exp(s - top)
    mass = share.sum(axis=1, keepdims=True)
    total = float((top + np.log(mass)).sum() - np.trace(s))
    share = scale * (share / mass - np.eye(len(a)))
    du, dv = share @ v, share.T @ u
    du = np.where(live_u, du - (du * u).sum(axis=1, keepdims=True) * u, 0.0) / nu
    dv = np.where(live_v, dv - (dv * v).sum(axis=1, keepdims=True) * v, 0.0) / nv
    return total, du.T @ a + dv.T @ b


def ranking_gradient(
    grouped: DataFrame, weights: np.ndarray, scale: float = RANKING_SCALE
) -> tuple[float, np.ndarray, int]:
    """Mean in-batch ranking loss of two views at W, its gradient, and the row count.

    ``grouped`` has one row for each batch, with arrays ``view_a`` and ``view_b``.
    """
    return fold_ranking_gradients(grouped, [weights], scale)[0]


def _matrices(view: pa.Array, width: int) -> list[np.ndarray]:
    """The vectors of each batch as one matrix, straight from Arrow's buffers."""
    ends = np.cumsum(pa.compute.list_value_length(view).to_numpy(zero_copy_only=False))
    vectors = view.flatten()
    widths = pa.compute.list_value_length(vectors)
    if widths.null_count or (widths.to_numpy() != width).any():
        raise ValueError(f"there are rows without a vector of {width} entries")
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.split(values.astype(np.float64, copy=False).reshape(-1, width), ends[:-1])


def fold_ranking_gradients(
    grouped: DataFrame, weights: list[np.ndarray], scale: float = RANKING_SCALE
) -> list[tuple[float, np.ndarray, int]]:
    """Of each fold the mean loss at its own W, the gradient, and the number of rows it sees.

    ``grouped`` has one row for each batch, with arrays ``view_a`` and ``view_b``, and
    ``fold``: the fold that holds a row out, or NULL. A fold's batch is the batch
    without the rows that the fold holds out. Folds that see the same rows at the
    same W, as all do where no row is held out, share one product. A batch is read as
    matrices, never as an object for each vector, which would take several times the memory.
    """
    if "fold" not in grouped.columns:
        grouped = grouped.withColumn("fold", F.lit(None).cast("array<int>"))
    shared = grouped.sparkSession.sparkContext.broadcast(weights)

    def partial(frames):
        from pyspark import TaskContext

        ws = shared.value
        first = [next(i for i, w in enumerate(ws) if w is one or np.array_equal(w, one)) for one in ws]
        total, n = [0.0] * len(ws), [0] * len(ws)
        grads = [np.zeros_like(w) for w in ws]
        for frame in frames:
            if not frame.num_rows:
                continue
            views = [_matrices(frame[name], len(ws[0])) for name in ("view_a", "view_b")]
            for a, b, held in zip(*views, frame["fold"].to_pylist(), strict=True):
                folds = np.full(len(a), -1) if held is None else np.array(
                    [-1 if f is None else f for f in held], np.int64
                )
                known = {}
                for fold in range(len(ws)):
                    seen = folds != fold
                    rows = int(seen.sum())
                    if not rows:
                        continue
                    key = first[fold], seen.tobytes()
                    if key not in known:
                        known[key] = _batch_ranking(a[seen], b[seen], ws[fold], scale)
                    total[fold] += known[key][0]
                    grads[fold] += known[key][1]
                    n[fold] += rows
        shard = TaskContext.get().partitionId() % SHARDS
        columns = {
            "shard": pa.array([shard] * len(ws), pa.int32()),
            "fold": pa.array(range(len(ws)), pa.int32()),
            "total": pa.array(total, pa.float64()),
            "n": pa.array(n, pa.int64()),
            "grad": pa.array([g.ravel() for g in grads], pa.list_(pa.float64())),
        }
        yield pa.RecordBatch.from_pydict(columns)

    partials = grouped.select("view_a", "view_b", "fold").mapInArrow(partial, FOLD_GRADIENT_SCHEMA)
    sums = partials.withColumn("grad", array_to_vector("grad"))
    for by in (["shard", "fold"], ["fold"]):
        sums = sums.groupBy(*by).agg(
            F.sum("total").alias("total"), F.sum("n").alias("n"), Summarizer.sum(F.col("grad")).alias("grad")
        )
    found = {r["fold"]: r for r in sums.withColumn("grad", vector_to_array("grad")).collect()}
    shared.destroy()
    out = []
    for fold, w in enumerate(weights):
        row = found.get(fold)
        if row is None or not row["n"]:
            raise ValueError("there are no rows to train the projection on")
        out.append((row["total"] / row["n"], np.array(row["grad"]).reshape(w.shape) / row["n"], row["n"]))
    return out


def clipped_step(
    weights: np.ndarray, grad: np.ndarray, rate: float, max_norm: float
) -> tuple[np.ndarray, float]:
    """Gradient step with the gradient clipped to ``max_norm``."""
    size = float(np.linalg.norm(grad))
    return weights - rate * min(1.0, max_norm / size if size > 0 else 1.0) * grad, size


def fit_pairs(
    train: DataFrame,
    start: Projection,
    n_pairs: int = 3000,
    epochs: int = 3,
    learning_rate: float = 2.0,
    max_grad_norm: float = 1.0,
    seed: int = DEFAULT_SEED,
) -> Projection:
    """Supervised fit on pairs drawn from ``train(row_id, LABEL, emb)``.

    Always starts from ``start``, so no round builds on another's matrix.
    """
    drawn = make_pairs(train, n_pairs, seed).persist()
    weights, log = start.weights, []
    pairs = attach_pair_values(drawn, train, "emb").persist()
    try:
        for epoch in range(1, epochs + 1):
            loss, grad, n = pair_gradient(pairs, weights)
            weights, size = clipped_step(weights, grad, learning_rate, max_grad_norm)
            log.append(("pairs", epoch, loss, size, n))
    finally:
        pairs.unpersist()
        drawn.unpersist()
    return Projection(weights, [*start.epochs, *log])


def dropout_view(
    vector: Column,
    row_id: Column,
    epoch: int,
    view: int,
    probability: float = 0.1,
    seed: int = DEFAULT_SEED,
) -> Column:
    """The vector with entries dropped by chance and the others scaled up.

    A mask bit is a digest of seed, row, epoch, view and dimension, so a task that
    is run again drops the same entries, and so does plain SQL.
    """
    keep, cut = 1.0 - probability, draw_below(probability)
    draws = keyed_draws(row_id, f"dropout-{epoch}-{view}", F.array_size(vector), seed)
    return F.zip_with(
        vector,
        draws,
        lambda x, draw: F.when(draw < F.lit(cut), F.lit(0.0)).otherwise(x.cast("double") / keep),
    )


def two_views(
    grouped: DataFrame, epoch: int, probability: float = 0.1, seed: int = DEFAULT_SEED
) -> DataFrame:
    """``view_a`` and ``view_b`` of each batch with arrays ``row_id`` and ``emb``, and its ``fold``.

    The masks are drawn after the rows have met, so only the vectors are shuffled.
    """

    def views(view):
        return F.zip_with(
            "emb",
            "row_id",
            lambda x, r: dropout_view(x, r, epoch, view, probability, seed),
        )

    rest = [c for c in ("fold",) if c in grouped.columns]
    return grouped.select(views(0).alias("view_a"), views(1).alias("view_b"), *rest)


def fit_simcse(
    texts: DataFrame,
    start: Projection,
    epochs: int = 1,
    batch_size: int = 32,
    learning_rate: float = 0.2,
    max_grad_norm: float = 1.0,
    dropout: float = 0.1,
    scale: float = RANKING_SCALE,
    seed: int = DEFAULT_SEED,
) -> Projection:
    """Unsupervised fit on ``texts(row_id, emb)``: tell a row's two views from its batch."""
    rows = texts.select("row_id", "emb")
    return fit_simcse_folds(
        rows, start, 1, epochs, batch_size, learning_rate, max_grad_norm, dropout, scale, seed
    )[0]


def fit_simcse_folds(
    texts: DataFrame,
    start: Projection,
    folds: int,
    epochs: int = 1,
    batch_size: int = 32,
    learning_rate: float = 0.2,
    max_grad_norm: float = 1.0,
    dropout: float = 0.1,
    scale: float = RANKING_SCALE,
    seed: int = DEFAULT_SEED,
) -> list[Projection]:
    """The unsupervised fits of all folds, each without the rows whose ``fold`` it is.

    ``texts`` has ``row_id, emb`` and, with more than one fold, ``fold``, NULL for
    rows that all folds see. The rows are dealt into batches once, and each batch
    adds to the gradients of all folds: the vectors are shuffled once however many
    folds there are. With more than one epoch the batches are written out and read
    by each.
    """
    columns = ["row_id", "emb", *(c for c in ("fold",) if c in texts.columns)]
    weights, logs = [start.weights] * folds, [[] for _ in range(folds)]
    grouped = gather_batches(batches(texts.select(*columns), batch_size, seed), *columns)
    path = new_path(texts.sparkSession, "batches") if epochs > 1 else None
    try:
        if path is not None:
            grouped = write_table(grouped, path)
        for epoch in range(1, epochs + 1):
            views = two_views(grouped, epoch, dropout, seed)
            sums = fold_ranking_gradients(views, weights, scale)
            weights = list(weights)
            for fold, (loss, grad, n) in enumerate(sums):
                weights[fold], size = clipped_step(weights[fold], grad, learning_rate, max_grad_norm)
                logs[fold].append(("simcse", epoch, loss, size, n))
    finally:
        if path is not None:
            drop_table(texts.sparkSession, path)
    return [Projection(w, [*start.epochs, *log]) for w, log in zip(weights, logs, strict=True)]
