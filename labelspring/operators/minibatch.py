"""Supervised fit of the projection with a step for each batch of pairs.

The pairs of an epoch are put in a hashed order and cut into batches. Runs of
``local_steps`` batches are dealt to workers: a worker is one group of pairs
that starts at the shared matrix, takes its steps one after the other in a task,
and gives back the matrix it ends with. The mean of the workers' matrices,
weighed by their steps, is the start of the next epoch. Up to ``local_steps``
batches there is one worker, and the fit is plain descent by batches; with more
pairs there are more workers, never a larger group. A task that is run again
takes the same steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.functions.keyed import DEFAULT_SEED, keyed_order
from labelspring.operators.projection import (
    SHARDS,
    Projection,
    batch_pair_gradient,
    clipped_step,
)
from labelspring.operators.rank import hashed_rank
from labelspring.operators.sampling import attach_pair_values, make_pairs
from labelspring.sources.scratch import drop_table, new_path, write_table

STEP_RATE = 0.05
# Pairs in a batch, steps of rising rate, and the steps of 3,000 such pairs.
BATCH, WARMUP, LOCAL_STEPS = 8, 100, 375

WORKER_SCHEMA = "shard int, total double, norms double, n long, steps long, w array<double>"


def rate_share(step: int, steps: int, warmup: int) -> float:
    """Share of the learning rate at a step: it rises over ``warmup`` steps, then falls to 0."""
    if step < warmup:
        return step / warmup
    return max(0.0, (steps - step) / max(1, steps - warmup))


def ordered_pairs(pairs: DataFrame, epoch: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """Add ``place``, the pair's position in the epoch's order."""
    order = keyed_order(F.col("pair_id"), f"steps-{epoch}", seed)
    return hashed_rank(pairs, order, key="pair_id", name="place")


def _worker(
    sent, batch_size: int, local_steps: int, first: int, steps: int, rate: float, warmup: int, max_norm: float
) -> Callable:
    """The steps of one worker; ``first`` is the number of steps taken before this epoch."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        a = np.stack(frame["emb_a"].to_numpy()).astype(np.float64)
        b = np.stack(frame["emb_b"].to_numpy()).astype(np.float64)
        label = frame["label"].to_numpy(dtype=np.float64)
        w, total, norms, taken = sent.value, 0.0, 0.0, 0
        for low in range(0, len(frame), batch_size):
            cut = slice(low, low + batch_size)
            loss, grad = batch_pair_gradient(a[cut], b[cut], label[cut], w)
            now = rate * rate_share(first + taken, steps, warmup)
            w, size = clipped_step(w, grad / len(label[cut]), now, max_norm)
            total, norms, taken = total + loss, norms + size, taken + 1
        shard = int(frame["place"].iloc[0]) // (batch_size * local_steps) % SHARDS
        return pd.DataFrame(
            {
                "shard": [shard],
                "total": [total],
                "norms": [norms],
                "n": [len(frame)],
                "steps": [taken],
                "w": [(w * taken).ravel()],
            }
        )

    return run


def _joined(workers: DataFrame):
    """Sums over the workers, first within shards, then over them."""
    sums = workers.withColumn("w", array_to_vector("w"))
    for by in (["shard"], []):
        sums = sums.groupBy(*by).agg(
            *[F.sum(c).alias(c) for c in ("total", "norms", "n", "steps")],
            Summarizer.sum(F.col("w")).alias("w"),
        )
    return sums.withColumn("w", vector_to_array("w")).first()


def fit_pair_steps(
    train: DataFrame,
    start: Projection,
    n_pairs: int = 3000,
    epochs: int = 3,
    batch_size: int = BATCH,
    learning_rate: float = STEP_RATE,
    warmup: int = WARMUP,
    max_grad_norm: float = 1.0,
    local_steps: int = LOCAL_STEPS,
    seed: int = DEFAULT_SEED,
) -> Projection:
    """Supervised fit on pairs drawn from ``train(row_id, LABEL, emb)``, a step a batch.

    The schedule counts the steps of one worker. An epoch's log has the mean loss of
    its batches, each before its step, and the mean norm of their gradients. A train
    table without pairs is an error.
    """
    spark = train.sparkSession
    path = new_path(spark, "pairs")
    try:
        drawn = write_table(make_pairs(train, n_pairs, seed), f"{path}/ids")
        pairs = write_table(attach_pair_values(drawn, train, "emb"), f"{path}/vectors")
        batches = -(-pairs.count() // batch_size)
        if not batches:
            raise ValueError("there are no rows to train the projection on")
        each = min(local_steps, batches)
        weights, log = start.weights, []
        for epoch in range(1, epochs + 1):
            sent = spark.sparkContext.broadcast(weights)
            run = _worker(
                sent, batch_size, local_steps, (epoch - 1) * each, epochs * each, learning_rate, warmup, max_grad_norm
            )
            worker = F.floor(F.col("place") / F.lit(batch_size * local_steps)).alias("worker")
            placed = ordered_pairs(pairs.select("pair_id", "label", "emb_a", "emb_b"), epoch, seed)
            row = _joined(placed.groupBy(worker).applyInPandas(run, WORKER_SCHEMA))
            sent.destroy()
            weights = np.array(row["w"]).reshape(weights.shape) / row["steps"]
            log.append(("steps", epoch, row["total"] / row["n"], row["norms"] / row["steps"], row["n"]))
    finally:
        drop_table(spark, path)
    return Projection(weights, [*start.epochs, *log])
