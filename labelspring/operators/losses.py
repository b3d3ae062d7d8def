"""Training objectives over pairs and batches of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.functions.vectors import cosine

# Fixed value: the documented default scale of the in-batch ranking loss.
RANKING_SCALE = 20.0


def pair_cosine(pairs: DataFrame) -> DataFrame:
    """Add ``cosine`` to pairs with vectors ``emb_a`` and ``emb_b``."""
    return pairs.withColumn("cosine", cosine(F.col("emb_a"), F.col("emb_b")))


def cosine_pair_loss(pairs: DataFrame) -> DataFrame:
    """One row: mean squared distance of cosine and label, and the number of pairs."""
    distance = F.col("cosine") - F.col("label")
    return pair_cosine(pairs).agg(
        F.avg(distance * distance).alias("loss"), F.count(F.lit(1)).alias("n_pairs")
    )


def gather_batches(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each batch, with its vectors as arrays of arrays.

    A batch holds at most the batch size, by construction.
    """
    members = rows.groupBy("batch_id").agg(F.collect_list(F.struct(*columns)).alias("m"))
    return members.select("batch_id", *[F.col(f"m.{c}").alias(c) for c in columns])


def in_batch_ranking_loss(rows: DataFrame, scale: float = RANKING_SCALE) -> DataFrame:
    """One row: mean loss of finding each row's own vector among its batch.

    ``rows`` has ``batch_id, row_id, emb``. A batch's similarities are one matrix
    product inside a task; no pair of rows is ever written out.
    """

    def batch_losses(frames):
        for frame in frames:
            out = []
            for members in frame["emb"]:
                x = np.stack(members).astype(np.float64)
                length = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(length > 0, length, 1.0)
                similarity = scale * (x @ x.T)
                top = similarity.max(axis=1)
                spread = top + np.log(np.exp(similarity - top[:, None]).sum(axis=1))
                out.append((float((spread - np.diag(similarity)).sum()), len(members)))
            yield pd.DataFrame(out, columns=["total", "n"])

    gathered = gather_batches(rows, "emb").select("emb")
    sums = gathered.mapInPandas(batch_losses, "total double, n long")
    return sums.agg(
        (F.sum("total") / F.sum("n")).alias("loss"), F.sum("n").alias("n_rows")
    )
