"""Fitting on labelled rows, and self-training on top of it.

Tables carry ``row_id, LABEL, emb``; unlabelled ones ``row_id, emb``. The base
vectors are computed once by the caller. A round only applies its matrix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspring.functions.columns import label_by_cut
from labelspring.operators.linear import LinearModel, fit_linear
from labelspring.operators.minibatch import fit_pair_steps
from labelspring.operators.models import fit_model, score_rows, scores_moved
from labelspring.operators.projection import (
    Projection,
    apply_projection,
    fit_pairs,
    fit_simcse,
    fit_simcse_folds,
    moved_vectors,
)
from labelspring.operators.selection import (
    augment,
    cap_by_class,
    round_cap,
    round_changes,
    round_counts,
    select_confident,
)
from labelspring.plans.settings import Settings
from labelspring.sources.scratch import drop_table, new_path, write_table
from labelspring.sources.tables import (
    cached_projection,
    fingerprint,
    require_unique_ids,
    save_model,
)

ROUND_SCHEMA = (
    "round int, total_train long, labeled long, pseudo long, pos long, neg long"
)
LOG_SCHEMA = "round int, stage string, epoch int, loss double, grad_norm double, n long"

# Chosen ids are broadcast up to this many; the caps say how many there can be.
BROADCAST_CHOSEN = 100_000


@dataclass
class Fitted:
    """Projection, scaler and regressor, with the counts of the rounds behind them."""

    projection: Projection
    model: PipelineModel | LinearModel
    train: DataFrame
    rounds: DataFrame | None = None
    scratch: str | None = None
    log: list[tuple] = field(default_factory=list)
    counts: list[tuple] = field(default_factory=list)
    changes: DataFrame | None = None
    change_paths: list[str] = field(default_factory=list)

    def release(self) -> None:
        """Delete the written pseudo-labels and changes; ``train`` and ``changes`` can no longer be read."""
        for path in [self.scratch, *self.change_paths]:
            if path is not None:
                drop_table(self.train.sparkSession, path)
        self.scratch, self.changes, self.change_paths = None, None, []

    def epoch_log(self) -> DataFrame:
        """``round, stage, epoch, loss, grad_norm, n`` of all rounds."""
        return self.train.sparkSession.createDataFrame(self.log, LOG_SCHEMA)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score`` to rows with ``emb``.

        Under a linear model or a forest one Python worker for a task moves and scores.
        """
        if self.projection.is_identity or not scores_moved(self.model):
            moved = apply_projection(df, self.projection)
            return score_rows(moved, self.model).drop("feat")
        return score_rows(df, self.model, "emb", _moving(df, self.projection))

    def predict(self, df: DataFrame, cut: float = 0.5) -> DataFrame:
        """``row_id, score, LABEL``."""
        return self.score(df).select(
            "row_id", "score", label_by_cut(F.col("score"), cut).alias("LABEL")
        )


def vector_width(df: DataFrame) -> int:
    row = df.filter(F.col("emb").isNotNull()).select(F.size("emb").alias("width")).first()
    if row is None:
        raise ValueError("there are no rows with vectors")
    return row["width"]


def _own_key(df: DataFrame, second: Column) -> DataFrame:
    """Ids that stay unique when two tables are put together.

    A labelled and an unlabelled row may carry the same ``row_id``, any 64-bit
    integer, so the key is a text that begins with the table it is from.
    """
    table = F.when(second, F.lit("u")).otherwise(F.lit("l"))
    return df.withColumn("row_id", F.concat(table, F.col("row_id").cast("string")))


def stage_one(
    labelled: DataFrame,
    unlabelled: DataFrame,
    settings: Settings,
    base: Projection,
    cache: str | None = None,
) -> Projection:
    """Unsupervised fit on the given labelled and all unlabelled texts, labels unused."""
    texts = _own_key(labelled.select("row_id", "emb"), F.lit(False)).unionByName(
        _own_key(unlabelled.select("row_id", "emb"), F.lit(True))
    )

    def fit():
        return fit_simcse(
            texts,
            base,
            settings.simcse_epochs,
            settings.simcse_batch,
            settings.simcse_learning_rate,
            settings.max_grad_norm,
            seed=settings.seed,
        )

    facts = ""
    if cache is not None:
        given = (
            settings.simcse_epochs,
            settings.simcse_batch,
            settings.simcse_learning_rate,
            settings.max_grad_norm,
            settings.seed,
            len(base.weights),
            base.is_identity,
        )
        facts = f"{given} {fingerprint(texts)}"
    return cached_projection(labelled.sparkSession, cache, fit, facts)


def stage_one_folds(
    folded: DataFrame, unlabelled: DataFrame, settings: Settings, base: Projection
) -> list[Projection]:
    """The unsupervised fit of each fold, on its training texts and all unlabelled ones.

    One pass for all folds: see :func:`fit_simcse_folds`.
    """
    rest = unlabelled.select("row_id", "emb", F.lit(None).cast("int").alias("fold"))
    texts = _own_key(folded.select("row_id", "emb", "fold"), F.lit(False)).unionByName(
        _own_key(rest, F.lit(True))
    )
    return fit_simcse_folds(
        texts,
        base,
        settings.folds,
        settings.simcse_epochs,
        settings.simcse_batch,
        settings.simcse_learning_rate,
        settings.max_grad_norm,
        seed=settings.seed,
    )


def first_rows(labelled: DataFrame) -> DataFrame:
    """The labelled rows as the first round of self-training is fitted on them."""
    return _own_key(labelled.select("row_id", "LABEL", "emb"), F.lit(False))


def fit_projection(train: DataFrame, settings: Settings, base: Projection) -> Projection:
    """The projection fitted on pairs, or ``base`` where there is no such fit."""
    if not settings.fine_tune:
        return base
    if settings.pair_batch is not None:
        return fit_pair_steps(
            train,
            base,
            settings.pairs,
            settings.epochs,
            settings.pair_batch,
            settings.step_learning_rate,
            settings.warmup_steps,
            settings.max_grad_norm,
            seed=settings.seed,
        )
    return fit_pairs(
        train,
        base,
        settings.pairs,
        settings.epochs,
        settings.learning_rate,
        settings.max_grad_norm,
        settings.seed,
    )


def _moving(df: DataFrame, projection: Projection) -> Callable[[np.ndarray], np.ndarray]:
    """What :func:`apply_projection` does to the vectors of a batch, as single precision."""
    sent = df.sparkSession.sparkContext.broadcast(projection.weights)

    def moved(x):
        return moved_vectors(x, sent.value).astype(np.float32).astype(np.float64)

    return moved


def fit_on(train: DataFrame, projection: Projection, settings: Settings) -> Fitted:
    """Scaler and regressor on the moved vectors.

    The elastic net is solved from sums over all rows, in one pass. The trees are
    fitted on all rows too, unless the settings name a bound in ``fit_rows``.
    """
    width = len(projection.weights)
    if settings.model == "elastic" and not projection.is_identity:
        # One Python worker for a task moves the vectors and sums them.
        moved = _moving(train, projection)
        model = fit_linear(train, width, "emb", moved, **settings.model_params)
    elif settings.model == "elastic":
        model = fit_linear(apply_projection(train, projection), width, **settings.model_params)
    else:
        model = fit_model(
            apply_projection(train, projection),
            settings.model,
            partitions=settings.fit_partitions,
            seed=settings.seed,
            fit_rows=settings.fit_rows,
            **settings.model_params,
        )
    log = [(0, *epoch) for epoch in projection.epochs]
    return Fitted(projection, model, train, log=log)


def fit_labelled(train: DataFrame, settings: Settings, base: Projection) -> Fitted:
    """Fit the projection on pairs, then scaler and regressor on the moved vectors."""
    return fit_on(train, fit_projection(train, settings, base), settings)


def _chosen_rows(
    fitted: Fitted,
    unlabelled: DataFrame,
    settings: Settings,
    rnd: int,
    path: str,
    scores: DataFrame | None = None,
) -> DataFrame:
    """``row_id, LABEL, emb`` of the round's pseudo-labels, written to ``path``.

    Under a cap only ids and scores of the confident rows are written; the cap is
    cut there, and the vectors follow for the rows below it. ``scores`` are the
    scores of all rows, if they are written already.
    """
    if scores is not None:
        chosen = cap_by_class(
            select_confident(scores, settings.threshold), round_cap(settings.cap, rnd)
        ).select("row_id", "LABEL")
        return write_table(
            unlabelled.join(chosen, "row_id").select("row_id", "LABEL", "emb"), path
        )
    scored = select_confident(fitted.score(unlabelled), settings.threshold)
    columns = ["row_id", "LABEL", "emb"]
    cap = round_cap(settings.cap, rnd)
    if cap is None:
        return write_table(scored.select(*columns), path)
    narrow = new_path(unlabelled.sparkSession, "scores")
    try:
        chosen = cap_by_class(
            write_table(scored.select("row_id", "score", "LABEL"), narrow), cap
        ).select("row_id", "LABEL")
        if 2 * cap <= BROADCAST_CHOSEN:
            chosen = F.broadcast(chosen)
        return write_table(unlabelled.join(chosen, "row_id").select(*columns), path)
    finally:
        drop_table(unlabelled.sparkSession, narrow)


def self_train(
    labelled: DataFrame,
    unlabelled: DataFrame,
    settings: Settings,
    base: Projection | None = None,
    first: Fitted | None = None,
    first_scores: DataFrame | None = None,
    track: bool = False,
) -> Fitted:
    """Fit, promote confident predictions to labels, and fit again from ``base``.

    All rounds but the last score the unlabelled rows. A round's pseudo-labels
    are written out with their vectors, so the next round starts from a table
    and neither joins them back nor predicts them again. The table of the round
    before is then deleted, and if a round fails so is its own. With ``track`` the
    result has ``changes``: the round of the scores, and which pseudo-labels entered,
    left or flipped by them. A round that selects nothing changes nothing.
    """
    spark = labelled.sparkSession
    columns = ["row_id", "LABEL", "emb"]
    labelled = labelled.select(*columns)
    unlabelled = unlabelled.select("row_id", "emb")
    if base is None:
        base = Projection.identity(vector_width(labelled))
    train = labelled.withColumn("is_pseudo", F.lit(False))
    counts, log, kept, path = [], [], None, None
    before, changes, change_paths = None, [], []
    try:
        for rnd in range(settings.rounds + 1):
            counts.append((rnd, *round_counts(train).first()))
            if rnd == 0 and first is not None:
                fitted = replace(first)
            else:
                fitted = fit_labelled(_own_key(train, F.col("is_pseudo")), settings, base)
            log += [(rnd, *epoch) for epoch in fitted.projection.epochs]
            if rnd == settings.rounds:
                break
            path = new_path(spark, f"pseudo-{rnd}")
            chosen = _chosen_rows(
                fitted, unlabelled, settings, rnd, path, first_scores if rnd == 0 else None
            )
            if chosen.isEmpty():
                drop_table(spark, path)
                continue
            train = augment(labelled, chosen, checked=True)
            if track:
                change_paths.append(new_path(spark, f"changes-{rnd}"))
                changed = round_changes(before, chosen).select(F.lit(rnd).alias("round"), "*")
                changes.append(write_table(changed, change_paths[-1]))
                before = chosen
            if kept is not None:
                drop_table(spark, kept)
            kept = path
    except BaseException:
        for written in {kept, path, *change_paths} - {None}:
            drop_table(spark, written)
        raise
    fitted.train = train
    fitted.rounds = spark.createDataFrame(counts, ROUND_SCHEMA)
    fitted.scratch = kept
    fitted.log, fitted.counts = log, counts
    if track:
        if not changes:
            nothing = labelled.limit(0)
            changes = [round_changes(None, nothing).select(F.lit(0).alias("round"), "*")]
        fitted.changes, fitted.change_paths = reduce(DataFrame.unionByName, changes), change_paths
    return fitted


def fit_predict(
    labelled: DataFrame,
    unlabelled: DataFrame,
    settings: Settings,
    self_training: bool = True,
) -> tuple[Fitted, DataFrame]:
    """Final run: fit on all labelled rows, then ``row_id, score, LABEL`` of the rest."""
    require_unique_ids(labelled)
    require_unique_ids(unlabelled)
    base = Projection.identity(vector_width(labelled))
    if settings.simcse != "none":
        base = stage_one(labelled, unlabelled, settings, base, settings.simcse_cache)
    if self_training:
        fitted = self_train(labelled, unlabelled, settings, base)
    else:
        fitted = fit_labelled(labelled, settings, base)
    if settings.save_path is not None:
        save_model(
            labelled.sparkSession, settings.save_path, fitted.projection, fitted.model
        )
    return fitted, fitted.predict(unlabelled, settings.output_cut)
