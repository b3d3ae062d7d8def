"""Cross-validation, repeated splits, fold ensembles and parameter sweeps.

Runs are made of steps: a fold's rows, its unsupervised stage, its first projection,
fit and scores, its later rounds. Runs that differ in later settings alone share
the earlier steps. Where the vectors do not depend on the fold and the regressor
is linear, all folds come from one pass over the rows, see :mod:`plans.linear`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring.functions.columns import label_by_cut
from labelspring.operators.linear import linear_scores
from labelspring.operators.metrics import fold_metrics, fold_summary, metrics_at_cut
from labelspring.operators.projection import Projection, apply_projection
from labelspring.operators.sampling import fold_rows, shuffle_splits, stratified_folds
from labelspring.plans.linear import fold_models, is_linear, split_models
from labelspring.plans.settings import Settings
from labelspring.plans.steps import Steps
from labelspring.plans.training import (
    LOG_SCHEMA,
    ROUND_SCHEMA,
    Fitted,
    first_rows,
    fit_labelled,
    fit_on,
    fit_projection,
    self_train,
    stage_one,
    stage_one_folds,
    vector_width,
)
from labelspring.sources.scratch import drop_table, new_path, write_table
from labelspring.sources.tables import require_unique_ids


@dataclass
class Validation:
    """Out-of-fold scores ``fold, row_id, y, score``; the unlabelled rows' scores if kept.

    ``counts`` and ``log`` hold the sizes of each fold's rounds and the losses of its
    epochs, led by the fold.
    """

    oof: DataFrame
    cut: float
    test_scores: DataFrame | None = None
    scratch: tuple[str, ...] = ()
    counts: list[tuple] = field(default_factory=list)
    log: list[tuple] = field(default_factory=list)

    def rounds(self) -> DataFrame:
        """``fold, round, total_train, labeled, pseudo, pos, neg``."""
        spark = self.oof.sparkSession
        return spark.createDataFrame(sorted(self.counts), f"fold int, {ROUND_SCHEMA}")

    def epochs(self) -> DataFrame:
        """``fold, round, stage, epoch, loss, grad_norm, n``."""
        return self.oof.sparkSession.createDataFrame(self.log, f"fold int, {LOG_SCHEMA}")

    def release(self) -> None:
        """Delete the written scores; the tables can no longer be read."""
        for path in self.scratch:
            drop_table(self.oof.sparkSession, path)
        self.scratch = ()

    def per_fold(self) -> DataFrame:
        return fold_metrics(self.oof, self.cut)

    def summary(self) -> DataFrame:
        return fold_summary(self.per_fold())

    def pooled(self) -> DataFrame:
        """Metrics of all folds' scores together; not the mean of the folds."""
        return metrics_at_cut(self.oof, self.cut)


def _each(spark: SparkSession, parts: list, parallel: int, run: Callable) -> list:
    """Run the parts, at most ``parallel`` at a time."""
    if parallel <= 1 or len(parts) <= 1:
        return [run(part) for part in parts]
    with ThreadPool(min(parallel, len(parts))) as pool:
        return pool.map(inheritable_thread_target(spark)(run), parts, chunksize=1)


def _fold_table(labelled: DataFrame, settings: Settings) -> tuple[DataFrame, str]:
    """The labelled rows with their fold, written so that a fold is a folder."""
    require_unique_ids(labelled)
    rows = labelled.select("row_id", "LABEL", "emb")
    path = new_path(labelled.sparkSession, "folds")
    folded = stratified_folds(rows, settings.folds, seed=settings.seed)
    return write_table(folded, path, "fold"), path


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _held_out(fitted: Fitted, rows: DataFrame, fold: int, path: str) -> DataFrame:
    scored = fitted.score(rows).select(
        F.lit(fold).alias("fold"), "row_id", F.col("LABEL").alias("y"), "score"
    )
    return write_table(scored, path)


class _Run:
    """The steps of one validation, in the order in which they depend on each other."""

    def __init__(self, labelled, unlabelled, settings: Settings, self_training: bool, steps: Steps):
        self.labelled, self.unlabelled, self.settings = labelled, unlabelled, settings
        self.self_training, self.steps = self_training, steps
        s = settings
        self.folds_key = (s.folds, s.seed)
        self.base_key = (*self.folds_key, s.simcse)
        if s.simcse != "none":
            self.base_key += (
                s.simcse_epochs, s.simcse_batch, s.simcse_learning_rate, s.max_grad_norm, s.simcse_cache
            )
        self.projection_key = (*self.base_key, s.fine_tune)
        if s.fine_tune:
            self.projection_key += (s.pairs, s.epochs, s.learning_rate, s.max_grad_norm)
            self.projection_key += (s.pair_batch, s.step_learning_rate, s.warmup_steps)
        params = tuple(sorted(s.model_params.items()))
        self.fit_key = (*self.projection_key, s.model, params, s.fit_rows, s.fit_partitions)
        cap = tuple(sorted(s.cap.items())) if isinstance(s.cap, dict) else s.cap
        self.rounds_key = (*self.fit_key, s.rounds, s.threshold, cap) if self_training else self.fit_key
        self.linear = is_linear(s, self_training)
        self.written: list[str] = []

    def _path(self, name: str) -> str:
        """A path for results of this run; they go if the run fails."""
        path = new_path(self.labelled.sparkSession, name)
        self.written.append(path)
        return path

    def folded(self) -> DataFrame:
        return self.steps.once(
            "folds", self.folds_key, lambda: _fold_table(self.labelled, self.settings)
        )[0]

    def bases(self) -> list[Projection]:
        """The projection that each fold starts from."""

        def run():
            identity = Projection.identity(vector_width(self.folded()))
            if self.settings.simcse == "fold":
                return stage_one_folds(self.folded(), self.unlabelled, self.settings, identity)
            base = identity
            if self.settings.simcse == "all":
                base = stage_one(
                    self.folded(), self.unlabelled, self.settings, identity, self.settings.simcse_cache
                )
            return [base] * self.settings.folds

        return self.steps.once("stage_one", self.base_key, run)

    def _first(self, train: DataFrame, fold: int) -> Fitted:
        projection = self.steps.once(
            "projection",
            (fold, *self.projection_key),
            lambda: fit_projection(train, self.settings, self.bases()[fold]),
        )
        return self.steps.once(
            "fit", (fold, *self.fit_key), lambda: fit_on(train, projection, self.settings)
        )

    def _first_scores(self, first: Fitted, fold: int) -> DataFrame:
        def run():
            path = new_path(self.labelled.sparkSession, f"first-scores-{fold}")
            return write_table(first.score(self.unlabelled).select("row_id", "score"), path), path

        return self.steps.once("scores", (fold, *self.fit_key), run)[0]

    def fold(self, fold: int, keep_test_scores: bool, shared: bool) -> dict:
        """One fold's held-out scores, and those of the unlabelled rows if kept.

        With ``shared`` scores of the first round other runs read them too.
        """
        train, held_out = fold_rows(self.folded(), fold)
        unlabelled = self.unlabelled.select("row_id", "emb")
        if self.self_training:
            first = self._first(first_rows(train), fold)
            shared = shared and self.settings.rounds > 0
            scores = self._first_scores(first, fold) if shared else None
            base = self.bases()[fold]
            fitted = self_train(train, unlabelled, self.settings, base, first, scores)
            self.steps.runs["rounds"] += 1
        else:
            fitted = replace(self._first(train, fold))
        try:
            test, at_test = None, None
            if keep_test_scores:
                scored = fitted.score(unlabelled)
                at_test = self._path(f"test-{fold}")
                test = write_table(
                    scored.select(F.lit(fold).alias("fold"), "row_id", "score"), at_test
                )
            at_held = self._path(f"held-out-{fold}")
            held = _held_out(fitted, held_out, fold, at_held)
            return {
                "held": held,
                "test": test,
                "paths": [p for p in (at_held, at_test) if p],
                "counts": [(fold, *c) for c in fitted.counts],
                "log": [(fold, *e) for e in fitted.log],
            }
        finally:
            fitted.release()


def _generic(runs: list[_Run], keep_test_scores: bool, parallel: int) -> list[Validation]:
    """The runs' folds, side by side."""
    spark = runs[0].labelled.sparkSession
    for run in runs:  # before the threads: one job for all folds
        run.bases()
    fits = [run.fit_key for run in runs]
    parts = [(run, fold) for run in runs for fold in range(run.settings.folds)]
    found = _each(
        spark,
        parts,
        parallel,
        lambda part: part[0].fold(part[1], keep_test_scores, fits.count(part[0].fit_key) > 1),
    )
    out = []
    for run in runs:
        mine = [result for (owner, _), result in zip(parts, found, strict=True) if owner is run]
        out.append(
            Validation(
                _union([part["held"] for part in mine]),
                run.settings.cv_cut,
                _union([part["test"] for part in mine]) if keep_test_scores else None,
                tuple(path for part in mine for path in part["paths"]),
                [line for part in mine for line in part["counts"]],
                [line for part in mine for line in part["log"]],
            )
        )
    return out


def _linear(runs: list[_Run], keep_test_scores: bool) -> list[Validation]:
    """Runs that differ in threshold, rounds and cuts alone, from shared passes over the rows."""
    first = runs[0]
    base = first.bases()[0]
    rows = apply_projection(first.folded(), base).select("fold", "row_id", "LABEL", "feat")
    unlabelled = apply_projection(first.unlabelled.select("row_id", "emb"), base)
    unlabelled = unlabelled.select("row_id", "feat")
    models, counts = fold_models(
        rows, unlabelled, [run.settings for run in runs], first.self_training, len(base.weights), first.steps
    )
    out = []
    for run, own, sizes in zip(runs, models, counts, strict=True):
        mine = F.element_at("scores", F.col("fold") + 1)
        held = linear_scores(rows, own).select(
            "fold", "row_id", F.col("LABEL").alias("y"), mine.alias("score")
        )
        paths = [run._path("held-out")]
        held, test = write_table(held, paths[0]), None
        if keep_test_scores:
            paths.append(run._path("test"))
            each = linear_scores(unlabelled, own).select("row_id", F.posexplode("scores"))
            test = write_table(
                each.select(F.col("pos").alias("fold"), "row_id", F.col("col").alias("score")), paths[1]
            )
        log = [(f, 0, *epoch) for f in range(run.settings.folds) for epoch in base.epochs]
        out.append(Validation(held, run.settings.cv_cut, test, tuple(paths), sizes, log))
    return out


def _validate(
    labelled: DataFrame,
    unlabelled: DataFrame,
    variants: list[Settings],
    self_training: bool,
    keep_test_scores: bool = False,
    steps: Steps | None = None,
) -> list[Validation]:
    """One validation for each of the settings; settings that fit alike share one."""
    steps = Steps() if steps is None else steps
    every = [_Run(labelled, unlabelled, s, self_training, steps) for s in variants]
    runs = list({run.rounds_key: run for run in reversed(every)}.values())
    found: dict[tuple, Validation] = {}
    try:
        linear: dict[tuple, list[_Run]] = {}
        for run in runs:
            if run.linear:
                linear.setdefault(run.fit_key, []).append(run)
        for group in linear.values():
            found |= zip([run.rounds_key for run in group], _linear(group, keep_test_scores), strict=True)
        rest = [run for run in runs if not run.linear]
        if rest:
            parallel = max(run.settings.parallel_folds for run in rest)
            found |= zip([run.rounds_key for run in rest], _generic(rest, keep_test_scores, parallel), strict=True)
    except BaseException:
        for path in [path for run in runs for path in run.written]:
            drop_table(labelled.sparkSession, path)
        raise
    finally:
        for _, path in [*steps.results("folds"), *steps.results("scores")]:
            drop_table(labelled.sparkSession, path)
    return [replace(found[run.rounds_key], cut=run.settings.cv_cut) for run in every]


def cross_validate(
    labelled: DataFrame,
    unlabelled: DataFrame,
    settings: Settings,
    self_training: bool = True,
    keep_test_scores: bool = False,
) -> Validation:
    """Stratified K-fold validation of a whole run.

    With ``simcse="fold"`` the unsupervised stage sees the fold's training texts
    and the unlabelled texts only; all folds' stages are fitted in one pass. With
    ``simcse="all"`` it runs once over all texts: cheaper, but the held-out texts,
    not their labels, reach the encoder. Pseudo-labels always come from the
    unlabelled table, never from held-out rows.

    The elastic net on vectors that are the same in all folds, without a cap, is
    fitted for all folds from one pass over the labelled rows, and each round of
    self-training is one pass over the unlabelled ones.
    """
    require_unique_ids(unlabelled)
    return _validate(labelled, unlabelled, [settings], self_training, keep_test_scores)[0]


def repeated_splits(
    labelled: DataFrame,
    settings: Settings,
    rounds: tuple[int, ...] = (0, 1, 2, 3, 4),
    test_share: float = 0.2,
) -> Validation:
    """Independent stratified 80/20 splits, each fitted from scratch; ``fold`` is the round."""
    rows = require_unique_ids(labelled).select("row_id", "LABEL", "emb")
    drawn = shuffle_splits(rows, rounds, test_share, settings.seed)
    # One column for each round, so the vectors are joined once for all rounds.
    flags = drawn.groupBy("row_id").agg(
        *[
            F.max(F.when(F.col("round") == r, F.col("held_out"))).alias(f"held_{r}")
            for r in rounds
        ]
    )
    path = new_path(labelled.sparkSession, "splits")
    split = write_table(rows.join(flags, "row_id"), path)

    def run(rnd: int) -> tuple[DataFrame, str]:
        held = F.col(f"held_{rnd}")
        columns = ["row_id", "LABEL", "emb"]
        fitted = fit_labelled(split.filter(~held).select(*columns), settings, base)
        path = new_path(labelled.sparkSession, f"held-out-{rnd}")
        return _held_out(fitted, split.filter(held).select(*columns), rnd, path), path

    spark = labelled.sparkSession
    try:
        base = Projection.identity(vector_width(split))
        if is_linear(settings.but(simcse="none"), False):
            return _linear_splits(split, settings, rounds, base)
        parts = _each(spark, list(rounds), settings.parallel_folds, run)
    finally:
        drop_table(spark, path)
    held = _union([table for table, _ in parts])
    return Validation(held, settings.cv_cut, None, tuple(path for _, path in parts))


def _linear_splits(
    split: DataFrame, settings: Settings, rounds: tuple[int, ...], base: Projection
) -> Validation:
    """All rounds' fits from one pass, and their held-out scores from another."""
    rows = apply_projection(split, base)
    held = F.array(*[F.when(F.col(f"held_{r}"), i) for i, r in enumerate(rounds)])
    held = F.filter(held, lambda i: i.isNotNull())
    models = split_models(rows, held, len(rounds), settings, len(base.weights))
    scored = linear_scores(rows.withColumn("_held", held), models)
    each = scored.select("row_id", "LABEL", "scores", F.explode("_held").alias("i"))
    table = each.select(
        F.element_at(F.array(*[F.lit(r) for r in rounds]), F.col("i") + 1).alias("fold"),
        "row_id",
        F.col("LABEL").alias("y"),
        F.element_at("scores", F.col("i") + 1).alias("score"),
    )
    path = new_path(split.sparkSession, "held-out")
    return Validation(write_table(table, path), settings.cv_cut, None, (path,))


def validate_frozen(fitted: Fitted, labelled: DataFrame, settings: Settings) -> Validation:
    """K-fold validation on the vectors of a fitted run; the projection is not refitted."""
    frozen = settings.but(fine_tune=False, simcse="none")
    steps = Steps()
    run = _Run(labelled, labelled, frozen, False, steps)
    steps.once("stage_one", run.base_key, lambda: [fitted.projection] * frozen.folds)
    return _validate(labelled, labelled, [frozen], False, steps=steps)[0]


def fold_ensemble(scores: DataFrame, folds: int, cut: float = 0.5) -> DataFrame:
    """``row_id, score, LABEL``: the mean of the fold models' scores, then the cut.

    The scores are added in the order of the folds, so a mean that lies on the
    cut comes out the same on every run.
    """
    parts = scores.groupBy("row_id").agg(
        *[
            F.max(F.when(F.col("fold") == f, F.col("score"))).alias(f"s{f}")
            for f in range(folds)
        ]
    )
    mean = reduce(lambda a, b: a + b, [F.col(f"s{f}") for f in range(folds)]) / folds
    return parts.select("row_id", mean.alias("score")).withColumn(
        "LABEL", label_by_cut(F.col("score"), cut)
    )


def sweep(
    labelled: DataFrame,
    unlabelled: DataFrame,
    settings: Settings,
    changes: list[dict],
    self_training: bool = True,
    steps: Steps | None = None,
) -> DataFrame:
    """Pooled metrics for each set of changed settings.

    Settings that differ in a cut alone share one validation, and their metrics
    come from its scores. Others share all steps that they do not change: the
    folds, the unsupervised stage, each fold's first projection, its first fit
    and its scores of the unlabelled rows. ``steps`` tells afterwards what was run.
    """
    require_unique_ids(unlabelled)
    variants = [settings.but(**change) for change in changes]
    results = _validate(labelled, unlabelled, variants, self_training, steps=steps)
    tables = [
        result.pooled().select(
            F.lit(varied.model).alias("model"),
            F.lit(varied.threshold).alias("threshold"),
            F.lit(str(varied.cap)).alias("cap"),
            F.lit(varied.cv_cut).alias("cut"),
            "*",
        )
        for varied, result in zip(variants, results, strict=True)
    ]
    return _union(tables)
