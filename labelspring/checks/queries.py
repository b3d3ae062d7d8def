"""One query for each operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring.checks import views
from labelspring.functions.columns import (
    clip_score,
    label_by_cut,
    sentinel_label,
    text_as_string,
)
from labelspring.functions.keyed import keyed_hash
from labelspring.functions.vectors import to_wide, with_unit_length
from labelspring.operators.encoders import attach_vectors, encode_once, hashed_encode, model_encode
from labelspring.operators.losses import (
    cosine_pair_loss,
    in_batch_ranking_loss,
    pair_cosine,
)
from labelspring.operators.metrics import (
    confusion,
    fold_metrics,
    fold_summary,
    metric_report,
    metrics_at_cut,
    ranking_metrics,
    threshold_metrics,
)
from labelspring.operators.minibatch import fit_pair_steps
from labelspring.operators.models import fit_model, score_rows
from labelspring.operators.projection import (
    Projection,
    apply_projection,
    fit_pairs,
    fit_simcse,
)
from labelspring.operators.sampling import (
    attach_pair_values,
    batches,
    class_index,
    class_pools,
    cross_class_pairs,
    fold_rows,
    make_pairs,
    mask_tokens,
    same_class_pairs,
    self_pairs,
    shuffle_pairs,
    shuffle_splits,
    stratified_folds,
)
from labelspring.operators.scaling import fit_scaler, scaler_stats
from labelspring.operators.selection import (
    augment,
    round_cap,
    round_counts,
    select_confident,
    select_top,
)
from labelspring.plans.evaluate import (
    cross_validate,
    fold_ensemble,
    repeated_splits,
    sweep,
    validate_frozen,
)
from labelspring.plans.settings import Settings
from labelspring.plans.job import run_job
from labelspring.plans.training import fit_predict, self_train
from labelspring.sources import tables
from labelspring.sources.scratch import cut_lineage, drop_table, new_path, write_table

PAIRS = 3000
WIDTH = 64
LETTERS = "abcdefghijklmnopqrstuvwxyz"
CAPS = {0: 10, 1: 20}

# Spark's solver stops when the loss no longer falls, which leaves about 1e-5 in a score.
SCORE_DIGITS = 2
# The solver on sums ends with the same digits as the one in SQL.
SOLVED_DIGITS = 6

# The elastic net to its end, on vectors as they are.
EXACT = Settings(model="elastic", fine_tune=False, parallel_folds=4)

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for column in columns:
        df = df.withColumn(column, F.round(column, digits))
    return df


def _metric(df: DataFrame) -> DataFrame:
    """All metric columns, to ten digits."""
    values = [c for c, kind in df.dtypes if kind == "double"]
    return _rounded(df, *values, digits=10)


def _wide(df: DataFrame, lead: tuple[str, ...], width: int = WIDTH, digits: int = 6):
    wide = to_wide(df, width, lead=lead)
    return wide.select(*lead, *[F.round(c, digits).alias(c) for c in wide.columns[len(lead) :]])


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Scored rows with a label."""
    return views.scored(spark, folder).filter(F.col("y").isNotNull())


def _open(spark: SparkSession, folder: str) -> DataFrame:
    """Scored rows without a label."""
    return views.scored(spark, folder).filter(F.col("y").isNull()).drop("y")


def _folded(spark: SparkSession, folder: str) -> DataFrame:
    return stratified_folds(_judged(spark, folder), label="y")


# Sources and sinks


def read_labelled(spark, folder):
    path = new_path(spark, "labelled.csv")
    tables.write_csv(views.labelled(spark, folder), path)
    return tables.read_labelled(spark, path)


def read_unlabelled(spark, folder):
    path = new_path(spark, "unlabelled.csv")
    tables.write_csv(views.unlabelled(spark, folder).drop("LABEL"), path)
    return tables.read_unlabelled(spark, path)


def class_balance(spark, folder):
    return tables.class_balance(views.labelled(spark, folder))


def write_predictions(spark, folder):
    path = new_path(spark, "result.csv")
    labels = _open(spark, folder).withColumn("LABEL", label_by_cut(F.col("score")))
    tables.write_predictions(labels, path)
    return spark.read.csv(path, header=True, schema="row_id long, LABEL int")


def oof_table(spark, folder):
    path = new_path(spark, "oof")
    tables.write_scores(_folded(spark, folder).select("fold", "row_id", "y", "score"), path)
    written = spark.read.schema("row_id long, y int, score double, fold int").parquet(path)
    return written.select("fold", "row_id", "y", "score")


def feature_wide(spark, folder):
    return to_wide(views.vectors(spark, folder), WIDTH)


# Columns


def _gappy(spark, folder):
    """Documents with some texts missing and some replaced by a missing marker."""
    draw = F.pmod(keyed_hash(F.col("row_id"), "gap"), F.lit(10))
    text = F.when(draw == 0, F.lit(None)).when(draw == 1, F.lit("NA")).otherwise(F.col("TEXT"))
    return views.documents(spark, folder).withColumn("TEXT", text)


def text_to_string(spark, folder):
    return _gappy(spark, folder).withColumn("TEXT", text_as_string(F.col("TEXT")))


def pools(spark, folder):
    """The ten raw labels: only 0 and 1 belong to a pool."""
    raw = views.table(spark, folder, "embeddings")
    return class_pools(
        raw.select(F.col("vec_id").alias("row_id"), F.col("label").alias("LABEL"))
    )


def sentinel(spark, folder):
    return sentinel_label(views.unlabelled(spark, folder), has_label=False).drop("TEXT")


def clip(spark, folder):
    raw = F.col("score") * F.lit(1.6) - F.lit(0.3)
    rows = views.scored(spark, folder).select("row_id", clip_score(raw).alias("score"))
    return _rounded(rows, "score", digits=9)


def cut(at: float) -> Query:
    def query(spark, folder):
        return views.scored(spark, folder).select(
            "row_id", label_by_cut(F.col("score"), at).alias("LABEL")
        )

    return query


def one_fold(spark, folder):
    train, held_out = fold_rows(stratified_folds(views.vectors(spark, folder)), 2)
    return (
        train.select("row_id", F.lit("train").alias("part"))
        .unionByName(held_out.select("row_id", F.lit("held_out").alias("part")))
    )


def report(spark, folder):
    values = ("accuracy", "precision", "recall", "f1")
    metrics = threshold_metrics(_folded(spark, folder), by=("fold",)).drop("mse")
    return metric_report(metrics, *values)


# Joins and sampling


def pair_texts(spark, folder):
    rows = views.labelled(spark, folder)
    return attach_pair_values(make_pairs(rows, PAIRS), rows, "TEXT")


def same_class(spark, folder):
    return same_class_pairs(views.vectors(spark, folder), PAIRS)


def cross_class(spark, folder):
    return cross_class_pairs(views.vectors(spark, folder), PAIRS)


def shuffled(spark, folder):
    return shuffle_pairs(views.vector_pairs(spark, folder, PAIRS))


def simcse_pairs(spark, folder):
    return self_pairs(views.labelled(spark, folder), views.unlabelled(spark, folder))


def index(spark, folder):
    return class_index(views.vectors(spark, folder))


def folds(spark, folder):
    return stratified_folds(views.vectors(spark, folder)).select("row_id", "LABEL", "fold")


def splits(spark, folder):
    drawn = shuffle_splits(views.vectors(spark, folder))
    return drawn.withColumn("held_out", F.col("held_out").cast("int"))


def masked(spark, folder):
    rows = mask_tokens(tables.spread(views.documents(spark, folder)))
    positions = F.transform("targets", lambda t: t.position.cast("string"))
    tokens = F.transform("targets", lambda t: t.token)
    return rows.select(
        "row_id",
        "masked_text",
        F.size("targets").alias("n_masked"),
        F.array_join(positions, ",").alias("positions"),
        F.array_join(tokens, " ").alias("tokens"),
    )


def batched(spark, folder):
    return batches(views.documents(spark, folder).select("row_id"), 64)


# Vectors


def hashed(spark, folder):
    return _wide(encoded_documents(spark, folder, "float64"), ("row_id",), digits=9)


def embedded(spark, folder):
    vectors = views.vectors(spark, folder).drop("LABEL")
    return to_wide(attach_vectors(views.documents(spark, folder), vectors), WIDTH, lead=("row_id", "TEXT"))


def model_encoded(spark, folder):
    """A model of the user's: how often each letter occurs."""

    def make_predict_fn():
        def predict(texts):
            return np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=np.float32)

        return predict

    rows = tables.spread(views.documents(spark, folder))
    encoded = model_encode(rows, make_predict_fn, dtype="float64")
    return _wide(encoded, ("row_id",), len(LETTERS), digits=9)


def encoded_once(spark, folder):
    """The letters of every document, each text given to the model once."""

    def make_predict_fn():
        def predict(texts):
            return np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=np.float32)

        return predict

    def encode(rows):
        return model_encode(tables.spread(rows), make_predict_fn, dtype="float64")

    encoded = encode_once(views.documents(spark, folder), encode)
    return _wide(encoded, ("row_id",), len(LETTERS), digits=9)


def normalised(spark, folder):
    stretched = F.transform(
        "emb", lambda x: x.cast("double") * (F.pmod(F.col("row_id"), F.lit(7)) + 1)
    )
    rows = views.vectors(spark, folder).withColumn("emb", stretched)
    unit = with_unit_length(rows, "emb", "unit").drop("emb").withColumnRenamed("unit", "emb")
    return _wide(unit, ("row_id",))


def _vector_pairs(spark, folder):
    rows = views.vectors(spark, folder)
    return attach_pair_values(make_pairs(rows, PAIRS), rows, "emb")


def cosines(spark, folder):
    pairs = pair_cosine(_vector_pairs(spark, folder))
    return _rounded(pairs.select("pair_id", "a", "b", "label", "cosine"), "cosine")


def pair_loss(spark, folder):
    return _rounded(cosine_pair_loss(_vector_pairs(spark, folder)), "loss")


def ranking_loss(spark, folder):
    encoded = encoded_documents(spark, folder, "float64")
    return _rounded(in_batch_ranking_loss(batches(encoded, 32)), "loss")


def dimension_stats(spark, folder):
    return _rounded(scaler_stats(views.vectors(spark, folder)), "mean", "std")


def scaled(spark, folder):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = views.vectors(spark, folder).withColumn("_raw", array_to_vector("emb"))
    scaler = fit_scaler(rows, rows.count(), "_raw", "_scaled")
    return _wide(
        scaler.transform(rows).withColumn("emb", vector_to_array("_scaled")), ("row_id", "LABEL")
    )


def encoded_documents(spark, folder, dtype: str = "float32") -> DataFrame:
    """``row_id, emb`` of all documents by the hashed encoder."""
    texts = tables.spread(views.documents(spark, folder))
    return hashed_encode(texts, WIDTH, dtype=dtype).select("row_id", "emb")


def encoded_tables(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Labelled and unlabelled documents with hashed vectors.

    The texts are encoded where they were read; only vectors meet the labels.
    """
    path = new_path(spark, "encoded")
    encoded = write_table(encoded_documents(spark, folder), path)
    labels = views.document_labels(spark, folder)
    try:
        return (
            cut_lineage(encoded.join(labels, "row_id"), "labelled"),
            cut_lineage(encoded.join(labels, "row_id", "left_anti"), "unlabelled"),
        )
    finally:
        drop_table(spark, path)


def projection_fit(spark, folder):
    """All vectors after the supervised fit on pairs of the labelled ones."""
    rows = views.vectors(spark, folder)
    fitted = fit_pairs(rows, Projection.identity(WIDTH))
    moved = apply_projection(rows, fitted, name="emb", dtype="double")
    return _wide(moved, ("row_id",))


def projection_steps(spark, folder):
    """All vectors after the supervised fit with a step for each batch of pairs."""
    rows = views.vectors(spark, folder)
    fitted = fit_pair_steps(rows, Projection.identity(WIDTH))
    moved = apply_projection(rows, fitted, name="emb", dtype="double")
    return _wide(moved, ("row_id",))


def step_epoch_loss(spark, folder):
    """Epoch log of the fit with a step for each batch."""
    fitted = fit_pair_steps(views.vectors(spark, folder), Projection.identity(WIDTH))
    return _rounded(fitted.epoch_table(spark), "loss", "grad_norm")


def pair_epoch_loss(spark, folder):
    """Epoch log of the supervised fit."""
    fitted = fit_pairs(views.vectors(spark, folder), Projection.identity(WIDTH))
    return _rounded(fitted.epoch_table(spark), "loss", "grad_norm")


def simcse_fit(spark, folder):
    rows = cut_lineage(encoded_documents(spark, folder), "encoded")
    fitted = fit_simcse(rows, Projection.identity(WIDTH))
    moved = apply_projection(rows, fitted, name="emb", dtype="double")
    return _wide(moved, ("row_id",), digits=6)


def epoch_loss(spark, folder):
    """Epoch log of the unsupervised fit followed by the supervised one."""
    encoded = cut_lineage(encoded_documents(spark, folder), "encoded")
    labelled = encoded.join(views.document_labels(spark, folder), "row_id")
    first = fit_simcse(encoded, Projection.identity(WIDTH), epochs=2)
    return _rounded(fit_pairs(labelled, first).epoch_table(spark), "loss", "grad_norm")


# Models


def model_scores(model: str, **params) -> Query:
    """Fit on the labelled documents, score the unlabelled ones."""

    def query(spark, folder):
        labelled, unlabelled = encoded_tables(spark, folder)
        fitted = fit_model(labelled, model, vector="emb", **params)
        return score_rows(unlabelled, fitted, vector="emb").select("row_id", "score")

    return query


def elastic_scores(spark, folder):
    scores = model_scores("elastic", tol=1e-14)(spark, folder)
    return _rounded(scores, "score", digits=SCORE_DIGITS)


# Self-training


def pseudo_select(spark, folder):
    return select_confident(_open(spark, folder), 0.85)


def pseudo_topk(spark, folder):
    return select_top(_open(spark, folder), 0.85, 20)


def pseudo_topk_round(spark, folder):
    """Rounds 0 to 2 under a cap map that lacks round 2."""
    scored = _open(spark, folder)
    parts = [
        select_top(scored, 0.85, round_cap(CAPS, r)).withColumn("round", F.lit(r))
        for r in (0, 1, 2)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _sets(spark, folder) -> tuple[DataFrame, DataFrame]:
    labelled = _judged(spark, folder).select("row_id", F.col("y").alias("LABEL"))
    return labelled, select_confident(_open(spark, folder), 0.85).select("row_id", "LABEL")


def augmented(spark, folder):
    labelled, pseudo = _sets(spark, folder)
    return _flagged(augment(labelled, pseudo))


def augmented_empty(spark, folder):
    """A round that selects nothing keeps the pseudo rows of the round before."""
    labelled, pseudo = _sets(spark, folder)
    current = augment(labelled, pseudo)
    nothing = select_top(_open(spark, folder), 0.85, 0).select("row_id", "LABEL")
    return _flagged(augment(labelled, nothing, current))


def _flagged(df: DataFrame) -> DataFrame:
    return df.withColumn("is_pseudo", F.col("is_pseudo").cast("int"))


def counts(spark, folder):
    labelled, pseudo = _sets(spark, folder)
    return round_counts(augment(labelled, pseudo))


def self_training(spark, folder):
    """Counts of each round of self-training with the forest."""
    labelled, unlabelled = encoded_tables(spark, folder)
    return self_train(labelled, unlabelled, Settings()).rounds


# Metrics


def roc_auc(spark, folder):
    return _metric(ranking_metrics(_judged(spark, folder)).select("auc"))


def average_precision(spark, folder):
    return _metric(ranking_metrics(_judged(spark, folder)).select("pr_auc"))


def accuracy(spark, folder):
    return _metric(threshold_metrics(_judged(spark, folder)).select("accuracy"))


def precision_recall_f1(spark, folder):
    columns = ("precision", "recall", "f1")
    return _metric(threshold_metrics(_judged(spark, folder)).select(*columns))


def mse(spark, folder):
    return _metric(threshold_metrics(_judged(spark, folder)).select("mse"))


def confusion_matrix(spark, folder):
    return confusion(_judged(spark, folder))


def per_fold(spark, folder):
    return _metric(fold_metrics(_folded(spark, folder)))


def summary(spark, folder):
    return _metric(fold_summary(fold_metrics(_folded(spark, folder))))


def pooled(spark, folder):
    return _metric(metrics_at_cut(_folded(spark, folder)))


def at_cut(spark, folder):
    return _metric(metrics_at_cut(_judged(spark, folder), 0.6))


def elastic_self_training(spark, folder):
    """Counts of each round with the elastic net, whose one answer SQL finds too."""
    labelled, unlabelled = encoded_tables(spark, folder)
    return self_train(labelled, unlabelled, EXACT.but(threshold=0.9)).rounds


def changes_of_rounds(spark, folder):
    """Which pseudo-labels entered, left or flipped in each round with the elastic net."""
    labelled, unlabelled = encoded_tables(spark, folder)
    return self_train(labelled, unlabelled, EXACT.but(threshold=0.85), track=True).changes


# Evaluation

QUICK = Settings(model="elastic", parallel_folds=4)


def validation(settings: Settings, self_training: bool, **options) -> Query:
    """Out-of-fold scores of one cross-validation."""

    def query(spark, folder):
        labelled, unlabelled = encoded_tables(spark, folder)
        return cross_validate(labelled, unlabelled, settings, self_training, **options).oof

    return query


def cv_assignment(spark, folder):
    """Which row a whole validation scored in which fold, and its true label."""
    labelled, unlabelled = encoded_tables(spark, folder)
    settings = QUICK.but(fine_tune=False)
    return cross_validate(labelled, unlabelled, settings, False).oof.drop("score")


def split_assignment(spark, folder):
    """The same for the repeated splits; ``fold`` is the round."""
    labelled, _ = encoded_tables(spark, folder)
    return repeated_splits(labelled, QUICK.but(fine_tune=False)).oof.drop("score")


def cv_oof(spark, folder):
    """Per-fold and pooled metrics of a validation with the unsupervised stage run once."""
    labelled, unlabelled = encoded_tables(spark, folder)
    settings = QUICK.but(simcse="all", cap={0: 100, 1: 160, 2: 200})
    result = cross_validate(labelled, unlabelled, settings)
    pooled_row = result.pooled().withColumn("part", F.lit("pooled"))
    by_fold = result.per_fold().withColumn(
        "part", F.concat(F.lit("fold "), F.col("fold").cast("string"))
    )
    return by_fold.drop("fold").unionByName(pooled_row)


def ensemble(spark, folder):
    """Five models' scores of the unlabelled documents, averaged and cut."""
    rows = views.unlabelled(spark, folder).select(
        "row_id", F.explode(F.array(*[F.lit(f) for f in range(5)])).alias("fold")
    )
    key = F.concat_ws("/", F.col("fold").cast("string"), F.col("row_id").cast("string"))
    draw = F.pmod(keyed_hash(key, "score"), F.lit(201))
    scores = rows.select("fold", "row_id", (draw / F.lit(200.0)).alias("score"))
    return _rounded(fold_ensemble(scores, 5), "score", digits=9)


def ensemble_cv(spark, folder):
    """The fold models of a real validation, averaged over the unlabelled documents."""
    labelled, unlabelled = encoded_tables(spark, folder)
    result = cross_validate(labelled, unlabelled, QUICK, False, keep_test_scores=True)
    return fold_ensemble(result.test_scores, QUICK.folds)


def split_rounds(spark, folder):
    labelled, _ = encoded_tables(spark, folder)
    return repeated_splits(labelled, QUICK).per_fold()


def cv_frozen(spark, folder):
    labelled, unlabelled = encoded_tables(spark, folder)
    fitted = self_train(labelled, unlabelled, QUICK)
    return validate_frozen(fitted, labelled, QUICK).summary()


def predicted(spark, folder):
    """Two-stage fit with self-training, then the labels of the unlabelled documents."""
    labelled, unlabelled = encoded_tables(spark, folder)
    return fit_predict(labelled, unlabelled, Settings(simcse="all"))[1]


def elastic_cv(spark, folder):
    labelled, unlabelled = encoded_tables(spark, folder)
    oof = cross_validate(labelled, unlabelled, EXACT, False).oof
    return _rounded(oof, "score", digits=SOLVED_DIGITS)


def elastic_cv_ensemble(spark, folder):
    labelled, unlabelled = encoded_tables(spark, folder)
    result = cross_validate(labelled, unlabelled, EXACT, False, keep_test_scores=True)
    scores = fold_ensemble(result.test_scores, EXACT.folds)
    return _rounded(scores, "score", digits=SOLVED_DIGITS)


def elastic_splits(spark, folder):
    labelled, _ = encoded_tables(spark, folder)
    oof = repeated_splits(labelled, EXACT).oof
    labelled_oof = oof.withColumn("LABEL", label_by_cut(F.col("score"), 0.5))
    return _rounded(labelled_oof, "score", digits=SOLVED_DIGITS)


def elastic_fit_predict(spark, folder):
    labelled, unlabelled = encoded_tables(spark, folder)
    predicted = fit_predict(labelled, unlabelled, EXACT.but(rounds=1, threshold=0.9))[1]
    return _rounded(predicted, "score", digits=SOLVED_DIGITS)


def elastic_cv_rounds(spark, folder):
    """Sizes of each fold's rounds in a validation with self-training."""
    labelled, unlabelled = encoded_tables(spark, folder)
    return cross_validate(labelled, unlabelled, EXACT.but(threshold=0.9)).rounds()


def elastic_sweep(spark, folder):
    """Thresholds and cuts of the elastic net, from two passes over each table."""
    labelled, unlabelled = encoded_tables(spark, folder)
    changes = [{"threshold": 0.8}, {"threshold": 0.9}, {"threshold": 0.9, "cv_cut": 0.6}]
    table = sweep(labelled, unlabelled, EXACT.but(rounds=1), changes)
    columns = ("threshold", "cut", "accuracy", "precision", "recall", "f1", "mse")
    return _rounded(table.select(*columns), *columns[2:], digits=6)


def whole_job(spark, folder):
    """The labels that a job from files to file has written."""
    path = new_path(spark, "job")
    tables.write_csv(views.labelled(spark, folder), f"{path}/train.csv")
    tables.write_csv(views.unlabelled(spark, folder).drop("LABEL"), f"{path}/test.csv")
    overrides = ["model=elastic", "fine_tune=False", "rounds=1"]
    return run_job(spark, f"{path}/train.csv", f"{path}/test.csv", f"{path}/out", overrides)


def metrics_log(spark, folder):
    """The log of two runs, one of which was repeated."""
    path = new_path(spark, "log")
    measured = per_fold(spark, folder)
    for run in ("first", "second", "first"):
        tables.append_metrics(measured, path, run)
    return spark.read.parquet(path)


def swept(spark, folder):
    labelled, unlabelled = encoded_tables(spark, folder)
    changes = [
        {"threshold": 0.80},
        {"threshold": 0.90, "cap": 100},
        {"threshold": 0.80, "cv_cut": 0.6},
        {"model": "rf", "model_params": {"trees": 50}, "cv_cut": 0.6},
        {"model": "gbm", "model_params": {"stages": 20}},
    ]
    return sweep(labelled, unlabelled, QUICK.but(rounds=1, parallel_folds=8), changes)


QUERIES: dict[str, Query] = {
    "read_labelled": read_labelled,
    "read_unlabelled": read_unlabelled,
    "class_balance": class_balance,
    "write_predictions": write_predictions,
    "oof_table": oof_table,
    "feature_wide": feature_wide,
    "text_as_string": text_to_string,
    "class_pools": pools,
    "sentinel_label": sentinel,
    "clip_score": clip,
    "label_by_cut": cut(0.5),
    "label_by_cut_060": cut(0.6),
    "fold_rows": one_fold,
    "metric_report": report,
    "labelled_view": views.labelled,
    "unlabelled_view": views.unlabelled,
    "pair_texts": pair_texts,
    "pairs_same_class": same_class,
    "pairs_cross_class": cross_class,
    "pairs_shuffled": shuffled,
    "simcse_pairs": simcse_pairs,
    "class_index": index,
    "stratified_folds": folds,
    "shuffle_splits": splits,
    "mlm_mask": masked,
    "batches": batched,
    "hashed_encode": hashed,
    "embed_join": embedded,
    "model_encode": model_encoded,
    "encode_once": encoded_once,
    "l2_normalise": normalised,
    "pair_cosine": cosines,
    "cosine_pair_loss": pair_loss,
    "in_batch_ranking_loss": ranking_loss,
    "scaler_stats": dimension_stats,
    "scaled_features": scaled,
    "projection_fit": projection_fit,
    "simcse_fit": simcse_fit,
    "pair_epoch_loss": pair_epoch_loss,
    "projection_steps": projection_steps,
    "step_epoch_loss": step_epoch_loss,
    "epoch_loss": epoch_loss,
    "rf_scores": model_scores("rf"),
    "gbm_scores": model_scores("gbm"),
    "elastic_scores": elastic_scores,
    "elastic_self_training": elastic_self_training,
    "round_changes": changes_of_rounds,
    "elastic_cv": elastic_cv,
    "elastic_cv_ensemble": elastic_cv_ensemble,
    "elastic_splits": elastic_splits,
    "elastic_fit_predict": elastic_fit_predict,
    "elastic_cv_rounds": elastic_cv_rounds,
    "elastic_sweep": elastic_sweep,
    "run_job": whole_job,
    "metrics_log": metrics_log,
    "pseudo_select": pseudo_select,
    "pseudo_topk": pseudo_topk,
    "pseudo_topk_round": pseudo_topk_round,
    "augment": augmented,
    "augment_empty": augmented_empty,
    "round_counts": counts,
    "self_training": self_training,
    "roc_auc": roc_auc,
    "average_precision": average_precision,
    "accuracy": accuracy,
    "precision_recall_f1": precision_recall_f1,
    "mse": mse,
    "confusion": confusion_matrix,
    "fold_metrics": per_fold,
    "fold_summary": summary,
    "oof_metrics": pooled,
    "metrics_at_cut": at_cut,
    "cv_baseline": validation(QUICK, False),
    "cv_two_stage": validation(QUICK.but(simcse="fold"), False),
    "cv_self_training": validation(QUICK.but(cv_cut=0.6, threshold=0.8), True),
    "cv_proper": validation(QUICK.but(simcse="fold"), True),
    "cv_assignment": cv_assignment,
    "split_assignment": split_assignment,
    "cv_oof": cv_oof,
    "fold_ensemble": ensemble,
    "cv_ensemble": ensemble_cv,
    "repeated_splits": split_rounds,
    "cv_frozen": cv_frozen,
    "fit_predict": predicted,
    "sweep": swept,
}
