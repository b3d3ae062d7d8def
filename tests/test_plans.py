from multiprocessing.pool import ThreadPool
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelspring.operators import linear
from labelspring.operators import projection as projection_module
from labelspring.operators.losses import gather_batches
from labelspring.operators.projection import (
    Projection,
    apply_projection,
    clipped_step,
    fit_simcse_folds,
    ranking_gradient,
    two_views,
)
from labelspring.operators.sampling import batches
from labelspring.plans import evaluate, training
from labelspring.plans.evaluate import (
    cross_validate,
    fold_ensemble,
    repeated_splits,
    sweep,
    validate_frozen,
)
from labelspring.plans.settings import Settings
from labelspring.plans.steps import Steps
from labelspring.plans.training import fit_on, fit_predict, self_train, vector_width
from labelspring.sources.scratch import shared_folder
from labelspring.sources.tables import load_model

WIDTH = 8
QUICK = Settings(
    model="elastic", pairs=200, epochs=2, rounds=1, folds=3, simcse_batch=16, parallel_folds=3
)


def cloud(seed, start, n):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(start, start + n):
        label = i % 2
        x = rng.normal(size=WIDTH) * 0.7
        x[0] += 2.0 * label - 1.0
        rows.append((i, label, (x / np.linalg.norm(x)).astype(float).tolist()))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(
        cloud(1, 0, 120), "row_id long, LABEL int, emb array<float>"
    ).cache()


@pytest.fixture(scope="module")
def hidden():
    return {i: label for i, label, _ in cloud(2, 1000, 300)}


@pytest.fixture(scope="module")
def unlabelled(spark):
    rows = [(i, emb) for i, _, emb in cloud(2, 1000, 300)]
    return spark.createDataFrame(rows, "row_id long, emb array<float>").cache()


def test_changes_of_rounds_add_up(labelled, unlabelled):
    fitted = self_train(labelled, unlabelled, QUICK.but(rounds=3, threshold=0.7), track=True)
    held = {}
    for rnd in range(3):
        for r in fitted.changes.filter(F.col("round") == rnd).collect():
            assert held.pop(r["row_id"], None) == r["label_before"] != r["label_after"]
            if r["label_after"] is not None:
                held[r["row_id"]] = r["label_after"]
    train = fitted.train.filter("is_pseudo").select("row_id", "LABEL").collect()
    assert held and held == {r["row_id"]: r["LABEL"] for r in train}
    fitted.release()
    assert fitted.changes is None and not list(Path(shared_folder(labelled.sparkSession)).rglob("changes-*"))


def test_no_changes_where_nothing_is_selected(labelled, unlabelled):
    fitted = self_train(labelled, unlabelled, QUICK.but(threshold=1.0, cap=0), track=True)
    assert fitted.changes.count() == 0
    assert fitted.changes.columns == ["round", "row_id", "change", "label_before", "label_after"]


def test_self_training(labelled, unlabelled, hidden):
    fitted = self_train(labelled, unlabelled, QUICK.but(rounds=2))
    rounds = fitted.rounds.orderBy("round").collect()
    assert [r["round"] for r in rounds] == [0, 1, 2]
    assert rounds[0]["pseudo"] == 0 and rounds[0]["total_train"] == 120
    for r in rounds:
        assert r["total_train"] == r["labeled"] + r["pseudo"] and r["labeled"] == 120
        assert r["pos"] + r["neg"] == r["pseudo"]
    train = fitted.train.collect()
    pseudo = [r for r in train if r["is_pseudo"]]
    assert len(pseudo) == rounds[-1]["pseudo"] > 20
    assert {r["row_id"] for r in pseudo} <= set(hidden)
    right = sum(hidden[r["row_id"]] == r["LABEL"] for r in pseudo) / len(pseudo)
    assert right > 0.85


def test_both_tables_may_use_the_same_ids(labelled, unlabelled):
    """Equal ids name different rows: the result is that of distinct ids."""
    shifted = unlabelled.withColumn("row_id", F.col("row_id") - 1000)
    settings = QUICK.but(simcse="all")
    apart, out = fit_predict(labelled, unlabelled, settings)
    same, shifted_out = fit_predict(labelled, shifted, settings)
    assert same.projection.epochs[-1][4] == settings.pairs
    assert same.train.count() == apart.train.count()
    scores = {r["row_id"]: r["score"] for r in out.collect()}
    again = {r["row_id"] + 1000: r["score"] for r in shifted_out.collect()}
    assert scores.keys() == again.keys()
    agree = sum((scores[i] >= 0.5) == (again[i] >= 0.5) for i in scores)
    assert agree > 0.95 * len(scores)


def test_any_64_bit_id_is_accepted(labelled, unlabelled):
    high = (1 << 63) - 5000
    far = unlabelled.withColumn("row_id", F.col("row_id") + F.lit(high))
    out = fit_predict(labelled, far, QUICK.but(simcse="all", cap=20))[1]
    ids = {r["row_id"] for r in out.collect()}
    assert ids == {high + i for i in range(1000, 1300)}


def scratch_files(spark):
    folder = Path(shared_folder(spark).removeprefix("file:")) / "labelspring"
    return {str(p) for p in folder.rglob("part-*")} if folder.exists() else set()


def test_runs_leave_no_files(spark, labelled, unlabelled, monkeypatch):
    before = scratch_files(spark)
    fitted = self_train(labelled, unlabelled, QUICK.but(rounds=2, cap={0: 5}))
    assert len(scratch_files(spark) - before) > 0
    fitted.release()
    assert scratch_files(spark) == before
    real, calls = training.fit_labelled, []

    def failing(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(training, "fit_labelled", failing)
    with pytest.raises(RuntimeError, match="lost"):
        self_train(labelled, unlabelled, QUICK.but(rounds=2))
    calls.clear()
    with pytest.raises(RuntimeError, match="lost"):
        cross_validate(labelled, unlabelled, QUICK.but(parallel_folds=1))
    assert scratch_files(spark) == before


def test_only_rows_under_the_cap_are_written_with_vectors(spark, labelled, unlabelled):
    fitted = self_train(labelled, unlabelled, QUICK.but(cap=5))
    assert spark.read.parquet(fitted.scratch).count() == 10
    fitted.release()


def test_log_of_all_rounds(labelled, unlabelled):
    fitted = self_train(labelled, unlabelled, QUICK.but(rounds=2))
    rows = fitted.epoch_log().collect()
    assert sorted((r["round"], r["epoch"]) for r in rows) == [(r, e) for r in range(3) for e in (1, 2)]


def test_stage_one_is_fitted_again_for_other_settings(labelled, unlabelled, tmp_path, monkeypatch):
    calls = []
    real = training.fit_simcse
    monkeypatch.setattr(training, "fit_simcse", lambda *a, **k: calls.append(1) or real(*a, **k))
    cached = QUICK.but(simcse="all", simcse_cache=str(tmp_path / "stage"))
    base = Projection.identity(WIDTH)

    def stage(settings, rows=unlabelled):
        return training.stage_one(labelled, rows, settings, base, settings.simcse_cache)

    first, second = stage(cached), stage(cached)
    assert len(calls) == 1
    assert np.array_equal(first.weights, second.weights) and first.epochs == second.epochs
    other = stage(cached.but(simcse_epochs=2))
    assert len(calls) == 2 and not np.array_equal(first.weights, other.weights)
    stage(cached.but(simcse_epochs=2), unlabelled.limit(100))
    assert len(calls) == 3


def test_a_cap_limits_each_class(labelled, unlabelled):
    fitted = self_train(labelled, unlabelled, QUICK.but(rounds=2, cap={0: 5}))
    rounds = fitted.rounds.orderBy("round").collect()
    assert (rounds[1]["pos"], rounds[1]["neg"]) == (5, 5)
    assert rounds[2]["pseudo"] > 10  # round 1 is not in the map, so it has no cap


def test_nothing_selected_keeps_the_set(labelled, unlabelled):
    fitted = self_train(labelled, unlabelled, QUICK.but(rounds=2, cap={0: 7, 1: 0}))
    rounds = fitted.rounds.orderBy("round").collect()
    assert [r["pseudo"] for r in rounds] == [0, 14, 14]


def test_fit_predict_labels_every_row(spark, labelled, unlabelled, hidden, tmp_path):
    path = str(tmp_path / "run")
    fitted, out = fit_predict(
        labelled, unlabelled, QUICK.but(simcse="all", save_path=path)
    )
    rows = {r["row_id"]: r for r in out.collect()}
    assert set(rows) == set(hidden)
    assert all(r["LABEL"] == int(r["score"] >= 0.5) for r in rows.values())
    right = sum(hidden[i] == r["LABEL"] for i, r in rows.items()) / len(rows)
    assert right > 0.8
    assert [e[0] for e in fitted.projection.epochs] == ["simcse", "pairs", "pairs"]
    fitted.projection, fitted.model = load_model(spark, path)
    again = {r["row_id"]: r["score"] for r in fitted.predict(unlabelled).collect()}
    assert all(again[i] == pytest.approx(r["score"]) for i, r in rows.items())


def test_repeated_ids_are_refused(labelled, unlabelled):
    with pytest.raises(ValueError, match="occurs 2 times"):
        fit_predict(labelled.unionByName(labelled.filter("row_id = 3")), unlabelled, QUICK)


@pytest.mark.parametrize("simcse", ["none", "all", "fold"])
@pytest.mark.parametrize("self_training", [False, True])
def test_cross_validation_scores_each_row_once(labelled, unlabelled, simcse, self_training):
    result = cross_validate(labelled, unlabelled, QUICK.but(simcse=simcse), self_training)
    rows = result.oof.collect()
    assert sorted(r["row_id"] for r in rows) == list(range(120))
    assert all(r["y"] == r["row_id"] % 2 and 0 <= r["score"] <= 1 for r in rows)
    assert sorted({r["fold"] for r in rows}) == [0, 1, 2]
    assert result.pooled().first()["auc"] > 0.85


def test_parallel_folds_give_the_same_scores(labelled, unlabelled):
    def scores(parallel):
        result = cross_validate(
            labelled, unlabelled, QUICK.but(parallel_folds=parallel), False, True
        )
        return (
            {r["row_id"]: r["score"] for r in result.oof.collect()},
            {(r["fold"], r["row_id"]): r["score"] for r in result.test_scores.collect()},
        )

    one, three = scores(1), scores(3)
    assert len(one[1]) == 900
    for left, right in zip(one, three, strict=True):
        assert left.keys() == right.keys()
        assert all(left[k] == pytest.approx(right[k], abs=1e-7) for k in left)


def test_validation_tables(labelled, unlabelled):
    result = cross_validate(labelled, unlabelled, QUICK.but(cv_cut=0.6), False)
    per_fold = result.per_fold().collect()
    assert len(per_fold) == 3
    mean = result.summary().filter("metric = 'accuracy'").first()["mean"]
    assert mean == pytest.approx(sum(r["accuracy"] for r in per_fold) / 3)


def test_repeated_splits_hold_out_a_fifth(labelled):
    result = repeated_splits(labelled, QUICK, rounds=(0, 1))
    sizes = {r["fold"]: r["count"] for r in result.oof.groupBy("fold").count().collect()}
    assert sizes == {0: 24, 1: 24}


def test_frozen_validation_keeps_the_projection(labelled, unlabelled):
    fitted = self_train(labelled, unlabelled, QUICK)
    before = fitted.projection.weights.copy()
    result = validate_frozen(fitted, labelled, QUICK)
    assert result.oof.count() == 120
    assert np.array_equal(before, fitted.projection.weights)


def test_ensemble_averages_in_fold_order(spark):
    scores = [0.1, 0.7, 0.3, 0.9, 0.5]
    rows = [(f, 1, s) for f, s in enumerate(scores)] + [(f, 2, 0.25) for f in range(5)]
    df = spark.createDataFrame(rows, "fold int, row_id long, score double").repartition(5)
    out = {r["row_id"]: r for r in fold_ensemble(df, 5).collect()}
    assert out[1]["score"] == (((0.1 + 0.7) + 0.3) + 0.9 + 0.5) / 5
    assert (out[1]["LABEL"], out[2]["LABEL"]) == (1, 0)


def test_sweep_has_one_row_for_each_setting(labelled, unlabelled):
    table = sweep(
        labelled, unlabelled, QUICK, [{"threshold": 0.8}, {"cap": 3, "cv_cut": 0.6}]
    ).collect()
    assert [(r["threshold"], r["cap"], r["cut"]) for r in table] == [
        (0.8, "None", 0.5),
        (0.85, "3", 0.6),
    ]
    assert all(r["auc"] > 0.8 for r in table)


def test_sweep_over_a_cut_fits_once(labelled, unlabelled):
    steps = Steps()
    changes = [{"cv_cut": c} for c in (0.4, 0.5, 0.6)]
    table = sweep(labelled, unlabelled, QUICK, changes, steps=steps).collect()
    assert [r["cut"] for r in table] == [0.4, 0.5, 0.6]
    assert steps.runs == {"folds": 1, "stage_one": 1, "projection": 3, "fit": 3, "rounds": 3}
    assert len({r["auc"] for r in table}) == 1 and len({r["recall"] for r in table}) > 1


def test_sweep_shares_the_steps_before_a_change(labelled, unlabelled):
    """Thresholds share the first fit and its scores, regressors the first projection."""
    steps = Steps()
    changes = [
        {"threshold": 0.8},
        {"threshold": 0.9, "cap": 5},
        {"model": "rf", "model_params": {"trees": 4}},
    ]
    table = sweep(labelled, unlabelled, QUICK, changes, steps=steps).collect()
    assert steps.runs == {
        "folds": 1, "stage_one": 1, "projection": 3, "fit": 6, "scores": 3, "rounds": 9
    }
    for row, change in zip(table, changes, strict=True):
        alone = cross_validate(labelled, unlabelled, QUICK.but(**change)).pooled().first()
        assert row["accuracy"] == pytest.approx(alone["accuracy"])
        assert row["mse"] == pytest.approx(alone["mse"], abs=1e-9)


def test_a_step_runs_once_in_many_threads():
    steps, calls = Steps(), []
    with ThreadPool(8) as pool:
        found = pool.map(lambda i: steps.once("a", (i % 2,), lambda: calls.append(i) or len(calls)), range(40))
    assert len(calls) == 2 and steps.runs["a"] == 2 and set(found) == {1, 2}
    assert sorted(steps.results("a")) == [1, 2] and steps.results("b") == []


def test_linear_folds_equal_separate_fits(labelled, unlabelled):
    """Folds, rounds and thresholds from shared passes, and each by itself."""
    plain = QUICK.but(fine_tune=False, rounds=2)
    steps = Steps()
    variants = [plain.but(threshold=t, cv_cut=c) for t, c in ((0.7, 0.5), (0.8, 0.5), (0.8, 0.6))]
    results = evaluate._validate(labelled, unlabelled, variants, True, True, steps)
    assert steps.runs["labelled_passes"] == 1 and steps.runs["unlabelled_passes"] == 2
    base = Projection.identity(WIDTH)
    for variant, result in zip(variants, results, strict=True):
        folds = {r["row_id"]: r["fold"] for r in result.oof.collect()}
        scores = {r["row_id"]: r["score"] for r in result.oof.collect()}
        assert sorted(folds) == list(range(120)) and result.cut == variant.cv_cut
        assert result.test_scores.count() == 900
        for fold in range(3):
            held = [i for i, f in folds.items() if f == fold]
            fitted = self_train(labelled.filter(~F.col("row_id").isin(held)), unlabelled, variant, base)
            alone = fitted.score(labelled.filter(F.col("row_id").isin(held)))
            for r in alone.collect():
                assert scores[r["row_id"]] == pytest.approx(r["score"], abs=1e-9)
            sizes = [tuple(r)[1:] for r in result.rounds().filter(F.col("fold") == fold).collect()]
            assert sizes == [tuple(r) for r in fitted.rounds.collect()]


def test_linear_splits_equal_separate_fits(labelled):
    settings = QUICK.but(fine_tune=False)
    result = repeated_splits(labelled, settings, rounds=(0, 3))
    base = Projection.identity(WIDTH)
    for rnd in (0, 3):
        scores = {r["row_id"]: r["score"] for r in result.oof.filter(F.col("fold") == rnd).collect()}
        assert len(scores) == 24
        held = F.col("row_id").isin(list(scores))
        fitted = training.fit_labelled(labelled.filter(~held), settings, base)
        for r in fitted.score(labelled.filter(held)).collect():
            assert scores[r["row_id"]] == pytest.approx(r["score"], abs=1e-9)


def test_a_validation_keeps_sizes_and_losses_of_its_folds(labelled, unlabelled):
    result = cross_validate(labelled, unlabelled, QUICK)
    rounds = result.rounds().collect()
    assert [(r["fold"], r["round"]) for r in rounds] == [(f, i) for f in range(3) for i in (0, 1)]
    assert all(r["labeled"] == 80 and r["total_train"] == 80 + r["pseudo"] for r in rounds)
    epochs = result.epochs().filter("stage = 'pairs'").collect()
    assert len(epochs) == 3 * 2 * QUICK.epochs and all(r["loss"] > 0 for r in epochs)


@pytest.mark.parametrize("change", [{"simcse": "both"}, {"threshold": 0.5}])
def test_settings_are_checked(change):
    with pytest.raises(ValueError):
        QUICK.but(**change)


def test_validation_texts_stay_out_of_the_fold_stage(labelled, unlabelled):
    """With ``simcse='fold'`` each fold's unsupervised stage sees no held-out row."""
    result = cross_validate(labelled, unlabelled, QUICK.but(simcse="fold"), False)
    seen = result.epochs().filter("stage = 'simcse'").collect()
    assert sorted((r["fold"], r["n"]) for r in seen) == [(f, 380) for f in range(3)]
    shared = cross_validate(labelled, unlabelled, QUICK.but(simcse="all"), False)
    assert {r["n"] for r in shared.epochs().filter("stage = 'simcse'").collect()} == {420}


@pytest.mark.parametrize("epochs", [1, 2])
def test_fold_stages_equal_separate_fits(labelled, unlabelled, epochs):
    """One pass for all folds, against each fold's own rows in the same batches."""
    folded = labelled.withColumn("fold", F.when(F.col("row_id") < 90, (F.col("row_id") % 3).cast("int")))
    texts = folded.select("row_id", "emb", "fold").unionByName(
        unlabelled.select("row_id", "emb", F.lit(None).cast("int").alias("fold"))
    )
    start = Projection.identity(WIDTH)
    found = fit_simcse_folds(texts, start, 3, epochs, batch_size=16)
    dealt = batches(texts, 16).cache()
    for fold, projection in enumerate(found):
        own = dealt.filter(F.col("fold").isNull() | (F.col("fold") != fold))
        grouped, weights = gather_batches(own, "row_id", "emb"), start.weights
        for epoch in range(1, epochs + 1):
            loss, grad, n = ranking_gradient(two_views(grouped, epoch), weights)
            weights, size = clipped_step(weights, grad, 0.2, 1.0)
            assert projection.epochs[epoch - 1][2] == pytest.approx(loss, abs=1e-12)
            assert projection.epochs[epoch - 1][4] == n == 390
        assert np.allclose(projection.weights, weights, atol=1e-12)
    assert not np.allclose(found[0].weights, found[1].weights, atol=1e-9)


def test_fold_stages_shuffle_the_vectors_once(labelled, unlabelled, monkeypatch):
    calls = []
    real = projection_module.fold_ranking_gradients
    monkeypatch.setattr(
        projection_module, "fold_ranking_gradients", lambda *a, **k: calls.append(1) or real(*a, **k)
    )
    cross_validate(labelled, unlabelled, QUICK.but(simcse="fold"), False)
    assert len(calls) == 1


def test_elastic_fit_moves_and_sums_in_one_python_worker(labelled, monkeypatch):
    plans, summed = [], linear._summed

    def seen(rows, *rest):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return summed(rows, *rest)

    monkeypatch.setattr(linear, "_summed", seen)
    width = vector_width(labelled)
    projection = Projection(np.eye(width) + 0.2 * np.arange(width * width).reshape(width, width) / width**2)
    train = labelled.select(F.col("row_id").cast("string").alias("row_id"), "LABEL", "emb")
    fitted = fit_on(train, projection, QUICK.but(model="elastic"))
    assert len(plans) == 1 and "project(" not in plans[0]
    apart = linear.fit_linear(apply_projection(train, projection), width)
    assert np.allclose(fitted.model.weights, apart.weights, atol=1e-9)
    assert np.isclose(fitted.model.intercept, apart.intercept, atol=1e-9) and "project(" in plans[1]


def many(spark, n, at=0):
    """Rows a tree of one split can tell apart; more of them than a fit was once bounded to."""
    label = (F.col("id") % 2).cast("int")
    emb = F.array(2.0 * label - 1.0, F.rand(at), F.rand(at + 1)).cast("array<float>")
    return spark.range(at, at + n).select(F.col("id").alias("row_id"), label.alias("LABEL"), emb.alias("emb")).cache()


def means(df):
    """Of the vectors as a fit sees them."""
    seen = apply_projection(df, Projection.identity(3)).select("feat").collect()
    return np.array([r["feat"] for r in seen], np.float64).mean(axis=0)


ONE_TREE = Settings(model_params={"trees": 1, "depth": 1}, fine_tune=False, rounds=1)


def test_the_final_fit_is_on_all_rows(spark):
    labelled, rest = many(spark, 20_500), many(spark, 30, 50_000)
    fitted, predicted = fit_predict(labelled, rest, ONE_TREE, self_training=False)
    assert np.allclose(fitted.model.stages[0].mean.toArray(), means(labelled), atol=1e-12)
    assert predicted.count() == 30


def test_the_rounds_of_self_training_fit_on_all_rows(spark):
    labelled, rest = many(spark, 15_000), many(spark, 9_000, 50_000)
    fitted = self_train(labelled, rest.drop("LABEL"), ONE_TREE)
    assert fitted.counts[1][1] > 20_500
    assert np.allclose(fitted.model.stages[0].mean.toArray(), means(fitted.train), atol=1e-12)
    fitted.release()


def test_a_sweep_fits_on_all_rows_of_a_fold(spark):
    labelled, rest = many(spark, 30_900), many(spark, 30, 50_000)
    steps = Steps()
    changes = [{}, {"model": "gbm", "model_params": {"stages": 1, "depth": 1}}]
    sweep(labelled, rest, ONE_TREE.but(folds=3, parallel_folds=3), changes, False, steps)
    fits = steps.results("fit")
    assert len(fits) == 6
    # The folds are equally large, so the means over their training rows average to the mean of all.
    for kind in ("RandomForest", "GBT"):
        found = [f.model.stages[0].mean.toArray() for f in fits if kind in type(f.model.stages[-1]).__name__]
        assert len(found) == 3 and np.allclose(np.mean(found, axis=0), means(labelled), atol=2e-5)
