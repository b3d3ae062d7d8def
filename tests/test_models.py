import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from labelspring.operators.forest import read_forest
from labelspring.operators.linear import (
    LinearModel,
    Moments,
    fit_linear,
    group_moments,
    pseudo_moments,
    solve_elastic,
)
from labelspring.operators.models import bounded_rows, fit_model, make_regressor, score_rows
from labelspring.operators.projection import Projection, apply_projection
from labelspring.operators.scaling import fit_scaler, scaler_stats
from labelspring.operators.selection import select_confident
from labelspring.plans.settings import Settings
from labelspring.plans.training import fit_on
from labelspring.sources.tables import load_model, save_model

WIDTH = 6


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, WIDTH)).astype(np.float32)
    x[:, 4] = 2.5  # a constant dimension
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=240) > 0).astype(int)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    table = [(i, int(y[i]), x[i].tolist()) for i in range(len(y))]
    return spark.createDataFrame(table, "row_id long, LABEL int, feat array<float>").cache()


def scores(df, model):
    return np.array([r["score"] for r in score_rows(df, model).orderBy("row_id").collect()])


def scaled(data):
    x = data[0].astype(np.float64)
    std = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(std > 0, std, 1.0)


def test_scaler_uses_the_population_std(spark, rows, data):
    x = data[0].astype(np.float64)
    stats = scaler_stats(rows, "feat").orderBy("dim").collect()
    std = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    assert [r["mean"] for r in stats] == pytest.approx(x.mean(axis=0))
    assert [r["std"] for r in stats] == pytest.approx(std)
    raw = rows.withColumn("_raw", array_to_vector("feat"))
    model = fit_scaler(raw, len(x), "_raw", "_out")
    out = model.transform(raw).orderBy("row_id").select(vector_to_array("_out"))
    assert np.allclose(np.array([r[0] for r in out.collect()]), scaled(data), atol=1e-9)


def test_two_rows_scale_to_plus_and_minus_one(spark):
    df = spark.createDataFrame([([1.0],), ([3.0],)], "v array<double>")
    raw = df.select(array_to_vector("v").alias("_raw"))
    out = fit_scaler(raw, 2, "_raw", "_out").transform(raw).select(vector_to_array("_out"))
    assert sorted(r[0][0] for r in out.collect()) == pytest.approx([-1.0, 1.0])


def test_elastic_net_meets_the_optimality_conditions(rows, data):
    alpha, l1_ratio = 0.01, 0.5
    model = fit_model(rows, "elastic", alpha=alpha, l1_ratio=l1_ratio, tol=1e-10).stages[-1]
    x, y = scaled(data), data[1]
    w = model.coefficients.toArray()
    residual = y - x @ w - model.intercept
    assert residual.mean() == pytest.approx(0.0, abs=1e-8)
    slope = x.T @ residual / len(y) - alpha * (1 - l1_ratio) * w
    for j in range(WIDTH):
        if abs(w[j]) > 1e-9:
            assert slope[j] == pytest.approx(alpha * l1_ratio * np.sign(w[j]), abs=1e-5)
        else:
            assert abs(slope[j]) <= alpha * l1_ratio + 1e-5
    assert np.abs(w).max() > 0.1


@pytest.mark.parametrize(
    "name, params", [("rf", {"trees": 12}), ("gbm", {"stages": 8}), ("elastic", {})]
)
def test_fit_depends_on_neither_partitioning_nor_session(spark, rows, name, params):
    one = scores(rows, fit_model(rows.repartition(1), name, **params))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        seven = scores(rows, fit_model(rows.repartition(7), name, **params))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.allclose(one, seven, atol=1e-9)
    assert one.min() >= 0.0 and one.max() <= 1.0
    truth = np.array([r["LABEL"] for r in rows.orderBy("row_id").collect()])
    assert ((one >= 0.5) == truth).mean() > 0.85


def test_defaults_of_the_regressors():
    forest = make_regressor("rf")
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (200, 30)
    assert forest.getFeatureSubsetStrategy() == "all" and forest.getSeed() == 42
    boosted = make_regressor("gbm")
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize()) == (200, 3, 0.1)
    elastic = make_regressor("elastic", label_std=0.5)
    assert elastic.getMaxIter() == 5000 and not elastic.getStandardization()
    assert elastic.getRegParam() == pytest.approx(0.01 * (0.5 + 0.5 * 0.5))


def test_the_bound_on_fitted_rows_keeps_class_shares(spark):
    df = spark.range(1000).selectExpr("id as row_id", "cast(id % 10 = 0 as int) as LABEL")
    kept = bounded_rows(df, 200).groupBy("LABEL").count()
    assert {r["LABEL"]: r["count"] for r in kept.collect()} == {0: 180, 1: 20}
    again = bounded_rows(df.repartition(7), 200)
    assert again.exceptAll(bounded_rows(df, 200)).count() == 0
    assert bounded_rows(df, 1000).count() == 1000
    assert bounded_rows(df, 2).count() == 3  # a class keeps a row


def test_all_rows_are_scored_by_a_bounded_fit(rows):
    model = fit_model(rows, "rf", trees=5, fit_rows=60)
    assert score_rows(rows, model).count() == 240
    assert model.stages[-1].trees[0].numNodes < 120


def many_rows(spark, n=20_500):
    """More rows than a fit was once bounded to."""
    feat = F.array(F.rand(1) + F.col("id") / n, F.rand(2)).cast("array<float>").alias("feat")
    rows = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("LABEL"), feat)
    return rows.cache()


@pytest.mark.parametrize(
    "name, params",
    [("elastic", {}), ("rf", {"trees": 1, "depth": 1}), ("gbm", {"stages": 1, "depth": 1})],
)
def test_a_fit_without_a_bound_is_on_all_rows(spark, name, params):
    df = many_rows(spark)
    x = np.array([r["feat"] for r in df.select("feat").collect()], np.float64)
    model = fit_model(df, name, **params)
    assert np.allclose(model.stages[0].mean.toArray(), x.mean(axis=0), atol=1e-12)
    if name == "elastic":  # the solver tells the rows it saw
        assert model.stages[-1].summary.numInstances == len(x)
    df.unpersist()


def test_forest_scores_are_the_means_of_its_trees(rows):
    model = fit_model(rows, "rf", trees=4, depth=5)
    forest = model.stages[-1]
    parts = model.transform(rows.withColumn("_features", array_to_vector("feat")))
    found = parts.select(vector_to_array("_scaled").alias("x"), "_prediction").collect()

    def walk(node, x):
        while node.numDescendants():
            split = node.split()
            left = x[split.featureIndex()] <= split.threshold()
            node = node.leftChild() if left else node.rightChild()
        return node.prediction()

    roots = [tree._call_java("rootNode") for tree in forest.trees]
    for row in found[::12]:
        mean = np.mean([walk(root, row["x"]) for root in roots])
        assert row["_prediction"] == pytest.approx(mean, abs=1e-9)


def plain_moments(x, y):
    return Moments(len(y), y.sum(), (y * y).sum(), x.sum(axis=0), x.T @ y, x.T @ x)


def test_the_net_on_sums_meets_the_optimality_conditions(rows, data):
    x, y = scaled(data), data[1]
    std = data[0].astype(np.float64).std(axis=0)
    for alpha, l1_ratio in ((0.01, 0.5), (0.2, 0.9), (0.05, 0.0)):
        model = fit_linear(rows, WIDTH, alpha=alpha, l1_ratio=l1_ratio)
        w = model.weights * np.where(std > 0, std, 1.0)
        residual = y - y.mean() - x @ w
        slope = x.T @ residual / len(y) - alpha * (1 - l1_ratio) * w
        for j in range(WIDTH):
            if w[j] != 0:
                assert slope[j] == pytest.approx(alpha * l1_ratio * np.sign(w[j]), abs=1e-10)
            else:
                assert abs(slope[j]) <= alpha * l1_ratio + 1e-10
        assert w[4] == 0.0  # the constant dimension
        expected = np.clip(data[0] @ model.weights + model.intercept, 0, 1)
        assert np.allclose(scores(rows, model), expected, atol=1e-9)


def test_groups_sums_may_overlap_and_be_taken_away(rows, data):
    x, y = data[0].astype(np.float64), data[1].astype(np.float64)
    members = F.filter(
        F.array(F.lit(0), F.when(F.col("row_id") % 3 == 0, 1), F.when(F.col("row_id") < 0, 2)),
        lambda g: g.isNotNull(),
    )
    every, third, none = group_moments(rows.repartition(7), members, 3, WIDTH)
    at = np.arange(len(y)) % 3 == 0
    for found, expected in (
        (every, plain_moments(x, y)),
        (third, plain_moments(x[at], y[at])),
        (every - third, plain_moments(x[~at], y[~at])),
        (third + (every - third), plain_moments(x, y)),
        (none, Moments.none(WIDTH)),
    ):
        for a, b in zip(found._parts(), expected._parts(), strict=True):
            assert np.allclose(a, b, atol=1e-9)
    with pytest.raises(ValueError, match="no labelled rows"):
        solve_elastic(none)


def test_pseudo_labels_of_several_models_in_one_pass(rows, data):
    x = data[0].astype(np.float64)
    models = [fit_linear(rows, WIDTH), LinearModel(np.zeros(WIDTH), 0.5), LinearModel(np.zeros(WIDTH), 9.0)]
    sums = pseudo_moments(rows, models, [0.8, 0.8, 1.0])
    score = np.clip(x @ models[0].weights + models[0].intercept, 0, 1)
    at = (score >= 0.8) | (score <= 1 - 0.8)
    assert (sums[0].n, sums[0].y) == (at.sum(), (score >= 0.8).sum()) and 0 < at.sum() < len(x)
    assert np.allclose(sums[0].x, x[at].sum(axis=0))
    assert sums[1].n == 0 and (sums[2].n, sums[2].y) == (len(x), len(x))


def test_a_linear_model_is_kept(spark, rows, tmp_path):
    model = fit_linear(rows, WIDTH)
    save_model(spark, str(tmp_path / "kept"), Projection.identity(WIDTH), model)
    projection, loaded = load_model(spark, str(tmp_path / "kept"))
    assert projection.is_identity and isinstance(loaded, LinearModel)
    assert np.array_equal(loaded.weights, model.weights) and loaded.intercept == model.intercept


def test_unknown_regressor():
    with pytest.raises(ValueError, match="unknown model"):
        make_regressor("svm")


def test_no_rows(rows):
    with pytest.raises(ValueError, match="no labelled rows"):
        fit_model(rows.filter(F.lit(False)), "elastic")


@pytest.mark.parametrize("params", [{}, {"depth": 0}, {"maxBins": 300}])
def test_forest_is_walked_in_batches_with_sparks_own_scores(rows, monkeypatch, params):
    """Deep trees, single leaves, and thresholds that are hit exactly or do not fit a byte."""
    monkeypatch.setattr("labelspring.operators.forest.BATCH", 7)
    model = fit_model(rows, "rf", trees=9, partitions=3, **params)
    *scaler, forest = model.stages
    features = rows.withColumn("_features", array_to_vector("feat"))
    found = model.transform(features).orderBy("row_id").select(vector_to_array("_scaled"), "_prediction").collect()
    x = np.array([r[0] for r in found])
    walked = read_forest(rows.sparkSession, forest)
    assert sum(len(t.value) for t in walked.trees) == forest.totalNumNodes
    assert walked.score(x).tolist() == [r[1] for r in found]
    assert scores(rows, model).tolist() == [min(max(r[1], 0.0), 1.0) for r in found]
    for f, edges in enumerate(walked.edges):
        for at in (*edges[:3], np.nan, np.inf, -np.inf):
            x[0, f] = at
            vector = forest.predict(DenseVector(x[0]))
            assert walked.score(x[:1])[0] == vector


@pytest.mark.parametrize("model", ["rf", "elastic"])
def test_confident_rows_are_moved_and_scored_once_by_one_worker(rows, model):
    params = {"trees": 3} if model == "rf" else {}
    settings = Settings(model=model, model_params=params)
    weights = np.eye(WIDTH) + np.random.default_rng(3).normal(size=(WIDTH, WIDTH)) / 9
    train = rows.withColumnRenamed("feat", "emb")
    fitted = fit_on(train, Projection(weights), settings)
    chosen = select_confident(fitted.score(train), 0.6).select("row_id", "score")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    apart = score_rows(apply_projection(train, fitted.projection), fitted.model)
    wanted = {r["row_id"]: r["score"] for r in apart.collect()}
    found = {r["row_id"]: r["score"] for r in chosen.collect()}
    assert found == {i: s for i, s in wanted.items() if s >= 0.6 or s <= 0.4} and found
