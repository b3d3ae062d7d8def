import math
import random

import pytest
from pyspark.sql import functions as F

from labelspring.operators import metrics
from labelspring.operators.metrics import (
    confusion,
    fold_metrics,
    fold_summary,
    long_metrics,
    metrics_at_cut,
    ranking_metrics,
    threshold_metrics,
)

SCHEMA = "fold int, row_id long, y int, score double"


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def brute_ap(rows):
    positives = sum(y for y, _ in rows)
    total, seen_pos, seen = 0.0, 0, 0
    for score in sorted({s for _, s in rows}, reverse=True):
        here = [y for y, s in rows if s == score]
        seen_pos += sum(here)
        seen += len(here)
        total += sum(here) / positives * seen_pos / seen
    return total


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    out = []
    for i in range(900):
        y = int(draw.random() < 0.7)
        # A third of all rows share one score; the rest are distinct.
        score = 0.75 if i % 3 == 0 else min(1.0, max(0.0, draw.gauss(0.4 + 0.2 * y, 0.2)))
        out.append((i % 3, i, y, score))
    return out


@pytest.mark.parametrize("ranges", [2, 7, 1024])
def test_ranking_metrics_equal_brute_force(spark, rows, ranges, monkeypatch):
    monkeypatch.setattr(metrics, "RANGES", ranges)
    check_against_brute_force(spark, rows)


def test_ranges_are_cut_again_when_there_are_many_scores(spark, rows, monkeypatch):
    monkeypatch.setattr(metrics, "RANGES", 8)
    monkeypatch.setattr(metrics, "RANGE_ROWS", 20)
    df = spark.createDataFrame(rows, SCHEMA)
    assert metrics._score_ranges(df)[1] == 4
    placed = df.select("score").distinct().withColumn(
        "_range", F.when(F.col("score") < 0.5, F.lit(0.0)).otherwise(F.lit(1.0))
    )
    sizes = [r["count"] for r in metrics._with_parts(placed, 8).groupBy("_range", "_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 100
    check_against_brute_force(spark, rows)


def check_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    row = ranking_metrics(df).first()
    plain = [(y, s) for _, _, y, s in rows]
    assert row["auc"] == pytest.approx(brute_auc(plain), abs=1e-12)
    assert row["pr_auc"] == pytest.approx(brute_ap(plain), abs=1e-12)
    for r in ranking_metrics(df, ("fold",)).collect():
        part = [(y, s) for f, _, y, s in rows if f == r["fold"]]
        assert r["auc"] == pytest.approx(brute_auc(part), abs=1e-12)
        assert r["pr_auc"] == pytest.approx(brute_ap(part), abs=1e-12)


def test_metrics_do_not_depend_on_partitioning(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    one = metrics_at_cut(df.repartition(1)).first()
    seven = metrics_at_cut(df.repartition(7)).first()
    assert tuple(one) == pytest.approx(tuple(seven), abs=1e-12)


def from_matrix(spark, tn, fp, fn, tp):
    cells = [(0, 0.1)] * tn + [(0, 0.9)] * fp + [(1, 0.1)] * fn + [(1, 0.9)] * tp
    data = [(0, i, y, s) for i, (y, s) in enumerate(cells)]
    return spark.createDataFrame(data, SCHEMA)


def test_logged_confusion_matrix(spark):
    df = from_matrix(spark, 160, 40, 39, 161)
    assert [tuple(r) for r in confusion(df).orderBy("y").collect()] == [(0, 160, 40), (1, 39, 161)]
    row = threshold_metrics(df).first()
    logged = {"accuracy": 0.8025, "precision": 0.8010, "recall": 0.8050, "f1": 0.8030}
    for name, value in logged.items():
        assert round(row[name], 4) == value


def test_confusion_always_has_both_classes(spark):
    df = from_matrix(spark, 3, 0, 0, 0)
    assert [tuple(r) for r in confusion(df).orderBy("y").collect()] == [(0, 3, 0), (1, 0, 0)]


def test_no_predicted_positive_gives_zero(spark):
    row = threshold_metrics(from_matrix(spark, 5, 0, 5, 0)).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_single_class_has_no_auc(spark):
    row = ranking_metrics(from_matrix(spark, 0, 0, 2, 3)).first()
    assert row["auc"] is None and row["pr_auc"] == 1.0
    row = ranking_metrics(from_matrix(spark, 2, 2, 0, 0)).first()
    assert row["auc"] is None and row["pr_auc"] == 0.0


@pytest.mark.parametrize("score", [None, float("nan")])
def test_unusable_scores_are_an_error(spark, score):
    df = spark.createDataFrame([(0, 1, 1, 0.5), (0, 2, 0, score)], SCHEMA)
    with pytest.raises(ValueError, match="1 scores"):
        ranking_metrics(df)


def test_summary_uses_the_population_std(spark, rows):
    per_fold = fold_metrics(spark.createDataFrame(rows, SCHEMA))
    values = [r["accuracy"] for r in per_fold.collect()]
    mean = sum(values) / 3
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / 3)
    row = fold_summary(per_fold).filter("metric = 'accuracy'").first()
    assert (row["mean"], row["std"]) == pytest.approx((mean, std))


def test_logged_summary_from_its_rounds(spark):
    # Recall of two logged rounds that both show [39, 161] as their second row.
    wide = spark.createDataFrame([(0, 0.8050), (1, 0.8050)], "fold int, recall double")
    row = long_metrics(wide, ("recall",)).agg(F.stddev_pop("value"), F.avg("value")).first()
    assert tuple(row) == pytest.approx((0.0, 0.8050))
