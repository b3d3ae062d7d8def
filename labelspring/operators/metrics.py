"""Ranking and threshold metrics of scored rows, for all folds in one pass.

Input is ``row_id, y, score`` with ``y`` in {0, 1}; ``by`` names columns with few
values, such as ``fold``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelspring.functions.columns import four_decimals, label_by_cut

RANGES = 1024
#: Distinct scores in a range, about; with more of them the ranges are cut again.
RANGE_ROWS = 1 << 18

THRESHOLD_METRICS = ("accuracy", "precision", "recall", "f1", "mse")
ALL_METRICS = ("auc", "pr_auc", *THRESHOLD_METRICS)


def _ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 where the denominator is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("double")


def _from_cells() -> list[Column]:
    """Threshold metrics from the columns ``tp, fp, fn, tn, mse``."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return [
        ((tp + tn) / F.nullif(tp + tn + fp + fn, F.lit(0.0))).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
        F.col("mse"),
    ]


def threshold_metrics(df: DataFrame, cut: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 at the cut, and the mean squared error."""
    hit = label_by_cut(F.col("score"), cut) == 1
    true = F.col("y") == 1
    counts = df.groupBy(*by).agg(
        _count(hit & true).alias("tp"),
        _count(hit & ~true).alias("fp"),
        _count(~hit & true).alias("fn"),
        _count(~hit & ~true).alias("tn"),
        F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))).alias("mse"),
    )
    return counts.select(*by, *_from_cells())


def confusion(df: DataFrame, cut: float = 0.5) -> DataFrame:
    """Confusion matrix: a row for each true class, a column for each predicted one."""
    predicted = label_by_cut(F.col("score"), cut)
    cells = df.agg(
        *[
            F.count_if((F.col("y") == y) & (predicted == p)).alias(f"c{y}{p}")
            for y in (0, 1)
            for p in (0, 1)
        ]
    )
    return cells.selectExpr("stack(2, 0, c00, c01, 1, c10, c11) as (y, pred_0, pred_1)")


def _score_ranges(df: DataFrame) -> tuple[list[float], int]:
    """Edges that split the rows into ranges of about equal size; checks for NaN.

    Also returns into how many parts each range is to be cut. At most ``RANGES``
    numbers reach the driver. They only spread the work: any edges give the same
    metrics.
    """
    facts = df.agg(
        F.percentile_approx(
            "score", [i / RANGES for i in range(1, RANGES)], 4 * RANGES
        ).alias("q"),
        F.count_if(F.col("score").isNull() | F.isnan("score")).alias("bad"),
        F.approx_count_distinct("score").alias("distinct"),
    ).first()
    if facts["bad"]:
        raise ValueError(f"{facts['bad']} scores are missing or NaN")
    edges = sorted(set(facts["q"] or []))
    parts = min(RANGES, -(-facts["distinct"] // (RANGES * RANGE_ROWS)))
    return [float("-inf"), *(edges or [0.0]), float("inf")], max(1, parts)


def _with_parts(placed: DataFrame, parts: int) -> DataFrame:
    """Add ``_part``, the number of the part of its range that a score lies in.

    The edges of all parts are a table of at most ``RANGES`` rows of ``RANGES``
    numbers, which is broadcast.
    """
    if parts == 1:
        return placed.withColumn("_part", F.lit(0))
    shares = [i / parts for i in range(1, parts)]
    inner = placed.groupBy("_range").agg(
        F.percentile_approx("score", shares, 4 * parts).alias("_edges")
    )
    below = F.size(F.filter("_edges", lambda edge: edge <= F.col("score")))
    return placed.join(F.broadcast(inner), "_range").withColumn("_part", below).drop("_edges")


def _cumulated(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Distinct scores with ``pos, cnt`` and the running ``above, seen`` from the top.

    ``above`` counts the positives and ``seen`` the rows with at least that score.

    Equal scores are merged first, so a score shared by a third of all rows is
    one row. The ranges then cut the running sum into many tasks, and their number
    grows with the distinct scores. What precedes a range is summed over the ranges
    and then over the parts of each, so no window has more than ``RANGES`` rows or
    the scores of one part.
    """
    edges, parts = _score_ranges(df)
    grouped = (
        df.select(*by, F.col("score").cast("double").alias("score"), "y")
        .groupBy(*by, "score")
        .agg(F.sum(F.col("y").cast("double")).alias("pos"), _count(F.lit(True)).alias("cnt"))
    )
    placed = Bucketizer(splits=edges, inputCol="score", outputCol="_range").transform(grouped)
    placed = _with_parts(placed, parts)
    keys = [*by, "_range", "_part"]

    def above(groups: list[str], order: str) -> list[Column]:
        whole = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(F.desc(order))
        rows = whole.rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(c).over(rows), F.lit(0.0)) for c in ("_pos", "_cnt")]

    cells = placed.groupBy(*keys).agg(F.sum("pos").alias("_pos"), F.sum("cnt").alias("_cnt"))
    if parts > 1:
        tp, n = above([*by, "_range"], "_part")
        before = cells.select(*keys, tp.alias("_tp_part"), n.alias("_n_part"))
        cells = cells.groupBy(*keys[:-1]).agg(*[F.sum(c).alias(c) for c in ("_pos", "_cnt")])
    tp, n = above([*by], "_range")
    ranges = cells.select(*(c for c in keys if c in cells.columns), tp.alias("_tp"), n.alias("_n"))
    if parts > 1:
        before = before.join(ranges, keys[:-1]).select(
            *keys,
            (F.col("_tp") + F.col("_tp_part")).alias("_tp"),
            (F.col("_n") + F.col("_n_part")).alias("_n"),
        )
    else:
        before = ranges
    inside = (
        Window.partitionBy(*keys)
        .orderBy(F.desc("score"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = placed.select(
        *keys,
        "score",
        "pos",
        (F.col("cnt") - F.col("pos")).alias("neg"),
        F.sum("pos").over(inside).alias("_tp_in"),
        F.sum("cnt").over(inside).alias("_n_in"),
    )
    return running.join(before, keys).select(
        *by,
        "score",
        "pos",
        "neg",
        (F.col("_tp") + F.col("_tp_in")).alias("above"),
        (F.col("_n") + F.col("_n_in")).alias("seen"),
    )


def _ranking_sums() -> list[Column]:
    pos, neg, above, seen = (F.col(c) for c in ("pos", "neg", "above", "seen"))
    return [
        F.sum(neg * (above - pos / 2)).alias("area"),
        F.sum(pos * above / seen).alias("steps"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    ]


def _from_sums() -> list[Column]:
    """Ranking metrics from the sums."""
    pairs = F.col("positives") * F.col("negatives")
    return [
        (F.col("area") / F.nullif(pairs, F.lit(0.0))).alias("auc"),
        _ratio(F.col("steps"), F.col("positives")).alias("pr_auc"),
    ]


def ranking_metrics(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``auc`` with ties counting half, and step-form average precision ``pr_auc``.

    ``auc`` is NULL where only one class occurs; ``pr_auc`` is 0 without positives.
    """
    sums = _cumulated(df, by).groupBy(*by).agg(*_ranking_sums())
    return sums.select(*by, *_from_sums())


def metrics_at_cut(df: DataFrame, cut: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """All metrics, one row for each value of ``by``, from one table of distinct scores."""
    score, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    hit = label_by_cut(score, cut) == 1
    error = pos * (1 - score) * (1 - score) + neg * score * score

    def total(condition: Column, count: Column) -> Column:
        return F.sum(F.when(condition, count).otherwise(F.lit(0.0)))

    sums = _cumulated(df, by).groupBy(*by).agg(
        *_ranking_sums(),
        total(hit, pos).alias("tp"),
        total(hit, neg).alias("fp"),
        total(~hit, pos).alias("fn"),
        total(~hit, neg).alias("tn"),
        (F.sum(error) / F.sum(pos + neg)).alias("mse"),
    )
    return sums.select(*by, *_from_sums(), *_from_cells())


def fold_metrics(df: DataFrame, cut: float = 0.5) -> DataFrame:
    """All metrics of every fold from one table of out-of-fold scores."""
    return metrics_at_cut(df, cut, ("fold",))


def long_metrics(wide: DataFrame, metrics: tuple[str, ...] = ALL_METRICS) -> DataFrame:
    """``..., metric, value`` from one column for each metric."""
    ids = [c for c in wide.columns if c not in metrics]
    return wide.unpivot(ids, list(metrics), "metric", "value")


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """``metric, mean, std`` over the folds, population std."""
    return (
        long_metrics(per_fold)
        .groupBy("metric")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    )


def metric_report(metrics: DataFrame, *values: str) -> DataFrame:
    """The named columns as text with four decimals."""
    return reduce(lambda d, v: d.withColumn(v, four_decimals(F.col(v))), values, metrics)
