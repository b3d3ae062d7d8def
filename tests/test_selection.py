import random

import pytest
from pyspark.sql import functions as F

from labelspring.operators.selection import (
    augment,
    cap_by_class,
    change_counts,
    kth_smallest,
    round_cap,
    round_changes,
    round_counts,
    select_confident,
    select_top,
)


def scored(spark, scores):
    return spark.createDataFrame(list(enumerate(scores)), "row_id long, score double")


def ids(df, label):
    return sorted(r["row_id"] for r in df.filter(F.col("LABEL") == label).collect())


def brute_top(scores, threshold, cap):
    up = sorted((-s, i) for i, s in enumerate(scores) if s >= threshold)[:cap]
    down = sorted((s, i) for i, s in enumerate(scores) if s <= 1.0 - threshold)[:cap]
    return sorted(i for _, i in up), sorted(i for _, i in down)


@pytest.fixture(scope="module")
def scores():
    draw = random.Random(3)
    # A third of the rows share the top score, a sixth the bottom one.
    return [
        1.0 if i % 3 == 0 else 0.0 if i % 6 == 1 else draw.randrange(201) / 200
        for i in range(1200)
    ]


def test_confident_rows(spark):
    rows = select_confident(scored(spark, [0.9, 0.5, 0.15, 0.85, 0.16, float("nan")]))
    assert (ids(rows, 1), ids(rows, 0)) == ([0, 3], [2])


@pytest.mark.parametrize("direct", [100_000, 4])
@pytest.mark.parametrize("cap", [1, 5, 250, 401, 5000])
def test_cap_takes_the_most_confident_with_ties_by_id(spark, scores, cap, direct):
    rows = select_confident(scored(spark, scores))
    capped = cap_by_class(rows, cap, direct)
    up, down = brute_top(scores, 0.85, cap)
    assert (ids(capped, 1), ids(capped, 0)) == (up, down)


def test_cap_zero_selects_nothing(spark, scores):
    assert select_top(scored(spark, scores), 0.85, 0).isEmpty()


def test_no_cap_keeps_all(spark, scores):
    df = scored(spark, scores)
    assert select_top(df, 0.85).count() == select_confident(df, 0.85).count()


def test_round_caps():
    caps = {0: 1000, 1: 1600, 2: 2000}
    assert [round_cap(caps, r) for r in range(4)] == [1000, 1600, 2000, None]
    assert round_cap(7, 3) == 7 and round_cap(None, 0) is None


@pytest.mark.parametrize("k", [1, 17, 333, 334, 999, 1000])
def test_kth_smallest_of_ties_and_large_integers(spark, k):
    draw = random.Random(k)
    values = [7.5 if i % 3 == 0 else draw.random() * 10 for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert kth_smallest(df, "x", k, direct=3) == sorted(values)[k - 1]
    large = [2**53 + draw.randrange(10**9) * 3 for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in large], "x long")
    assert kth_smallest(df, "x", k, direct=3) == sorted(large)[k - 1]


def test_kth_smallest_beyond_the_table(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert kth_smallest(df, "x", 3) is None
    assert kth_smallest(df, "x", 3, direct=1) is None


def test_kth_smallest_of_neighbouring_integers(spark):
    """Integers that share a double are still told apart."""
    values = [2**60 + i for i in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert kth_smallest(df, "x", 31, direct=3) == values[30]


def test_a_hot_value_ends_the_search_early(spark):
    """Two thirds of the rows share one value, the rest are distinct."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") / 60_000).otherwise(F.lit(0.3)).alias("x")
    )
    values = sorted(r["x"] for r in df.collect())
    context = spark.sparkContext
    for k in (5_000, 30_000, 59_000):
        context.setJobGroup(f"kth-{k}", "one search")
        assert kth_smallest(df, "x", k, direct=10) == values[k - 1]
        assert len(context.statusTracker().getJobIdsForGroup(f"kth-{k}")) <= 15
    context.setLocalProperty("spark.jobGroup.id", None)


def test_augment_replaces_earlier_pseudo_rows(spark):
    lab = spark.createDataFrame([(1, 0), (2, 1)], "row_id long, LABEL int")
    first = spark.createDataFrame([(10, 1), (11, 0)], "row_id long, LABEL int")
    second = spark.createDataFrame([(12, 1)], "row_id long, LABEL int")
    once = augment(lab, first)
    twice = augment(lab, second, once)
    assert sorted(r["row_id"] for r in twice.collect()) == [1, 2, 12]
    assert tuple(round_counts(once).first()) == (4, 2, 2, 1, 1)
    kept = augment(lab, second.limit(0), once)
    assert sorted(r["row_id"] for r in kept.collect()) == [1, 2, 10, 11]
    unchanged = augment(lab, second.limit(0))
    assert tuple(round_counts(unchanged).first()) == (2, 2, 0, 0, 0)


def test_round_changes_against_brute_force(spark):
    draw = random.Random(5)
    before = {i: draw.randrange(2) for i in range(60) if draw.random() < 0.6}
    after = {i: draw.randrange(2) for i in range(60) if draw.random() < 0.6}

    def table(rows):
        return spark.createDataFrame(list(rows.items()), "row_id long, LABEL int")

    def found(old, new):
        rows = round_changes(None if old is None else table(old), table(new)).collect()
        assert len({r["row_id"] for r in rows}) == len(rows)
        return {r["row_id"]: tuple(r)[1:] for r in rows}

    def wanted(old, new):
        kinds = {
            i: "entered" if i not in old else "left" if i not in new else "flipped"
            for i in old.keys() | new.keys()
            if old.get(i) != new.get(i)
        }
        return {i: (kind, old.get(i), new.get(i)) for i, kind in kinds.items()}

    assert {k for k, _, _ in wanted(before, after).values()} == {"entered", "left", "flipped"}
    for old, new in [(before, after), (before, before), (before, {}), ({}, after), ({}, {})]:
        assert found(old, new) == wanted(old, new)
    assert found(None, after) == wanted({}, after)


def test_change_counts(spark):
    rows = [(0, "entered"), (0, "entered"), (1, "left"), (1, "flipped"), (1, "left")]
    counted = change_counts(spark.createDataFrame(rows, "round int, change string"))
    assert sorted(map(tuple, counted.collect())) == [(0, 2, 0, 0), (1, 0, 2, 1)]
