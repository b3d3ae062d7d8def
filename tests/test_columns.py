import math

import pytest
from pyspark.sql import functions as F

from labelspring.functions.columns import (
    clip_score,
    confidence_label,
    four_decimals,
    label_by_cut,
    text_as_string,
)
from labelspring.functions.keyed import keyed_hash, keyed_index, keyed_order
from labelspring.functions.vectors import cosine, l2_normalise, to_wide

NAN = float("nan")


def column(spark, values, expression, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_clip_limits_and_keeps_nan(spark):
    clipped = column(spark, [-0.2, 0.0, 0.4, 1.0, 1.3, NAN], clip_score)
    assert clipped[:5] == [0.0, 0.0, 0.4, 1.0, 1.0]
    assert math.isnan(clipped[5])


def test_cut_includes_the_bound_and_drops_nan(spark):
    assert column(spark, [0.49, 0.5, 0.6, NAN], label_by_cut) == [0, 1, 1, 0]
    assert column(spark, [0.5, 0.6], lambda x: label_by_cut(x, 0.6)) == [0, 1]


def test_confidence_bounds_follow_double_arithmetic(spark):
    at_85 = column(spark, [0.85, 0.15, 0.1501, NAN], lambda x: confidence_label(x, 0.85))
    assert at_85 == [1, 0, None, None]
    at_90 = column(spark, [0.9, 0.10, 0.095], lambda x: confidence_label(x, 0.90))
    assert at_90 == [1, None, 0]


@pytest.mark.parametrize("threshold", [0.5, 0.2, 1.01])
def test_threshold_must_separate_the_classes(threshold):
    with pytest.raises(ValueError):
        confidence_label(F.col("x"), threshold)


def test_missing_texts_become_nan(spark):
    texts = [None, "", "NA", "null", "  pad ", "nan", "word"]
    assert column(spark, texts, text_as_string, "string") == [
        "nan", "nan", "nan", "nan", "  pad ", "nan", "word",
    ]


def test_four_decimals(spark):
    assert column(spark, [0.8025, 1.0, 0.66666], four_decimals) == ["0.8025", "1.0000", "0.6667"]


def test_draws_use_60_bits_for_every_pool_size(spark):
    keys = spark.range(2000)
    size = 1 << 50
    drawn = keys.select(keyed_index(F.col("id"), "a", size).alias("x")).agg(F.max("x")).first()[0]
    assert (1 << 32) < drawn < size
    for small in (7, 1 << 20, (1 << 20) + 1):
        both = keys.select(
            keyed_index(F.col("id"), "a", small), keyed_order(F.col("id"), "a") % small
        )
        assert all(r[0] == r[1] for r in both.collect())


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [list(r[0]) for r in df.select(l2_normalise(F.col("v"))).collect()] == [
        [0.6, 0.8],
        [0.0, 0.0],
    ]


def test_cosine_of_a_zero_vector_is_zero(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>"
    )
    found = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert found == pytest.approx([2**-0.5, 0.0])


def test_wide_table_leads_with_id_and_label(spark):
    df = spark.createDataFrame([(1, 0, [0.5, 2.0])], "row_id long, LABEL int, emb array<float>")
    wide = to_wide(df, 2)
    assert wide.columns == ["row_id", "LABEL", "emb_0", "emb_1"]
    assert tuple(wide.first()) == (1, 0, 0.5, 2.0)
