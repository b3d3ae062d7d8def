from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelspring.functions.keyed import keyed_order
from labelspring.operators.rank import hashed_rank
from labelspring.operators import sampling
from labelspring.operators.sampling import (
    attach_pair_values,
    batches,
    class_index,
    cross_class_pairs,
    make_pairs,
    mask_tokens,
    same_class_pairs,
    self_pairs,
    shuffle_pairs,
    shuffle_splits,
    stratified_folds,
)


def table(spark, positives, negatives, other=0):
    labels = [1] * positives + [0] * negatives + [7] * other
    return spark.createDataFrame(list(enumerate(labels)), "row_id long, LABEL int")


@pytest.fixture(scope="module")
def rows(spark):
    return table(spark, 700, 23, 5)


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_rank_is_the_same_for_any_bucket_count(spark, rows, bits):
    order = keyed_order(F.col("row_id"), "pool")
    ranked = hashed_rank(rows, order, by=("LABEL",), bucket_bits=bits, size="n")
    whole = hashed_rank(rows, order, by=("LABEL",), size="n")
    assert collected(ranked, *ranked.columns) == collected(whole, *whole.columns)
    assert sorted(r["idx"] for r in ranked.collect() if r["LABEL"] == 0) == list(range(23))


def test_rank_numbers_follow_the_hash(spark, rows):
    order = keyed_order(F.col("row_id"), "x")
    ranked = hashed_rank(rows.withColumn("h", order), order).orderBy("idx").collect()
    assert [r["h"] for r in ranked] == sorted(r["h"] for r in ranked)


def test_results_do_not_depend_on_partitioning(spark, rows):
    for build in (
        lambda d: make_pairs(d, 100),
        lambda d: stratified_folds(d.filter("LABEL < 2")),
        lambda d: shuffle_splits(d),
        lambda d: batches(d, 32),
    ):
        one, seven = build(rows.repartition(1)), build(rows.repartition(7))
        assert collected(one, *one.columns) == collected(seven, *one.columns)


def test_class_index_leaves_other_labels_out(rows):
    index = class_index(rows).collect()
    assert len(index) == 723
    assert {(r["LABEL"], r["pool_size"]) for r in index} == {(0, 23), (1, 700)}


def test_pairs(spark, rows):
    label = {r["row_id"]: r["LABEL"] for r in rows.collect()}
    pairs = make_pairs(rows, 401).collect()
    assert len(pairs) == 401
    assert Counter(p["label"] for p in pairs) == {1.0: 200, 0.0: 201}
    for p in pairs:
        if p["label"] == 1.0:
            assert label[p["a"]] == label[p["b"]] and p["a"] != p["b"]
        else:
            assert (label[p["a"]], label[p["b"]]) == (1, 0)
    coin = Counter(label[p["a"]] for p in pairs if p["label"] == 1.0)
    assert 60 < coin[0] < 140


def test_odd_pair_count_gives_the_extra_pair_to_the_cross_class(spark, rows):
    counts = Counter(p["label"] for p in make_pairs(rows, 5).collect())
    assert counts == {1.0: 2, 0.0: 3}


def test_broadcast_and_shuffled_pools_agree(spark, rows, monkeypatch):
    small = make_pairs(rows, 300)
    expected = collected(small, "pair_id", "a", "b", "label")
    for limit in (0, 100):  # no class, then only the smaller one, is broadcast
        monkeypatch.setattr(sampling, "BROADCAST_ROWS", limit)
        assert collected(make_pairs(rows, 300), "pair_id", "a", "b", "label") == expected


@pytest.mark.parametrize("broadcast, hot", [(100_000, 10_000), (5, 1), (299, 7), (299, 10_000)])
def test_values_are_attached_to_both_ends(spark, monkeypatch, broadcast, hot):
    rows = table(spark, 1, 40).withColumn("TEXT", F.concat(F.lit("t"), F.col("row_id")))
    pairs = make_pairs(rows, 300)
    monkeypatch.setattr(sampling, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(sampling, "HOT_DRAWS", hot)
    found = attach_pair_values(pairs, rows, "TEXT").collect()
    assert len(found) == 300
    assert all(r["TEXT_a"] == f"t{r['a']}" and r["TEXT_b"] == f"t{r['b']}" for r in found)
    assert sorted((r["pair_id"], r["a"], r["b"]) for r in found) == collected(
        pairs, "pair_id", "a", "b"
    )
    assert sum(r["a"] == 0 for r in found) > 100  # the only positive row


def test_single_row_class_pairs_with_itself(spark):
    rows = table(spark, 1, 10)
    same = same_class_pairs(rows, 60).collect()
    assert len(same) == 60
    assert any(p["a"] == p["b"] == 0 for p in same)
    assert all(p["a"] != p["b"] for p in same if p["a"] != 0)
    cross = cross_class_pairs(rows, 60).collect()
    assert {p["a"] for p in cross} == {0}


def test_empty_class_is_an_error(spark):
    with pytest.raises(ValueError, match="class 1 has no rows"):
        make_pairs(table(spark, 0, 10), 10)


def test_shuffle_gives_each_pair_one_position(spark, rows):
    shuffled = shuffle_pairs(make_pairs(rows, 50)).orderBy("position").collect()
    assert [p["position"] for p in shuffled] == list(range(50))
    assert [p["pair_id"] for p in shuffled] != list(range(50))


@pytest.mark.parametrize("k", [2, 5, 7])
def test_folds_partition_the_rows_evenly(spark, rows, k):
    folds = stratified_folds(rows.filter("LABEL < 2"), k).collect()
    assert len(folds) == 723
    for label in (0, 1):
        sizes = Counter(r["fold"] for r in folds if r["LABEL"] == label)
        assert len(sizes) == k and max(sizes.values()) - min(sizes.values()) <= 1
    sizes = Counter(r["fold"] for r in folds)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_splits_hold_out_a_fifth_of_each_class(spark):
    splits = shuffle_splits(table(spark, 1000, 500)).collect()
    held = Counter((r["round"], r["LABEL"]) for r in splits if r["held_out"])
    assert held == {(r, c): n for r in range(5) for c, n in ((1, 200), (0, 100))}
    chosen = {
        r: {s["row_id"] for s in splits if s["round"] == r and s["held_out"]} for r in (0, 1)
    }
    assert chosen[0] != chosen[1]


def test_batches_are_full_but_the_last(spark, rows):
    sizes = Counter(r["batch_id"] for r in batches(rows, 64).collect())
    assert sorted(sizes.values(), reverse=True) == [64] * 11 + [24]
    assert sizes[11] == 24


def test_self_pairs_cover_both_tables(spark):
    a = spark.createDataFrame([(1, "x")], "row_id long, TEXT string")
    b = spark.createDataFrame([(2, "y")], "row_id long, TEXT string")
    assert collected(self_pairs(a, b), "row_id", "anchor", "positive") == [
        (1, "x", "x"),
        (2, "y", "y"),
    ]


def test_masking_keeps_the_rest_of_the_text(spark):
    text = " ".join(f"w{i}" for i in range(4000))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "a  b ")], "row_id long, TEXT string")
    rows = {r["row_id"]: r for r in mask_tokens(df, mask="[M]").collect()}
    masked = rows[1]["masked_text"].split(" ")
    targets = {t["position"]: t["token"] for t in rows[1]["targets"]}
    assert 480 < len(targets) < 720
    restored = [targets.get(i, t) for i, t in enumerate(masked)]
    assert " ".join(restored) == text
    assert all(masked[i] == "[M]" for i in targets)
    assert rows[3]["masked_text"].count(" ") == 3
    everything = mask_tokens(df, probability=1.0, mask="[M]").collect()
    assert {r["row_id"]: r["masked_text"] for r in everything}[3] == "[M] [M] [M] [M]"
