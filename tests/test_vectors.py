import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelspring.functions.columns import text_as_string
from labelspring.functions.keyed import keyed_hash
from labelspring.operators.encoders import (
    _chunk_counts,
    _Slots,
    attach_vectors,
    encode_once,
    hashed_encode,
    model_encode,
)
from labelspring.operators.losses import (
    RANKING_SCALE,
    cosine_pair_loss,
    gather_batches,
    in_batch_ranking_loss,
)
from labelspring.operators.projection import (
    Projection,
    _batch_ranking,
    apply_projection,
    dropout_view,
    fit_pairs,
    fit_simcse,
    fold_ranking_gradients,
    pair_gradient,
    ranking_gradient,
    two_views,
)
from labelspring.operators.sampling import attach_pair_values, batches, make_pairs

WIDTH = 5


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    table = []
    for i in range(150):
        label = i % 2
        x = rng.normal(size=WIDTH) + 0.6 * label
        table.append((i, label, (x / np.linalg.norm(x)).astype(float).tolist()))
    table.append((150, 0, [0.0] * WIDTH))  # an empty text
    return spark.createDataFrame(table, "row_id long, LABEL int, emb array<double>").cache()


def numeric_gradient(loss, weights, step=1e-6):
    grad = np.zeros_like(weights)
    for i, j in np.ndindex(*weights.shape):
        up, down = weights.copy(), weights.copy()
        up[i, j] += step
        down[i, j] -= step
        grad[i, j] = (loss(up) - loss(down)) / (2 * step)
    return grad


def unit(x):
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1.0)


def test_pair_gradient(rows):
    pairs = attach_pair_values(make_pairs(rows, 200), rows, "emb").cache()
    local = pairs.orderBy("pair_id").collect()
    a, b = (np.array([p[c] for p in local]) for c in ("emb_a", "emb_b"))
    y = np.array([p["label"] for p in local])

    def loss(w):
        return float((((unit(a @ w.T) * unit(b @ w.T)).sum(axis=1) - y) ** 2).mean())

    w = np.eye(WIDTH) + 0.1 * np.arange(WIDTH * WIDTH).reshape(WIDTH, WIDTH) / 25
    for parts in (1, 4):
        value, grad, n = pair_gradient(pairs.repartition(parts), w)
        assert n == 200
        assert value == pytest.approx(loss(w))
        assert np.allclose(grad, numeric_gradient(loss, w), atol=1e-6)


def test_ranking_gradient(spark, rows):
    gathered = gather_batches(batches(rows, 16), "row_id", "emb")
    grouped = two_views(gathered, epoch=1, probability=0.2).cache()
    local = grouped.collect()
    assert max(len(g["view_a"]) for g in local) == 16

    def loss(w):
        total, n = 0.0, 0
        for g in local:
            s = 20.0 * unit(np.array(g["view_a"]) @ w.T) @ unit(np.array(g["view_b"]) @ w.T).T
            total += float((np.log(np.exp(s).sum(axis=1)) - np.diag(s)).sum())
            n += len(s)
        return total / n

    w = np.eye(WIDTH) + 0.02 * np.arange(WIDTH * WIDTH).reshape(WIDTH, WIDTH) / 25
    value, grad, n = ranking_gradient(grouped, w)
    assert n == 151
    assert value == pytest.approx(loss(w))
    assert np.allclose(grad, numeric_gradient(loss, w), atol=1e-5)


def test_ranking_loss_without_dropout(spark, rows):
    same = gather_batches(
        batches(rows, 16).withColumn("view_a", F.col("emb")).withColumn("view_b", F.col("emb")),
        "view_a", "view_b",
    )
    expected = ranking_gradient(same, np.eye(WIDTH))[0]
    row = in_batch_ranking_loss(batches(rows, 16)).first()
    assert row["loss"] == pytest.approx(expected) and row["n_rows"] == 151


def test_dropout_masks_differ_by_view_and_repeat(rows):
    wide = rows.withColumn("emb", F.array_repeat(F.lit(1.0), 400))

    def views(df):
        drawn = [
            dropout_view(F.col("emb"), F.col("row_id"), 1, v).alias(f"view_{end}")
            for v, end in enumerate("ab")
        ]
        return df.select("row_id", *drawn).orderBy("row_id").collect()

    one = views(wide.repartition(3))
    assert one == views(wide.repartition(5))
    a = np.array([r["view_a"] for r in one])
    b = np.array([r["view_b"] for r in one])
    assert (a == 0).mean() == pytest.approx(0.1, abs=0.01)
    assert not np.array_equal(a, b)
    assert set(np.unique(a.round(9))) == {0.0, round(1 / 0.9, 9)}


def test_pair_fit_starts_at_the_plain_loss_and_falls(rows):
    start = Projection.identity(WIDTH)
    pairs = attach_pair_values(make_pairs(rows, 400), rows, "emb")
    plain = cosine_pair_loss(pairs).first()["loss"]
    fitted = fit_pairs(rows, start, n_pairs=400, epochs=4, learning_rate=0.5)
    losses = [e[2] for e in fitted.epochs]
    assert losses[0] == pytest.approx(plain)
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0]
    assert start.is_identity and not fitted.is_identity


def test_simcse_fit_lowers_its_loss(spark, rows):
    start = Projection.identity(WIDTH)
    fitted = fit_simcse(rows, start, epochs=2, batch_size=16)
    assert [e[:2] for e in fitted.epochs] == [("simcse", 1), ("simcse", 2)]
    grouped = two_views(gather_batches(batches(rows, 16), "row_id", "emb"), epoch=1)
    before = ranking_gradient(grouped, start.weights)[0]
    assert before == pytest.approx(fitted.epochs[0][2])
    once = fit_simcse(rows, start, epochs=1, batch_size=16)
    assert ranking_gradient(grouped, once.weights)[0] < before
    table = fitted.epoch_table(spark)
    assert table.columns == ["stage", "epoch", "loss", "grad_norm", "n"] and table.count() == 2


def test_projected_vectors_have_unit_length(rows):
    turn = np.arange(25, dtype=float).reshape(5, 5) / 10 + np.eye(5)
    moved = apply_projection(rows, Projection(turn)).orderBy("row_id").collect()
    found = np.array([r["feat"] for r in moved])
    expected = unit(np.array([r["emb"] for r in moved]) @ turn.T)
    assert np.allclose(found, expected, atol=1e-6)
    assert not found[150].any()
    plain = apply_projection(rows, Projection.identity(5)).orderBy("row_id").collect()
    assert np.allclose([r["feat"] for r in plain], [r["emb"] for r in plain], atol=1e-6)


def test_projection_survives_a_round_trip(spark, tmp_path):
    kept = Projection(np.arange(9, dtype=float).reshape(3, 3) / 7)
    kept.save(spark, str(tmp_path / "w"))
    assert np.array_equal(Projection.load(spark, str(tmp_path / "w")).weights, kept.weights)


TEXTS = "row_id long, TEXT string"


def test_chunks_of_texts_look_up_each_distinct_token_once():
    class Asked(_Slots):
        calls = []

        def __getitem__(self, token):
            self.calls.append(token)
            return super().__getitem__(token)

    texts = [b"b a  b", b"", b" a", "\u00a0 \x85 a\x1cb\x0bc".encode(), b"\n"]
    known = Asked(b"42:", b":token", 7)
    counts = _chunk_counts(pa.array(texts, pa.binary()), known).reshape(len(texts), 7)
    assert len(known.calls) == len(set(known.calls)) == 7
    for text, found in zip(texts, counts, strict=True):
        wanted = [_Slots(b"42:", b":token", 7)[t] for t in re.split(rb"[ \t\n\x0b\f\r]+", text)]
        assert found.tolist() == np.bincount(wanted, minlength=7).tolist()
    assert _chunk_counts(pa.array(texts, pa.binary())[2:4], known).tolist() == counts[2:4].ravel().tolist()


def test_hashed_encoder(spark):
    df = spark.createDataFrame([(1, "A b\na"), (2, "a A b"), (3, None), (4, "nan")], TEXTS)
    rows = {r["row_id"]: r["emb"] for r in hashed_encode(df, 32).collect()}
    assert rows[1] == rows[2] and rows[3] == rows[4] != rows[1]
    assert all(np.linalg.norm(v) == pytest.approx(1.0) for v in rows.values())
    assert max(rows[1]) == pytest.approx(2 / 5**0.5)
    assert len(rows[1]) == 32


def test_whole_texts_are_encoded(spark):
    long_text = "x " * 50_000 + "y"
    df = spark.createDataFrame([(1, long_text), (2, "x " * 50_000 + "z")], TEXTS)
    first, second = (r["emb"] for r in hashed_encode(df, 64, dtype="float64").collect())
    assert first != second


def test_hashed_encoder_hashes_a_token_once_and_keeps_odd_blanks(spark, monkeypatch):
    odd = ["", " ", "  a", "a  ", "\ta\x1cB\x1d c\u00a0d  E\n", "\u0130 A\u03a3", "a\x85b\x0bc", None, "a a A"]
    df = spark.createDataFrame(list(enumerate(odd)), "row_id long, TEXT string")
    encoded = hashed_encode(df, 7, dtype="float64")
    assert "md5(" not in encoded._jdf.queryExecution().optimizedPlan().toString()
    tokens = F.split(F.lower(text_as_string(F.col("TEXT"))), r"\s+")
    slots = F.transform(tokens, lambda t: F.pmod(keyed_hash(t, "token"), F.lit(7)))
    wanted = {r["row_id"]: r["slots"] for r in df.select("row_id", slots.alias("slots")).collect()}
    for r in encoded.collect():
        counts = np.bincount(wanted[r["row_id"]], minlength=7)
        assert np.allclose(r["emb"], counts / np.linalg.norm(counts))
    known = _Slots(b"42:", b":token", 7)
    monkeypatch.setattr("labelspring.operators.encoders.KNOWN_TOKENS", 1)
    assert [known[t] for t in (b"a", b"c", b"c")] == [_Slots(b"42:", b":token", 7)[t] for t in (b"a", b"c", b"c")]
    assert len(known) == 1


def test_gradients_are_read_as_matrices(spark, rows, monkeypatch):
    def refused(*_):
        raise AssertionError("an object for each vector")

    texts = rows.withColumn("fold", F.when(F.col("row_id") % 3 > 0, (F.col("row_id") % 3 - 1).cast("int")))
    grouped = two_views(gather_batches(batches(texts, 8), "row_id", "emb", "fold"), 1)
    weights = [np.eye(WIDTH), 2 * np.eye(WIDTH) + 0.1]
    monkeypatch.setattr(type(rows), "mapInPandas", refused)
    for fold, (loss, grad, n) in enumerate(fold_ranking_gradients(grouped, weights)):
        total, slope, seen = 0.0, 0.0, 0
        for r in grouped.collect():
            mine = [f != fold for f in r["fold"]]
            if any(mine):
                one, part = _batch_ranking(
                    np.array(r["view_a"])[mine], np.array(r["view_b"])[mine], weights[fold], RANKING_SCALE
                )
                total, slope, seen = total + one, slope + part, seen + sum(mine)
        assert n == seen and np.isclose(loss, total / n) and np.allclose(grad, slope / n)


def test_model_encoder_feeds_batches_of_texts(spark):
    def make_predict_fn():
        def predict(texts):
            assert len(texts) <= 4
            return np.array([[len(t), 1.0, 0.0] for t in texts], dtype=np.float32)

        return predict

    df = spark.createDataFrame([(i, "t" * i) for i in range(1, 11)], TEXTS)
    for r in model_encode(df, make_predict_fn, batch_size=4).collect():
        i = r["row_id"]
        assert r["emb"] == pytest.approx([i / (i * i + 1) ** 0.5, 1 / (i * i + 1) ** 0.5, 0.0])


def test_precomputed_vectors_are_joined_by_id(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], TEXTS)
    vectors = spark.createDataFrame([(2, [1.0])], "row_id long, emb array<float>")
    assert [tuple(r) for r in attach_vectors(texts, vectors).collect()] == [(2, "b", [1.0])]


def test_each_text_is_encoded_once(spark, monkeypatch):
    monkeypatch.setattr("labelspring.operators.encoders.HOT_ROWS", 4)
    calls = spark.sparkContext.accumulator(0)

    def make_predict_fn():
        def predict(texts):
            calls.add(len(texts))
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

        return predict

    texts = ["hot"] * 30 + [f"{'x' * i}" for i in range(6)] + [None, "nan", ""]
    df = spark.createDataFrame(
        [(i, t, i % 2) for i, t in enumerate(texts)], "row_id long, TEXT string, _rows int"
    )
    rows = encode_once(df, lambda d: model_encode(d, make_predict_fn)).collect()
    # hot, five of x, and "nan", which stands for a missing or empty text too
    assert calls.value == 7
    assert sorted(r["row_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        n = len(r["TEXT"] or "nan")
        assert r["TEXT"] == texts[r["row_id"]] and r["_rows"] == r["row_id"] % 2
        assert r["emb"] == pytest.approx([n / (n * n + 1) ** 0.5, 1 / (n * n + 1) ** 0.5], abs=1e-6)
    none = encode_once(df.limit(0), lambda d: model_encode(d, make_predict_fn))
    assert none.columns == [*df.columns, "emb"] and none.count() == 0


def test_dropout_of_empty_short_and_missing_vectors(spark):
    rows = spark.createDataFrame(
        [(1, []), (2, None), (3, [1.0] * 3), (4, [1.0] * 17)], "row_id long, emb array<float>"
    )
    view = dropout_view(F.col("emb"), F.col("row_id"), 1, 0, 0.5).alias("view")
    found = {r["row_id"]: r["view"] for r in rows.select("row_id", view).collect()}
    assert found[1] == [] and found[2] is None
    assert len(found[3]) == 3 and len(found[4]) == 17
    assert set(found[4]) == {0.0, 2.0}
    with pytest.raises(ValueError):
        dropout_view(F.col("emb"), F.col("row_id"), 1, 0, 1.0)
