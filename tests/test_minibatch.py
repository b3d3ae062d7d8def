"""Steps by batches against numpy."""

import numpy as np
import pytest

from labelspring.operators.minibatch import fit_pair_steps, ordered_pairs, rate_share
from labelspring.operators.projection import Projection, batch_pair_gradient
from labelspring.operators.sampling import attach_pair_values, make_pairs

WIDTH = 5
SCHEMA = "row_id long, LABEL int, emb array<double>"


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    data = [(i, i % 2, (draw.normal(size=WIDTH) + (i % 2)).tolist()) for i in range(90)]
    return spark.createDataFrame([*data, (90, 0, [0.0] * WIDTH)], SCHEMA).cache()


def by_numpy(rows, n, epochs, size, rate, warmup, local_steps):
    pairs = attach_pair_values(make_pairs(rows, n), rows, "emb").cache()
    w, log = np.eye(WIDTH), []
    batches = -(-n // size)
    each = min(local_steps, batches)
    for epoch in range(epochs):
        order = ordered_pairs(pairs, epoch + 1).orderBy("place").collect()
        ends, losses = [], 0.0
        for low in range(0, n, size * local_steps):
            own, at = order[low : low + size * local_steps], w
            for t, k in enumerate(range(0, len(own), size)):
                some = own[k : k + size]
                a, b = (np.array([r[c] for r in some]) for c in ("emb_a", "emb_b"))
                loss, grad = batch_pair_gradient(a, b, np.array([r["label"] for r in some]), at)
                grad /= len(some)
                share = rate_share(epoch * each + t, epochs * each, warmup)
                at = at - rate * share * min(1.0, 1.0 / np.linalg.norm(grad)) * grad
                losses += loss
            ends.append((at, -(-len(own) // size)))
        w = sum(m * k for m, k in ends) / sum(k for _, k in ends)
        log.append(losses / n)
    return w, log


@pytest.mark.parametrize("local_steps", [100, 7])
def test_steps_equal_numpy_with_one_worker_and_with_many(rows, local_steps):
    fitted = fit_pair_steps(
        rows, Projection.identity(WIDTH), 203, 2, 8, 0.2, warmup=5, local_steps=local_steps
    )
    w, log = by_numpy(rows, 203, 2, 8, 0.2, 5, local_steps)
    assert np.allclose(fitted.weights, w, atol=1e-9)
    assert [e[0] for e in fitted.epochs] == ["steps", "steps"]
    assert [e[2] for e in fitted.epochs] == pytest.approx(log)
    assert [e[4] for e in fitted.epochs] == [203, 203]
    assert log[1] < log[0]


def test_schedule():
    assert [rate_share(t, 6, 2) for t in range(7)] == [0, 0.5, 1, 0.75, 0.5, 0.25, 0]
    assert rate_share(0, 4, 0) == 1


def test_no_rows_is_an_error(rows):
    with pytest.raises(ValueError):
        fit_pair_steps(rows.limit(0), Projection.identity(WIDTH))
