"""Scoring and mixing: plain recomputation, held-out accuracy, targets that are met."""

import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from labelspring.llm import mixing, scoring
from labelspring.llm.scoring import EDGE, SIZE, TOP


@pytest.fixture(scope="module")
def sentences(spark):
    """Texts in which each word is followed by its own successor, and shuffled ones."""
    rng = random.Random(3)
    rows = []
    for k in range(120):
        at = rng.randrange(60)
        words = [f"m{(at + j) % 60}" for j in range(40)]
        if k >= 100:
            rng.shuffle(words)
        rows.append((k, " ".join(words)))
    rows += [(200, None), (201, ""), (None, rows[0][1]), (0, rows[0][1]), (202, "Rare " * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))


def test_scores_equal_a_plain_sum(sentences):
    rows = scoring.pseudo_likelihood(sentences).collect()
    top = scoring.vocabulary(sentences)
    network = scoring.trained(scoring.window_counts(sentences, top))
    table = scoring.log_table(network)
    assert np.allclose(np.exp(table).sum(axis=1), 1, atol=1e-4)
    counts = np.zeros_like(table)
    texts = {r["doc_id"]: r["text"] for r in sentences.collect()}
    expected = {}
    for i, text in texts.items():
        words = brute.words(text, lower=True)
        hashed = _hashes(words)
        tokens = [int(t) for t in scoring.entries(hashed, top)] if words else []
        around = [EDGE, *tokens, EDGE]
        total = 0.0
        for k, token in enumerate(tokens):
            window = around[k] * (SIZE + 1) + around[k + 2]
            total += float(table[window, token])
        expected[i] = (len(tokens), total)
    for r in rows:
        n, total = expected[r["doc_id"]]
        assert r["n_tokens"] == n
        assert math.isclose(r["log_likelihood"], total, abs_tol=1e-2)
        assert (r["per_token"] is None) == (n == 0)
    assert len(rows) == sentences.count()
    by_id = {r["doc_id"]: r["per_token"] for r in rows if r["doc_id"] is not None}
    ordered = np.mean([by_id[k] for k in range(100)])
    shuffled = np.mean([by_id[k] for k in range(100, 120)])
    assert ordered > shuffled + 0.5
    assert counts.shape[1] == SIZE


def _hashes(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    start, end, _ = scoring.word_spans(data, offsets)
    return scoring.word_hashes(data, start, end)


def test_window_counts_cover_the_whole_corpus(sentences):
    top = scoring.vocabulary(sentences)
    assert len(top) <= TOP
    total = scoring.window_counts(sentences, top).agg(F.sum("n")).first()[0]
    assert total == sum(len(brute.words(r["text"])) for r in sentences.collect())
    again = scoring.window_counts(sentences.repartition(7), top)
    assert scoring.window_counts(sentences, top).exceptAll(again).count() == 0


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(1)
    counts = np.zeros(((SIZE + 1) ** 2, SIZE), np.float32)
    counts[rng.integers(0, len(counts), 300), rng.integers(0, SIZE, 300)] = 5
    seen = counts.sum(axis=1) > 0
    means = []
    for epochs in (0, 60):
        table = scoring.log_table(scoring.train(counts, epochs))
        means.append((counts[seen] * table[seen]).sum() / counts.sum())
    assert means[1] > means[0] + 0.5


def test_scores_of_nothing(no_documents):
    assert scoring.pseudo_likelihood(no_documents).collect() == []


@pytest.fixture(scope="module")
def domains(spark):
    """Three domains with words of their own; two thirds are labelled."""
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(450):
        domain = ("good", "plain", "toxic")[0 if k % 5 < 3 else k % 5 - 2]
        own = [f"{domain}{rng.randrange(30)}" for _ in range(rng.randrange(10, 60))]
        both = [f"all{rng.randrange(50)}" for _ in range(len(own))]
        rows.append((k, " ".join(own + both), domain, "old"))
        if k % 3:
            labels.append((k, domain))
    rows += [(900, None, "good", "old"), (901, "", "good", "old"), (None, "good1 good2", "good", "old")]
    labels += [(None, "good"), (7, None), (8, "unknown"), (12345, "good")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, truth string, rate string")
    return documents, spark.createDataFrame(labels, "doc_id long, domain string")


def test_posteriors_on_held_out_documents(domains):
    documents, labelled = domains
    model = mixing.fit_domains(documents, labelled, ["good", "plain", "toxic"])
    rows = mixing.with_posteriors(documents, model).where("doc_id % 3 = 0 and doc_id < 900").collect()
    right = [model.domains[int(np.argmax(r["posterior"]))] == r["truth"] for r in rows]
    assert np.mean(right) > 0.95
    assert all(math.isclose(sum(r["posterior"]), 1, abs_tol=1e-9) for r in rows)


@pytest.mark.parametrize("weights", [
    {"good": 0.5, "plain": 0.3, "toxic": 0.2},
    {"good": 0.8, "plain": 0.15, "toxic": 0.05},
])
def test_rates_meet_the_targets(domains, weights):
    documents, labelled = domains
    mixed = mixing.mixed(documents, labelled, weights)
    assert mixed.columns == ["doc_id", "text", "truth", "n_tokens", "posterior", "rate"]
    rows = mixed.collect()
    assert len(rows) == documents.count()
    n = np.array([r["n_tokens"] for r in rows], float)
    p = np.array([r["posterior"] for r in rows])
    rate = np.array([r["rate"] for r in rows])
    assert (rate >= 0).all()
    assert [r["n_tokens"] for r in rows] == [len(brute.words(r["text"])) for r in rows]
    target = np.array(list(weights.values())) * n.sum()
    assert np.allclose((rate * n) @ p, target, rtol=1e-2, atol=0)


@pytest.mark.parametrize("shares", [(0.97, 0.03, 0.0), (0.4, 0.3, 0.3)])
def test_rates_equal_plain_projected_gradient(spark, shares):
    """Also where no rates meet the targets."""
    rng = np.random.default_rng(8)
    p = rng.dirichlet([2, 2, 2], 60)
    n = rng.integers(1, 50, 60).astype(float)
    target = np.array(shares) * n.sum()
    members = spark.createDataFrame(
        [(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)],
        "n_tokens long, posterior array<double>",
    )
    weight = mixing.weighed(target, 0.02)
    push, total = mixing.solve_rates(members, target, weight, np.zeros(3))
    r, step = np.ones(60), 1 / (np.linalg.norm(p * np.sqrt(n)[:, None] / np.sqrt(weight), 2) ** 2 + 1)
    for _ in range(100_000):  # in the metric of the tokens
        r = np.maximum(0, r - step * (p @ (((r * n) @ p - target) / weight) + r - 1))
    assert np.allclose(mixing.rates(p, push), r, atol=1e-4)
    assert np.allclose((r * n) @ p, total, rtol=1e-3)


def test_targets_out_of_reach_are_told(spark):
    """Every document is half of each domain, so that no rates part them."""
    members = spark.createDataFrame([(10, [0.5, 0.5])] * 4, "n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="no rates meet"):
        push, total, miss = mixing.fit_rates(members, np.array([30.0, 10.0]))
    assert miss > 0.5 and np.allclose(total[0], total[1])
    assert np.isfinite(mixing.rates(np.array([[0.5, 0.5]]), push)).all()


def test_rates_meet_the_targets_of_the_given_documents(spark, folder):
    """Each domain within one in a hundred of its target, the small one too."""
    rows = driver.queries()["op9_mixing"](spark, folder).collect()
    n = np.array([r["n_tokens"] * r["rate"] for r in rows])
    total = sum(r["n_tokens"] for r in rows)
    for name, share in corpus_pipeline.TARGETS.items():
        assert n @ np.array([r[f"p_{name}"] for r in rows]) == pytest.approx(share * total, rel=0.01)


def test_mixing_of_nothing_and_without_labels(domains, no_documents):
    documents, labelled = domains
    weights = {"good": 0.5, "plain": 0.5}
    assert mixing.mixed(no_documents, labelled, weights).collect() == []
    rows = mixing.mixed(documents, labelled.limit(0), weights).collect()
    assert {tuple(r["posterior"]) for r in rows} == {(0.5, 0.5)}
    assert all(math.isclose(r["rate"], 1) for r in rows)
