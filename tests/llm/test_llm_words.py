"""Words outside of the network's own entries have probabilities of their own."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelspring.llm import scoring


@pytest.fixture(scope="module")
def rare_words(spark):
    """More words than entries; the last two texts differ in one word of one bucket."""
    rng = random.Random(5)
    rows = [(k, " ".join(f"f{rng.randrange(300)}" for _ in range(60))) for k in range(200)]
    hashes = {}
    for k in range(300, 4000):
        hashes.setdefault(int(_hash(f"f{k}")) % scoring.SHARED, []).append(f"f{k}")
    often, once = hashes[7][:2]
    rows += [(500 + k, f"{often} {often}") for k in range(30)]
    rows += [(900, f"f1 {often} f2"), (901, f"f1 {once} f2")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _hash(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return scoring.word_hashes(data, np.array([0]), np.array([len(data)]))[0]


def test_words_of_one_bucket_score_apart(rare_words):
    found = {r["doc_id"]: r["log_likelihood"] for r in scoring.pseudo_likelihood(rare_words).collect()}
    assert found[900] > found[901] + 2


def test_shares_of_a_bucket_add_up(rare_words):
    counts = scoring.word_counts(rare_words)
    top = scoring.vocabulary(rare_words)
    shares = scoring.word_shares(counts, top)
    n = {r["word"] % 2**64: r["n"] for r in counts.collect()}
    bucket = lambda w: w % scoring.SHARED
    for b in range(scoring.SHARED):
        kept = [w for w in shares.kept.tolist() if bucket(w) == b and w not in top]
        assert all(n[w] >= scoring.KEPT for w in kept)
        rare = any(bucket(w) == b and c < scoring.KEPT and w not in top for w, c in n.items())
        total = sum(math.exp(shares.share[np.searchsorted(shares.kept, np.uint64(w))]) for w in kept)
        total += math.exp(shares.rare[b]) if rare else 0
        assert not kept or math.isclose(total, 1, abs_tol=1e-5)


def test_spelling_equals_a_plain_sum(spark):
    text = "aa ab é b " * 2 + "xyz"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "ba")], "doc_id long, text string")
    nothing = np.zeros(0)
    shares = scoring.Shares(nothing.astype(np.uint64), nothing, np.zeros(scoring.SHARED))
    steps = scoring.spelling_steps(docs.repartition(2), shares)
    assert np.allclose(np.exp(steps).sum(axis=1), 1, atol=1e-3)
    seen = np.full((257, 257), 0.5)
    words = [w.encode() for w in (text + " ba").split()]
    for w in words:
        for a, b in zip([256, *w], [*w, 256], strict=True):
            seen[a, b] += 1
    plain = np.log(seen / seen.sum(axis=1, keepdims=True))
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = scoring.word_spans(data, np.array([0, len(data)]))
    for s, e, got in zip(start, end, scoring.spelling_logs(steps, data, start, end), strict=True):
        w = list(data[s:e])
        want = sum(plain[a, b] for a, b in zip([256, *w], [*w, 256], strict=True))
        assert math.isclose(got, want, abs_tol=1e-4)


def test_what_is_gathered_grows_with_the_corpus(spark, rare_words):
    more = spark.range(50).select(
        (F.col("id") + 2000).alias("doc_id"), F.repeat(F.concat(F.lit("new"), "id", F.lit(" ")), 9).alias("text")
    )
    kept = [
        len(scoring.word_shares(scoring.word_counts(d), scoring.vocabulary(d)).kept)
        for d in (rare_words, rare_words.union(more))
    ]
    assert kept[1] >= kept[0] + 50 - scoring.TOP // 2 and kept[1] > scoring.SIZE
