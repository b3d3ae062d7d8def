"""Every stretch that the rule accepts is found, by all stretches and all placings."""

from itertools import combinations, product

import numpy as np
import pytest

from labelspring.llm import decontaminate
from labelspring.llm.decontaminate import contamination


def all_stretches(equal, least):
    """Most equal words of a stretch with at least 80 % of them; 0 if none has enough."""
    best = 0
    for i in range(len(equal)):
        for j in range(i + 1, len(equal) + 1):
            same = sum(equal[i:j])
            if same >= least and 5 * same >= 4 * (j - i):
                best = max(best, same)
    return best


def test_accepted_overlap_equals_all_stretches():
    rng = np.random.default_rng(6)
    for k in range(400):
        equal = rng.random(int(rng.integers(1, 45))) < (0.6, 0.75, 0.8, 0.9)[k % 4]
        least = int(rng.integers(1, 14))
        found = decontaminate.accepted_overlap(equal, least)
        assert (found[2] if found else 0) == all_stretches(equal.tolist(), least)
        if found:
            start, length, same = found
            assert equal[start : start + length].sum() == same
            assert 5 * same >= 4 * length and equal[start] and equal[start + length - 1]


def _documents(spark, equal):
    item = [f"i{k}" for k in range(len(equal))]
    text = [w if e else f"x{k}" for k, (w, e) in enumerate(zip(item, equal, strict=True))]
    return (
        spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string"),
        spark.createDataFrame([(5, " ".join(item))], "item_id long, text string"),
    )


@pytest.mark.parametrize(
    "equal",
    [([True] * 12 + [False] * 5) * 4, [True] * 14 + [True, True, True, False] * 20],
    ids=["four runs", "weaker tail"],
)
def test_weaker_overlap_beside_an_accepted_stretch(spark, equal):
    row = contamination(*_documents(spark, equal)).first()
    assert row["contaminated"] and row["item_id"] == 5
    assert 12 <= row["n_equal"] <= all_stretches(equal, 12)


def _has_seed(equal):
    n, bits = len(equal), int("".join("1" if e else "0" for e in equal), 2)
    return any(
        (bits >> k) & int(m, 2) == int(m, 2) for m in decontaminate.MASKS for k in range(n - len(m) + 1)
    )


def test_every_accepted_alignment_of_a_short_item_has_a_seed():
    for n in range(8, 22):
        least = decontaminate.least_equal(n)
        for changed in range(n // 5 + 1):
            for at in combinations(range(n), changed):
                equal = [k not in at for k in range(n)]
                assert sum(equal) < least or _has_seed(equal)


def test_every_accepted_stretch_of_any_length_has_a_seed():
    """Without a run of 5, runs are 4 less some words: 4 in all, as there are 4 to a changed word.

    Of more than 9 runs two that follow each other are whole, which the last line tests.
    """
    for n in range(3, 10):
        for less in product(range(5), repeat=n):
            if sum(less) <= 4 and 4 * n - sum(less) >= decontaminate.MIN_WORDS:
                runs = [[True] * (4 - x) for x in less]
                assert _has_seed([e for run in runs for e in [*run, False]][:-1])
    assert _has_seed([True] * 4 + [False] + [True] * 4) and _has_seed([True] * 5)


def test_short_items(spark):
    items = ["one", "what is", "a b c", "p q r s", "t1 t2 t3 t4 t5 t6 t7", " ".join(f"u{k}" for k in range(10))]
    texts = [
        "So, one!", "what, is this", "a b x c", "z p q r s", "t1 t2 t3 t4 t5 t6 t7 end", "t1 t2 t3 x t5 t6 t7",
        "u0 u1 u2 x u4 u5 x u7 u8 u9", "u0 u1 x u3 u4 x u6 u7 x u9", "is what", "p q r",
    ]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {r["doc_id"]: r["item_id"] for r in contamination(documents, benchmark).collect()}
    assert found == {0: 0, 1: 1, 2: None, 3: 3, 4: 4, 5: None, 6: 5, 7: None, 8: None, 9: None}
