"""Near-duplicates, components, lines and repeated strings against plain versions."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from labelspring.llm.components import connected_components
from labelspring.llm.lines import without_boilerplate
from labelspring.llm.minhash import near_duplicates, without_near_duplicates
from labelspring.llm.suffixes import repeat_report, sliding_least, without_repeats


def test_components_of_paths_stars_loops_and_nulls(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 130)]
    links += [(5, 5), (7, None), (None, 9), (200, 150), (150, 200), (129, 120)]
    edges = spark.createDataFrame(links, "u long, v long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    expected = {i: 0 for i in range(21)} | {i: 100 for i in range(100, 130)} | {150: 150, 200: 150}
    assert found == expected
    assert connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_all_pairs(corpus, corpus_rows, n):
    expected = brute.components([(i, t) for i, t, _ in corpus_rows], n, 80)
    rows = near_duplicates(corpus, words=n, percent=80).collect()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert found == expected
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in rows)
    assert len({c for _, c in found.values()}) < len(found) - 15


@pytest.mark.parametrize("block", [3, 256])
def test_near_duplicates_of_a_chain_in_one_bucket(spark, monkeypatch, block):
    """Neighbours are alike, ends are not: one component all the same."""
    monkeypatch.setattr("labelspring.llm.minhash.BLOCK", block)
    words = [f"t{k}" for k in range(140)]
    texts = [(k, " ".join(words[2 * k : 2 * k + 60])) for k in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    expected = brute.components(texts, 2, 80)
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, 2, 80).collect()}
    assert found == {i: c for i, (_, c) in expected.items()}
    assert set(found.values()) == {0}


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(docs, 2, 80).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"]) == [(1, 1), (1, 1), (2, 1)]
    kept = without_near_duplicates(docs, 2, 80)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "None", "None"]


def test_near_duplicates_of_nothing(no_documents):
    assert near_duplicates(no_documents).collect() == []
    kept = without_near_duplicates(no_documents)
    assert kept.columns == no_documents.columns and kept.count() == 0


def test_boilerplate_equals_plain_version(corpus, corpus_rows):
    expected = brute.without_lines(corpus_rows)
    cleaned = without_boilerplate(corpus)
    assert cleaned.columns == [*corpus.columns, "_n_dropped"]
    rows = cleaned.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == expected
    changed = [r for r in rows if r["_n_dropped"]]
    assert len(changed) >= 12
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)


def test_boilerplate_of_many_hosts_is_joined_by_shuffle(corpus, corpus_rows, monkeypatch):
    monkeypatch.setattr("labelspring.llm.lines.BROADCAST_LINES", 0)
    found = {r["doc_id"]: r["text"] for r in without_boilerplate(corpus).collect()}
    assert found == brute.without_lines(corpus_rows)


def test_boilerplate_of_nothing(no_documents):
    assert without_boilerplate(no_documents).count() == 0


def test_sliding_least():
    values = np.random.default_rng(3).integers(0, 1 << 40, 1000).astype(np.uint64)
    for width in (1, 7, 256, 1000):
        expected = [values[i : i + width].min() for i in range(1000 - width + 1)]
        assert (sliding_least(values, width) == expected).all()


def test_repeats_equal_plain_version(corpus, corpus_rows):
    expected = brute.repeats([t for _, t, _ in corpus_rows], 400)
    rows = repeat_report(corpus).orderBy("doc_id").collect()
    found = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows]
    assert found == expected
    assert sum(n > 0 for _, n, _, _ in expected) > 10


def test_repeats_in_long_texts_and_repeated_rows(spark, monkeypatch):
    """Stretches of a long text are judged together, and an equal row repeats all of a text."""
    monkeypatch.setattr("labelspring.llm.suffixes.PIECE", 700)
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("abcdefgh"), 6000))
    texts = [long + long[1000:2500], long[3000:3900] + "z" * 900, "q" + long[100:480], long[50:460]]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (4, texts[3]), (5, texts[3]), (6, "é" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute.repeats([t for _, t in rows], 400)
    found = repeat_report(docs).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == sorted(expected)
    kept = without_repeats(docs).select(F.length("kept").alias("n")).collect()
    assert sorted(r["n"] for r in kept) == sorted(n - gone for n, gone, _, _ in expected)


def test_repeats_of_nothing(no_documents):
    assert repeat_report(no_documents).collect() == []
