"""Phrases, ranked search and token counts against plain versions."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from labelspring.llm import phrases, search
from labelspring.llm.phrases import collocations, compact_paths, covering_counts, maximal_phrases, weakest_cuts
from labelspring.llm.search import ranked_search, signature_index
from labelspring.llm.shared import Workspace
from labelspring.llm.token_counts import token_counts, whole_tokens

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Token counts


def test_token_counts_equal_the_library(corpus, corpus_rows):
    tokenizer = Tokenizer.from_file(str(WORD_BPE))
    rows = {r["doc_id"]: r for r in token_counts(corpus, str(WORD_BPE)).collect()}
    assert set(rows) == {i for i, _, _ in corpus_rows}
    for i, text, _ in corpus_rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert rows[i]["n_tokens"] == n
        assert rows[i]["n_bytes"] == len((text or "").encode())
        assert rows[i]["over_limit"] == (n > 2048)
        assert 0 <= rows[i]["n_whole"] <= n


def test_token_counts_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr("labelspring.llm.token_counts.PART", 7)
    texts = [
        "It's <|endoftext|> here", "x<|startoftext|>y", "e\u0301 \u212b \u1e9b\u0323 STRASSE \u0130",
        "a\u00a0b\u2003c\u3000d", "don't we'll they've", "1234567", "\x1c\x1f\x85 a", "\u6771\u4eac tower",
        "a" * 300, " \n\t ", "", None, "...!!!", "\U0001f600\U0001f600", "\ufb01 \u03a3\u03c3\u03c2", "no\u0338 <\u0338",
    ]
    tokenizer = Tokenizer.from_file(str(WORD_BPE))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "null id"), (3, texts[3])], "doc_id long, text string")
    rows = token_counts(docs, str(WORD_BPE), limit=3).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = (texts[r["doc_id"]] if r["doc_id"] is not None else "null id") or ""
        assert r["n_tokens"] == len(tokenizer.encode(text, add_special_tokens=False).ids), text
        assert r["over_limit"] == (r["n_tokens"] > 3)


def test_whole_tokens_encode_alone_as_one():
    tokenizer = Tokenizer.from_file(str(WORD_BPE))
    whole = whole_tokens(open(WORD_BPE, encoding="utf-8").read())
    plain = [p for p in whole if p.isascii() and p.isalpha() and p.islower()]
    assert len(plain) > 20_000
    assert all(len(e.ids) == 1 for e in tokenizer.encode_batch(plain, add_special_tokens=False))
    # Some strings of the vocabulary are never reached by the merges.
    assert len(whole) < sum(t.endswith("</w>") for t in tokenizer.get_vocab()) + 1


def test_token_counts_of_nothing(no_documents):
    assert token_counts(no_documents, str(WORD_BPE)).count() == 0
    with pytest.raises(ValueError):
        token_counts(no_documents, str(public_tokenizers.path("byte_bpe_50k.json")))


# Ranked search


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain_search(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in wanted.items():
        scores = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in asked if t in c
            )
            if score > 0:
                scores.append((-score, math.inf if i is None else i))
        for rank, (score, i) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if i == math.inf else i, -score))
    return sorted(out, key=repr)


def found(rows):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("pairs, few", [(1 << 19, 200_000), (60, 0)])
def test_search_equals_brute_force(spark, corpus, corpus_rows, monkeypatch, pairs, few):
    """In one block and in several, with few candidates and with candidates joined by shuffle."""
    monkeypatch.setattr(search, "PAIRS_AT_ONCE", pairs)
    monkeypatch.setattr(search, "BROADCAST_DOCUMENTS", few)
    rng = random.Random(3)
    docs = [(i, t) for i, t, _ in corpus_rows]
    items = [(k, " ".join((t or "").split()[5:40])) for k, t in enumerate(t for _, t in docs[:12])]
    items += [(90, "AGAIN and"), (91, None), (92, ""), (93, "zzz never"), (None, "w1 w2"), (None, "w3"), (94, "w5 w5 W5")]
    items += [(95, " ".join(f"w{rng.randrange(300)}" for _ in range(400)))]
    asked = spark.createDataFrame([(i, t, "k", 1) for i, t in items], "item_id long, text string, _doc string, rank int")
    assert found(ranked_search(corpus, asked)) == plain_search(docs, items)


def test_search_of_repeated_and_null_documents(spark):
    docs = [(4, "red fish"), (4, "red fish red"), (None, "red fish"), (2, "red fish"), (9, None), (8, "!!"), (7, "blue")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, "Red"), (2, "fish red")], "item_id int, text string")
    for k in (2, 10):
        expected = plain_search(docs, [(1, "Red"), (2, "fish red")], k)
        assert found(ranked_search(table, items, k)) == expected


def test_search_of_nothing(spark, corpus, no_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked_search(corpus, none).collect() == []
    assert ranked_search(no_documents, some).collect() == []


def test_bounds_lie_above_scores_and_blocks_are_full(spark, corpus, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BITS", 1 << 14)
    index = signature_index(corpus).collect()
    assert sum(r["n_docs"] for r in index) == sum(len(r["ids"]) for r in index)
    assert all(len(r["slices"]) == r["width"] * -(-r["n_docs"] // 8) for r in index)


# Phrases


def plain_counts(docs):
    counts, total = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    key = (lang, " ".join(words[i : i + n]))
                    counts[key] = counts.get(key, 0) + 1
    return counts, total


def plain_collocations(docs, most=2000, least=10):
    counts, total = plain_counts(docs)
    kept = {}
    for (lang, gram), a in counts.items():
        words = gram.split(" ")
        if len(words) < 2 or a < least:
            continue
        ways = []
        for k in range(1, len(words)):
            left, right = counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]
            ways.append((1_000_000 * a * a // (left * right), k, left, right))
        kept[lang, gram] = (a, min(ways))
    covered = set()
    for (lang, gram), (a, _) in kept.items():
        words = gram.split(" ")
        if len(words) == 3:
            for part in (" ".join(words[:2]), " ".join(words[1:])):
                if 100 * a >= 50 * kept[lang, part][0]:
                    covered.add((lang, part))
    out = []
    for lang in {one for one, _ in kept}:
        rows = [(-s, -a, g.encode(), g, a, left, right) for (one, g), (a, (s, _, left, right)) in kept.items()
                if one == lang and (one, g) not in covered]
        for rank, (s, _, _, g, a, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, g, a, left, right, total[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    docs = []
    for k in range(60):
        words = [f"W{min(rng.randrange(40), rng.randrange(40))}" for _ in range(80)]
        marks = [rng.choice(["", "", "", "", ",", ".", "\n", "\t", "!"]) for _ in words]
        docs.append((" ".join(w + m for w, m in zip(words, marks, strict=True)), ["en", "fr", None][k % 3]))
    passage = " ".join(f"p{i}" for i in range(50))
    docs += [(f"w1 {passage}. {passage}", "en") for _ in range(9)]
    docs += [("round a round b " * 30, "fr"), ("same " * 60, "fr"), (None, "en"), ("", None), ("only", ""), ("\u00c9t\u00e9 \u00c9t\u00e9;" * 20, "fr")]
    return docs


@pytest.mark.parametrize("at_once", [2 << 20, 50])
def test_collocations_equal_brute_force(spark, monkeypatch, at_once):
    """Whole, and with graphs that are flushed and nodes that are dealt out all the time."""
    docs = phrase_rows()
    if at_once == 50:
        monkeypatch.setattr(phrases, "WORDS_AT_ONCE", at_once)
        monkeypatch.setattr(phrases, "PART", 37)
        monkeypatch.setattr(phrases, "LEAST_HOT", 1)
        space = Workspace(spark)
        table = spark.createDataFrame(docs, "text string, lang string")
        assert len(phrases.hot_nodes(table, space)[0]) > 3
        monkeypatch.setattr(phrases, "RANKED_AT_ONCE", 30)
    most = 2000 if at_once > 50 else 12
    table = spark.createDataFrame([(t, lang, "x", 3) for t, lang in docs], "text string, lang string, gram string, n int")
    rows = collocations(table.repartition(5), most).collect()
    expected = plain_collocations(docs, most)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows) == expected
    assert len(expected) > 15


def test_collocations_of_nothing(no_documents, spark):
    assert collocations(no_documents).collect() == []


def test_scores_beyond_64_bits(spark):
    a, left, right = 10**14 + 7, 3 * 10**14 + 11, 10**14 + 13
    cuts = [("en", "x y z", a, 1, left, right), ("en", "x y z", a, 2, right, left), ("en", "u v", 5, 1, 5, 5)]
    rows = weakest_cuts(spark.createDataFrame(cuts, "lang string, gram string, n long, k int, l long, r long"))
    found = {r["phrase"]: (r["a"], r["l"], r["r"], r["score"]) for r in rows.collect()}
    assert found == {"x y z": (a, left, right, 10**6 * a * a // (left * right)), "u v": (5, 5, 5, 10**6)}


def test_unary_paths(spark):
    """A fork, a long path and a ring that nothing leads into."""
    line = [f"l{i}" for i in range(40)]
    edges = [(" ".join(line[i : i + 3]), 20 + i) for i in range(38)]
    edges += [("l20 l21 x", 3), ("r0 r1 r2", 7), ("r1 r2 r0", 6), ("r2 r0 r1", 5), ("s s s", 4)]
    table = spark.createDataFrame([("en", g, n) for g, n in edges], "lang string, gram string, n long")
    paths = compact_paths(table, Workspace(spark))
    rows = {r["gram"]: (r["path"], r["place"]) for r in paths.collect()}
    assert len(rows) == len(edges)
    # The node (l20 l21) has two ways out: one path ends there, two begin.
    assert rows["l19 l20 l21"] == ("l0 l1 l2", 19)
    assert rows["l20 l21 l22"] == ("l20 l21 l22", 0) and rows["l20 l21 x"] == ("l20 l21 x", 0)
    assert rows["l37 l38 l39"] == ("l20 l21 l22", 17)
    assert [rows[g] for g in ("r0 r1 r2", "r1 r2 r0", "r2 r0 r1")] == [("r0 r1 r2", i) for i in range(3)]
    assert rows["s s s"] == ("s s s", 0)
    texts = {r["phrase"]: (r["n_edges"], r["least"], r["most"]) for r in maximal_phrases(paths).collect()}
    assert texts[" ".join(line[:22])] == (20, 20, 39)
    longer = {r["gram"]: r["longer"] for r in covering_counts(paths).collect()}
    plain = {}
    for g, n in edges:
        words = g.split(" ")
        for node in (" ".join(words[:2]), " ".join(words[1:])):
            plain[node] = max(plain.get(node, 0), n)
    assert longer == plain
