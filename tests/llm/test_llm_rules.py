"""Quality rules, licences, URL lists and decontamination against plain versions."""

import random
from datetime import datetime, timedelta

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from labelspring.llm import decontaminate
from labelspring.llm.decontaminate import contamination, overlaps, without_contaminated
from labelspring.llm.licenses import KNOWN_LICENSES, canonical_lines, license_scan
from labelspring.llm.quality import failing_hosts, good_documents, quality_verdicts
from labelspring.llm.urls import list_intervals, url_patterns, url_verdicts


def test_quality_equals_plain_version(corpus, corpus_rows):
    expected = brute.quality(corpus_rows)
    rows = quality_verdicts(corpus).collect()
    assert len(rows) == len(corpus_rows)
    for r in rows:
        counts, base, host = expected[r["doc_id"]]
        assert all(r[c] == counts[c] for c in counts if c != "n_lines")
        assert (r["base_failed"], r["host_failed"]) == (base, host)
        assert r["kept"] == (not base and not host)
    good = good_documents(corpus)
    assert good.columns == corpus.columns
    kept = {i for i, (_, base, host) in expected.items() if not base and not host}
    assert {r["doc_id"] for r in good.collect()} == kept
    assert kept


def test_a_failing_host_takes_its_good_documents_along(spark):
    good = " ".join(f"v{k}" for k in range(60))
    rows = [(k, good if k % 10 == 0 else "bad", "low") for k in range(200)]
    rows += [(1000 + k, "bad" if k % 20 == 0 else good, f"h{k % 5}") for k in range(300)]
    rows += [(2000, "bad", "new"), (2001, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    expected = brute.quality(rows)
    found = {r["doc_id"]: r["host_failed"] for r in quality_verdicts(docs).collect()}
    assert found == {i: host for i, (_, _, host) in expected.items()}
    assert {i for i, gone in found.items() if gone and i < 2000} == set(range(200))
    assert not found[2001]
    assert not {r["doc_id"] for r in good_documents(docs).collect()} & set(range(200))


def test_quality_of_nothing(no_documents):
    assert quality_verdicts(no_documents).collect() == []
    assert good_documents(no_documents).columns == no_documents.columns
    judged = no_documents.select("host", F.lit(True).alias("failed"))
    assert failing_hosts(judged).count() == 0


def test_canonical_forms_of_equivalent_texts(spark):
    texts = [
        "Copyright (c) 2020 Someone\nThis Licence is non-commercial; see https://x.org.",
        " * Copyright 1999-2001, A. N. Other. All rights reserved.\r\nthis LICENSE is noncommercial, see http://x.org!",
        "© us\n(c) them\nAll rights reserved.",
        "The above copyright notice shall stay.",
        None,
        "",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = docs.orderBy("doc_id").select(canonical_lines(F.col("text")).alias("f")).collect()
    forms = [r["f"] for r in rows]
    assert forms[0] == forms[1] == ["this license is noncommercial see http x org"]
    assert forms[2] == forms[4] == forms[5] == []
    assert forms[3] == ["the above copyright notice shall stay"]


def test_license_scan(spark, corpus):
    known = spark.createDataFrame([*KNOWN_LICENSES, (None, "x"), ("none", "")], "license_id string, text string")
    isc = dict(KNOWN_LICENSES)["ISC"]
    rows = [
        (1, f"Copyright (c) 2001 Me\n{isc}"),
        (1, f"Copyright (c) 2001 Me\n{isc}"),
        (2, "words\nreleased under the  MIT Licence\nmore\nLicensed under CC BY-NC 4.0.\nReleased under the MIT license"),
        (3, "Released under the MIT License. And more."),
        (4, None),
        (None, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r["doc_id"]), r["license_id"], r["notice_ids"]) for r in license_scan(docs, known).collect())
    assert found == [
        ("1", "ISC", "ISC"),
        ("1", "ISC", "ISC"),
        ("2", None, "CC-BY-NC-4.0,MIT"),
        ("3", None, ""),
        ("4", None, ""),
        ("None", "MIT", "MIT"),
    ]
    assert license_scan(corpus, known).count() == corpus.count()
    assert license_scan(docs.limit(0), known).count() == 0
    assert {r["notice_ids"] for r in license_scan(docs, known.limit(0)).collect()} == {""}


def plain_patterns(url):
    scheme, _, rest = (url or "").partition("://")
    if not rest:
        return set()
    host = rest
    for c in "/?#:":
        host = host.split(c)[0]
    path = ""
    authority = rest.split("?")[0].split("#")[0]
    if "/" in authority:
        path = "/" + authority.split("/")[1]
    host = host.lower()
    labels = host.split(".")
    out = {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))}
    return out | ({host + path} if len(path) > 1 else set())


def test_url_verdicts_equal_plain_version(spark):
    rng = random.Random(2)
    day0 = datetime(2024, 1, 1)
    hosts = ["a.example.com", "b.example.com", "Example.org", "x.y.z.net", "localhost"]
    urls = [
        f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', ':8080'])}"
        f"{rng.choice(['', '/', '/p', '/p/q', '/q?x=/p', '#/p'])}"
        for _ in range(150)
    ]
    captures = [(i, u, day0 + timedelta(days=rng.randrange(600), seconds=rng.randrange(9))) for i, u in enumerate(urls)]
    captures += [(900, None, day0), (901, urls[0], None), (902, "no url", day0), (None, urls[0], day0)]
    captures += [captures[0], captures[0]]
    patterns = ["example.com", "a.example.com", "EXAMPLE.org", "example.org/p", "y.z.net", "localhost", "never.net"]
    entries = [
        (rng.choice(patterns), rng.choice(["add", "add", "remove"]), day0 + timedelta(days=rng.randrange(600)))
        for _ in range(60)
    ]
    entries += [entries[0], (None, "add", day0), ("localhost", "add", None), ("localhost", "odd", day0)]
    entries += [("y.z.net", "add", entries[5][2]), ("y.z.net", "remove", entries[5][2])]
    found = url_verdicts(
        spark.createDataFrame(captures, "page_id long, url string, fetched timestamp"),
        spark.createDataFrame(entries, "pattern string, action string, dated timestamp"),
    ).collect()
    assert len(found) == len(captures)
    history = {}
    for pattern, action, dated in entries:
        if pattern and dated and action in ("add", "remove"):
            at = history.setdefault(pattern.lower(), {})
            at[dated] = max(action, at.get(dated, ""))
    for r in found:
        active = []
        for p in plain_patterns(r["url"]) if r["fetched"] else ():
            past = [d for d in history.get(p, {}) if d <= r["fetched"]]
            if past and history[p][max(past)] == "add":
                active.append((-len(p), p, max(past)))
        best = min(active, default=(0, None, None))
        assert (r["n_active"], r["pattern"], r["valid_from"]) == (len(active), best[1], best[2])
        assert r["kept"] == (not active)
    assert 20 < sum(not r["kept"] for r in found) < 140


def test_url_lists_of_nothing(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", datetime(2024, 1, 1))], "page_id long, url string, fetched timestamp")
    entries = spark.createDataFrame([], "pattern string, action string, dated timestamp")
    assert [r["kept"] for r in url_verdicts(captures, entries).collect()] == [True]
    assert url_verdicts(captures.limit(0), entries).count() == 0
    assert list_intervals(entries).count() == 0
    assert captures.select(url_patterns(F.lit(None).cast("string"))).first()[0] is None


@pytest.fixture(scope="module")
def leaks(spark):
    """Documents with whole, cut and changed items, and with less than enough of one."""
    rng = random.Random(11)
    make = lambda n: [f"u{rng.randrange(400)}" for _ in range(n)]
    items = [make(rng.randrange(15, 45)) for _ in range(12)] + [make(9), make(5), []]
    items.append(list(items[0]))
    documents = []
    for item in items[:13]:
        documents.append(make(40) + item + make(30))
        changed = [w if k % 6 else "other" for k, w in enumerate(item)]
        documents.append(make(10) + changed)
        documents.append(item[:7] + make(50))
        documents.append(make(100) + item[3:17])
    texts = [" ".join(d).capitalize().replace(" ", ", ", 3) + "!" for d in documents]
    texts += [None, "", texts[0]]
    documents = spark.createDataFrame(
        [(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, seed int"
    )
    benchmark = spark.createDataFrame(
        [(i, " ".join(w)) for i, w in enumerate(items)] + [(None, "x"), (99, None)],
        "item_id long, text string",
    )
    return documents, benchmark


def test_contamination_equals_all_alignments(leaks):
    documents, benchmark = leaks
    items = {r["item_id"]: r["text"] for r in benchmark.collect() if r["item_id"] is not None and r["text"]}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    found = {r["doc_id"]: r for r in contamination(documents, benchmark).collect()}
    expected = {i: {k for k, item in items.items() if brute.holds(t, item)} for i, t in texts.items()}
    expected = {i: {0 if k == 15 else k for k in held} for i, held in expected.items()}
    assert {i for i, r in found.items() if r["contaminated"]} == {i for i, held in expected.items() if held}
    assert all(r["n_items"] == len(expected[i]) for i, r in found.items())
    assert all(r["item_id"] in expected[i] for i, r in found.items() if r["contaminated"])
    kept = without_contaminated(documents, benchmark)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, held in expected.items() if not held}


def test_best_overlap_equals_all_stretches():
    rng = np.random.default_rng(4)
    for _ in range(200):
        equal = rng.random(25) < 0.7
        _, length, same = decontaminate.best_overlap(equal)
        assert (same, length) == brute.best_overlap(equal.tolist())


def test_contamination_of_nothing(no_documents, leaks):
    documents, benchmark = leaks
    assert contamination(no_documents, benchmark).collect() == []
    rows = contamination(documents, benchmark.limit(0)).collect()
    assert len(rows) == documents.count() and not any(r["contaminated"] for r in rows)
    assert overlaps(documents, benchmark.where("item_id = 13")).count() == 0
