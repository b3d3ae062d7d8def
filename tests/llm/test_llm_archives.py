"""Archives: record types, round trip, merge order."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from labelspring.llm.archives import (
    LoserTree,
    archive_index,
    merged_index,
    parse_records,
    read_captures,
    url_key,
    write_archives,
)
from labelspring.sources.scratch import new_path, write_table

SCHEMA = "page_id long, url string, captured string, html string, run int"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(1)
    long = "<p>" + "déjà vu \r\n\r\nWARC/1.1\r\n " * 80 + "</p>"
    rows = []
    for k in range(60):
        html = {0: long, 1: "short", 2: "x" * 999, 3: "y" * 1000}.get(k % 8, f"<i>{rng.random()}</i>" * 90)
        url = f"https://{rng.choice('abc')}.Example.{rng.choice(['com', 'org'])}:80/{rng.randrange(5)}?q={k % 3}#top"
        rows.append((k, url, f"2024-01-{1 + rng.randrange(9):02d}T00:00:00Z", html, 1))
    rows += [(70, None, None, None, 1), (71, "no url", None, "", 1), (None, "http://a.b", None, long, 1)]
    rows += [(56, "http://again.com/", None, long, 1), (56, "http://again.com/", None, long, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_index_of_read_archives(pages):
    rows = pages.collect()
    payloads = [(r["page_id"], (r["html"] or "").encode()) for r in rows]
    newest = {}
    for i, raw in payloads:
        if i is not None and len(raw) >= 1000:
            newest[raw] = max(i, newest.get(raw, i))
    expected = []
    for i, raw in payloads:
        other = newest.get(raw, i)
        kind = "response" if i == other else "revisit"
        expected.append((i, len(raw), hashlib.sha1(raw).hexdigest(), kind, None if i == other else other))
    found = archive_index(pages).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in found), key=repr) == sorted(expected, key=repr)
    assert sum(r["record_type"] == "revisit" for r in found) > 10
    ordered = sorted(found, key=lambda r: (r["part"], r["place"]))
    keys = [(r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in ordered]
    assert keys == sorted(keys)


def test_archives_keep_every_byte(spark, pages):
    path = new_path(spark, "archives")
    write_archives(pages, path)
    files = spark.read.format("binaryFile").load(path).collect()
    import gzip

    records = [r for f in files for r in parse_records(gzip.decompress(f["content"]))]
    assert len(records) == pages.count()
    written = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for fields, _, _, payload in records:
        if fields["WARC-Type"] == "response":
            number = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
            assert payload == written[int(number) if number else None]
        else:
            assert payload == b"" and "WARC-Refers-To" in fields
    captures = read_captures(spark, path)
    assert captures.groupBy("run", "position").count().where("count > 1").count() == 0


def test_damaged_archives_are_refused():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [p for *_, p in parse_records(good * 2)] == [b"abc", b"abc"]
    for bad in (good[1:], good.replace(b": 3", b": 2")):
        with pytest.raises(ValueError):
            list(parse_records(bad))


def test_loser_tree_equals_sorting():
    rng = random.Random(6)
    for k in range(12):
        runs = [sorted((rng.randrange(20),) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(LoserTree([iter(r) for r in runs])) == sorted(sum(runs, []))


def test_runs_of_one_url_are_merged_over_many_ranges(spark):
    n = 400
    captures = spark.range(n).select(
        F.concat(F.lit("run"), F.col("id") % 7).alias("run"),
        F.lit("http://one.com/").alias("url"),
        F.lpad((F.col("id") * 37 % 100).cast("string"), 3, "0").alias("captured"),
        F.col("id").alias("page_id"),
        F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
        F.lit(5).cast("long").alias("payload_bytes"),
        F.lit("d").alias("payload_digest"),
        F.col("id").alias("position"),
        F.lit(9).cast("long").alias("length"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = merged_index(write_table(captures, new_path(spark, "captures"))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = sorted(rows, key=lambda r: (r["part"], r["place"]))
    keys = [(r["captured"], r["page_id"]) for r in ordered]
    assert keys == sorted(keys) and len(keys) == n
    assert len({r["part"] for r in rows}) > 1


def test_url_keys(spark):
    urls = [("https://a.Example.com:80/x?y#z", "com,example,a)/x?y"), ("http://b.org", "org,b)/"), ("odd", "odd")]
    rows = spark.createDataFrame(urls, "url string, k string").select(url_key(F.col("url")).alias("f"), "k")
    assert all(r["f"] == r["k"] for r in rows.collect())


def test_archives_of_nothing(spark):
    assert archive_index(spark.createDataFrame([], SCHEMA)).collect() == []
