"""List entries with deep paths, paths in capitals and paths on domains above a host."""

from datetime import datetime

import pytest

from labelspring.llm.urls import url_verdicts


@pytest.mark.parametrize(
    ("pattern", "url", "met"),
    [
        ("Example.COM/Ads", "https://example.com/Ads/x?y", "example.com/Ads"),
        ("example.com/Ads", "https://example.com/ads", None),
        ("example.com/ads", "https://EXAMPLE.com/ads#z", "example.com/ads"),
        ("example.com/ads", "https://www.example.com/ads/1", "example.com/ads"),
        ("www.example.com/ads", "https://example.com/ads", None),
        ("example.com/a/b", "http://x.www.example.com:80/a/b/c.html", "example.com/a/b"),
        ("example.com/a/b", "http://example.com/a/b", "example.com/a/b"),
        ("example.com/a/b", "http://example.com/a/bc", None),
        ("example.com/a/b", "http://example.com/a", None),
        ("example.com/a/b/", "http://example.com/a/b/c", "example.com/a/b/"),
        ("example.com/a/b", "http://example.com/a/b/", "example.com/a/b"),
        ("example.com/a", "http://example.com/?q=/a", None),
    ],
)
def test_path_entries(spark, pattern, url, met):
    day = datetime(2024, 5, 1)
    captures = spark.createDataFrame([(1, url, day)], "page_id long, url string, fetched timestamp")
    entries = spark.createDataFrame([(pattern, "add", day)], "pattern string, action string, dated timestamp")
    row = url_verdicts(captures, entries).first()
    assert (row["pattern"], row["n_active"], row["kept"]) == (met, int(met is not None), met is None)
