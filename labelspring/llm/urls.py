"""URL filters: dated list entries, and an as-of join of captures with them.

DataFrame functions only. An entry names a host (with all hosts below it), or a
host and a path of whole segments (with all paths below it); the case counts in a
path only. It adds this to the list or removes it from a date on. Entries
without pattern, action or date are passed over; of entries with equal pattern
and time the removal wins. A capture without URL or time meets no entry and
passes. Rows are judged one by one, so repeated captures get the same verdict;
repeated entries count once. Other columns are not looked at. Empty tables give
no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspring.llm.shared import spread_join
from labelspring.sources.scratch import new_path, write_table

#: Days in a slice of time. Intervals are cut into slices, so that an as-of join is an equal join.
SLICE_DAYS = 64


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def url_path(url: Column) -> Column:
    """The first segment of the path, with its slash."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]*)", 1)


def url_paths(url: Column) -> Column:
    """The whole path and all that it lies under, segment by segment, with and without a last slash."""
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    segments = F.split(F.substr(path, F.lit(2)), "/")
    n = F.size(segments)
    under = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.concat(
            F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"), F.when(i < n, "/").otherwise("")
        ),
    )
    both = F.concat(under, F.transform(under, lambda p: F.rtrim(p, F.lit("/"))))
    return F.when(F.length(path) > 1, F.filter(F.array_distinct(both), lambda p: F.length(p) > 1)).otherwise(
        F.array().cast("array<string>")
    )


def url_patterns(url: Column) -> Column:
    """All patterns that would match: the host, the domains above it, each of them with the paths."""
    host = url_host(url)
    labels = F.split(host, "\\.")
    n = F.size(labels)
    above = F.transform(
        F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array(F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, n), "."),
    )
    paths = F.flatten(F.transform(above, lambda d: F.transform(url_paths(url), lambda p: F.concat(d, p))))
    return F.when(F.length(host) > 0, F.array_distinct(F.concat(above, paths)))


def list_intervals(entries: DataFrame) -> DataFrame:
    """``pattern, valid_from, valid_to`` from ``pattern, action, dated``; open at the end: NULL.

    An ``add`` holds until the next entry of its pattern; adding what is on the
    list starts a new interval at once, removing what is not changes nothing.
    """
    host = F.substring_index("pattern", "/", 1)
    pattern = F.concat(F.lower(host), F.substr("pattern", F.length(host) + 1))
    known = entries.where(
        "pattern is not null and dated is not null and action in ('add', 'remove')"
    ).select(pattern.alias("pattern"), "action", "dated")
    changes = known.groupBy("pattern", "dated").agg(F.max("action").alias("action"))
    later = F.lead("dated").over(Window.partitionBy("pattern").orderBy("dated"))
    return (
        changes.withColumn("valid_to", later)
        .where("action = 'add'")
        .select("pattern", F.col("dated").alias("valid_from"), "valid_to")
    )


def _slice(time: Column) -> Column:
    return F.floor(F.unix_seconds(time) / (86400 * SLICE_DAYS)).cast("int")


def active_entries(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, url, fetched, pattern, valid_from`` of all entries active when a page was fetched.

    ``captures`` has ``page_id, url, fetched``. Each capture asks for a handful
    of patterns in the slice of its time; each interval stands in the slices it
    touches, up to the last slice of the captures. A host with any share of the
    captures is dealt out.
    """
    spark = captures.sparkSession
    asked = write_table(
        captures.where("url is not null and fetched is not null").select(
            "page_id",
            "url",
            "fetched",
            F.explode(url_patterns(F.col("url"))).alias("pattern"),
            _slice(F.col("fetched")).alias("slice"),
        ),
        new_path(spark, "asked"),
    )
    last = asked.agg(F.max("slice"), F.min("slice")).first()
    intervals = list_intervals(entries)
    if last[0] is None:
        intervals, last = intervals.limit(0), (0, 0)
    start = F.greatest(_slice(F.col("valid_from")), F.lit(last[1]))
    end = F.least(F.coalesce(_slice(F.col("valid_to")), F.lit(last[0])), F.lit(last[0]))
    sliced = intervals.where(start <= end).withColumn("slice", F.explode(F.sequence(start, end)))
    met = spread_join(asked, sliced, ["pattern", "slice"], "page_id")
    return met.where(
        "valid_from <= fetched and (valid_to is null or fetched < valid_to)"
    ).select("page_id", "url", "fetched", "pattern", "valid_from")


def url_verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, url, fetched, n_active, pattern, valid_from, kept`` of every capture.

    ``pattern`` is the longest active one, the smallest of equally long ones.
    """
    spark = captures.sparkSession
    rows = captures.select("page_id", "url", "fetched")
    found = write_table(active_entries(rows, entries).distinct(), new_path(spark, "active"))
    best = F.struct(-F.length("pattern"), "pattern", "valid_from")
    verdicts = found.groupBy("page_id", "url", "fetched").agg(
        F.count(F.lit(1)).alias("n_active"), F.min(best).alias("best")
    )
    same = (
        rows["page_id"].eqNullSafe(verdicts["page_id"])
        & (rows["url"] == verdicts["url"])
        & (rows["fetched"] == verdicts["fetched"])
    )
    return rows.join(verdicts, same, "left").select(
        *[rows[c] for c in rows.columns],
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.col("best.pattern").alias("pattern"),
        F.col("best.valid_from").alias("valid_from"),
        F.col("n_active").isNull().alias("kept"),
    )
