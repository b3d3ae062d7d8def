"""Line dedup: drop the lines that many documents of a host have.

A line is what stands between line feeds, white space at its ends aside; blank
lines stay. NULL texts stay NULL and count as documents of their host. A NULL
host is a host of its own. Rows are counted one by one, so a repeated row
counts again; a line twice in one text counts once. With ``copies_once`` equal
texts of a host count as one document, so that a text of which a host has many
copies is not taken for boilerplate line by line. The columns are those
given, other columns are untouched, and ``n_chars``, where present, follows the
text. A text whose lines all go becomes empty. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspring.llm.quality import BLANKS
from labelspring.llm.shared import spread_join
from labelspring.sources.scratch import new_path, write_table

#: Share of a host's documents above which a line is boilerplate.
RATIO = 0.1
#: Below this many documents a line is never boilerplate.
MIN_DOCUMENTS = 3
#: A host list of at most this many lines is broadcast; the count is checked.
BROADCAST_LINES = 200_000


def host_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_key(line: Column) -> Column:
    """64 bits that stand for a line within its host; NULL for a blank line."""
    return F.when(F.length(_stripped(line)) > 0, F.xxhash64(_stripped(line)))


def boilerplate_lines(
    documents: DataFrame, ratio: float = RATIO, least: int = MIN_DOCUMENTS, copies_once: bool = True
) -> DataFrame:
    """``host, line, n_docs, host_docs`` of the lines above the ratio, ``line`` as its key.

    Lines are made distinct within each text, so that the shuffle carries one
    partial count for each line, host and task. Equal texts of a host are one page,
    both in a line's count and in the host's, so that a document with many copies
    does not make boilerplate of itself; ``copies_once=False`` counts every row.
    Copies meet by digest, with their lines' keys and not their texts.
    """
    spark = documents.sparkSession
    rows = documents.select(host_key(F.col("source")).alias("host"), F.col("text"))
    keys = F.array_compact(F.array_distinct(F.transform(F.split("text", "\n"), line_key)))
    if copies_once:
        digest = F.md5(F.encode("text", "UTF-8")).alias("of")
        rows = rows.select("host", digest, keys.alias("keys")).groupBy("host", "of").agg(F.first("keys").alias("keys"))
        rows, keys = write_table(rows, new_path(spark, "pages")), F.col("keys")
    counts = (
        rows.select("host", F.explode(keys).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") >= least)
    )
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counts = write_table(counts, new_path(spark, "lines"))
    hosts = write_table(hosts, new_path(spark, "hosts"))
    return spread_join(counts, hosts, ["host"], "line").where(
        F.col("n_docs") > F.col("host_docs") * F.lit(ratio)
    )


def without_boilerplate(
    documents: DataFrame, ratio: float = RATIO, least: int = MIN_DOCUMENTS, copies_once: bool = True
) -> DataFrame:
    """The documents without their hosts' boilerplate lines, with ``_n_dropped`` added.

    A column of that name is replaced. Every row stays: one of which all lines go
    has an empty text, a null text stays null. A very long text is a row like others.

    A host has at most (lines of an average document) / ratio such lines, so
    they travel as one array to each host. While all arrays are few, counted
    first, they are broadcast and the texts stay where they are; else the texts
    go to their hosts, large hosts dealt out.
    """
    spark = documents.sparkSession
    found = write_table(boilerplate_lines(documents, ratio, least, copies_once), new_path(spark, "found"))
    lists = found.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("_bad"))
    rows = documents.select(
        F.struct(*[documents[c] for c in documents.columns]).alias("_row"),
        host_key(documents["source"]).alias("host"),
    )
    if found.count() <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(lists), "host", "left")
    else:
        rows = write_table(rows.withColumn("_by", F.xxhash64("_row.text")), new_path(spark, "rows"))
        joined = spread_join(rows, lists, ["host"], "_by", "left")
    lines = joined.select("_row", "_bad", F.split("_row.text", "\n").alias("_lines"))
    left = F.filter(
        "_lines",
        lambda line: F.col("_bad").isNull()
        | ~F.coalesce(F.array_contains(F.col("_bad"), line_key(line)), F.lit(False)),
    )
    kept = lines.select("_row", "_lines", left.alias("_left"))
    text = F.array_join("_left", "\n")
    same = F.size("_left") == F.size("_lines")
    out = []
    for name in documents.columns:
        if name == "_n_dropped":
            continue
        column = F.col("_row").getField(name)
        if name == "text":
            column = F.when(F.col("_lines").isNull() | same, column).otherwise(text)
        elif name == "n_chars":
            column = F.when(F.col("_lines").isNull() | same, column).otherwise(
                F.length(text).cast(documents.schema[name].dataType)
            )
        out.append(column.alias(name))
    dropped = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines") - F.size("_left"))
    return kept.select(*out, dropped.cast("long").alias("_n_dropped"))
