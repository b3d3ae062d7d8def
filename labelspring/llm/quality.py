"""Quality rules: text rules for each document, and a verdict for each host.

DataFrame functions only. NULL and empty texts have no words and fail. A NULL
host is a host of its own. Rows are judged one by one, so repeated rows and
repeated ids get the same verdict; other columns are carried along untouched.
An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspring.llm.shared import spread_join
from labelspring.sources.scratch import new_path, write_table

BLANKS = " \t\n\x0b\f\r"
GAP = "[ \\t\\n\\x0B\\f\\r]+"
MIN_WORDS = 50
#: A host goes if its shrunken rate of failing documents is above this.
HOST_RATE = 0.5
#: The prior weighs this many documents where hosts differ no more than by chance.
EVEN_HOSTS = 1e6


def words_of(text: Column) -> Column:
    """The words of a text; none where it is NULL."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, GAP)).otherwise(
        F.array().cast("array<string>")
    )


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0,
    )


def _windows(words: Column) -> Column:
    """The first word numbers of all windows of three words."""
    last = F.size(words) - 2
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def repeat_words(words: Column) -> Column:
    """How many words lie in a three-word window that the text has twice or more.

    Hashes tell the many texts without any such window. In the others the windows
    are sorted, equal neighbours found, and the words they cover counted.
    """

    def three(i: Column) -> list[Column]:
        return [F.element_at(words, i + k) for k in range(3)]

    hashes = F.transform(_windows(words), lambda i: F.xxhash64(*three(i)))
    keyed = F.sort_array(
        F.transform(
            _windows(words),
            lambda i: F.struct(
                F.xxhash64(*three(i)).alias("h"), F.concat_ws(" ", *three(i)).alias("t"), i.alias("i")
            ),
        )
    )

    def equal_neighbours(s: Column) -> Column:
        n = F.size(s) - 1
        return F.flatten(
            F.zip_with(
                F.slice(s, F.lit(1), n),
                F.slice(s, F.lit(2), n),
                lambda a, b: F.when(
                    (a["h"] == b["h"]) & (a["t"] == b["t"]), F.array(a["i"], b["i"])
                ).otherwise(F.array().cast("array<int>")),
            )
        )

    def covered(p: Column) -> Column:
        second, third = F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)
        return F.size(F.array_distinct(F.concat(p, second, third)))

    # transform over an array of one element binds a value that is used more than once
    counted = F.transform(
        F.transform(F.array(keyed), equal_neighbours), covered
    )[0]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(words) - 2, counted).otherwise(0)


def text_rules(documents: DataFrame) -> DataFrame:
    """``row`` (all columns), ``host``, the counts of each text, ``base_failed`` and ``failed``.

    ``failed`` adds to the base rules: more than one symbol to ten words, or more
    than 30 % of the lines repeated.
    """
    split = documents.select(
        F.struct(*[documents[c] for c in documents.columns]).alias("row"),
    ).select("row", words_of(F.col("row.text")).alias("words"), lines_of(F.col("row.text")).alias("lines"))
    counted = split.select(
        "row",
        F.when(F.col("row.source").isNull(), F.lit("")).otherwise(
            F.concat(F.lit("="), F.col("row.source"))
        ).alias("host"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("row.text", F.lit("[#*$%&|<>]")), F.lit(0))
        .cast("long")
        .alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * 50
    )
    more = (F.col("n_symbols") * 10 > F.col("n_words")) | (
        F.col("n_dup_lines") * 100 > F.col("n_lines") * 30
    )
    return counted.withColumn("base_failed", base).withColumn("failed", base | more).drop("n_lines")


def failing_hosts(judged: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """The hosts whose shrunken failure rate is above ``rate``.

    The beta prior is fitted to all hosts by its moments: the pooled rate, and
    the spread of the hosts' rates beyond what chance gives. A host with few
    documents stays near the pooled rate, one with many near its own.
    """
    hosts = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("bad")
    )
    hosts = write_table(hosts, new_path(judged.sparkSession, "hosts"))
    own = F.col("bad") / F.col("n")
    totals = hosts.agg(
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("n") * own * own).alias("squares"),
    ).first()
    if not totals["n"]:
        return hosts.select("host").limit(0)
    mean = totals["bad"] / totals["n"]
    chance = mean * (1 - mean) * totals["hosts"] / totals["n"]
    between = totals["squares"] / totals["n"] - mean * mean - chance
    weight = EVEN_HOSTS
    if between > 0:
        weight = min(EVEN_HOSTS, max(0.0, mean * (1 - mean) / between - 1))
    shrunk = (F.col("bad") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.where(shrunk > rate).select("host")


def quality_verdicts(documents: DataFrame) -> DataFrame:
    """``doc_id``, the counts of each text, ``base_failed``, ``host_failed``, ``kept``."""
    spark = documents.sparkSession
    judged = text_rules(documents)
    names = [c for c in judged.columns if c != "row"]
    judged = write_table(
        judged.select(F.col("row.doc_id").alias("doc_id"), *names), new_path(spark, "judged")
    )
    hosts = failing_hosts(judged).withColumn("host_failed", F.lit(True))
    placed = spread_join(judged, hosts, ["host"], "doc_id", "left")
    host_failed = F.coalesce("host_failed", F.lit(False))
    return placed.select(
        "doc_id",
        *[c for c in names if c not in ("host", "failed")],
        host_failed.alias("host_failed"),
        (~F.col("base_failed") & ~host_failed).alias("kept"),
    )


def good_documents(documents: DataFrame) -> DataFrame:
    """The documents that pass the base rules and whose host passes; the columns given.

    Texts are written once and not shuffled unless a host fails.
    """
    spark = documents.sparkSession
    judged = text_rules(documents).select(
        "host", "failed", F.when(~F.col("base_failed"), F.col("row")).alias("row")
    )
    judged = write_table(judged, new_path(spark, "judged"))
    hosts = failing_hosts(judged)
    passed = judged.where("row is not null")
    if not hosts.isEmpty():
        passed = spread_join(
            passed.select("host", "row", F.col("row.doc_id").alias("_by")), hosts, ["host"], "_by", "left_anti"
        )
    return passed.select("row.*")
