"""Choosing confident predictions as pseudo-labels."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.functions.columns import confidence_label

# Up to this many narrow rows are ranked by one take-ordered step.
DIRECT_TOP = 100_000
GRID = 256


def select_confident(scored: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Rows with a confident score; ``LABEL`` becomes the pseudo-label."""
    labelled = scored.withColumn("LABEL", confidence_label(F.col("score"), threshold))
    return labelled.filter(F.col("LABEL").isNotNull())


def kth_smallest(df: DataFrame, column: str, k: int, direct: int = DIRECT_TOP):
    """Exact k-th smallest value of a numeric column, counted from 1.

    Each pass counts the rows at and between quantiles of the remaining range
    and goes on in the one part that holds the value, until ``k`` is small enough
    to rank directly. A value that fills much of the range is a quantile, so it
    is a part of its own and ends the search. No sort, and no row leaves its
    task. None when there are fewer than ``k`` rows.
    """
    rest = df.select(F.col(column).alias("x")).filter(F.col("x").isNotNull())
    while k > direct:
        facts = rest.agg(
            F.min("x").alias("low"),
            F.max("x").alias("high"),
            F.percentile_approx("x", [i / GRID for i in range(1, GRID)], 10 * GRID).alias("q"),
        ).first()
        if facts["low"] is None:
            return None
        points = {float(v) for v in [facts["low"], *facts["q"], facts["high"]]}
        if len(points) == 1 and facts["low"] != facts["high"]:
            break  # integers that share one double: few enough to rank
        edges = sorted(points | {math.nextafter(v, math.inf) for v in points})
        placed = Bucketizer(
            splits=[-math.inf, *edges, math.inf], inputCol="d", outputCol="part"
        ).transform(rest.withColumn("d", F.col("x").cast("double")))
        counts = placed.groupBy("part").agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")
        )
        for row in sorted(counts.collect(), key=lambda r: r["part"]):
            if k <= row["n"]:
                break
            k -= row["n"]
        else:
            return None
        if row["low"] == row["high"]:
            return row["low"]
        rest = rest.filter(F.col("x").between(row["low"], row["high"]))
    top = rest.orderBy("x").limit(k).agg(F.max("x").alias("x"), F.count(F.lit(1)).alias("n"))
    found = top.first()
    return found["x"] if found["n"] == k else None


def first_by_score(
    rows: DataFrame, cap: int, highest: bool, direct: int = DIRECT_TOP
) -> DataFrame:
    """The ``cap`` rows with the highest (or lowest) score, ties by ``row_id``.

    The last row that fits is found from ``(score, row_id)`` alone; the rows
    themselves are then filtered in place and are neither sorted nor moved.
    """
    if cap <= 0:
        return rows.limit(0)
    sign = -1.0 if highest else 1.0
    keyed = rows.select((F.col("score") * F.lit(sign)).alias("s"), "row_id")
    if cap <= direct:
        last = (
            keyed.orderBy("s", "row_id")
            .limit(cap)
            .agg(F.max(F.struct("s", "row_id")).alias("last"), F.count(F.lit(1)).alias("n"))
            .first()
        )
        if last["n"] < cap:
            return rows
        s, row_id = last["last"]["s"], last["last"]["row_id"]
    else:
        s = kth_smallest(keyed, "s", cap, direct)
        if s is None:
            return rows
        before = keyed.filter(F.col("s") < s).count()
        row_id = kth_smallest(keyed.filter(F.col("s") == s), "row_id", cap - before, direct)
    signed = F.col("score") * F.lit(sign)
    return rows.filter((signed < s) | ((signed == s) & (F.col("row_id") <= row_id)))


def round_cap(cap: int | dict[int, int] | None, rnd: int) -> int | None:
    """Cap of a round: one number for all, or a map; a round it lacks has no cap."""
    return cap.get(rnd) if isinstance(cap, dict) else cap


def cap_by_class(
    confident: DataFrame, cap: int | None = None, direct: int = DIRECT_TOP
) -> DataFrame:
    """At most ``cap`` rows of each pseudo-label, the most confident first."""
    if cap is None:
        return confident
    positives = first_by_score(confident.filter(F.col("LABEL") == 1), cap, True, direct)
    negatives = first_by_score(confident.filter(F.col("LABEL") == 0), cap, False, direct)
    return positives.unionByName(negatives)


def select_top(
    scored: DataFrame, threshold: float = 0.85, cap: int | None = None
) -> DataFrame:
    """Confident rows under a cap for each class."""
    return cap_by_class(select_confident(scored, threshold), cap)


def augment(
    labelled: DataFrame,
    pseudo: DataFrame,
    current: DataFrame | None = None,
    checked: bool = False,
) -> DataFrame:
    """Labelled rows plus this round's pseudo rows, marked by ``is_pseudo``.

    Earlier pseudo rows are replaced. When nothing was selected the ``current``
    set stays as it is, earlier pseudo rows included. A caller who knows that
    something was selected says so by ``checked``.
    """
    columns = [c for c in labelled.columns if c != "is_pseudo"]
    base = labelled.select(*columns, F.lit(False).alias("is_pseudo"))
    if not checked and pseudo.isEmpty():
        return base if current is None else current
    return base.unionByName(pseudo.select(*columns, F.lit(True).alias("is_pseudo")))


def round_counts(train: DataFrame) -> DataFrame:
    """One row: training set size, its labelled and pseudo parts, pseudo-labels by class."""
    pseudo = F.col("is_pseudo")
    return train.agg(
        F.count(F.lit(1)).alias("total_train"),
        F.count_if(~pseudo).alias("labeled"),
        F.count_if(pseudo).alias("pseudo"),
        F.count_if(pseudo & (F.col("LABEL") == 1)).alias("pos"),
        F.count_if(pseudo & (F.col("LABEL") == 0)).alias("neg"),
    )


def round_changes(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """How the pseudo-labels of a round differ from those of the round before.

    Both tables have ``row_id, LABEL`` with unique ids; ``before`` is None in the
    first round. One row for each id that ``entered``, ``left`` or ``flipped``:
    ``row_id, change, label_before, label_after``, where the label of an id that is
    not in a table is NULL. Ids that kept their label give no row, and equal or
    empty tables give none at all. Only ids and labels are shuffled.
    """
    new = after.select("row_id", F.col("LABEL").cast("int").alias("label_after"))
    if before is None:
        both = new.withColumn("label_before", F.lit(None).cast("int"))
    else:
        old = before.select("row_id", F.col("LABEL").cast("int").alias("label_before"))
        both = old.join(new, "row_id", "full")
    change = (
        F.when(F.col("label_before").isNull(), F.lit("entered"))
        .when(F.col("label_after").isNull(), F.lit("left"))
        .otherwise(F.lit("flipped"))
    )
    return both.filter(~F.col("label_before").eqNullSafe(F.col("label_after"))).select(
        "row_id", change.alias("change"), "label_before", "label_after"
    )


def change_counts(changes: DataFrame) -> DataFrame:
    """``round, entered, left, flipped`` of the changes of several rounds."""
    return changes.groupBy("round").agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("entered", "left", "flipped")]
    )
