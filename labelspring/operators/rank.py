"""Exact row numbers over a hashed order, without a single-task window.

``row_number() over (partition by class)`` would put a whole class in one task.
The hash that gives the order is uniform, so its leading bits split every
class into equal buckets, however large the class. A row's number is the
number of rows in the buckets before its own, plus its place in the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_BITS = 16
ORDER_BITS = 60


def hashed_rank(
    df: DataFrame,
    order: Column,
    key: str = "row_id",
    by: tuple[str, ...] = (),
    name: str = "idx",
    size: str | None = None,
    run_on: bool = False,
    bucket_bits: int = BUCKET_BITS,
) -> DataFrame:
    """Add ``name``: the row's position from 0 in its group, by ``order`` then ``key``.

    ``order`` is a 60-bit keyed hash, ``key`` a unique id that breaks ties and
    ``by`` columns with few values (class, round). With ``size`` the number of
    rows of the group is added too. With ``run_on`` a group's numbers go on where
    those of the group before it end.

    The offsets table has at most ``2**bucket_bits`` rows for each group and
    is joined on the keys by which the window has already partitioned the rows.
    """
    groups = list(by)
    # Never NULL, so the join below does not hash every row again to test for it.
    rows = df.withColumn("_order", F.coalesce(order, F.lit(0))).withColumn(
        "_bucket", F.shiftright(F.col("_order"), ORDER_BITS - bucket_bits)
    )
    keys = [*groups, "_bucket"]
    per_bucket = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    group_window = Window.partitionBy(*(groups or [F.lit(0)]))
    run = Window.partitionBy(F.lit(0)).orderBy(*keys) if run_on else group_window.orderBy("_bucket")
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_n").over(group_window).alias("_size"),
    )
    in_bucket = Window.partitionBy(*keys).orderBy("_order", key)
    placed = rows.withColumn("_place", F.row_number().over(in_bucket))
    result = placed.join(offsets, keys).withColumn(
        name, F.col("_start") + F.col("_place") - 1
    )
    if size is not None:
        result = result.withColumn(size, F.col("_size"))
    return result.select(
        *df.columns, name, *([size] if size is not None else [])
    )
