"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.llm.shared import spread_join
from labelspring.sources.scratch import drop_table, new_path, write_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node with the smallest of them and itself.

    The large star looks at all neighbours and links the larger ones, the small
    star looks at the smaller neighbours and links these and the node.
    """
    low = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        linked = spread_join(edges, low, ["u"], "v").where(F.col("v") > F.col("u"))
        return linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    linked = spread_join(edges, low, ["u"], "v").where(F.col("v") != F.col("m"))
    own = low.select("u", F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def _state(edges: DataFrame) -> tuple:
    """The same for the same set of edges."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``u, v``: the smallest node it can reach.

    Each round writes the edges to the shared folder and drops the ones before,
    so that a lost executor costs no earlier round. Loops, repeated links and
    NULL ends are ignored. A node without a link to another is not returned.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "links")
        return write_table(df.where(F.col("u") != F.col("v")).distinct(), path), path

    links, path = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where(edges["u"].isNotNull() & edges["v"].isNotNull())
    )
    state = _state(links)
    while state[0]:
        both, mirrored = written(
            links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        )
        larger, at_large = written(_star(both, large=True))
        drop_table(spark, mirrored)
        smaller, at_small = written(_star(larger, large=False))
        drop_table(spark, at_large)
        drop_table(spark, path)
        links, path = smaller, at_small
        before, state = state, _state(links)
        if state == before:
            break
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ends.unionByName(roots)
