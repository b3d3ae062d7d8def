"""Joins and filters that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring.sources.scratch import drop_table, new_path, write_table

#: A key with more than this share of the rows is dealt out to copies: at most SHARE keys.
SHARE = 2000
#: Below this many rows a key is left whole.
WHOLE = 2000
#: Bits of a membership filter; its size does not follow the data.
FILTER_BITS = 1 << 23


def spread_join(
    left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner"
) -> DataFrame:
    """Join where any share of ``left`` may have one key.

    ``left`` is a written table, since it is read twice: once to find the keys
    that hold more than 1 / SHARE of its rows. There are fewer than SHARE of
    them, so that they can be broadcast. Their rows are dealt out by a hash of
    ``by``, and their rows in ``right`` are copied as often.
    """
    most = max(WHOLE, left.count() // SHARE)
    hot = (
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > most)
        .select(*keys, F.ceil(F.col("_rows") / F.lit(most)).cast("int").alias("_copies"))
    )
    copies = F.coalesce("_copies", F.lit(1))
    dealt = (
        left.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(F.col(by)), copies).cast("int"))
        .drop("_copies")
    )
    copied = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
        .drop("_copies")
    )
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


class Workspace:
    """Tables that one run writes to the shared folder, by name, and drops when done with them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        return write_table(df, path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                drop_table(self.spark, path)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[name for name in self.paths if name not in names])


class Membership:
    """A bitmap of fixed size that holds every value of a column, and few others.

    It only thins out the rows that an exact join sees next. Built by Spark,
    one word of 64 bits to a row, so the driver gets at most ``bits / 64`` rows.
    ``bits`` is a power of two. Each value sets the bits that :meth:`probes` names.
    """

    def __init__(self, values: DataFrame, column: str, bits: int = FILTER_BITS, hashed=False):
        key = F.col(column).cast("long")
        key = key if hashed else F.xxhash64(key)
        at = F.explode(F.array(*[F.pmod(part, F.lit(bits)) for part in (key, F.shiftright(key, 32))]))
        words = (
            values.where(F.col(column).isNotNull())
            .select(at.alias("at"))
            .select((F.col("at") / 64).cast("int").alias("word"), (F.col("at") % 64).cast("int").alias("bit"))
            .groupBy("word")
            .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
        )
        table = words.toArrow()
        mask = np.zeros(bits // 64, np.int64)
        mask[table["word"].to_numpy()] = table["mask"].to_numpy()
        self.bits = bits
        self.sent = values.sparkSession.sparkContext.broadcast(mask)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """For 64-bit hashes, whether both their bits are set."""
        out = np.ones(len(hashes), bool)
        words = self.sent.value
        for at in (hashes.view(np.int64), hashes.view(np.int64) >> 32):
            at = at & (self.bits - 1)
            out &= (words[at >> 6] >> (at & 63)) & 1 == 1
        return out


def thinned(rows: DataFrame, members: Membership, column: str, hashed=False) -> DataFrame:
    """The rows whose ``column`` may be a member; all rows that are one stay."""

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            mask = members.holds(at)
            if mask.any():
                yield batch.drop_columns(["_at"]).filter(pa.array(mask))

    key = F.col(column).cast("long")
    placed = rows.select("*", (key if hashed else F.xxhash64(key)).alias("_at"))
    return placed.mapInArrow(keep, rows.schema)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
