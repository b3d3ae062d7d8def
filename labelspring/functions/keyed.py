"""Randomness as a function of a seed and a row key.

``rand()`` changes with the partitioning and when a lost task is run again.
Every random choice here is the MD5 of ``seed:key:tag`` instead, so it is the
same on every cluster, after every retry, and in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def _digest(key: Column, tag: str | None, seed: int) -> Column:
    parts = [F.lit(str(seed)), key.cast("string")]
    if tag is not None:
        parts.append(F.lit(tag))
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _leading_bits(digest: Column, hex_digits: int) -> Column:
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")


def keyed_hash(key: Column, tag: str, seed: int = DEFAULT_SEED) -> Column:
    """32-bit hash of ``key`` for the purpose ``tag``, as a non-negative BIGINT."""
    return _leading_bits(_digest(key, tag, seed), 8)


def keyed_order(key: Column, tag: str | None, seed: int = DEFAULT_SEED) -> Column:
    """60-bit hash of ``key``: the sort key of a random permutation."""
    return _leading_bits(_digest(key, tag, seed), 15)


def keyed_index(key: Column, tag: str, size: int, seed: int = DEFAULT_SEED) -> Column:
    """Position in ``[0, size)`` drawn for ``key``, from 60 bits whatever the size."""
    return F.pmod(keyed_order(key, tag, seed), F.lit(size))


def keyed_chance(key: Column, tag: str, seed: int = DEFAULT_SEED) -> Column:
    """Uniform double in ``[0, 1)`` drawn for ``key``."""
    return keyed_hash(key, tag, seed) / F.lit(float(1 << 32))


#: Hex digits of one draw of :func:`keyed_draws`, and how many draws a digest gives.
DRAW_DIGITS, DRAWS = 4, 8


def keyed_draws(key: Column, tag: str, count: Column, seed: int = DEFAULT_SEED) -> Column:
    """``count`` draws for ``key``: texts of four hex digits, which order as numbers do.

    One digest gives eight of them, so a vector of 64 entries takes eight digests.
    """
    last = F.greatest(F.floor((count - 1) / F.lit(DRAWS)), F.lit(0)).cast("int")
    digests = F.transform(
        F.sequence(F.lit(0), last),
        lambda block: _digest(F.concat_ws("/", key.cast("string"), block.cast("string")), tag, seed),
    )
    draws = F.regexp_extract_all(F.array_join(digests, ""), F.lit(f".{{{DRAW_DIGITS}}}"), F.lit(0))
    return F.slice(draws, F.lit(1), count)


def draw_below(chance: float) -> str:
    """The draw that a share ``chance`` of all draws lies below."""
    if not 0.0 <= chance < 1.0:
        raise ValueError(f"a chance from 0 up to, but not including, 1 is needed, not {chance}")
    return f"{int(chance * 16**DRAW_DIGITS):0{DRAW_DIGITS}x}"
