"""Data sets drawn from the rows: pairs, folds, splits, batches, masked text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspring.functions.keyed import (
    DEFAULT_SEED,
    keyed_chance,
    keyed_hash,
    keyed_index,
    keyed_order,
)
from labelspring.operators.rank import hashed_rank

CLASSES = (0, 1)

# Tables of ids are broadcast up to this many rows, a few megabytes.
BROADCAST_ROWS = 100_000

# A row drawn more often than this is joined by several tasks.
HOT_DRAWS = 10_000


def class_pools(df: DataFrame) -> DataFrame:
    """Rows of the two classes; any other label belongs to neither pool."""
    return df.filter(F.col("LABEL").isin(*CLASSES))


def class_index(df: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """Dense position of every row in its class pool: ``row_id, LABEL, idx, pool_size``.

    Ids only: texts and vectors are joined to the drawn pairs, never shuffled here.
    """
    pools = class_pools(df).select("row_id", F.col("LABEL").cast("int").alias("LABEL"))
    order = keyed_order(F.col("row_id"), "pool", seed)
    return hashed_rank(pools, order, by=("LABEL",), size="pool_size")


def _class_sizes(df: DataFrame) -> dict[int, int]:
    """Rows of each class pool."""
    row = df.agg(*[F.count_if(F.col("LABEL") == c).alias(f"m{c}") for c in CLASSES]).first()
    return {c: row[f"m{c}"] for c in CLASSES}


def _require_rows(sizes: dict[int, int]) -> None:
    for label, size in sizes.items():
        if not size:
            raise ValueError(f"class {label} has no rows to draw pairs from")


def _pair_ids(df: DataFrame, start: int, stop: int) -> DataFrame:
    return df.sparkSession.range(start, stop).withColumnRenamed("id", "pair_id")


def _end(side: int, label: Column, idx: Column) -> Column:
    return F.struct(F.lit(side).alias("side"), label.alias("cls"), idx.alias("idx"))


def _same_class(ids: DataFrame, sizes: dict[int, int], seed: int) -> DataFrame:
    """``pair_id, label, ends``: class and position of two distinct rows of one class."""
    _require_rows(sizes)
    pair = F.col("pair_id")

    def positions(m: int) -> Column:
        a = keyed_index(pair, "a", m, seed)
        if m == 1:
            return F.struct(a.alias("a"), a.alias("b"))
        step = keyed_index(pair, "b", m - 1, seed) + 1
        return F.struct(a.alias("a"), F.pmod(a + step, F.lit(m)).alias("b"))

    side = F.pmod(keyed_hash(pair, "cls", seed), F.lit(2)).cast("int")
    drawn = ids.withColumn("cls", side).withColumn(
        "at", F.when(F.col("cls") == 1, positions(sizes[1])).otherwise(positions(sizes[0]))
    )
    ends = F.array(
        _end(0, F.col("cls"), F.col("at.a")), _end(1, F.col("cls"), F.col("at.b"))
    )
    return drawn.select("pair_id", F.lit(1.0).alias("label"), ends.alias("ends"))


def _cross_class(ids: DataFrame, sizes: dict[int, int], seed: int) -> DataFrame:
    """``pair_id, label, ends``: class and position of a positive and a negative row."""
    _require_rows(sizes)
    pair = F.col("pair_id")
    positive = keyed_index(pair, "pos", sizes[1], seed)
    negative = keyed_index(pair, "neg", sizes[0], seed)
    ends = F.array(_end(0, F.lit(1), positive), _end(1, F.lit(0), negative))
    return ids.select("pair_id", F.lit(0.0).alias("label"), ends.alias("ends"))


def _gather_ends(ends: DataFrame, **values: str) -> DataFrame:
    """One row for each pair from its two ends, ``side`` 0 and 1."""
    return ends.groupBy("pair_id", "label").agg(
        *[
            F.max(F.when(F.col("side") == side, F.col(column))).alias(pattern.format(end))
            for side, end in ((0, "a"), (1, "b"))
            for column, pattern in values.items()
        ]
    )


def _resolve(draws: DataFrame, df: DataFrame, sizes: dict[int, int], seed: int) -> DataFrame:
    """Row ids of the drawn positions; each pool is ranked once for both ends.

    A class of few rows is drawn again and again, so a shuffle by position would
    pile its draws into a few tasks. Such a class is broadcast instead; of a
    larger one no row can expect many draws.
    """
    ends = draws.select("pair_id", "label", F.inline("ends"))
    few = [c for c in CLASSES if sizes[c] <= BROADCAST_ROWS]
    many = [c for c in CLASSES if sizes[c] > BROADCAST_ROWS]
    found = []
    for classes in (few, many):
        if not classes:
            continue
        index = class_index(df.filter(F.col("LABEL").isin(*classes)), seed).select(
            F.col("LABEL").alias("cls"), "idx", "row_id"
        )
        side = F.broadcast(index) if classes is few else index
        found.append(ends.join(side, ["cls", "idx"]))
    return _gather_ends(reduce(DataFrame.unionByName, found), row_id="{}")


def same_class_pairs(df: DataFrame, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """``n`` pairs of distinct rows of one class, label 1.0.

    The class is a fair coin; a class of one row pairs that row with itself.
    """
    sizes = _class_sizes(df)
    return _resolve(_same_class(_pair_ids(df, 0, n), sizes, seed), df, sizes, seed)


def cross_class_pairs(df: DataFrame, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """``n`` pairs of one positive and one negative row, drawn with replacement, label 0.0."""
    sizes = _class_sizes(df)
    return _resolve(_cross_class(_pair_ids(df, 0, n), sizes, seed), df, sizes, seed)


def make_pairs(df: DataFrame, n: int = 3000, seed: int = DEFAULT_SEED) -> DataFrame:
    """``pair_id, label, a, b``: half same-class pairs, the rest cross-class."""
    sizes = _class_sizes(df)
    half = n // 2
    same = _same_class(_pair_ids(df, 0, half), sizes, seed)
    cross = _cross_class(_pair_ids(df, half, n), sizes, seed)
    return _resolve(same.unionByName(cross), df, sizes, seed)


def shuffle_pairs(pairs: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """Add ``position``, the pair's place in a random order."""
    order = keyed_order(F.col("pair_id"), "shuffle", seed)
    return hashed_rank(pairs, order, key="pair_id", name="position")


def _join_drawn_often(ends: DataFrame, rows: DataFrame, n_pairs: int) -> DataFrame:
    """Join on ``row_id`` where some rows are drawn far more often than others.

    A row drawn more than ``quota`` times is copied, and its draws are dealt out to
    the copies. At most ``BROADCAST_ROWS`` rows can exceed the quota.
    """
    quota = max(HOT_DRAWS, -(-2 * n_pairs // max(BROADCAST_ROWS, 1)))
    hot = (
        ends.groupBy("row_id")
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(quota)).cast("int").alias("copies"))
        .filter(F.col("copies") > 1)
    )
    copies = F.coalesce(F.col("copies"), F.lit(1))
    dealt = ends.join(F.broadcast(hot), "row_id", "left").withColumn(
        "copy", F.pmod(F.col("pair_id"), copies).cast("int")
    )
    copied = rows.join(F.broadcast(hot), "row_id", "left").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), copies - 1))
    )
    return dealt.drop("copies").join(copied.drop("copies"), ["row_id", "copy"])


def attach_pair_values(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Add ``{value}_a`` and ``{value}_b`` from ``rows(row_id, value)``.

    Both ends are stacked, so the wide table is read once. The ids of few pairs,
    which are counted, are broadcast, and then the wide table is not shuffled either.
    """
    n_pairs = pairs.count()
    ends = pairs.select(
        "pair_id",
        "label",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("a").alias("row_id")),
                F.struct(F.lit(1).alias("side"), F.col("b").alias("row_id")),
            )
        ),
    )
    rows = rows.select("row_id", value)
    if n_pairs <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(ends), "row_id")
    else:
        found = _join_drawn_often(ends, rows, n_pairs)
    return _gather_ends(found, row_id="{}", **{value: value + "_{}"})


def self_pairs(*tables: DataFrame) -> DataFrame:
    """``row_id, anchor, positive`` with equal texts, over all the given tables."""
    texts = [t.select("row_id", "TEXT") for t in tables]
    union = texts[0]
    for other in texts[1:]:
        union = union.unionByName(other)
    return union.select(
        "row_id", F.col("TEXT").alias("anchor"), F.col("TEXT").alias("positive")
    )


def stratified_folds(
    df: DataFrame, k: int = 5, label: str = "LABEL", seed: int = DEFAULT_SEED
) -> DataFrame:
    """Add ``fold`` in ``[0, k)``; the folds' counts of a class differ by at most 1."""
    order = keyed_order(F.col("row_id"), None, seed)
    ranked = hashed_rank(df, order, by=(label,), name="_idx", run_on=True)
    return ranked.select(
        *df.columns, F.pmod(F.col("_idx"), F.lit(k)).cast("int").alias("fold")
    )


def fold_rows(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows of one fold."""
    return df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)


def shuffle_splits(
    df: DataFrame,
    rounds: tuple[int, ...] = (0, 1, 2, 3, 4),
    test_share: float = 0.2,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """``round, row_id, LABEL, held_out``: independent stratified splits, ids only."""
    repeated = df.select(
        F.explode(F.array(*[F.lit(r) for r in rounds])).alias("round"), "row_id", "LABEL"
    )
    order = keyed_order(
        F.concat_ws("/", F.col("round").cast("string"), F.col("row_id").cast("string")),
        "split",
        seed,
    )
    ranked = hashed_rank(repeated, order, by=("round", "LABEL"), size="_m")
    quota = F.round(F.lit(float(test_share)) * F.col("_m"))
    return ranked.select("round", "row_id", "LABEL", (F.col("idx") < quota).alias("held_out"))


def batches(df: DataFrame, size: int = 32, seed: int = DEFAULT_SEED) -> DataFrame:
    """Add ``batch_id``: random batches of ``size`` rows, the last one may be short."""
    ranked = hashed_rank(df, keyed_order(F.col("row_id"), "batch", seed), name="_idx")
    batch = F.floor(F.col("_idx") / F.lit(size)).cast("bigint")
    return ranked.select(*df.columns, batch.alias("batch_id"))


def mask_tokens(
    df: DataFrame,
    probability: float = 0.15,
    mask: str = "<mask>",
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """``row_id, masked_text, targets``: each blank-separated token is masked by chance.

    ``targets`` holds the position and the original of each masked token.
    """
    row = F.col("row_id").cast("string")

    def chosen(i):
        return keyed_chance(F.concat_ws("/", row, i.cast("string")), "mask", seed) < probability

    tokens = F.split(F.col("TEXT"), " ", -1)
    drawn = F.transform(
        tokens,
        lambda t, i: F.struct(i.alias("position"), t.alias("token"), chosen(i).alias("hit")),
    )
    # The draws are materialised once per row; both outputs read them.
    rows = df.select("row_id", F.explode(F.array(drawn)).alias("_drawn"))
    text = F.array_join(
        F.transform("_drawn", lambda d: F.when(d.hit, F.lit(mask)).otherwise(d.token)), " "
    )
    hits = F.transform(
        F.filter("_drawn", lambda d: d.hit),
        lambda d: F.struct(d.position.alias("position"), d.token.alias("token")),
    )
    return rows.select("row_id", text.alias("masked_text"), hits.alias("targets"))
