"""Near-duplicate documents: many universal hash minima, banding, verification, components.

Rows are read whole. NULL and empty texts have no shingles and are linked with
nothing; rows without a ``doc_id`` get no component. Rows that repeat a
``doc_id`` are one node: equal rows stay equal rows, and different texts under
one id link whatever each of them is near to. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspring.llm.components import connected_components
from labelspring.llm.shared import Membership, Workspace, spread_join, thinned, union_all
from labelspring.llm.tokens import (
    LOWER,
    letters,
    numbered,
    pieces,
    shingles,
    SPACES,
    word_hashes,
    word_spans,
)
from labelspring.sources.scratch import new_path, write_table

#: With similarity 0.8 a pair shares no band with probability (1 - 0.8^6)^50 = 3e-7.
BANDS, ROWS = 50, 6
#: Standard deviations that the estimate from the minima may lie below the bound.
SLACK = 6.0
#: Classes of one side of a block, in which those of a bucket that are still apart meet.
BLOCK = 256

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, minima binary"


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each piece of the column its first row and the rows' distinct shingle hashes."""
    inside = letters(SPACES)
    for row, data, offsets in pieces(texts):
        lowered = LOWER[data]
        start, end, text = word_spans(lowered, offsets, inside)
        hashes, owner = shingles(word_hashes(lowered, start, end), text, words)
        cuts = np.searchsorted(owner, np.arange(len(offsets)))
        yield row, [
            np.unique(hashes[cuts[i] : cuts[i + 1]]) for i in range(len(offsets) - 1)
        ]


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each function ``a x + b`` of the high halves of ``values``."""
    x = values >> np.uint64(32)
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 256):
        block = a[:, None] * x[None, at : at + 256] + b[:, None]
        np.minimum(low, block.min(axis=1), out=low)
    return low >> np.uint64(32)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """A row for each document: set size, two sums that identify the set, bands, minima."""
    n = BANDS * ROWS
    a, b = numbered(11, n) | np.uint64(1), numbered(12, n)
    weights = numbered(13, ROWS) | np.uint64(1)
    tags = numbered(14, BANDS)
    odd = np.uint64(0x9FB21C651E98DF25)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, sets in shingle_sets(batch.column(1), words):
                rows = []
                for values in sets:
                    if not len(values):
                        rows.append((0, 0, 0, None, None))
                        continue
                    low = minima(values, a, b)
                    bands = (low.reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=np.uint64)
                    bands = (bands ^ (bands >> np.uint64(29))) * odd + tags
                    set_a = int(values.sum(dtype=np.uint64).view(np.int64))
                    spread = (values ^ (values >> np.uint64(23))) * odd
                    set_b = int((spread ^ (spread >> np.uint64(31))).sum(dtype=np.uint64).view(np.int64))
                    low = (low & np.uint64(255)).astype(np.uint8).tobytes()
                    rows.append((len(values), set_a, set_b, bands.view(np.int64), low))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(sets)).cast(pa.int64()), *columns],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "minima"],
                )

    return docs.mapInArrow(sign, SIGNED)


def full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node, shingles`` of the nodes; texts that cannot be one are not worked on."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(1), words):
                values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                ids = batch.column(0).slice(row, len(sets)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, values], ["node", "shingles"])

    candidates = thinned(docs, Membership(nodes, "node"), "doc_id")
    sets = candidates.mapInArrow(make, "node long, shingles array<long>")
    return sets.join(nodes, "node", "left_semi")


def _estimated(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """Drop the pairs whose minima agree far too seldom. ``u`` may be hot."""
    n = BANDS * ROWS
    least = similarity - SLACK * (similarity * (1 - similarity) / n) ** 0.5

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, n)
                for i in (2, 3)
            )
            near = (left == right).mean(axis=1) >= least
            yield batch.select([0, 1]).filter(pa.array(near))

    side = signed.where("minima is not null").select("doc_id", "minima")
    u = side.select(F.col("doc_id").alias("u"), F.col("minima").alias("minima_u"))
    v = side.select(F.col("doc_id").alias("v"), F.col("minima").alias("minima_v"))
    both = spread_join(pairs, u, ["u"], "v").join(v, "v")
    rows = both.select("u", "v", "minima_u", "minima_v")
    return rows.mapInArrow(agree, "u long, v long").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are as similar as asked for, written."""
    u = sets.select(F.col("node").alias("u"), F.col("shingles").alias("set_u"))
    v = sets.select(F.col("node").alias("v"), F.col("shingles").alias("set_v"))
    common = F.size(F.array_intersect("set_u", "set_v"))
    near = (
        spread_join(pairs, u, ["u"], "v")
        .join(v, "v")
        .select("u", "v", (F.size("set_u") + F.size("set_v")).alias("sizes"), common.alias("common"))
        .where(F.col("common") * 100 >= (F.col("sizes") - F.col("common")) * percent)
    )
    return write_table(near.select("u", "v").distinct(), new_path(pairs.sparkSession, "near"))


def near_duplicates(
    documents: DataFrame, words: int = 5, percent: int = 80
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``doc_id, text``.

    Documents are linked if the distinct shingles of ``words`` words have a
    Jaccard similarity of at least ``percent`` / 100. Equal sets are one class,
    so copies are never paired. In each bucket of a band all classes are compared
    with the smallest. Where a bucket still has several components, what is not
    in its largest one is compared with all that is in another, block by block,
    so no link is left to chance but for the banding. Every link is confirmed on
    the full sets.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))

    tables = Workspace(spark)
    kept = tables.keep

    signed = kept(signatures(docs, words), "signed")
    identity = ["set_a", "set_b", "n_shingles"]
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    classes = kept(
        linked.groupBy(*identity).agg(
            F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")
        ),
        "classes",
    )
    named = classes.select(*identity, F.col("node").alias("doc_id"))
    buckets = kept(
        linked.join(named, [*identity, "doc_id"], "left_semi")
        .dropDuplicates([*identity, "doc_id"])
        .select(F.explode("bands").alias("band"), F.col("doc_id").alias("node")),
        "buckets",
    )
    leaders = (
        buckets.groupBy("band")
        .agg(F.min("node").alias("leader"), F.max("node").alias("last"))
        .where("leader < last")
        .drop("last")
    )
    shared = kept(spread_join(buckets, leaders, ["band"], "node"), "shared")
    tables.drop("buckets")

    stars = shared.where("node <> leader")
    stars = stars.select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    stars = kept(_estimated(kept(stars, "asked"), signed, percent / 100), "likely")
    links = [_confirmed(stars, kept(full_sets(docs, _ends(stars), words), "sets"), percent)]
    tables.drop("sets", "asked", "likely")
    components = kept(connected_components(links[0]), "components")
    own = components.select("node", F.col("component").alias("own"))
    open_buckets = kept(
        _mixed_buckets(
            spread_join(shared.drop("leader"), own, ["node"], "band", "left").select(
                "band", "node", F.coalesce("own", "node").alias("own")
            )
        ),
        "open",
    )
    tables.drop("shared")
    if not open_buckets.isEmpty():
        nodes = open_buckets.select("node").distinct()
        sets = kept(full_sets(docs, nodes, words), "sets")
        asked = kept(_block_pairs(open_buckets, sets, percent), "asked")
        links.append(_confirmed(asked, sets, percent))
    if len(links) > 1:
        components = kept(connected_components(union_all(links).distinct()), "components")

    at_class = classes.join(components, "node", "left").select(
        *identity, "copies", "node", F.coalesce("component", "node").alias("component_id")
    )
    moved = kept(
        at_class.where("copies > 1 or component_id <> node").select(*identity, "component_id"),
        "moved",
    )
    tables.drop_all_but("signed", "moved")
    found = spread_join(signed.select("doc_id", *identity), moved, identity, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _mixed_buckets(placed: DataFrame) -> DataFrame:
    """The rows of ``band, node, own`` whose bucket holds more than one component."""
    mixed = (
        placed.groupBy("band")
        .agg(F.min("own").alias("low"), F.max("own").alias("high"))
        .where("low < high")
        .select("band")
    )
    return placed.join(mixed, "band", "left_semi")


def _block_pairs(open_buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u, v`` of one bucket and different components that are near, found in blocks.

    The largest component of a bucket is the one side; what is not in it, the
    minor side, meets all that is in another component. Both sides are dealt out
    to chunks of about BLOCK classes; a block is two chunks of which one is minor.
    A task has one block at a time and puts out near pairs only. Shingles are cut
    to 32 bits here, which can only add pairs; they are to be confirmed.
    """
    spark = open_buckets.sparkSession
    sides = (
        open_buckets.groupBy("band", "own")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("band")
        .agg(
            F.max_by("own", F.struct("n", "own")).alias("main"),
            F.ceil(F.max("n") / BLOCK).cast("int").alias("chunks"),
            F.ceil((F.sum("n") - F.max("n")) / BLOCK).cast("int").alias("minor_chunks"),
        )
    )
    minor = F.col("own") != F.col("main")
    chunk = F.pmod(F.xxhash64("node"), F.when(minor, F.col("minor_chunks")).otherwise(F.col("chunks")))
    placed = spread_join(open_buckets, sides, ["band"], "node").select(
        "*", minor.alias("minor"), chunk.cast("int").alias("chunk")
    )

    def block(left: Column, right: Column, of_main: bool) -> Column:
        return F.struct(left.alias("left"), right.alias("right"), F.lit(of_main).alias("of_main"))

    def all_of(name: str, block_of: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(name) - 1), block_of)

    own = F.col("chunk")
    with_main = all_of("chunks", lambda k: block(own, k, True))
    with_minor = all_of("minor_chunks", lambda k: block(F.least(own, k), F.greatest(own, k), False))
    of_main = all_of("minor_chunks", lambda k: block(k, own, True))
    blocks = F.when(F.col("minor"), F.concat(with_main, with_minor)).otherwise(of_main)
    rows = write_table(
        placed.select("band", "node", "own", "minor", F.explode(blocks).alias("block")),
        new_path(spark, "blocks"),
    )
    cut = sets.select(
        "node", F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int")).alias("shingles")
    )
    held = spread_join(rows, cut, ["node"], "band").select(
        "band", "block.*", "node", "own", "minor", "shingles"
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, own, first = (table[c].to_numpy() for c in ("node", "own", "minor"))
        lists = table["shingles"].chunk(0)
        at = lists.offsets.to_numpy()
        values = np.asarray(lists.values)[at[0] : at[-1]]
        starts, size = (at - at[0])[:-1], np.diff(at)
        codes = np.unique(values, return_inverse=True)[1]
        found = [np.zeros((0, 2), np.int64)]
        here = np.zeros(codes.max() + 1, np.int64)
        for k in np.flatnonzero(first):
            mine = codes[starts[k] : starts[k] + size[k]]
            here[mine] = 1
            common = np.add.reduceat(here[codes], starts)
            here[mine] = 0
            near = common * 100 >= (size + size[k] - common) * percent
            others = node[near & (own != own[k])]
            found.append(np.stack([np.minimum(others, node[k]), np.maximum(others, node[k])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    near = held.groupBy("band", "left", "right", "of_main").applyInArrow(compare, "u long, v long")
    return near.distinct()


def without_near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that a smaller ``doc_id`` of their component stands for.

    Of rows that repeat a kept ``doc_id`` all stay. The columns are those given.
    """
    spark = documents.sparkSession
    found = near_duplicates(documents, words, percent)
    gone = write_table(
        found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(),
        new_path(spark, "gone"),
    )
    return documents.join(gone, documents["doc_id"].cast("long") == gone["_gone"], "left_anti")
