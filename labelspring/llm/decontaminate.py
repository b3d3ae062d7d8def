"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits in lower case; white space and ASCII
punctuation separate them. NULL and empty texts hold nothing. An item of up to
seven words is found where all of them stand in a row; a longer one, by any
stretch of an alignment with enough equal words, which always has a seed. Rows without ``doc_id`` or ``item_id`` are
passed over. Rows that repeat a ``doc_id`` are judged together: if one of them
holds an item, the id does. Items with equal words count as the one with the
smallest id. Empty tables give no hits. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.llm.shared import Membership, spread_join
from labelspring.llm.tokens import (
    SPACES,
    _mixed,
    letters,
    numbered,
    pieces,
    word_hashes,
    word_spans,
)
from labelspring.sources.scratch import cut_lineage, drop_table, new_path, write_table

#: The words that a seed looks at (1) and those that it ignores (0).
#: Each stretch that :func:`accepted_overlap` takes of an item of eight words or more fits one.
MASKS = ("11111", "110111", "11001011")
#: Items shorter than the shortest mask have their whole word sequence as seed.
SHORTEST = min(map(len, MASKS))
#: Words kept to each side of the hits, for the alignment.
REACH = 48
#: An overlap needs so many equal words (see least_equal for shorter items) ...
MIN_WORDS = 12
#: An item with fewer words tolerates no substitution.
EXACT_BELOW = 8
#: ... and so large a share of them among its words.
MIN_SHARE = 0.8
#: So many equal words must stand against each other word for that share.
MIN_SHARE_COST = round(MIN_SHARE / (1 - MIN_SHARE))
#: Points that a substituted word costs; an equal word gains one.
SUBSTITUTION = 2
SEED_BITS = 1 << 24

BETWEEN = SPACES + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def text_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece: first row, offsets of the rows in the words, word hashes, text numbers."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    inside = letters(BETWEEN)
    for row, data, offsets in pieces(pc.utf8_lower(texts)):
        start, end, text = word_spans(data, offsets, inside)
        cuts = np.searchsorted(text, np.arange(len(offsets)))
        yield row, cuts, word_hashes(data, start, end), text


def least_equal(n: int) -> int:
    """The equal words that an item of ``n`` words needs: MIN_SHARE of them, MIN_WORDS at most."""
    if n < EXACT_BELOW:
        return n
    return min(MIN_WORDS, -(-n * MIN_SHARE_COST // (MIN_SHARE_COST + 1)))


def seeds(
    words: np.ndarray, text: np.ndarray, masks: dict[int, str] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask the positions it fits at and the hashes of the words it looks at."""
    for number, mask in (dict(enumerate(MASKS)) if masks is None else masks).items():
        span = len(mask)
        size = len(words) - span + 1
        if size <= 0:
            continue
        weights = numbered(20 + number, span) | np.uint64(1)
        total = np.zeros(size, np.uint64)
        for k in range(span):
            if mask[k] == "1":
                total += words[k : k + size] * weights[k]
        at = np.flatnonzero(text[:size] == text[span - 1 :])
        yield at, _mixed(total[at])


def whole_masks(lengths: Iterable[int]) -> dict[int, str]:
    """Masks for the whole sequences of items with so few words, by their numbers."""
    return {len(MASKS) + n: "1" * n for n in sorted(lengths)}


def item_seeds(items: DataFrame) -> DataFrame:
    """``seed, item_id, at`` of every seed of every item."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, cuts, words, text in text_words(batch.column(1)):
                found = list(seeds(words, text))
                n_words = np.diff(cuts)
                for number, mask in whole_masks(range(1, SHORTEST)).items():
                    for at, hashes in seeds(words, text, {number: mask}):
                        all_of_it = n_words[text[at]] == len(mask)
                        found.append((at[all_of_it], hashes[all_of_it]))
                for at, hashes in found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(hashes.view(np.int64)),
                            pa.array(ids[row + text[at]]),
                            pa.array((at - cuts[text[at]]).astype(np.int32)),
                        ],
                        ["seed", "item_id", "at"],
                    )

    return items.mapInArrow(make, "seed long, item_id long, at int").distinct()


def item_words(items: DataFrame) -> DataFrame:
    """``item_id, words`` with the hashes of the words as bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, cuts, words, _ in text_words(batch.column(1)):
                values = [words[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(values)), pa.array(values, pa.binary())],
                    ["item_id", "words"],
                )

    return items.mapInArrow(make, "item_id long, words binary")


def hit_regions(documents: DataFrame, known: Membership, short: Iterable[int] = ()) -> DataFrame:
    """Stretches of the documents around words whose seeds an item may have.

    ``short`` are the lengths of the items that are shorter than a mask.
    """
    masks = dict(enumerate(MASKS)) | whole_masks(short)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, cuts, words, text in text_words(batch.column(1)):
                hits = [(at[m], h[m]) for at, h in seeds(words, text, masks) for m in [known.holds(h)]]
                if not hits or not sum(len(at) for at, _ in hits):
                    continue
                at = np.concatenate([a for a, _ in hits])
                hashes = np.concatenate([h for _, h in hits])
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                breaks = (np.diff(at) > 2 * REACH) | (np.diff(text[at]) > 0)
                edges = np.concatenate([[0], np.flatnonzero(breaks) + 1, [len(at)]])
                rows = []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    number = text[at[a]]
                    low = max(cuts[number], at[a] - REACH)
                    high = min(cuts[number + 1], at[b - 1] + REACH)
                    rows.append(
                        (
                            int(ids[row + number]),
                            int(low - cuts[number]),
                            words[low:high].tobytes(),
                            hashes[a:b].view(np.int64),
                            (at[a:b] - cuts[number]).astype(np.int32),
                        )
                    )
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["doc_id", "low", "words", "seeds", "places"],
                )

    return documents.mapInArrow(
        find, "doc_id long, low int, words binary, seeds array<long>, places array<int>"
    )


def best_overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, length and equal words of the best stretch of an alignment."""
    scores = np.concatenate([[0], np.cumsum(np.where(equal, 1, -SUBSTITUTION))])
    lowest = np.minimum.accumulate(scores)
    end = int(np.argmax(scores - lowest))
    start = int(np.flatnonzero(scores[: end + 1] == lowest[end])[-1])
    return start, end - start, int(equal[start:end].sum())


def accepted_overlap(equal: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """Start, length and equal words of the accepted stretch with the most equal words, if any.

    A stretch is accepted with ``least`` equal words that are MIN_SHARE of its
    words. At 80 %, equal words gain 1 and others cost 4; for each end the first
    start whose sum is no higher gives the most equal words. Ties: the first end.
    """
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MIN_SHARE_COST))])
    same = np.concatenate([[0], np.cumsum(equal)])
    first = np.searchsorted(-np.minimum.accumulate(sums), -sums, side="left")
    held = same - same[first]
    end = int(np.argmax(held))
    if held[end] < max(1, least):
        return None
    start = int(first[end])
    start += int(np.argmax(equal[start:]))
    return start, end - start, int(held[end])


def _verified(aligned: DataFrame) -> DataFrame:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], np.uint64)
                item = np.frombuffer(row["item"], np.uint64)
                shift = row["diagonal"] - row["low"]
                first, last = max(0, -shift), min(len(item), len(words) - shift)
                if last <= first:
                    continue
                equal = words[first + shift : last + shift] == item[first:last]
                found = accepted_overlap(equal, least_equal(len(item)))
                if found:
                    start, length, same = found
                    place = row["diagonal"] + first + start
                    out.append((row["doc_id"], row["item_id"], place, length, same))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    ["doc_id", "item_id", "word", "n_words", "n_equal"],
                )

    return aligned.mapInArrow(
        verify, "doc_id long, item_id long, word int, n_words int, n_equal int"
    )


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, word, n_words, n_equal``: the stretches that documents share with items.

    Documents are read once. Only stretches around a seed that is in a bitmap of
    all item seeds go on; their seeds are joined with the items', and each
    alignment found is scored word by word. Frequent passages are hot on the
    join's keys and are dealt out.
    """
    spark = documents.sparkSession
    named = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), "text"
    )
    items = cut_lineage(
        item_words(named).groupBy("words").agg(F.min("item_id").alias("item_id")), "items"
    )
    wanted = named.join(items.select("item_id"), "item_id", "left_semi")
    known = cut_lineage(item_seeds(wanted), "seeds")
    docs = documents.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    n_words = F.octet_length("words") / 8
    short = items.where((n_words > 0) & (n_words < SHORTEST)).select(n_words.cast("int").alias("n"))
    lengths = [r["n"] for r in short.distinct().collect()]
    members = Membership(known, "seed", SEED_BITS, hashed=True)
    regions = cut_lineage(hit_regions(docs, members, lengths), "regions")
    hits = regions.select(
        "doc_id", "low", F.explode(F.arrays_zip("seeds", "places")).alias("hit")
    ).select("doc_id", "low", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("place"))
    at_hits = new_path(spark, "hits")
    met = spread_join(write_table(hits, at_hits), known, ["seed"], "doc_id")
    diagonals = cut_lineage(
        met.select("doc_id", "low", "item_id", (F.col("place") - F.col("at")).alias("diagonal")).distinct(),
        "diagonals",
    )
    drop_table(spark, at_hits)
    held = spread_join(
        diagonals, items.select("item_id", F.col("words").alias("item")), ["item_id"], "doc_id"
    )
    aligned = held.join(regions.select("doc_id", "low", "words"), ["doc_id", "low"])
    return _verified(aligned.select("doc_id", "low", "item_id", "diagonal", "item", "words")).distinct()


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, item_id, n_equal`` of every row of the documents.

    ``item_id`` is the item with the most equal words in one stretch, the
    smallest id among equals; NULL where there is none.
    """
    found = cut_lineage(overlaps(documents, benchmark), "overlaps")
    best = found.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"),
        F.max_by("item_id", F.struct("n_equal", -F.col("item_id"))).alias("item_id"),
        F.max("n_equal").cast("long").alias("n_equal"),
    )
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(best, "doc_id", "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "item_id",
        F.coalesce("n_equal", F.lit(0)).alias("n_equal"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; the columns given."""
    found = cut_lineage(
        overlaps(documents, benchmark).select(F.col("doc_id").alias("_held")).distinct(), "held"
    )
    return documents.join(found, documents["doc_id"].cast("long") == found["_held"], "left_anti")
