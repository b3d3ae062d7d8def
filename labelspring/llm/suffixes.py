"""Removal of long repeated strings with a logarithmic family of suffix indexes.

Every text is its UTF-8 bytes, NULL is empty, and no match crosses documents. A
byte goes if a string of ``length`` bytes that covers it starts anywhere else
too, be it in the same text or in an equal row.

An array of all suffixes would take sixteen bytes for each byte of text. The
indexes here hold the suffixes at sampled places only: a string's anchor is the
least of the hashed 32-grams in its first 256 places. Equal strings have equal
anchors, so each string is found by the suffix at its anchor. What all strings
of one anchor share is the first ``length - 255`` bytes of that suffix; their
fingerprint is the order of the index. Batches of documents come one by one. A
new batch's suffixes are sorted, scanned against each level of the family for
fingerprints that both have, and merged with a level of equal size into the
next. Only anchors with a repeated fingerprint are looked at more closely: where
the strings of one anchor are not repeated as a whole, they get anchors among
their first 16 places, and then their own places.

Rows are told apart by their texts, so rows that repeat a ``doc_id`` or have none
are judged like any other; other columns are not looked at. An empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspring.llm.shared import Membership, Workspace, spread_join, thinned, union_all
from labelspring.llm.tokens import PIECE, pieces, powers, prefix_sums, span_hashes
from labelspring.sources.scratch import new_path, write_table

LENGTH = 400
GRAM = 32
#: The first places of a string in which its anchor lies, from coarse to fine.
PLACES = (256, 16, 1)
BATCHES = 4
_INDEX_BITS = 21
_INDEX = np.uint64((1 << _INDEX_BITS) - 1)

ANCHORS = "key binary, low int, high int, mark long, span long"


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.substring(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256), 1, 32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values, in time linear in their number."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(blocks, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:count], before[width - 1 : width - 1 + count])


def anchors_of(
    data: np.ndarray, offsets: np.ndarray, length: int, places: int
) -> tuple[np.ndarray, ...]:
    """Text number, first and last string start, mark and span of all anchors.

    ``mark`` is the hash of what all strings of ``length`` bytes with this anchor
    share, ``span`` of all that they cover together, by another family of hashes:
    a single string, where both are of the same bytes, has 128 bits.
    """
    none = tuple(np.zeros(0, t) for t in [np.int64] * 3 + [np.uint64] * 2)
    starts, ends = offsets[:-1], offsets[1:] - length + 1
    long = ends > starts
    if not long.any():
        return none
    sums = prefix_sums(data)
    grams = (sums[GRAM:] - sums[:-GRAM]) * powers(len(data) - GRAM + 1, back=True)
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0x9E3779B97F4A7C15)
    index = np.arange(len(grams), dtype=np.uint64)
    least = sliding_least((grams & ~_INDEX) | index, places)
    n = (ends - starts)[long]
    text = np.repeat(np.flatnonzero(long), n)
    begin = np.arange(n.sum()) + np.repeat(starts[long] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    anchor = (least[begin] & _INDEX).astype(np.int64)
    first = np.ones(len(anchor), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    runs = np.flatnonzero(first)
    last = np.concatenate([runs[1:], [len(anchor)]]) - 1
    at, text = anchor[runs], text[runs]
    low, high = begin[runs], begin[last]
    mark = span_hashes(sums, at, at + length - places + 1)
    span = span_hashes(prefix_sums(data, 1), low, high + length, 1)
    base = offsets[text]
    return text, low - base, high - base, mark, span


def suffix_anchors(texts: DataFrame, length: int) -> DataFrame:
    """The anchors of ``key, text``. A long text is worked on in overlapping stretches."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in pieces(batch.column(1)):
                for shift in range(0, max(1, len(data) if len(offsets) == 2 else 1), PIECE):
                    part, cuts = data, offsets
                    if len(offsets) == 2:
                        part = data[shift : shift + PIECE + length - 1]
                        cuts = np.array([0, len(part)])
                    text, low, high, mark, span = anchors_of(part, cuts, length, PLACES[0])
                    if not len(text):
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(row + text)),
                            *(pa.array((x + shift).astype(np.int32)) for x in (low, high)),
                            pa.array(mark.view(np.int64)),
                            pa.array(span.view(np.int64)),
                        ],
                        ["key", "low", "high", "mark", "span"],
                    )

    return texts.mapInArrow(find, ANCHORS)


class IndexFamily:
    """Levels of sorted suffix marks; level k holds 2^k batches."""

    def __init__(self, tables: Workspace):
        self.keep = tables.keep
        self.levels: list[tuple[int, DataFrame]] = []
        self.repeated: list[DataFrame] = []

    def _merge_equal(self) -> None:
        """Merge the two smallest levels while they are of one size."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one), (_, two) = self.levels.pop(), self.levels.pop()
            merged = one.unionByName(two).distinct().sortWithinPartitions("mark")
            self.levels.append((size + 1, self.keep(merged, "level")))

    def add(self, marks: DataFrame) -> None:
        """Sort a batch, and scan it against itself and all levels for marks seen before."""
        self._merge_equal()
        counted = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
        batch = self.keep(counted.sortWithinPartitions("mark"), "level")
        self.repeated.append(batch.where("n > 1").select("mark"))
        for _, level in self.levels:
            met = level.join(batch.select("mark"), "mark")
            self.repeated.append(self.keep(met, "seen"))
        self.levels.append((0, batch.select("mark")))

    def repeated_marks(self) -> DataFrame:
        return self.keep(union_all(self.repeated).distinct(), "repeated")


def finer_anchors(texts: DataFrame, length: int, places: int) -> DataFrame:
    """The anchors of the strings that start in ``lows``..``highs`` of ``key, text``.

    ``weights`` says how often a stretch counts: 2 if it is known to be repeated.
    """

    def flushed(keys: list, lows: list, weights: list, parts: list) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        text, low, high, mark, span = anchors_of(np.concatenate(parts), offsets, length, places)
        base = np.array(lows)[text]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.binary()).take(pa.array(text)),
                pa.array((low + base).astype(np.int32)),
                pa.array((high + base).astype(np.int32)),
                pa.array(mark.view(np.int64)),
                pa.array(span.view(np.int64)),
                pa.array(np.array(weights, np.int32)[text]),
            ],
            ["key", "low", "high", "mark", "span", "weight"],
        )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = ([], [], [], []), 0
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                data = np.frombuffer(row["text"].encode(), np.uint8)
                for low, high, weight in zip(row["lows"], row["highs"], row["weights"], strict=True):
                    part = data[low : high + length]
                    for values, value in zip(held, (row["key"], low, weight, part), strict=True):
                        values.append(value)
                    size += len(part)
                    if size > PIECE // 2:
                        yield flushed(*held)
                        held, size = ([], [], [], []), 0
            if size:
                yield flushed(*held)

    return texts.mapInArrow(find, f"{ANCHORS}, weight int")


def classes_of(anchors: DataFrame) -> DataFrame:
    """``mark, span, n`` and ``one``, a stretch of the class; ``n`` adds up the weights."""
    return anchors.groupBy("mark", "span").agg(
        F.sum("weight").alias("n"), F.min(F.struct("key", "low", "high")).alias("one")
    )


def undecided(classes: DataFrame) -> DataFrame:
    """``key, low, high, weight`` to be looked at in finer places.

    That is all classes of a repeated mark of which one class is alone, one
    stretch for each. One mark may have any share of the classes, so they are
    dealt out by their spans. ``classes`` is a written table.
    """
    marks = (
        classes.groupBy("mark")
        .agg(F.sum("n").alias("total"), F.min("n").alias("least"))
        .where("total > 1 and least = 1")
        .select("mark")
    )
    weight = F.least("n", F.lit(2)).cast("int").alias("weight")
    return spread_join(classes, marks, ["mark"], "span", "left_semi").select("one.*", weight)


def cleaned(texts: DataFrame, length: int) -> DataFrame:
    """``key, n_removed, n_spans, kept`` from ``text`` and the string starts ``lows``..``highs``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                data = np.frombuffer(batch.column("text")[k].as_py().encode(), np.uint8)
                low = batch.column("lows")[k].values.to_numpy(zero_copy_only=False)
                high = batch.column("highs")[k].values.to_numpy(zero_copy_only=False)
                edges = np.zeros(len(data) + 1, np.int64)
                np.add.at(edges, low, 1)
                np.add.at(edges, high + length, -1)
                gone = np.cumsum(edges[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((batch.column("key")[k].as_py(), int(gone.sum()), runs, data[~gone].tobytes()))
            if rows:
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["key", "n_removed", "n_spans", "kept"],
                )

    return texts.mapInArrow(cut, "key binary, n_removed long, n_spans long, kept binary")


def repeated_starts(
    tables: Workspace, texts: DataFrame, copied: DataFrame, length: int, batches: int
) -> tuple[DataFrame, DataFrame]:
    """``key, low, high``: starts of repeated strings of the texts that no other row equals.

    Also returns the texts that hold them, among others. ``texts`` has ``key,
    text`` of all rows, ``copied`` the keys that several rows have.
    """
    kept = tables.keep
    anchors = kept(suffix_anchors(texts, length), "anchors")
    family = IndexFamily(tables)
    number = F.pmod(F.xxhash64("key"), F.lit(batches))
    for k in range(batches):
        family.add(anchors.where(number == k).select("mark"))
    found = spread_join(anchors, family.repeated_marks(), ["mark"], "key")
    matched = kept(found.withColumn("weight", F.lit(1)), "matched")
    tables.drop("anchors", "level", "seen")

    equal = ["mark", "span"]
    classes = kept(classes_of(matched), "classes")
    whole = classes.where("n > 1").select(*equal)
    own = kept(spread_join(matched, copied, ["key"], "low", "left_anti"), "own")
    starts = [kept(spread_join(own, whole, equal, "key").select("key", "low", "high"), "resolved")]
    asked = kept(undecided(classes), "asked")
    tables.drop("matched", "own")

    keys = asked.select("key").union(starts[0].select("key"))
    members = Membership(keys.select(F.xxhash64("key").alias("h")), "h", hashed=True)
    some = thinned(texts.withColumn("_h", F.xxhash64("key")), members, "_h", hashed=True)
    some = kept(some.drop("_h").dropDuplicates(["key"]), "texts")
    for places in PLACES[1:]:
        lists = asked.groupBy("key").agg(
            *[F.collect_list(c).alias(f"{c}s") for c in ("low", "high", "weight")]
        )
        finer = kept(finer_anchors(some.join(lists, "key"), length, places), "finer")
        classes = kept(classes_of(finer), "classes")
        whole = classes.where("n > 1").select(*equal)
        found = spread_join(finer.where("weight = 1"), whole, equal, "key")
        starts.append(kept(found.select("key", "low", "high"), "resolved"))
        tables.drop("finer")
        if places != PLACES[-1]:
            asked = kept(undecided(classes), "asked")
    return union_all(starts), some


def _removal(documents: DataFrame, length: int, batches: int) -> tuple[DataFrame, DataFrame]:
    """The ids of all rows with their texts' keys, and what happens to the texts that lose bytes.

    Texts that several rows have are repeated from end to end. The others go
    through the index family. An anchor whose strings cover the same bytes as
    those of another anchor is decided at once. The rest, which stand at the ends
    of a match, get finer anchors together with one of each class that was
    decided, down to single strings. Text is read again only for documents with
    a match.
    """
    tables = Workspace(documents.sparkSession)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("key", text_key(F.col("text")))
    ids = tables.keep(
        rows.select(
            "doc_id",
            "key",
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha"),
        ),
        "ids",
    )
    copied = tables.keep(
        ids.where(F.col("n_bytes") >= length)
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("n_removed"))
        .where("n > 1")
        .drop("n"),
        "copied",
    )
    starts, some = repeated_starts(tables, rows.select("key", "text"), copied.select("key"), length, batches)
    lists = starts.groupBy("key").agg(
        F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")
    )
    cut = tables.keep(cleaned(some.join(lists, "key"), length), "cut")
    tables.drop_all_but("ids", "copied", "cut")
    gone = copied.select(
        "key", "n_removed", F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept")
    )
    return ids, cut.unionByName(gone)


def repeat_report(
    documents: DataFrame, length: int = LENGTH, batches: int = BATCHES
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    ids, cut = _removal(documents, length, batches)
    digests = cut.select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha"))
    found = spread_join(ids, digests, ["key"], "doc_id", "left")
    return found.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("cut_sha", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def without_repeats(
    documents: DataFrame, length: int = LENGTH, batches: int = BATCHES
) -> DataFrame:
    """``doc_id, kept`` of every document: the bytes that are left."""
    _, cut = _removal(documents, length, batches)
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), F.encode(text, "UTF-8").alias("raw")
    )
    rows = write_table(rows, new_path(spark, "rows"))
    found = spread_join(rows, cut.select("key", "kept"), ["key"], "doc_id", "left")
    return found.select("doc_id", F.coalesce("kept", "raw").alias("kept"))
