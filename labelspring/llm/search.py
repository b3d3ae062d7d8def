"""Ranked lexical search by bit-sliced Bloom signatures.

Every document is a row of a Bloom signature: a bit pattern that holds each of its
terms, once for each level that the term's number of occurrences reaches. The rows
of a block of documents are stored by bit position, so that the bits a term needs
are a few slices of the block, and their conjunction says which documents may have
the term, and how often at most. Sums of the terms' weights over these slices bound
every document's score from above. The best bounds are scored exactly, which gives
each item a score to reach; every document that cannot be proved to stay below it
is then scored exactly too. So the result is exact, whatever the signatures let by.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspring.llm.shared import Membership, Workspace, thinned, union_all
from labelspring.llm.tokens import _mixed

#: Bits of a signature for each key of the document, at least, and bits that a key sets.
BITS_A_KEY, HASHES = 12, 3
#: A signature has between 2^8 and 2^21 bits; a text with more keys is bounded less tightly.
LEAST_WIDTH, MOST_WIDTH = 1 << 8, 1 << 21
#: Bits of a block of signatures.
BLOCK_BITS = 1 << 23
#: Pairs of item and term that are searched at once; further items follow in blocks.
PAIRS_AT_ONCE = 1 << 19
#: Terms that are bounded at once in a task.
TERMS_AT_ONCE = 1024
#: Candidate documents are broadcast up to this many, and joined by shuffle beyond it.
BROADCAST_DOCUMENTS = 200_000

#: Numbers of occurrences that have a key of their own: all to 4, then two in each doubling.
LEVELS = [1, 2, 3, *(2**e // 2 * h for e in range(2, 21) for h in (2, 3))]

#: Everything but letters, digits and non-ASCII bytes parts terms; A to Z are lower-cased.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]")
_PARTED = bytes(
    (b + 32 if 65 <= b <= 90 else b) if _TERM.match(bytes([b])) else 32 for b in range(256)
)
#: Stands for a null id: after all others.
LAST = (1 << 63) - 1

INDEX_SCHEMA = "width int, n_docs long, n_terms long, ids array<long>, lengths array<long>, slices binary"


def terms_of(text: bytes) -> Counter:
    """Occurrences of each term of a whole text."""
    return Counter(text.translate(_PARTED).split())


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column:
        buffer = value.as_buffer()
        yield buffer.to_pybytes() if buffer is not None else b""


class _TermHashes(dict):
    """64-bit hashes of terms, the last million of them remembered."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[term] = found = xxhash.xxh3_64_intdigest(term)
        return found


def key_hashes(terms: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Hashes of (term, level) keys from the terms' hashes and the levels' places."""
    return _mixed(terms + level.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def places(keys: np.ndarray, width: int) -> np.ndarray:
    """The bits that each key sets in a signature: one row of positions for each hash."""
    shifts = np.arange(HASHES, dtype=np.uint64)[:, None] * np.uint64(21)
    return ((keys[None, :] >> shifts) & np.uint64(width - 1)).astype(np.int64)


def document_keys(counts: Counter, hashes: _TermHashes) -> np.ndarray:
    """Key hashes of one document: each term with every level that its occurrences reach."""
    terms = np.fromiter(map(hashes.__getitem__, counts), np.uint64, len(counts))
    often = np.fromiter(counts.values(), np.int64, len(counts))
    reached = np.searchsorted(LEVELS, often, side="right")
    level = np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached)
    return key_hashes(np.repeat(terms, reached), level)


def signature_index(documents: DataFrame) -> DataFrame:
    """Blocks of bit-sliced signatures of all documents that have a term.

    A block holds documents of one width, so that long texts do not fill up the
    signatures of short ones, and a task holds one open block for each width.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, opened = _TermHashes(), {}

        def closed(width: int) -> pa.RecordBatch:
            rows = opened.pop(width)
            bits = np.zeros((width, len(rows)), bool)
            for row, (_, _, keys) in enumerate(rows):
                bits[places(keys, width), row] = True
            ids, lengths = [r[0] for r in rows], [r[1] for r in rows]
            columns = [[width], [len(rows)], [sum(lengths)], [ids], [lengths], [np.packbits(bits, axis=1).tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["width", "n_docs", "n_terms", "ids", "lengths", "slices"]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                counts = terms_of(text)
                if not counts:
                    continue
                keys = document_keys(counts, hashes)
                width = 1 << (BITS_A_KEY * len(keys) - 1).bit_length()
                width = min(max(width, LEAST_WIDTH), MOST_WIDTH)
                rows = opened.setdefault(width, [])
                rows.append((at, counts.total(), keys))
                if len(rows) * width >= BLOCK_BITS:
                    yield closed(width)
        for width in sorted(opened):
            yield closed(width)

    return _keyed(documents).select("_doc", "text").mapInArrow(build, INDEX_SCHEMA)


def _keyed(documents: DataFrame) -> DataFrame:
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), at.alias("_doc"), "text")


@dataclass
class Queries:
    """A block of items: for each the places of its terms in ``terms``, with their weights."""

    items: list
    terms: list[bytes]
    members: list[np.ndarray]
    weights: np.ndarray
    n_docs: int
    n_terms: int
    k: int

    def groups(self) -> Iterator[tuple[list[int], np.ndarray]]:
        """Runs of items with about TERMS_AT_ONCE terms, and the terms of each run."""
        run, held = [], set()
        for item, members in enumerate(self.members):
            if run and len(held.union(members)) > TERMS_AT_ONCE:
                yield run, np.array(sorted(held), np.int64)
                run, held = [], set()
            run.append(item)
            held.update(members.tolist())
        if run:
            yield run, np.array(sorted(held), np.int64)

    def norm(self, lengths):
        return 10 + (90 * lengths * self.n_docs) // self.n_terms

    def score(self, item: int, counts: Counter, norm: int) -> int:
        """The exact score of a document with these terms."""
        total = 0
        for at in self.members[item]:
            often = counts.get(self.terms[at])
            if often:
                total += int(self.weights[at]) * (1_000_000_000 * often // (1000 * often + 8 * norm))
        return total


def _item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: the distinct terms of each item; rows with one id are one item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(terms_of(text)) for text in _texts(batch.column("text"))]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            ids = batch.column("item_id").take(pa.array(at, pa.int64()))
            terms = pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, terms], ["item_id", "term"])

    rows = items.select("item_id", "text")
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(split, f"item_id {kind}, term string").distinct()


def _document_frequency(documents: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the terms; a task sends one row for each that it met."""
    sent = documents.sparkSession.sparkContext.broadcast(frozenset(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in _texts(batch.column("text")):
                found.update(sent.value.intersection(text.translate(_PARTED).split()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())],
            ["term", "n"],
        )

    rows = documents.select("text").mapInArrow(count, "term string, n long")
    table = rows.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sent.unpersist()
    return {t.encode(): n for t, n in zip(table["term"].to_pylist(), table["n"].to_pylist(), strict=True)}


def _bounds(
    queries: Queries, group: list[int], held: np.ndarray, width: int, lengths: np.ndarray, slices: bytes
) -> np.ndarray:
    """Upper bounds of the scores of a block's documents, one row for each item of the group."""
    size = len(lengths)
    bits = np.frombuffer(slices, np.uint8).reshape(width, -1)
    norm = queries.norm(lengths)
    hashes = np.array([xxhash.xxh3_64_intdigest(queries.terms[t]) for t in held], np.uint64)
    values = np.zeros((len(held), size), np.int64)
    alive = np.arange(len(held))
    for level in range(len(LEVELS)):
        where = places(key_hashes(hashes[alive], np.full(len(alive), level)), width)
        may = bits[where[0]]
        for row in where[1:]:
            may &= bits[row]
        some = may.any(axis=1)
        alive, may = alive[some], may[some]
        if not len(alive):
            break
        holds = np.unpackbits(may, axis=1, count=size).view(bool)
        if level + 1 < len(LEVELS):
            often = LEVELS[level + 1] - 1
            most = 1_000_000_000 * often // (1000 * often + 8 * norm)
        else:
            most = np.full(size, 1_000_000)
        # A key of a higher level counts only where all lower ones are there.
        if level:
            holds &= before[some]
        before = holds
        values[alive] = np.where(holds, most * queries.weights[held[alive], None], values[alive])
    where = [np.searchsorted(held, queries.members[item]) for item in group]
    return np.stack([values[at].sum(axis=0) for at in where])


def _best_bounds(index: DataFrame, sent: Broadcast) -> DataFrame:
    """``_item, _doc``: in each task the k documents with the highest bounds for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        groups = list(queries.groups())
        for width, ids, lengths, slices in _blocks(batches):
            for group, held in groups:
                bounds = _bounds(queries, group, held, width, lengths, slices)
                for item, bound in zip(group, bounds, strict=True):
                    top = np.argpartition(-bound, min(queries.k, len(bound)) - 1)[: queries.k]
                    top = top[bound[top] > 0]
                    if item in best:
                        joined = np.concatenate([best[item][0], bound[top]]), np.concatenate([best[item][1], ids[top]])
                    else:
                        joined = bound[top], ids[top]
                    first = np.lexsort((joined[1], -joined[0]))[: queries.k]
                    best[item] = joined[0][first], joined[1][first]
        for item, (bound, at) in best.items():
            yield _pairs(np.full(len(at), item), at, bound)

    rows = index.mapInArrow(run, "_item int, _doc long, _bound long")
    order = Window.partitionBy("_item").orderBy(F.desc("_bound"), "_doc")
    return (
        rows.withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= sent.value.k)
        .select("_item", "_doc")
    )


def _not_excluded(index: DataFrame, sent: Broadcast, reach: dict[int, tuple[int, int]]) -> DataFrame:
    """``_item, _doc``: all documents whose bound does not keep them below the k-th found.

    ``reach`` holds score and document of an item's k-th exact result so far. A
    document with a lower bound is excluded, and so is one with an equal bound
    and a later id. It has at most one entry for each item of the block.
    """
    sent_reach = index.sparkSession.sparkContext.broadcast(reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        groups = list(queries.groups())
        for width, ids, lengths, slices in _blocks(batches):
            for group, held in groups:
                bounds = _bounds(queries, group, held, width, lengths, slices)
                for item, bound in zip(group, bounds, strict=True):
                    score, at = sent_reach.value.get(item, (0, -LAST - 1))
                    stays = (bound > score) | ((bound == score) & (ids <= at))
                    stays &= bound > 0
                    if stays.any():
                        yield _pairs(np.full(int(stays.sum()), item), ids[stays], bound[stays])

    return index.mapInArrow(run, "_item int, _doc long, _bound long").select("_item", "_doc")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield (
                batch.column("width")[row].as_py(),
                batch.column("ids")[row].values.to_numpy(),
                batch.column("lengths")[row].values.to_numpy(),
                batch.column("slices")[row].as_buffer(),
            )


def _pairs(items: np.ndarray, docs: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(items, pa.int32()), pa.array(docs, pa.int64()), pa.array(bounds, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["_item", "_doc", "_bound"])


def _scored(documents: DataFrame, pairs: DataFrame, sent: Broadcast) -> DataFrame:
    """``_item, _doc, doc_id, score``: exact scores of the pairs' documents, over whole texts.

    ``pairs`` is a written table. Documents that no pair names are let go before
    they are joined: by the ids themselves while these are few, and beyond that by
    a bitmap sized by their number, so that only candidates' texts are shuffled.
    """
    asked = pairs.groupBy("_doc").agg(F.collect_set("_item").alias("_items"))
    docs, n = _keyed(documents), pairs.select("_doc").distinct().count()
    if n <= BROADCAST_DOCUMENTS:
        asked = F.broadcast(asked)
    else:
        bits = 1 << max(23, (16 * n - 1).bit_length())
        docs = thinned(docs, Membership(pairs, "_doc", bits=min(bits, 1 << 30)), "_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        for batch in batches:
            row, item, score = [], [], []
            wanted = batch.column("_items").to_pylist()
            for at, (text, items) in enumerate(zip(_texts(batch.column("text")), wanted, strict=True)):
                counts = terms_of(text)
                norm = queries.norm(counts.total())
                for one in sorted(items):
                    row.append(at)
                    item.append(one)
                    score.append(queries.score(one, counts, norm))
            taken = batch.select(["_doc", "doc_id"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), *taken.columns, pa.array(score, pa.int64())],
                ["_item", "_doc", "doc_id", "score"],
            )

    rows = docs.join(asked, "_doc").select("_doc", "doc_id", "text", "_items")
    found = rows.mapInArrow(run, "_item int, _doc long, doc_id long, score long")
    return found.where("score > 0")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_item").orderBy(F.desc("score"), "_doc")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents for each item.

    ``documents`` has ``doc_id, text``, ``items`` has ``item_id, text``; whole texts
    count. The signatures are built once. Items are searched in blocks of about
    PAIRS_AT_ONCE terms, so what the driver and the tasks hold of them has a fixed
    size. Equal scores are ranked by ascending ``doc_id``.

    Null and empty texts hold no term: such a document is in no count and no
    result, such an item has no rows. A document without id ranks after equal ones;
    rows with one ``doc_id`` are documents of their own; rows with one ``item_id``,
    null included, are one item with the terms of all. A very long text has a wider
    signature and shares a block with its like. Other columns are not read. Without
    documents or items there are no rows.
    """
    spark = documents.sparkSession
    space = Workspace(spark)
    index = space.keep(signature_index(documents), "signatures")
    facts = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("terms")).first()
    pairs = space.keep(_item_terms(items), "item_terms")
    schema = items.select("item_id").schema["item_id"].dataType.simpleString()
    answer = f"item_id {schema}, rank int, doc_id long, score long"
    n_pairs = pairs.count()
    if not facts["n"] or not n_pairs:
        space.drop_all_but()
        return spark.createDataFrame([], answer)
    blocks = -(-n_pairs // PAIRS_AT_ONCE)
    results = []
    for block in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        grouped = mine.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
        table = grouped.orderBy("item_id").toArrow()
        if not table.num_rows:
            continue
        asked = [[t.encode() for t in terms] for terms in table["terms"].to_pylist()]
        terms = sorted({t for one in asked for t in one})
        at = {t: i for i, t in enumerate(terms)}
        frequency = _document_frequency(documents, terms)
        weights = [
            math.floor(1000 * math.log((2 * facts["n"] + 2) / (2 * frequency.get(t, 0) + 1)))
            for t in terms
        ]
        ids = table["item_id"].to_pylist()
        queries = Queries(
            ids,
            terms,
            [np.array(sorted(at[t] for t in one if t in frequency), np.int64) for one in asked],
            np.array(weights, np.int64),
            facts["n"],
            facts["terms"],
            k,
        )
        sent = spark.sparkContext.broadcast(queries)
        first = space.keep(_best_bounds(index, sent), "best_bounds")
        tops = _ranked(_scored(documents, first, sent), k).where(F.col("rank") == k)
        reach = {r["_item"]: (r["score"], r["_doc"]) for r in tops.collect()}
        rest = space.keep(_not_excluded(index, sent, reach), "not_excluded")
        best = space.keep(
            _ranked(_scored(documents, rest, sent), k).select("_item", "rank", "doc_id", "score"), "ranked"
        )
        names = spark.createDataFrame(
            [(i, one) for i, one in enumerate(ids)], f"_item int, item_id {schema}"
        )
        results.append(best.join(F.broadcast(names), "_item").select("item_id", "rank", "doc_id", "score"))
    space.drop_all_but("ranked")
    return union_all(results)
