"""Masked pseudo-likelihood: each token predicted from both of its neighbours.

The network's entries are the most frequent lower-case words and, for all others,
hash buckets. Spark counts every (left, token, right) of the whole corpus; the
network is trained in numpy on these counts, so it sees each position, and its
result does not depend on how the rows are partitioned. Within a bucket each word
has a probability of its own: its share of the bucket's occurrences, or, where it
stands fewer than KEPT times in the corpus, the share of all such words times that
of its spelling. A document's score is the sum of the conditional log-probabilities
of its words.

NULL and empty texts have no tokens and the score 0. Rows are scored one by
one, so repeated rows score alike and count again in the corpus; a NULL
``doc_id`` is carried along. Other columns are not looked at. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.llm.tokens import LOWER, numbered, pieces, word_hashes, word_spans
from labelspring.sources.scratch import drop_table, new_path, write_table

#: Words with an entry of their own, and entries that the other words share.
TOP, SHARED = 96, 32
SIZE = TOP + SHARED
#: Stands on both ends of a text; it is a neighbour but never predicted.
EDGE = SIZE
CELLS = (SIZE + 1) ** 2 * SIZE
HIDDEN, EPOCHS, RATE = 24, 200, 0.05
#: Words that stand so often in the corpus keep a probability of their own; others are spelt.
KEPT = 5
#: Stands before the first and after the last byte of a spelt word.
BLANK = 256


def _spelt_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each piece: batch, first row, rows, word hashes, their texts, bytes, starts and ends."""
    for batch in batches:
        for row, data, offsets in pieces(batch.column(batch.schema.names.index("text"))):
            lowered = LOWER[data]
            start, end, text = word_spans(lowered, offsets)
            words = word_hashes(lowered, start, end)
            yield batch, row, len(offsets) - 1, words, text, lowered, start, end


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each piece: batch, first row, number of rows, word hashes, their texts."""
    for piece in _spelt_texts(batches):
        yield piece[:5]


def word_counts(documents: DataFrame) -> DataFrame:
    """``word, n`` of every word of the corpus, the word as its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, words, _ in _texts(batches):
            values, n = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"]
            )

    partial = documents.select("text").mapInArrow(count, "word long, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(documents: DataFrame) -> np.ndarray:
    """The hashes of the TOP most frequent words, sorted; the entry of a word is its place."""
    return _most_frequent(word_counts(documents))


def _most_frequent(counts: DataFrame) -> np.ndarray:
    rows = counts.orderBy(F.desc("n"), "word").limit(TOP).collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def entries(words: np.ndarray, top: np.ndarray) -> np.ndarray:
    out = TOP + (words % np.uint64(SHARED)).astype(np.int64)
    if len(top):
        place = np.minimum(np.searchsorted(top, words), len(top) - 1)
        out = np.where(top[place] == words, place, out)
    return out


def neighbours(tokens: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries to the left and to the right of each token, EDGE outside of the text."""
    left, right = np.full(len(tokens), EDGE), np.full(len(tokens), EDGE)
    same = text[1:] == text[:-1]
    left[1:] = np.where(same, tokens[:-1], EDGE)
    right[:-1] = np.where(same, tokens[1:], EDGE)
    return left, right


def window_counts(documents: DataFrame, top: np.ndarray) -> DataFrame:
    """``cell, n``: how often each token stands between each two neighbours in the corpus.

    A task adds up its texts in one array of fixed size, and Spark adds up the
    tasks' cells. There are at most CELLS of them, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for _, _, _, words, text in _texts(batches):
            tokens = entries(words, top)
            left, right = neighbours(tokens, text)
            values, n = np.unique((left * (SIZE + 1) + right) * SIZE + tokens, return_counts=True)
            total[values] += n
        used = np.flatnonzero(total)
        for at in range(0, len(used), 100_000):
            part = used[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(total[part])], ["cell", "n"]
            )

    partial = documents.select("text").mapInArrow(count, "cell int, n long")
    return partial.groupBy("cell").agg(F.sum("n").alias("n"))


@dataclass
class WindowNetwork:
    """Both neighbours' vectors, added, through tanh, to scores of all entries."""

    left: np.ndarray
    right: np.ndarray
    inner: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, bias: np.ndarray) -> WindowNetwork:
        def drawn(seed: int, *shape: int) -> np.ndarray:
            unit = numbered(seed, int(np.prod(shape))) >> np.uint64(40)
            return ((unit / 2.0**24 - 0.5) * 0.4).astype(np.float32).reshape(shape)

        return cls(
            drawn(31, SIZE + 1, HIDDEN),
            drawn(32, SIZE + 1, HIDDEN),
            np.zeros(HIDDEN, np.float32),
            drawn(33, HIDDEN, SIZE),
            bias.astype(np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.left, self.right, self.inner, self.out, self.bias]

    def hidden(self, windows: np.ndarray) -> np.ndarray:
        return np.tanh(self.left[windows // (SIZE + 1)] + self.right[windows % (SIZE + 1)] + self.inner)

    def log_probabilities(self, hidden: np.ndarray) -> np.ndarray:
        scores = hidden @ self.out + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def train(counts: np.ndarray, epochs: int = EPOCHS) -> WindowNetwork:
    """Maximise the mean log-probability of all counted positions, by Adam over all of them."""
    totals = counts.sum(axis=0, dtype=np.float64) + 0.5
    network = WindowNetwork.fresh(np.log(totals / totals.sum()))
    windows = np.flatnonzero(counts.sum(axis=1))
    if not len(windows):
        return network
    seen = counts[windows] / np.float32(counts.sum(dtype=np.float64))
    weight = seen.sum(axis=1, keepdims=True)
    first, second = ([np.zeros_like(p) for p in network.parts()] for _ in range(2))
    for epoch in range(1, epochs + 1):
        h = network.hidden(windows)
        error = weight * np.exp(network.log_probabilities(h)) - seen
        back = (error @ network.out.T) * (1 - h * h)
        left, right = np.zeros_like(network.left), np.zeros_like(network.right)
        np.add.at(left, windows // (SIZE + 1), back)
        np.add.at(right, windows % (SIZE + 1), back)
        gradients = [left, right, back.sum(axis=0), h.T @ error, error.sum(axis=0)]
        rate = RATE * (1 - 0.9 * epoch / epochs)
        for p, g, m, v in zip(network.parts(), gradients, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return network


def trained(counts: DataFrame, epochs: int = EPOCHS) -> WindowNetwork:
    """Train in one task, which gets the CELLS counts at most; the driver gets the weights."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.float32)
        for batch in batches:
            seen[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        network = train(seen.reshape((SIZE + 1) ** 2, SIZE), epochs)
        packed = [p.astype(np.float32).tobytes() for p in network.parts()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(packed)), pa.int32()), pa.array(packed, pa.binary())], ["part", "weights"]
        )

    rows = counts.repartition(1).mapInArrow(fit, "part int, weights binary").orderBy("part").collect()
    blank = WindowNetwork.fresh(np.zeros(SIZE))
    if not rows:
        return train(np.zeros(((SIZE + 1) ** 2, SIZE), np.float32))
    arrays = [
        np.frombuffer(r["weights"], np.float32).reshape(p.shape)
        for r, p in zip(rows, blank.parts(), strict=True)
    ]
    return WindowNetwork(*arrays)


def log_table(network: WindowNetwork) -> np.ndarray:
    """The log-probability of each entry between each two neighbours."""
    windows = np.arange((SIZE + 1) ** 2)
    return network.log_probabilities(network.hidden(windows)).astype(np.float32)


@dataclass
class Shares:
    """What each word has of its entry: kept words by their hash, the others by their spelling."""

    kept: np.ndarray
    share: np.ndarray
    rare: np.ndarray
    steps: np.ndarray | None = None

    def is_rare(self, words: np.ndarray) -> np.ndarray:
        if not len(self.kept):
            return np.ones(len(words), bool)
        place = np.minimum(np.searchsorted(self.kept, words), len(self.kept) - 1)
        return self.kept[place] != words

    def logs(self, words: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The log of each word's share of its entry."""
        out = np.zeros(len(words))
        rare = self.is_rare(words)
        out[~rare] = self.share[np.searchsorted(self.kept, words[~rare])]
        if rare.any():
            out[rare] = self.rare[(words[rare] % np.uint64(SHARED)).astype(np.int64)]
            out[rare] += spelling_logs(self.steps, data, start[rare], end[rare])
        return out


def spelling_logs(steps: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sums of the steps from byte to byte of words, both ends included."""
    sums = np.zeros(len(data))
    np.cumsum(steps[data[:-1], data[1:]], out=sums[1:])
    return steps[BLANK, data[start]] + sums[end - 1] - sums[start] + steps[data[end - 1], BLANK]


def word_shares(counts: DataFrame, top: np.ndarray) -> Shares:
    """The shares of all words of ``counts``, but for the steps of the spelling.

    A word of ``top`` is all of its entry. The kept words, at 16 bytes each, are
    at most a KEPT-th of the corpus' words, and grow with it.
    """
    others = counts.where(~F.col("word").isin(top.view(np.int64).tolist()))
    low = F.when(F.col("n") < KEPT, F.col("n")).otherwise(0)
    sums = others.groupBy(F.col("word").bitwiseAND(SHARED - 1).alias("bucket")).agg(
        F.sum("n").alias("n"), F.sum(low).alias("rare")
    )
    total, rare = np.ones(SHARED), np.ones(SHARED)
    for r in sums.collect():
        total[r["bucket"]], rare[r["bucket"]] = r["n"], max(1, r["rare"])
    kept = others.where(F.col("n") >= KEPT).toArrow()
    words = kept["word"].to_numpy().view(np.uint64)
    share = np.log(kept["n"].to_numpy() / total[(words % np.uint64(SHARED)).astype(np.int64)])
    words, share = np.concatenate([words, top]), np.concatenate([share, np.zeros(len(top))])
    order = np.argsort(words)
    return Shares(words[order], share[order].astype(np.float32), np.log(rare / total))


def spelling_steps(documents: DataFrame, shares: Shares) -> np.ndarray:
    """Log-probability of each byte after each other one, counted in all words that are not kept.

    The values are multiples of 2**-20, so that sums of them are exact in any order.
    """
    size = BLANK + 1
    sent = documents.sparkSession.sparkContext.broadcast(shares)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for _, _, _, words, _, data, start, end in _spelt_texts(batches):
            rare = sent.value.is_rare(words)
            if not rare.any():
                continue
            start, end = start[rare], end[rare]
            inner = np.zeros(len(data) + 1, np.int64)
            inner[start] += 1
            inner[end - 1] -= 1
            at = np.flatnonzero(np.cumsum(inner[:-1]))
            steps = [
                BLANK * size + data[start].astype(np.int64),
                data[at].astype(np.int64) * size + data[at + 1],
                data[end - 1].astype(np.int64) * size + BLANK,
            ]
            total += np.bincount(np.concatenate(steps), minlength=size * size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["step", "n"])

    partial = documents.select("text").mapInArrow(count, "step int, n long")
    seen = np.full(size * size, 0.5)
    for r in partial.groupBy("step").agg(F.sum("n").alias("n")).collect():
        seen[r["step"]] += r["n"]
    seen = seen.reshape(size, size)
    return np.round(np.log(seen / seen.sum(axis=1, keepdims=True)) * 2**20) / 2**20


def pseudo_likelihood(documents: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, per_token`` of every document.

    ``per_token`` is NULL where there are no tokens. The tasks get the weights, of
    fixed size, and tabulate the log-probabilities once each; and the kept words.
    """
    spark = documents.sparkSession
    at = new_path(spark, "words")
    counts = write_table(word_counts(documents), at)
    top = _most_frequent(counts)
    shares = word_shares(counts, top)
    drop_table(spark, at)
    shares.steps = spelling_steps(documents, shares)
    network = trained(window_counts(documents, top))
    sent = spark.sparkContext.broadcast((network, shares))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, shares = sent.value
        table = log_table(network).ravel()
        for batch, row, rows, words, text, data, start, end in _spelt_texts(batches):
            tokens = entries(words, top)
            left, right = neighbours(tokens, text)
            each = table[(left * (SIZE + 1) + right) * SIZE + tokens].astype(np.float64)
            each += shares.logs(words, data, start, end)
            total = np.bincount(text, weights=each, minlength=rows)
            n = np.bincount(text, minlength=rows)
            mean = pa.array(np.round(total / np.maximum(n, 1), 4), mask=n == 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, rows),
                    pa.array(n.astype(np.int64)),
                    pa.array(np.round(total, 3)),
                    mean,
                ],
                ["doc_id", "n_tokens", "log_likelihood", "per_token"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        score, "doc_id long, n_tokens long, log_likelihood double, per_token double"
    )
