"""Mixing sources to target weights by soft membership.

A classifier, fitted to labelled documents, gives every document a posterior
over the domains. A nonnegative rate for each document is then fitted by least
squares, so that the expected tokens of each domain, ``sum(rate * tokens *
posterior)``, match the targets; a small weight on ``tokens * (rate - 1)^2``
makes the rates unique, and keeps them moderate where no rates meet the targets.

NULL and empty texts have no tokens, a posterior from the intercept alone, and
change no total. Rows are mixed one by one, so a repeated row counts again.
Columns named like the ones added are replaced, others are untouched. An empty
table stays empty; without any labelled text the domains of the targets are
taken to be equally likely.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspring.llm.tokens import LOWER, pieces, word_hashes, word_spans
from labelspring.sources.scratch import cut_lineage

#: The classifier is fitted to at most so many labelled rows, the first by a hash of the id.
FIT_ROWS = 10_000
#: Buckets that words are hashed to.
FEATURES = 512
STEPS, RATE, DECAY = 300, 4.0, 1e-4
#: Weight of the rates' distance from 1 against a domain's miss as a share of its target, at
#: first and at least; it shrinks tenfold until every miss is below TOLERANCE of its target.
RIDGE, LEAST_RIDGE, TOLERANCE = 1e-3, 1e-10, 0.005
#: Passes over the posteriors, and the relative gradient at which they end.
PASSES, CLOSE = 40, 1e-9


@dataclass
class DomainModel:
    """Softmax regression on the square roots of hashed word shares."""

    domains: list[str]
    weights: np.ndarray

    def posteriors(self, features: np.ndarray) -> np.ndarray:
        logits = features @ self.weights[:-1] + self.weights[-1]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def text_features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each piece the first row, the features of its rows and their numbers of words."""
    for row, data, offsets in pieces(texts):
        lowered = LOWER[data]
        start, end, text = word_spans(lowered, offsets)
        rows = len(offsets) - 1
        bucket = (word_hashes(lowered, start, end) % np.uint64(FEATURES)).astype(np.int64)
        counts = np.bincount(text * FEATURES + bucket, minlength=rows * FEATURES)
        n_words = np.bincount(text, minlength=rows)
        shares = counts.reshape(rows, FEATURES) / np.maximum(n_words, 1)[:, None]
        yield row, np.sqrt(shares), n_words


def fit_domains(documents: DataFrame, labelled: DataFrame, domains: list[str]) -> DomainModel:
    """Fit the classifier to ``doc_id, domain``; domains that are not named are left out."""
    chosen = (
        labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), "domain")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "domain")
        .limit(FIT_ROWS)
    )
    chosen = cut_lineage(chosen, "chosen")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), "doc_id"
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, features, _ in text_features(batch.column("text")):
                packed = [x.astype(np.float32).tobytes() for x in features]
                part = batch.slice(row, len(packed))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("domain"), pa.array(packed, pa.binary())],
                    ["doc_id", "domain", "features"],
                )

    table = (
        rows.mapInArrow(encode, "doc_id long, domain string, features binary")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("domain", "ascending"), ("features", "ascending")])
    )
    weights = np.zeros((FEATURES + 1, len(domains)))
    if table.num_rows:
        x = np.frombuffer(b"".join(table["features"].to_pylist()), np.float32)
        x = x.reshape(-1, FEATURES).astype(np.float64)
        y = np.array([domains.index(d) for d in table["domain"].to_pylist()])
        weights = fit_softmax(x, np.eye(len(domains))[y])
    return DomainModel(domains, weights)


def fit_softmax(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, as the last row, intercepts, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = ahead = np.zeros((x.shape[1], y.shape[1]))
    for step in range(STEPS):
        logits = x @ ahead
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        moved = ahead - RATE / 4 * (x.T @ (p - y) / len(x) + DECAY * ahead)
        ahead = moved + step / (step + 3) * (moved - w)
        w = moved
    return w


def rates(posteriors: np.ndarray, push: np.ndarray) -> np.ndarray:
    """The rates that the domains' push gives, projected on what is not negative."""
    return np.maximum(0.0, 1.0 - posteriors @ push)


def _totals(members: DataFrame, push: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """In one pass: ``sum(n r^2)``, expected tokens of the domains, and their derivatives."""
    k = len(push)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, total, slope = 0.0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            r = rates(p, push)
            square += float((n * r) @ r)
            total += (r * n) @ p
            slope += (p * (n * (r > 0))[:, None]).T @ p
        values = np.concatenate([[square], total, slope.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["cell", "value"]
        )

    sums = members.mapInArrow(partial, "cell int, value double").groupBy("cell").agg(
        F.sum("value").alias("value")
    )
    values = np.zeros(1 + k + k * k)
    for row in sums.collect():
        values[row["cell"]] = row["value"]
    return float(values[0]), values[1 : 1 + k], values[1 + k :].reshape(k, k)


def weighed(targets: np.ndarray, ridge: float) -> np.ndarray:
    """A domain's own ridge: its target, or a millionth of all where it has none, times ``ridge``."""
    return ridge * np.maximum(targets, max(float(targets.sum()), 1.0) * 1e-6)


def solve_rates(
    members: DataFrame, targets: np.ndarray, ridge: np.ndarray, push: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The domains' push whose rates solve the least squares, and the expected tokens there.

    The gradient for a document depends on its posteriors and on the domains'
    misses alone, so the rates are a projection of ``1 - posterior @ push``.
    Each pass takes the gradient of all documents at once, scaled by the active
    documents' second moments, and halves the step while the objective does not
    fall. The driver sees sums by domain and pair of domains.
    """
    square, total, slope = _totals(members, push)

    def objective(at: np.ndarray, squares: float) -> float:
        return float(ridge @ (at * at) / 2 + squares / 2 + targets @ at)

    value, size = objective(push, square), 1.0
    step = None
    for _ in range(PASSES):
        gradient = ridge * push - total + targets
        if step is None:
            step = np.linalg.solve(slope + np.diag(ridge), gradient)
        if np.abs(gradient).sum() <= CLOSE * max(float(targets.sum()), 1.0):
            break
        moved = push - size * step
        squares, found, curved = _totals(members, moved)
        if objective(moved, squares) <= value - 1e-4 * size * float(gradient @ step):
            push, total, slope, value = moved, found, curved, objective(moved, squares)
            step, size = None, 1.0
        else:
            size /= 2
            if size < 1e-6:
                break
    return push, total


def fit_rates(members: DataFrame, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The push whose rates meet the targets, the expected tokens, and the worst relative miss.

    Each domain's miss is weighed by its target. The weight of the rates' distance
    from 1 shrinks until every domain is within TOLERANCE of its target. Where a
    tenth of it does not halve the worst miss, the targets are out of reach of any
    rates: then the last rates that did are taken, and a warning tells the miss.
    """
    push, ridge, best = np.zeros(len(targets)), RIDGE, None
    while ridge >= LEAST_RIDGE:
        push, total = solve_rates(members, targets, weighed(targets, ridge), push)
        miss = float((np.abs(total - targets) / weighed(targets, 1.0)).max())
        if best is not None and miss > best[2] / 2:
            break
        best = push, total, miss
        if miss <= TOLERANCE or not targets.sum():
            return best
        ridge /= 10
    warnings.warn(f"no rates meet the targets: a domain misses its own by {best[2]:.2%}", stacklevel=2)
    return best


def with_posteriors(
    documents: DataFrame, model: DomainModel, push: np.ndarray | None = None
) -> DataFrame:
    """Add ``n_tokens`` and ``posterior`` (in the order of the domains), and ``rate`` on request."""
    added = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("posterior", T.ArrayType(T.DoubleType())),
    ]
    if push is not None:
        added.append(T.StructField("rate", T.DoubleType()))
    names = [f.name for f in added]
    rows = documents.drop(*names)
    k = len(model.domains)
    schema = T.StructType([*rows.schema.fields, *added])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, features, n_words in text_features(batch.column("text")):
                p = model.posteriors(features)
                part = batch.slice(row, len(p))
                flat = pa.array(p.ravel())
                at = pa.array(np.arange(0, len(flat) + 1, k, dtype=np.int32))
                columns = [pa.array(n_words.astype(np.int64)), pa.ListArray.from_arrays(at, flat)]
                if push is not None:
                    columns.append(pa.array(rates(p, push)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *columns], [*part.schema.names, *names]
                )

    return rows.mapInArrow(score, schema)


def mixed(documents: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The documents with ``n_tokens``, ``posterior`` and ``rate``.

    ``labelled`` has ``doc_id, domain``; ``weights`` names the domains and their
    shares of the mixed tokens, of which there are to be as many as now. A
    document is to be read ``rate`` times in expectation; 0 leaves it out. Every
    domain's expected tokens are within TOLERANCE of its target, or a warning
    tells by how much they miss it.
    """
    domains = list(weights)
    model = fit_domains(documents, labelled, domains)
    members = cut_lineage(
        with_posteriors(documents.select("text"), model).select("n_tokens", "posterior"), "members"
    )
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    shares = np.array([weights[d] for d in domains], np.float64)
    push, _, _ = fit_rates(members, shares / shares.sum() * total)
    return with_posteriors(documents, model, push)
