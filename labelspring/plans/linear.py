"""All folds of a linear model from sums that are taken away from each other.

A fold's training rows are all labelled rows less the fold, so one pass over the
labelled rows fits every fold. A round of self-training adds what each fold's
model is confident about: one pass over the unlabelled rows for all folds and all
thresholds, in which a row is scored by every model and added to its sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspring.operators.linear import (
    LinearModel,
    Moments,
    group_moments,
    pseudo_moments,
    solve_elastic,
)
from labelspring.plans.settings import Settings
from labelspring.plans.steps import Steps


def is_linear(settings: Settings, self_training: bool) -> bool:
    """Whether the folds can share passes: a linear model on vectors that all folds share.

    A cap on the pseudo-labels needs the rows in the order of their scores.
    """
    shared = settings.model == "elastic" and not settings.fine_tune and settings.simcse != "fold"
    return shared and not (self_training and settings.cap is not None)


def _sizes(fold: int, rnd: int, labelled: Moments, pseudo: Moments) -> tuple:
    n, added, positive = int(labelled.n), int(pseudo.n), int(pseudo.y)
    return fold, rnd, n + added, n, added, positive, added - positive


def fold_models(
    rows: DataFrame,
    unlabelled: DataFrame,
    variants: list[Settings],
    self_training: bool,
    width: int,
    steps: Steps,
) -> tuple[list[list[LinearModel]], list[list[tuple]]]:
    """For each of the settings the last model of each fold, and the sizes of the rounds.

    ``rows`` has ``fold, LABEL, feat``, ``unlabelled`` has ``feat``. The settings
    differ in threshold and rounds alone. A round in which a model is confident
    about no row leaves its training set as it is.
    """
    k, params = variants[0].folds, variants[0].model_params
    parts = group_moments(rows, F.array("fold"), k, width)
    steps.runs["labelled_passes"] += 1
    everything = reduce(Moments.__add__, parts)
    known = [everything - part for part in parts]
    first = [solve_elastic(sums, **params) for sums in known]
    steps.runs["fit"] += k
    models = [list(first) for _ in variants]
    extra = [[Moments.none(width)] * k for _ in variants]
    counts = [[] for _ in variants]
    last = [s.rounds if self_training else 0 for s in variants]
    for rnd in range(max(last) + 1):
        for v, rounds in enumerate(last):
            if self_training and rnd <= rounds:
                counts[v] += [_sizes(f, rnd, known[f], extra[v][f]) for f in range(k)]
        going = [(v, f) for v, rounds in enumerate(last) if rnd < rounds for f in range(k)]
        if not going:
            break
        asked = [models[v][f] for v, f in going]
        thresholds = [variants[v].threshold for v, _ in going]
        for (v, f), sums in zip(going, pseudo_moments(unlabelled, asked, thresholds), strict=True):
            if sums.n:
                extra[v][f] = sums
                models[v][f] = solve_elastic(known[f] + sums, **params)
                steps.runs["fit"] += 1
        steps.runs["unlabelled_passes"] += 1
    return models, counts


def split_models(
    rows: DataFrame, held: Column, groups: int, settings: Settings, width: int
) -> list[LinearModel]:
    """The model of each split, fitted on the rows that it does not hold out.

    ``held`` is an array of the splits that hold a row out. One pass over the rows.
    """
    members = F.concat(held, F.array(F.lit(groups)))
    *parts, everything = group_moments(rows, members, groups + 1, width)
    return [solve_elastic(everything - part, **settings.model_params) for part in parts]
