"""Settings of a run."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field, fields, replace

from labelspring.functions.keyed import DEFAULT_SEED
from labelspring.operators.minibatch import STEP_RATE, WARMUP
from labelspring.operators.models import FIT_PARTITIONS


@dataclass(frozen=True)
class Settings:
    model: str = "rf"
    model_params: dict = field(default_factory=dict)
    seed: int = DEFAULT_SEED

    # rows that fit the trees, all unless a bound is named, and the layout they are fitted in
    fit_rows: int | None = None
    fit_partitions: int = FIT_PARTITIONS

    # supervised fit of the projection, in every round
    fine_tune: bool = True
    pairs: int = 3000
    epochs: int = 3
    learning_rate: float = 2.0
    max_grad_norm: float = 1.0
    # pairs in a batch, for a step a batch in place of one an epoch, and their schedule
    pair_batch: int | None = None
    step_learning_rate: float = STEP_RATE
    warmup_steps: int = WARMUP

    # unsupervised fit before it: "none", once on "all" texts, or in each "fold"
    simcse: str = "none"
    simcse_epochs: int = 1
    simcse_batch: int = 32
    simcse_learning_rate: float = 0.2
    simcse_cache: str | None = None

    # pseudo-labels
    rounds: int = 2
    threshold: float = 0.85
    cap: int | dict | None = None

    # cuts of the score, for the metrics and for the written labels
    cv_cut: float = 0.5
    output_cut: float = 0.5

    # where the fitted projection and model of the final run are kept, if anywhere
    save_path: str | None = None

    folds: int = 5
    parallel_folds: int = 1

    def __post_init__(self):
        if self.simcse not in ("none", "all", "fold"):
            raise ValueError(f"simcse must be 'none', 'all' or 'fold', got {self.simcse!r}")
        if not 0.5 < self.threshold <= 1.0:
            raise ValueError(f"threshold must be in (0.5, 1], got {self.threshold}")

    def but(self, **changes) -> Settings:
        return replace(self, **changes)

    def overridden(self, assignments: list[str]) -> Settings:
        """Changed by texts ``KEY=VALUE``; a value is a Python literal, or else a text."""
        changes = {}
        for assignment in assignments:
            key, equals, value = assignment.partition("=")
            if not equals or key not in {f.name for f in fields(self)}:
                raise ValueError(f"{assignment!r} does not set a setting")
            try:
                changes[key] = ast.literal_eval(value)
            except (SyntaxError, ValueError):
                changes[key] = value
        return self.but(**changes)
