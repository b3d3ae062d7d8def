"""Steps of several runs, each done once for all runs that need it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Hashable
from threading import Lock
from typing import Any


class Steps:
    """Results by the kind of a step and all settings that it depends on.

    Runs ask for a step by :meth:`once`. The first to ask does it, in its own
    thread, and the others wait for it and read the same result: a table's path,
    a projection, a model. ``runs`` counts what was done, by kind.
    """

    def __init__(self):
        self.runs: Counter = Counter()
        self._results: dict[Hashable, Any] = {}
        self._locks: dict[Hashable, Lock] = {}
        self._guard = Lock()

    def once(self, kind: str, key: tuple, run: Callable[[], Any]) -> Any:
        at = (kind, *key)
        with self._guard:
            lock = self._locks.setdefault(at, Lock())
        with lock:
            if at not in self._results:
                result = run()
                with self._guard:
                    self._results[at] = result
                    self.runs[kind] += 1
            return self._results[at]

    def results(self, kind: str) -> list:
        """All results of a kind."""
        with self._guard:
            return [result for at, result in self._results.items() if at[0] == kind]
