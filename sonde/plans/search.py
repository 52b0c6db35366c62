"""Random search over the detector's settings."""

from __future__ import annotations

import random
from collections.abc import Callable
from math import prod
from pathlib import Path

from sonde.sources.writers import write_json

#: Settings whose values may be given for each dataset.
BY_DATASET = {"min_similarity"}


class Grid:
    """Combinations of settings, each with a rank: the place it has when the last setting turns fastest."""

    def __init__(self, given: dict, dataset: str | None = None):
        chosen = {k: v.get(dataset) if k in BY_DATASET and isinstance(v, dict) else v for k, v in given.items()}
        self.values = {k: [*v] if isinstance(v, (list, tuple)) else [v] for k, v in chosen.items() if v is not None}

    def __len__(self) -> int:
        return prod(len(v) for v in self.values.values())

    def __getitem__(self, rank: int) -> dict:
        if not 0 <= rank < len(self):
            raise IndexError(rank)
        out = {}
        for name in reversed(self.values):
            rank, at = divmod(rank, len(self.values[name]))
            out[name] = self.values[name][at]
        return dict(reversed(out.items()))

    def drawn(self, runs: int, seed: int = 42) -> list[dict]:
        """All combinations if there are at most `runs`, else so many distinct ranks drawn at random."""
        ranks = range(len(self)) if len(self) <= runs else random.Random(seed).sample(range(len(self)), runs)
        return [self[r] for r in ranks]


def search(trial: Callable[[dict], dict], configs: list[dict], report: str | Path) -> dict:
    """Runs trial(config) for each; a trial returns metrics with `average_precision`.

    The report is written after every run. A run that fails is noted and the search goes on.
    """
    done: list[dict] = []
    best: dict | None = None
    for k, config in enumerate(configs, 1):
        try:
            run = {"run": k, "config": config, **trial(config)}
        except Exception as e:  # noqa: BLE001
            run = {"run": k, "config": config, "error": f"{type(e).__name__}: {e}"[:500]}
        done.append(run)
        good = run.get("average_precision")
        if good is not None and (best is None or good > best["average_precision"]):
            best = run
        write_json({"runs": done, "best": best}, report)
    return {"runs": done, "best": best}
