"""Runs over a grid of problems, settings and repetitions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trace import Fit


@dataclass(frozen=True)
class Problem:
    """Training rows, and the model that is to be found if known, of every repetition."""

    rows: Sequence[DataFrame]
    expected: Sequence[Sequence[float]] | None = None


@dataclass(frozen=True)
class Run:
    problem: str
    setting: str
    rep: int
    fit: Fit

    def keyed(self, table: DataFrame) -> DataFrame:
        return table.select(F.lit(self.problem).alias("problem"), F.lit(self.setting).alias("setting"),
                            F.lit(self.rep).alias("rep"), "*")


def run_sweep(problems: Mapping[str, DataFrame | Problem], settings: Mapping[str, Mapping],
              fit: Callable[..., Fit], repetitions: int = 1) -> list[Run]:
    """fit(rows, **setting) for every combination.

    A plain table is the same problem in all repetitions; a ``Problem`` has rows and expected
    model for each. A ``seed`` in a setting grows by one from repetition to repetition. Fits run
    one after the other, each using the whole cluster. For a grid of penalty weights on one
    problem, ``sgd_grid`` advances all of them in the same scans instead.
    """
    runs = []
    for name, given in problems.items():
        problem = given if isinstance(given, Problem) else Problem([given] * repetitions)
        if len(problem.rows) < repetitions:
            raise ValueError(f"problem {name} has rows for {len(problem.rows)} of {repetitions} repetitions")
        for setting, options in settings.items():
            for rep in range(1, repetitions + 1):
                seeded = {"seed": options["seed"] + rep - 1} if "seed" in options else {}
                found = fit(problem.rows[rep - 1], **{**options, **seeded},
                            run_id=f"{name}/{setting}/{rep}")
                if problem.expected is not None:
                    found.expected = np.asarray(problem.expected[rep - 1], dtype=float)
                runs.append(Run(name, setting, rep, found))
    if not runs:
        raise ValueError("empty sweep")
    return runs


def sweep(problems: Mapping[str, DataFrame | Problem], settings: Mapping[str, Mapping],
          fit: Callable[..., Fit], repetitions: int = 1) -> DataFrame:
    """The traces of ``run_sweep``, with columns problem, setting and rep."""
    return traces(run_sweep(problems, settings, fit, repetitions))


def traces(runs: Sequence[Run]) -> DataFrame:
    return union_all([run.keyed(run.fit.trace) for run in runs])


def summaries(runs: Sequence[Run]) -> DataFrame:
    """One row per run, with the expected model next to the final one."""
    return union_all([run.keyed(run.fit.summary) for run in runs])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
