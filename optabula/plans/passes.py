"""What the driver-side solvers share: cached training rows and counted passes."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..cluster import scan_partitions
from ..operators.objectives import Objective, logistic_pass, objective_pass


def spread(df: DataFrame) -> DataFrame:
    """Spreads rows over all cores if they come from a scan of fewer partitions than cores.

    So few partitions mean a small table, so this shuffle is small too; a large table has
    more partitions than cores and passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    partitions = scan_partitions(df)
    small = partitions is not None and partitions < cores
    return df.repartition(cores) if small else df


@contextmanager
def held(df: DataFrame, features: str, label: str, cache: bool = True, *others: str):
    """The training columns, kept in memory (then on disk) for the length of an iterative fit.

    Rows the caller already caches are used as they are.
    """
    rows = df.select(features, label, *others)
    if not cache or df.storageLevel.useMemory or df.storageLevel.useDisk:
        yield rows
        return
    rows = spread(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def infer_width(df: DataFrame, features: str = "features") -> int:
    row = df.select(features).first()
    if row is None:
        raise ValueError("no training rows")
    return len(row[0])


class MeanObjective:
    """Mean loss over the rows; calling it with k models costs one pass.

    Logistic loss by default; any other is a function that runs in the tasks, see ``Objective``.
    """

    def __init__(self, df: DataFrame, features: str = "features", label: str = "label",
                 objective: Objective | None = None):
        self.rows, self.columns = df.select(features, label), {"features": features, "label": label}
        self.objective, self.passes = objective, 0

    def __call__(self, models):
        if self.objective is None:
            result = logistic_pass(self.rows, models, **self.columns)
        else:
            result = objective_pass(self.rows, models, self.objective, **self.columns)
        self.passes += 1
        return result.mean_loss, result.mean_grad


def penalized_mask(d: int, intercept: bool) -> np.ndarray:
    """1 for penalized coordinates; the intercept (last) is free."""
    mask = np.ones(d)
    if intercept:
        mask[-1] = 0.0
    return mask
