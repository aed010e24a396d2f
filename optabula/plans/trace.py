"""Iteration traces and fit results as tables."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .journal import Entries

TRACE_SCHEMA = """
    run_id string, method string, iteration int, n_eval int, elapsed_seconds double,
    iter_seconds double, rho double, dual_residual double, dual_tol double,
    primal_residual double, primal_tol double, inner_tol double, unsolved_blocks double,
    objective double,
    model array<double>
"""
SUMMARY_SCHEMA = """
    run_id string, method string, init_seconds double, total_seconds double,
    iterations int, n_eval int, converged boolean, stop_reason string, objective double,
    expected array<double>, final array<double>
"""
TRACE_COLUMNS = [part.split()[0] for part in TRACE_SCHEMA.split(",")]


@dataclass
class Trace:
    """One row per iteration: all on the driver, or the last one if a journal takes them."""

    run_id: str
    method: str
    start: float = field(default_factory=time.perf_counter)
    init_seconds: float = 0.0
    rows: list = field(default_factory=list)
    journal: Entries | None = None
    iterations: int = 0
    n_eval: int = 0
    earlier_seconds: float = 0.0

    def ready(self) -> None:
        """Marks the end of initialization."""
        self.init_seconds = time.perf_counter() - self.start

    def keep_in(self, journal: Entries | None) -> dict | None:
        """Writes to a journal from now on; gives the last iteration of a run that goes on."""
        self.journal = journal
        last = None if journal is None else journal.last.get(self.run_id)
        if last is not None:
            self.iterations, self.n_eval = journal.counts[self.run_id]
            self.earlier_seconds = last["elapsed_seconds"]
            self.rows = [last] if last["iteration"] > 0 else []
        return last

    def add(self, iteration: int, model, objective=None, n_eval: int = 1, timed: bool = True,
            state: dict | None = None, **values) -> None:
        """Adds a row; ``model=None`` and ``timed=False`` leave what is not known NULL.

        ``state`` is what a journal keeps beside it: gradient, kept and dropped steps, numbers carried.
        """
        elapsed = self.earlier_seconds + time.perf_counter() - self.start - self.init_seconds
        before = max((r["elapsed_seconds"] or 0.0 for r in self.rows[-1:]), default=0.0)
        row = {
            "run_id": self.run_id, "method": self.method, "iteration": iteration,
            "n_eval": n_eval, "elapsed_seconds": elapsed if timed else None,
            "iter_seconds": elapsed - before if timed else None,
            "objective": None if objective is None else float(objective),
            "model": None if model is None else [float(v) for v in model],
        }
        row.update({k: None if v is None else float(v) for k, v in values.items()})
        self.iterations, self.n_eval = self.iterations + 1, self.n_eval + n_eval
        if self.journal is None:
            self.rows.append(row)
        else:
            self.rows = [row]
            self.journal.add(row | (state or {}))

    def frame(self, spark: SparkSession) -> DataFrame:
        if self.journal is not None:
            return self.journal.trace().where(F.col("run_id") == self.run_id)
        rows = [tuple(row.get(name) for name in TRACE_COLUMNS) for row in self.rows]
        return spark.createDataFrame(rows, TRACE_SCHEMA)


@dataclass
class Fit:
    """A fitted model: ``weights`` on the driver, everything else as tables on demand.

    ``converged`` is true only if the test that was asked for held at the end; ``stop_reason``
    says what ended the fit: that test (gradient, residuals, spark.ml), precision or iterations.
    """

    spark: SparkSession
    weights: np.ndarray
    trace_rows: Trace
    converged: bool
    objective: float | None = None
    expected: np.ndarray | None = None
    stop_reason: str | None = None

    @property
    def model(self) -> DataFrame:
        """(pos, weight, is_intercept)"""
        last = len(self.weights) - 1
        rows = [(i, float(w), i == last) for i, w in enumerate(self.weights)]
        return self.spark.createDataFrame(rows, "pos int, weight double, is_intercept boolean")

    @property
    def trace(self) -> DataFrame:
        return self.trace_rows.frame(self.spark)

    @property
    def summary(self) -> DataFrame:
        """One row: what a run cost and where it ended, next to the expected model."""
        rows = self.trace_rows.rows
        expected = None if self.expected is None else [float(v) for v in self.expected]
        row = (
            self.trace_rows.run_id, self.trace_rows.method, self.trace_rows.init_seconds,
            rows[-1]["elapsed_seconds"] if rows else 0.0, self.trace_rows.iterations,
            self.trace_rows.n_eval, self.converged,
            self.stop_reason, None if self.objective is None else float(self.objective),
            expected, [float(v) for v in self.weights],
        )
        return self.spark.createDataFrame([row], SUMMARY_SCHEMA)


def iteration_times(trace: DataFrame, run: str = "run_id", order: str = "iteration",
                    elapsed: str = "elapsed_seconds", out: str = "iter_seconds",
                    bucket_rows: int = 1 << 20) -> DataFrame:
    """Cumulative time -> time per iteration; the first of a run keeps its value.

    ``order`` is an integer, unique within a run. Runs are cut into buckets of at most
    ``bucket_rows`` rows, so a run holding most of the table is not sorted by one task: the
    lag is taken inside a bucket, and a bucket's first row sees the last value of the run's
    previous bucket.
    """
    bucketed = trace.withColumn("bucket", F.floor(F.col(order) / bucket_rows))
    inside = Window.partitionBy(run, "bucket").orderBy(order)
    across = Window.partitionBy(run).orderBy("bucket")
    carried = (
        bucketed.groupBy(run, "bucket").agg(F.max_by(elapsed, order).alias("last"))
        .select(run, "bucket", F.lag("last").over(across).alias("carried"))
    )
    before = F.coalesce("previous", "carried", F.lit(0.0))
    return (
        bucketed.withColumn("previous", F.lag(elapsed).over(inside))
        .join(carried, [run, "bucket"])
        .withColumn(out, F.col(elapsed) - before)
        .drop("bucket", "previous", "carried")
    )
