"""Iterations appended to a table while a fit runs; a fit that was stopped goes on from the last one.

A journal is a folder: ``iterations`` grows by an append per iteration (or per ``every`` of them),
``objectives`` holds what is evaluated after the fit, and ``state-*`` the newest block state of a
consensus fit. The driver keeps the last iteration only. An append is one file and comes into place
whole, so a fit that dies at any point leaves complete iterations.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import exists, qualified, remove
from .trace import TRACE_COLUMNS, TRACE_SCHEMA

# What a solver needs to go on, next to the trace: see ``Trace.add``.
ENTRY_SCHEMA = TRACE_SCHEMA.rstrip() + """,
    gradient array<double>, kept boolean, dropped boolean, carried map<string,double>, settings string
"""
ENTRY_COLUMNS = [*TRACE_COLUMNS, "gradient", "kept", "dropped", "carried", "settings"]
OBJECTIVE_SCHEMA = "run_id string, iteration int, objective double"


@dataclass(frozen=True)
class Journal:
    """A folder that all executors share, and how many iterations an append takes.

    Give the same journal and ``run_id`` again to go on: the rows, the objective and the settings
    that shape an iterate must be those of the first call (settings are compared, rows are not);
    tolerances and the number of iterations may change. At most ``every`` iterations are lost
    when the driver dies. One fit at a time writes a run.
    """

    path: str
    every: int = 1


class Entries:
    """The open journal of runs that advance together."""

    def __init__(self, spark: SparkSession, journal: Journal | str, run_ids: Sequence[str], settings: Mapping):
        journal = Journal(journal) if isinstance(journal, str) else journal
        if journal.every < 1:
            raise ValueError("every must be at least 1")
        self.spark, self.run_ids = spark, list(run_ids)
        self.root = qualified(spark, journal.path).rstrip("/")
        self.settings = json.dumps(settings, sort_keys=True)
        self.every, self.batch = journal.every, journal.every * len(self.run_ids)
        self.buffer: list[dict] = []
        self.committed = -1
        self.last: dict[str, dict] = {}
        self.counts: dict[str, tuple[int, int]] = {}
        if exists(spark, self._table("iterations")):
            self._open()

    def _table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def rows(self) -> DataFrame:
        """Everything written for these runs, the start as iteration 0 included."""
        written = self.spark.read.schema(ENTRY_SCHEMA).parquet(self._table("iterations"))
        return written.where(F.col("run_id").isin(self.run_ids))

    def _open(self) -> None:
        found = self.rows().groupBy("run_id").agg(
            F.max("iteration").alias("last"), F.count(F.when(F.col("iteration") > 0, 1)).alias("n"),
            F.sum("n_eval").alias("n_eval"), F.max("settings").alias("settings")).collect()
        if not found:
            return
        if len(found) < len(self.run_ids) or len({r.last for r in found}) > 1:
            raise ValueError(f"{self.root} holds another set of runs")
        for r in found:
            if r.settings != self.settings:
                raise ValueError(
                    f"run {r.run_id} in {self.root} was fitted with {r.settings}, not {self.settings}")
        self.committed = found[0].last
        self.counts = {r.run_id: (r.n, r.n_eval) for r in found}
        self.last = {r.run_id: r.asDict() for r in self.rows().where(
            F.col("iteration") == self.committed).collect()}

    def begin(self, run_id: str, model, gradient=None, **carried: float) -> None:
        """The start of a run, as iteration 0; nothing for a run that goes on."""
        if run_id in self.last:
            return
        self.buffer.append({
            "run_id": run_id, "iteration": 0, "n_eval": 0, "elapsed_seconds": 0.0,
            "model": floats(model), "gradient": floats(gradient), "carried": carried or None,
            "settings": self.settings})
        if len(self.buffer) == len(self.run_ids):
            self.commit()

    def add(self, row: dict) -> None:
        self.buffer.append(row)
        if len(self.buffer) >= self.batch:
            self.commit()

    def commit(self) -> None:
        """Appends what is not written yet, as one file."""
        if not self.buffer:
            return
        rows = [tuple(row.get(name) for name in ENTRY_COLUMNS) for row in self.buffer]
        self.spark.createDataFrame(rows, ENTRY_SCHEMA).coalesce(1).write.mode("append").parquet(
            self._table("iterations"))
        self.committed = self.buffer[-1]["iteration"]
        self.buffer = []

    # What goes on -----------------------------------------------------------------------

    def steps(self, run_id: str, memory: int) -> list[dict]:
        """The iterations whose steps a quasi-Newton direction still remembers, oldest first.

        Flags of all iterations are read, but vectors of at most 2 * memory + 2.
        """
        run = self.rows().where(F.col("run_id") == run_id)
        flags = run.select("iteration", "kept", "dropped").orderBy(F.desc("iteration"))
        wanted, seen = {self.committed, self.committed - 1}, 0
        for r in flags.toLocalIterator():
            if r.kept and seen < memory:
                wanted |= {r.iteration, r.iteration - 1}
                seen += 1
            if r.dropped or seen == memory:
                break
        return [r.asDict() for r in run.where(F.col("iteration").isin(sorted(wanted))).select(
            "iteration", "model", "gradient", "kept", "dropped").orderBy("iteration").collect()]

    # Block state ------------------------------------------------------------------------

    def state_path(self, run_id: str, iteration: int) -> str:
        return self._table(f"state-{run_id.replace('/', '_')}-{iteration}")

    def keep_state(self, run_id: str, iteration: int):
        """For ``cut_and_sum``: the state goes to the journal instead of a checkpoint."""
        path = self.state_path(run_id, iteration)

        def keep(df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        return keep

    def read_state(self, run_id: str, iteration: int) -> DataFrame:
        return self.spark.read.parquet(self.state_path(run_id, iteration))

    def oldest_state(self, done: int) -> int:
        """The oldest iteration of which a fit that died after ``done`` may have left a state."""
        return max(0, done - self.every)

    def drop_states(self, run_id: str, first: int) -> int:
        """Removes states from ``first`` up to the last written iteration's; gives the oldest left."""
        for iteration in range(first, self.committed):
            remove(self.spark, self.state_path(run_id, iteration))
        return max(first, self.committed)

    # What is evaluated afterwards ---------------------------------------------------------

    def unevaluated(self, run_id: str, at_once: int) -> Iterator[tuple[list[int], np.ndarray]]:
        """Iterations without an objective and their models, at most ``at_once`` together."""
        todo = self.trace().where((F.col("run_id") == run_id) & F.col("objective").isNull())
        numbers = sorted(r.iteration for r in todo.select("iteration").collect())
        for lo in range(0, len(numbers), at_once):
            part = numbers[lo:lo + at_once]
            models = todo.where(F.col("iteration").between(part[0], part[-1])).orderBy("iteration")
            yield part, np.array([r.model for r in models.select("model").collect()])

    def add_objectives(self, run_id: str, iterations: Sequence[int], values: Sequence[float]) -> None:
        rows = [(run_id, k, float(v)) for k, v in zip(iterations, values)]
        self.spark.createDataFrame(rows, OBJECTIVE_SCHEMA).coalesce(1).write.mode("append").parquet(
            self._table("objectives"))

    def trace(self) -> DataFrame:
        """The trace of the runs so far, those of earlier sessions included."""
        rows = self.rows().where("iteration > 0").select(*TRACE_COLUMNS)
        if not exists(self.spark, self._table("objectives")):
            return rows
        later = self.spark.read.schema(OBJECTIVE_SCHEMA).parquet(self._table("objectives")).groupBy(
            "run_id", "iteration").agg(F.max("objective").alias("later"))
        return rows.join(later, ["run_id", "iteration"], "left").withColumn(
            "objective", F.coalesce("objective", "later")).select(*TRACE_COLUMNS)


def floats(vector) -> list[float] | None:
    return None if vector is None else [float(v) for v in vector]
