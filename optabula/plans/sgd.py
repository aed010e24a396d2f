"""Proximal mini-batch gradient descent with step s / sqrt(k)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.objectives import Objective, batch_of, logistic_pass, objective_pass, required_key
from .journal import Entries, Journal
from .passes import held, infer_width, penalized_mask
from .trace import Fit, Trace


def _soft(v, t):
    return np.sign(v) * np.maximum(np.abs(v) - t, 0.0) + 0.0


def sgd_grid(df: DataFrame, lams: Sequence[float], step: float | None = None, iters: int = 600,
             fraction: float = 1.0, seed: int = 42, key: str | None = None, w0=None, features: str = "features",
             label: str = "label", cache: bool = True, run_ids: Sequence[str] | None = None,
             penalize_intercept_in_value: bool = False, objective: Objective | None = None,
             updater: Callable[[np.ndarray, float], np.ndarray] | None = None,
             journal: Journal | str | None = None) -> list[Fit]:
    """One fit per penalty weight, all advanced by the same scan in every iteration.

    The recorded objective of iteration k is the batch loss at the incoming model plus the
    penalty value of the incoming model. A fraction below 1 takes, in iteration k, the rows that
    ``batch_of`` draws by ``key``, an integer SQL expression that tells rows apart: the same
    batches for any partitioning and on any engine; a row whose key is NULL raises an error. The fit
    ends after ``iters`` iterations; there is no test of convergence.

    ``objective`` replaces the logistic loss, see ``Objective``. ``updater`` replaces the soft
    threshold: it gets a model after its gradient step and the step's size and gives the new model. ``journal`` keeps every iteration in a
    table and goes on from the last one found there.
    """
    if fraction < 1.0 and key is None:
        raise ValueError("mini-batches need key, an integer expression that tells rows apart")
    d = infer_width(df, features)
    lams = np.asarray(lams, dtype=float)
    step = 0.3 * np.sqrt(d) if step is None else step
    models = np.tile(np.zeros(d) if w0 is None else np.asarray(w0, dtype=float), (len(lams), 1))
    mask = penalized_mask(d, True)
    in_value = np.ones(d) if penalize_intercept_in_value else mask
    names = run_ids or [f"sgd-lam={lam:g}" for lam in lams]
    traces = [Trace(name, "sgd") for name in names]
    objectives, done = np.full(len(lams), np.nan), 0
    entries = None if journal is None else Entries(df.sparkSession, journal, names, {
        "method": "sgd", "lams": lams.tolist(), "step": float(step), "fraction": fraction, "seed": seed,
        "key": key, "objective": getattr(objective, "__qualname__", None),
        "updater": getattr(updater, "__qualname__", None)})
    before = [trace.keep_in(entries) for trace in traces]
    if entries and entries.last:
        models, done = np.array([r["model"] for r in before]), entries.committed
        objectives = np.array([np.nan if r["objective"] is None else r["objective"] for r in before])
    elif entries:
        for name, w in zip(names, models):
            entries.begin(name, w)
    keyed = df if key is None else df.withColumn("batch_key", F.expr(required_key(key)))
    with held(keyed, features, label, cache, *(["batch_key"] if key else [])) as rows:
        for trace in traces:
            trace.ready()
        for k in range(done + 1, iters + 1):
            batch = rows if fraction >= 1.0 else rows.where(
                batch_of("batch_key", fraction, seed, k))
            found = logistic_pass(batch, models, features=features, label=label) \
                if objective is None else objective_pass(batch, models, objective, features, label)
            objectives = found.mean_loss + lams * (np.abs(models) * in_value).sum(axis=1)
            size = step / np.sqrt(k)
            moved = models - size * found.mean_grad
            models = np.where(mask > 0, _soft(moved, size * lams[:, None]), moved) \
                if updater is None else np.stack([updater(w, size) for w in moved])
            for trace, w, value in zip(traces, models, objectives):
                trace.add(k, w, value)
    if entries:
        entries.commit()
    spark = df.sparkSession
    return [
        Fit(spark, w, trace, False, value, stop_reason="iterations")
        for w, trace, value in zip(models, traces, objectives)
    ]


def sgd(df: DataFrame, lam: float = 0.0, **options) -> Fit:
    """A single fit; see ``sgd_grid`` for the options."""
    run_id = options.pop("run_id", "sgd")
    return sgd_grid(df, [lam], run_ids=[run_id], **options)[0]
