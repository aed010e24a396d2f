"""Limited-memory quasi-Newton fits: smooth (lbfgs) and orthant-wise for L1 (owlqn).

The driver holds d-vectors only. A trial step costs one pass; when it is rejected, the
next few step sizes are tried together in one further pass. Many runs, of a path of penalty
weights or of one model per segment, are advanced together by the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import curvature_direction, logistic_objective
from ..operators.objectives import Objective, segment_pass
from .journal import Entries, Journal, floats
from .passes import MeanObjective, held, infer_width, penalized_mask
from .trace import Fit, Trace

STEPS_PER_PASS = 4


def pseudo_gradient(w, grad, l1):
    """Steepest one-sided slope of loss + sum l1*|w|, coordinate by coordinate."""
    at_zero = np.where(grad - l1 > 0, grad - l1, np.where(grad + l1 < 0, grad + l1, 0.0))
    slope = np.where(w == 0, at_zero, grad + np.sign(w) * l1)
    return np.where(l1 == 0, grad, slope)


def _search(start, first, shrink, accept):
    """Backtracking: the first step alone, then STEPS_PER_PASS smaller ones per pass.

    A generator, as ``search``: yields the trial models of a pass.
    """
    sizes, size = [first], first
    while size > 1e-14:
        trials = np.stack([start(t) for t in sizes])
        losses, grads = yield trials
        for i, trial in enumerate(trials):
            if accept(sizes[i], trial, losses[i]):
                return trial, float(losses[i]), grads[i]
        size = sizes[-1]
        sizes = [size * shrink ** (i + 1) for i in range(STEPS_PER_PASS)]
    return None


def _bends(s, y):
    """Whether a step with its change of the gradient is worth remembering."""
    return bool(s @ y > 1e-14 * (y @ y))


def _resumed(steps, memory):
    """(model, gradient, remembered steps, stalled) from the entries of a journal."""
    by_number = {r["iteration"]: r for r in steps}
    models = {k: np.array(r["model"]) for k, r in by_number.items()}
    grads = {k: np.array(r["gradient"]) for k, r in by_number.items()}
    pairs = []
    for k, r in by_number.items():
        if r["dropped"]:
            pairs = []
        if r["kept"] and k - 1 in models:
            pairs = [*pairs, (models[k] - models[k - 1], grads[k] - grads[k - 1])][-memory:]
    end = max(by_number)
    stalled = end > 0 and np.array_equal(models[end], models[end - 1])
    return models[end], grads[end], pairs, stalled


def search(w0, l1, m: int, tol: float, max_iter: int, orthant: bool, trace: Trace):
    """The minimization itself, without the rows: a generator that one pass after the other feeds.

    Yields the models (k x d) that it wants evaluated, is sent their mean losses and gradients, and
    returns (weights, value, reason). Iterates go to ``trace``. One or many of them can be advanced
    by the same scans, see ``lockstep``.
    """
    last = trace.journal and trace.journal.last.get(trace.run_id)
    if last:
        w, grad, pairs, stalled = _resumed(trace.journal.steps(trace.run_id, m), m)
        trace.ready()
        done, asked, loss = last["iteration"], 0, last["carried"]["loss"]
        if stalled:
            return w, loss + np.abs(l1 * w).sum(), "precision"
    else:
        w, pairs, done, asked = np.array(w0, dtype=float), [], 0, 1
        losses, grads = yield w[None, :]
        trace.ready()
        loss, grad = float(losses[0]), grads[0]
        if trace.journal:
            trace.journal.begin(trace.run_id, w, grad, loss=loss)
    value, reason = loss + np.abs(l1 * w).sum(), "iterations"
    for k in range(done + 1, max_iter + 1):
        slope = pseudo_gradient(w, grad, l1) if orthant else grad
        size = np.linalg.norm(slope)
        if size <= tol * max(1.0, np.linalg.norm(w)):
            reason = "gradient"
            break
        direction = curvature_direction(slope, pairs)
        if orthant:
            direction = np.where(direction * slope < 0, direction, 0.0)
        dropped = bool(direction @ slope >= 0)
        if dropped:
            direction, pairs = -slope, []
        signs = np.where(w != 0, np.sign(w), np.sign(-slope))

        def moved(t, w=w, direction=direction, signs=signs):
            trial = w + t * direction
            if not orthant:
                return trial
            return np.where((np.sign(trial) == signs) | (l1 == 0), trial, 0.0)

        def accept(t, trial, trial_loss, w=w, slope=slope, value=value):
            trial_value = trial_loss + np.abs(l1 * trial).sum()
            return trial_value <= value + 1e-4 * (slope @ (trial - w)) + 1e-13 * abs(value)

        first = 1.0 if pairs else (0.5 if orthant else 1.0) / size
        shrink = 0.1 if orthant and k == 1 else 0.5
        steps, answer = _search(moved, first, shrink, accept), None
        while True:
            try:
                trials = steps.send(answer)
            except StopIteration as end:
                found = end.value
                break
            asked += 1
            answer = yield trials
        if found is None:
            reason = "precision"  # no descent left
            break
        trial, loss, trial_grad = found
        kept = _bends(trial - w, trial_grad - grad)
        if kept:
            pairs = [*pairs, (trial - w, trial_grad - grad)][-m:]
        stalled = np.array_equal(trial, w)
        w, grad = trial + 0.0, trial_grad  # no -0.0
        value = loss + np.abs(l1 * w).sum()
        state = trace.journal and {
            "gradient": floats(grad), "kept": kept, "dropped": dropped, "carried": {"loss": loss}}
        trace.add(k, w, value, n_eval=asked, inner_tol=tol, state=state)
        asked = 0
        if stalled:
            reason = "precision"
            break
    else:
        slope = pseudo_gradient(w, grad, l1) if orthant else grad
        if np.linalg.norm(slope) <= tol * max(1.0, np.linalg.norm(w)):
            reason = "gradient"
    return w, value, reason


def lockstep(searches: Mapping, evaluate: Callable[[dict], Mapping]) -> dict:
    """Advances searches together: every round evaluates what all of them ask for, in one call.

    ``evaluate`` maps {key: models} to {key: (mean losses, mean gradients)}. Returns what each
    search returned. A search that has ended asks for nothing more.
    """
    ended, asked = {}, {}
    for key, one in searches.items():
        try:
            asked[key] = next(one)
        except StopIteration as end:  # a journal held its end
            ended[key] = end.value
    while asked:
        found, still = evaluate(asked), {}
        for key in asked:
            try:
                still[key] = searches[key].send(found[key])
            except StopIteration as end:
                ended[key] = end.value
        asked = still
    return ended


def _fit(spark, trace, ended) -> Fit:
    w, value, reason = ended
    return Fit(spark, w, trace, reason == "gradient", value, stop_reason=reason)


def _l1(l1, d, intercept):
    l1 = l1 * penalized_mask(d, intercept) if np.isscalar(l1) else np.asarray(l1, dtype=float)
    if (l1 < 0).any():
        raise ValueError("l1 must not be negative")
    return l1


def _minimize(df, l1, m, tol, max_iter, w0, features, label, cache, run_id, method, orthant,
              objective, journal):
    trace = Trace(run_id, method)
    if journal is not None:
        trace.keep_in(Entries(df.sparkSession, journal, [run_id], {
            "method": method, "m": m, "width": len(l1), "l1": sha256(l1.tobytes()).hexdigest(),
            "objective": getattr(objective, "__qualname__", None)}))
    with held(df, features, label, cache) as rows:
        mean = MeanObjective(rows, features, label, objective)
        run = search(w0, l1, m, tol, max_iter, orthant, trace)
        ended = lockstep({0: run}, lambda asked: {0: mean(asked[0])})
    if trace.journal:
        trace.journal.commit()
    return _fit(df.sparkSession, trace, ended[0])


def lbfgs(df: DataFrame, m: int = 20, tol: float = 1e-9, max_iter: int = 1000, w0=None,
          features: str = "features", label: str = "label", cache: bool = True,
          run_id: str = "lbfgs", objective: Objective | None = None,
          journal: Journal | str | None = None) -> Fit:
    """Minimizes a mean loss; stops when |gradient| <= tol * max(1, |w|).

    Logistic loss by default. ``objective`` takes any smooth one instead: see ``Objective``, and
    ``least_squares_objective`` and ``huber_objective`` in kernels. ``journal`` keeps every
    iteration in a table and goes on from the last one found there, with the same steps remembered.
    """
    d = infer_width(df, features)
    w0 = np.zeros(d) if w0 is None else w0
    return _minimize(df, np.zeros(d), m, tol, max_iter, w0, features, label, cache, run_id,
                     "lbfgs", False, objective, journal)


def owlqn(df: DataFrame, l1, m: int = 20, tol: float = 1e-9, max_iter: int = 1000, w0=None,
          features: str = "features", label: str = "label", intercept: bool = True,
          cache: bool = True, run_id: str = "owlqn", objective: Objective | None = None,
          journal: Journal | str | None = None) -> Fit:
    """Minimizes a mean loss + sum l1_i |w_i|; l1 is a number or one per coordinate.

    A number leaves the intercept (last coordinate) free unless ``intercept=False``. ``objective``
    and ``journal`` as in ``lbfgs``.
    """
    d = infer_width(df, features)
    w0 = np.zeros(d) if w0 is None else w0
    return _minimize(df, _l1(l1, d, intercept), m, tol, max_iter, w0, features, label, cache, run_id,
                     "owlqn", True, objective, journal)


@dataclass(frozen=True)
class Runs:
    """Fits of many runs by key, and the scans over the rows that all of them took together."""

    fits: dict
    scans: int

    def models(self, key: str) -> DataFrame:
        """(key, pos, weight, is_intercept) of all runs."""
        rows = [(k, i, float(w), i == len(fit.weights) - 1)
                for k, fit in self.fits.items() for i, w in enumerate(fit.weights)]
        spark = next(iter(self.fits.values())).spark
        kind = "long" if all(isinstance(k, int) for k in self.fits) else "double"
        return spark.createDataFrame(rows, f"{key} {kind}, pos int, weight double, is_intercept boolean")


def owlqn_path(df: DataFrame, l1s: Sequence[float], m: int = 20, tol: float = 1e-9,
               max_iter: int = 1000, features: str = "features", label: str = "label",
               intercept: bool = True, cache: bool = True,
               objective: Objective | None = None) -> Runs:
    """A regularization path: one ``owlqn`` fit per weight, all advanced by the same scans.

    Every fit has its own directions and line search; a scan evaluates the trial models that all
    fits ask for. The scans are as many as the slowest fit needs.
    """
    d = infer_width(df, features)
    weights = [float(x) for x in l1s]
    if not weights or len(set(weights)) < len(weights):
        raise ValueError("a path has at least one weight, and each once")
    traces = {x: Trace(f"owlqn-l1={x:g}", "owlqn") for x in weights}
    with held(df, features, label, cache) as rows:
        mean = MeanObjective(rows, features, label, objective)

        def evaluate(asked):
            losses, grads = mean(np.concatenate(list(asked.values())))
            ends = np.cumsum([len(models) for models in asked.values()])
            return {key: (losses[e - len(models):e], grads[e - len(models):e])
                    for (key, models), e in zip(asked.items(), ends)}

        ended = lockstep({x: search(np.zeros(d), _l1(x, d, intercept), m, tol, max_iter, True, traces[x])
                          for x in weights}, evaluate)
    return Runs({x: _fit(df.sparkSession, traces[x], ended[x]) for x in weights}, mean.passes)


# Most segments of one call: the driver keeps 2 m vectors of each.
MAX_SEGMENTS = 10_000


def lbfgs_by_segment(df: DataFrame, segment: str, l1: float = 0.0, m: int = 20, tol: float = 1e-9,
                     max_iter: int = 1000, features: str = "features", label: str = "label",
                     intercept: bool = True, cache: bool = True,
                     objective: Objective | None = None) -> Runs:
    """One model per value of the integer column ``segment``, all advanced by the same scans.

    A row meets the trial models of its own segment only, so a scan costs what one fit's scan does.
    Partial sums leave a task once per segment, however many rows it holds; segments whose fit has
    ended are passed over. ``l1`` above 0 fits with that penalty. At most MAX_SEGMENTS values; a
    NULL segment raises an error.
    """
    d, method = infer_width(df, features), "owlqn" if l1 else "lbfgs"
    with held(df, features, label, cache, segment) as rows:
        keys = [r[0] for r in rows.select(F.col(segment).cast("long")).distinct().limit(
            MAX_SEGMENTS + 1).collect()]
        if len(keys) > MAX_SEGMENTS or None in keys:
            raise ValueError(f"rows have no segment, or one of more than {MAX_SEGMENTS}")
        traces = {key: Trace(f"{method}-{segment}={key}", method) for key in sorted(keys)}
        scans = 0

        def evaluate(asked):
            nonlocal scans
            scans += 1
            found = segment_pass(rows, asked, segment, objective or logistic_objective, features, label)
            return {key: (p.mean_loss, p.mean_grad) for key, p in found.items()}

        ended = lockstep({key: search(np.zeros(d), _l1(l1, d, intercept), m, tol, max_iter, l1 > 0, trace)
                          for key, trace in traces.items()}, evaluate)
    return Runs({key: _fit(df.sparkSession, trace, ended[key]) for key, trace in traces.items()}, scans)
