"""Objectives: every evaluation is one aggregation over the rows.

Two physical plans give the same numbers. Narrow models (few coordinates) use
generated column sums inside whole-stage codegen. Wide models use Arrow batches
and one partial vector per partition. Several candidate models share one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import kernels
from ..cluster import check_shipped
from ..functions.prox import log1p_exp, sigmoid
from ..functions.vectors import (
    NARROW_WIDTH,
    at,
    checked,
    dot,
    finite,
    parameter_sql,
    rows_counted,
    vector_literal,
)
from .sums import KEYED_PIECES, PIECES, collect_sum, collect_sums_by_key, grouped_sums, sum_partials

# Aggregation buffers that still fit one whole-stage codegen stage.
CODEGEN_BUFFERS = 80


@dataclass(frozen=True)
class Pass:
    """Sums of one pass: ``loss`` (k,), ``grad`` (k, d) or None, over ``n`` rows."""

    n: int
    loss: np.ndarray
    grad: np.ndarray | None

    @property
    def mean_loss(self) -> np.ndarray:
        return self.loss / self.n

    @property
    def mean_grad(self) -> np.ndarray:
        return self.grad / self.n


def row_loss(margin: Column, label: Column) -> Column:
    """Logistic loss of one row with label 0/1."""
    return log1p_exp((F.lit(1.0) - F.lit(2.0) * label) * margin)


def _is_narrow(k: int, d: int, with_gradient: bool) -> bool:
    buffers = 1 + k * (d + 1 if with_gradient else 1)
    return d <= NARROW_WIDTH and buffers <= CODEGEN_BUFFERS


def _narrow_sums(df, models, with_gradient, features, label):
    """Generated column sums; the models are a subquery parameter, see ``parameter_sql``."""
    k, d = models.shape
    rows = df.selectExpr(
        f"{features} AS x", f"{label} AS y", f"{parameter_sql(models.ravel())} AS w")
    margins = [
        " + ".join(f"x[{i}] * w[{j * d + i}]" for i in range(d)) for j in range(k)
    ]
    rows = rows.selectExpr(
        "x", "y", *[f"CASE WHEN size(x) = {d} THEN {m} END AS m{j}"
                    for j, m in enumerate(margins)])
    sums = [
        f"sum(greatest((1 - 2 * y) * m{j}, 0D) + log1p(exp(-abs(m{j}))))" for j in range(k)
    ]
    if with_gradient:
        sums += [
            f"sum((1D / (1D + exp(-m{j})) - y) * x[{i}])" for j in range(k) for i in range(d)
        ]
    problem = f"raise_error('a row is no complete, finite vector of {d} features with a label')"
    count = (
        "CASE WHEN count(CASE WHEN abs(m0 + y) < double('inf') THEN 1 END) = count(1) "
        f"THEN CAST(count(1) AS DOUBLE) ELSE {problem} END"
    )
    return rows.selectExpr(f"array({', '.join([*sums, count])}) AS partial")


def logistic_sums(df: DataFrame, models: Sequence[Sequence[float]], with_gradient: bool = True,
                  features: str = "features", label: str = "label",
                  narrow: bool | None = None) -> DataFrame:
    """One row ``partial``: [loss per model, gradient per model, rows] as plain sums."""
    models, narrow = _candidates(models, with_gradient, narrow)
    if narrow:
        return _narrow_sums(df, models, with_gradient, features, label)
    body = kernels.logistic_partials(models, with_gradient)
    return sum_partials(df.select(features, label).mapInArrow(body, PIECES),
                        _sums_of(models, with_gradient))


def _sums_of(models, with_gradient):
    k, d = models.shape
    return k * (d + 1) + 1 if with_gradient else k + 1


def _candidates(models, with_gradient, narrow):
    models = np.atleast_2d(np.asarray(models, dtype=float))
    k, d = models.shape
    check_shipped(k * d, "the candidate models of one pass")
    return models, _is_narrow(k, d, with_gradient) if narrow is None else narrow


def logistic_pass(df: DataFrame, models, with_gradient: bool = True, features: str = "features",
                  label: str = "label", narrow: bool | None = None) -> Pass:
    """Runs one pass and brings the d-sized sums to the driver."""
    models, narrow = _candidates(models, with_gradient, narrow)
    k, d = models.shape
    try:
        if narrow:
            found = _narrow_sums(df, models, with_gradient, features, label).first()["partial"]
            sums = np.array([np.nan if v is None else v for v in found])
        else:
            body = kernels.logistic_partials(models, with_gradient)
            partials = df.select(features, label).mapInArrow(body, PIECES)
            sums = collect_sum(partials, _sums_of(models, with_gradient))
    except PySparkException as error:
        _raise_of_rows(error)
    return _found(sums, k, d, with_gradient)


def _raise_of_rows(error):
    if "finite" in str(error):
        raise ValueError("a row is not complete and finite; run require_clean on the rows") from error
    raise error


def _found(sums, k, d, with_gradient=True):
    if not sums[-1]:
        raise ValueError("no training rows")
    if not np.isfinite(sums).all():
        raise ValueError("loss or gradient is not finite; run require_clean on the rows")
    grad = sums[k:k + k * d].reshape(k, d) if with_gradient else None
    return Pass(int(sums[-1]), sums[:k], grad)


# An objective: (rows x d features, labels or targets, k x d models) -> the summed loss of every
# model and the gradients of those sums, as arrays of k and of k x d numbers.
Objective = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def objective_pass(df: DataFrame, models, objective: Objective, features: str = "features",
                   label: str = "label") -> Pass:
    """``logistic_pass`` for any objective that is a sum over rows, in Arrow batches.

    ``objective`` runs in the tasks and must not depend on how rows are cut into batches.
    """
    models, _ = _candidates(models, True, False)
    k, d = models.shape
    partials = df.select(features, label).mapInArrow(
        kernels.objective_partials(objective, models), PIECES)
    try:
        sums = collect_sum(partials, _sums_of(models, True))
    except PySparkException as error:
        _raise_of_rows(error)
    return _found(sums, k, d)


def segment_pass(df: DataFrame, models: Mapping[int, np.ndarray], segment: str,
                 objective: Objective = kernels.logistic_objective, features: str = "features",
                 label: str = "label") -> dict[int, Pass]:
    """One pass in which every row meets the models of its segment only: a Pass per segment.

    ``models`` holds k x d models for the integer segments that ask for some; k may differ. Rows of
    other segments are passed over, rows without a segment raise an error.
    """
    models = {key: np.atleast_2d(np.asarray(m, dtype=float)) for key, m in models.items()}
    check_shipped(sum(m.size for m in models.values()), "the candidate models of all segments")
    rows = df.select(features, label, F.col(segment).cast("long").alias("segment"))
    partials = rows.mapInArrow(kernels.segment_partials(objective, models), KEYED_PIECES)
    try:
        sums = collect_sums_by_key(partials)
    except PySparkException as error:
        _raise_of_rows(error)
    return {key: _found(sums.get(key, np.zeros(1)), *m.shape) for key, m in models.items()}


def batch_of(key: str, fraction: float, seed: int, iteration: int | str) -> str:
    """SQL condition that draws about ``fraction`` of the rows, by an integer key.

    Squaring modulo a prime, in whole numbers that every engine computes alike.
    """
    prime = 2_147_483_647
    x = f"((CAST(({key}) AS BIGINT) % {prime} + {prime}) % {prime})"
    for term in (f"{int(seed)} * 7919 + ({iteration}) * 104729 + 1", "12345"):
        x = f"(({x} * {x} + {x} * 48271 + {term}) % {prime})"
    return f"{x} < {int(fraction * prime)}"


def required_key(key: str) -> str:
    """SQL of the key that raises where it is NULL: such a row would be in no batch."""
    return f"CASE WHEN ({key}) IS NULL THEN raise_error('a row has no batch key') ELSE ({key}) END"


def logistic_value_grad(df: DataFrame, w: Sequence[float], batch_fraction: float = 1.0,
                        seed: int = 42, key: str | None = None, **columns) -> DataFrame:
    """Mean logistic loss and gradient at ``w``: one row (n_rows, loss, gradient).

    ``batch_fraction`` below 1 takes the rows that ``batch_of`` draws by ``key``.
    """
    d = len(w)
    if batch_fraction < 1.0 and key is None:
        raise ValueError("a batch needs key, an integer expression that tells rows apart")
    sampled = df if batch_fraction >= 1.0 else df.where(
        batch_of(required_key(key), batch_fraction, seed, 0))
    sums = F.col("partial")
    n = F.element_at(sums, -1)
    return logistic_sums(sampled, [w], **columns).select(
        n.cast("long").alias("n_rows"),
        (at(sums, 0) / n).alias("loss"),
        F.transform(F.slice(sums, 2, d), lambda g: g / n).alias("gradient"),
    )


def logistic_loss(df: DataFrame, w: Sequence[float], **columns) -> DataFrame:
    """Summed logistic loss at ``w``: one row (n_rows, loss)."""
    sums = F.col("partial")
    return logistic_sums(df, [w], with_gradient=False, **columns).select(
        F.element_at(sums, -1).cast("long").alias("n_rows"), at(sums, 0).alias("loss")
    )


def augmented_value_grad(df: DataFrame, w: Sequence[float], u: Sequence[float],
                         z: Sequence[float], rho: float, by: str | None = None,
                         penalty_per: str = "block", features: str = "features",
                         label: str = "label") -> DataFrame:
    """Logistic sum plus rho/2 |w + u - z|^2 and its gradient: (by, n_rows, value, gradient).

    ``penalty_per="block"`` adds the quadratic term once per group, ``"row"`` once per row.
    Rows are pre-aggregated before the shuffle, so a group of any size is one vector sum.
    """
    if penalty_per not in ("block", "row"):
        raise ValueError(f"unknown penalty_per {penalty_per!r}")
    w, shift = np.asarray(w, dtype=float), np.asarray(w) + np.asarray(u) - np.asarray(z)
    d = len(w)
    keys = (by,) if by else ()
    x, y = F.col(features), F.col(label)
    if d <= NARROW_WIDTH:
        rows = df.select(*keys, x.alias("x"), y.alias("y"), dot(x, list(w)).alias("m"))
        residual = sigmoid(F.col("m")) - F.col("y")
        usable = finite(F.col("m") + F.col("y"))
        sums = rows.groupBy(*keys).agg(
            rows_counted(usable, f"a complete vector of {d} features with a label").alias("n_rows"),
            F.sum(row_loss(F.col("m"), F.col("y"))).alias("loss"),
            F.array(*[F.sum(residual * at(F.col("x"), i)) for i in range(d)]).alias("g"),
        )
    else:
        sums = grouped_sums(df, kernels.logistic_sums(w), d, d + 2, x, y, by).select(
            *keys, at(F.col("partial"), 0).cast("long").alias("n_rows"),
            at(F.col("partial"), 1).alias("loss"), F.slice("partial", 3, d).alias("g"),
        )
    times = F.lit(1.0) if penalty_per == "block" else F.col("n_rows").cast("double")
    penalty = vector_literal(rho * shift)
    return sums.select(
        *keys, "n_rows",
        checked(F.col("loss") + times * F.lit(float(rho / 2 * (shift @ shift)))).alias("value"),
        checked(F.zip_with("g", penalty, lambda g, p: g + times * p)).alias("gradient"),
    )


def least_squares_value(df: DataFrame, w: Sequence[float], by: str | None = None,
                        features: str = "features", target: str = "target") -> DataFrame:
    """Residual sums at ``w``: (by, n_rows, sse, half_sse)."""
    residual = dot(F.col(features), list(w)) - F.col(target)
    keys = (by,) if by else ()
    sse = F.sum(residual * residual)
    n = rows_counted(finite(residual), f"a complete vector of {len(w)} features with a target")
    return df.groupBy(*keys).agg(
        n.alias("n_rows"), sse.alias("sum")).select(
        *keys, "n_rows", checked("sum").alias("sse"), (checked("sum") * 0.5).alias("half_sse"))


def total_value(df: DataFrame, objective: str, w: Sequence[float], by: str = "block_id",
                **columns) -> DataFrame:
    """Value of a function that is a sum over blocks: one row (n_blocks, value)."""
    if objective == "logistic":
        x, y = columns.get("features", "features"), columns.get("label", "label")
        margin = dot(F.col(x), list(w))
        n = rows_counted(finite(margin + F.col(y)), f"a complete vector of {len(w)} features with a label")
        parts = df.groupBy(by).agg(
            n.alias("n_rows"), F.sum(row_loss(margin, F.col(y))).alias("value"))
    elif objective == "least_squares":
        parts = least_squares_value(df, w, by, **columns).withColumnRenamed("sse", "value")
    else:
        raise ValueError(f"unknown objective {objective!r}")
    return parts.agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(checked("value")).alias("value"))


def pseudo_gradient(models: DataFrame, weight: str = "w", gradient: str = "g",
                    l1: str = "l1") -> DataFrame:
    """Adds ``pseudo_gradient`` of g + l1*|w| to a (run_id, pos, w, g, l1) table.

    Where w is 0 it is the one-sided derivative that still decreases, or 0.
    """
    w, g, lam = F.col(weight), F.col(gradient), F.col(l1)
    at_zero = (
        F.when(g - lam > 0, g - lam).when(g + lam < 0, g + lam).otherwise(F.lit(0.0))
    )
    slope = F.when(lam == 0, g).when(w == 0, at_zero).otherwise(g + F.signum(w) * lam)
    return models.withColumn("pseudo_gradient", slope)


def l1_adjusted_value(models: DataFrame, value: str, weight: str = "w",
                      l1: str = "l1", key: str = "run_id") -> DataFrame:
    """(key, value): smooth value (repeated on the rows of a run) plus sum |l1 * w|."""
    return models.groupBy(key).agg(
        (F.first(value) + F.sum(F.abs(F.col(l1) * F.col(weight)))).alias("value")
    )


def penalty_value(models: DataFrame, kind: str, lam: float = 0.0, gamma: float = 0.0,
                  key: str = "run_id", value: str = "value", pos: str = "pos",
                  free_pos: int | None = None) -> DataFrame:
    """(key, penalty) of every model in a long (key, pos, value) table.

    Kinds: ``l1``, ``elastic_net``, ``lower_bound`` and ``zero`` (both 0 where feasible).
    ``free_pos`` leaves one coordinate, the intercept, out of the value.
    """
    v = F.col(value)
    if free_pos is not None:
        v = F.when(F.col(pos) == free_pos, F.lit(0.0)).otherwise(v)
    if kind == "l1":
        penalty = F.lit(float(lam)) * F.sum(F.abs(v))
    elif kind == "elastic_net":
        penalty = F.lit(float(lam)) * F.sum(F.abs(v)) + F.lit(gamma / 2) * F.sum(v * v)
    elif kind in ("lower_bound", "zero"):
        penalty = F.sum(F.lit(0.0) * v)
    else:
        raise ValueError(f"unknown penalty {kind!r}")
    return models.groupBy(key).agg(penalty.alias("penalty"))
