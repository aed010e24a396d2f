"""Proximal maps as column expressions over a scalar or ARRAY<DOUBLE> column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log1p_exp(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow to NaN."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _number(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def soft_threshold(x: Column, t: Column | float) -> Column:
    """Shrinks x towards 0 by t; exactly 0 inside [-t, t]."""
    return F.signum(x) * F.greatest(F.abs(x) - _number(t), F.lit(0.0))


def _but_last(vector: Column, fn) -> Column:
    last = F.size(vector) - 1
    return F.transform(vector, lambda v, i: F.when(i == last, v).otherwise(fn(v)))


def prox_l1(vector: Column, lam: float, length: Column | float, rho: Column | float) -> Column:
    """L1 prox with threshold length * lam / rho; the intercept (last slot) is left alone."""
    t = _number(length) * float(lam) / _number(rho)
    return _but_last(vector, lambda v: soft_threshold(v, t))


def prox_elastic_net(vector: Column, lam: float, gamma: float, rho: Column | float,
                     variant: str = "exact") -> Column:
    """Elastic-net prox. ``exact`` divides by 1 + gamma/rho, ``reference`` by 1 + lam*gamma."""
    rho = _number(rho)
    if variant == "exact":
        divisor = F.lit(1.0) + F.lit(float(gamma)) / rho
    elif variant == "reference":
        divisor = F.lit(1.0 + lam * gamma)
    else:
        raise ValueError(f"unknown variant {variant!r}")
    t = F.lit(float(lam)) / rho
    return F.transform(vector, lambda v: soft_threshold(v, t) / divisor)


def prox_lower_bound(vector: Column, threshold: float) -> Column:
    """Projection on w >= threshold."""
    return F.transform(vector, lambda v: F.greatest(v, F.lit(float(threshold))))


def prox_zero_set(vector: Column) -> Column:
    """Prox of the indicator of {0}: the zero vector of the same size."""
    return F.array_repeat(F.lit(0.0), F.size(vector))


def prox_identity(vector: Column) -> Column:
    """Prox of the zero penalty."""
    return vector
