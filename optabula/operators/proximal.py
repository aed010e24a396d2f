"""Proximal steps over tables of vectors, one row per block or candidate model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .. import kernels
from ..functions.prox import soft_threshold


def prox_least_squares(grams: DataFrame, vectors: DataFrame, width: int, rho: float,
                       key: str = "block_id", vector: str = "v") -> DataFrame:
    """(key, x): (A'A + rho I)^-1 (A'b + rho v) per block, from grams instead of raw rows.

    Grams with the column ``factor`` (see ``factored``) are not factored again, whatever ``rho`` is.
    """
    if "factor" in grams.columns:
        solve = arrow_udf(kernels.solve_eigen(width, rho), "array<double>")
        joined = grams.select(key, "factor", "atb").join(vectors.select(key, vector), key)
        return joined.select(key, solve("factor.vectors", "factor.values", "atb", vector).alias("x"))
    solve = arrow_udf(kernels.solve_grams(width, rho), "array<double>")
    joined = grams.select(key, "ata", "atb").join(vectors.select(key, vector), key)
    return joined.select(key, solve("ata", "atb", vector).alias("x"))


def prox_zip(blocks: DataFrame, vectors: DataFrame, prox: Callable[[Column, Column], Column],
             key: str = "block_id", parameter: str = "rho", vector: str = "v") -> DataFrame:
    """Applies each block's prox to the vector with the same key: (key, x).

    ``prox`` builds a column from (vector, parameter). An equi-join on the key replaces
    pairing by position.
    """
    joined = blocks.select(key, parameter).join(vectors.select(key, vector), key)
    return joined.select(key, prox(F.col(vector), F.col(parameter)).alias("x"))


def sgd_update(models: DataFrame, k: Column | int, step: float, lam: float, intercept_pos: int,
               weight: str = "w", gradient: str = "g", pos: str = "pos") -> DataFrame:
    """Adds ``w_new`` of iteration k: gradient step of step/sqrt(k), then soft threshold.

    The intercept coordinate takes the gradient step only.
    """
    k = k if isinstance(k, Column) else F.lit(k)
    size = F.lit(float(step)) / F.sqrt(k.cast("double"))
    moved = F.col(weight) - size * F.col(gradient)
    shrunk = soft_threshold(moved, size * F.lit(float(lam)))
    return models.withColumn(
        "w_new", F.when(F.col(pos) == intercept_pos, moved).otherwise(shrunk))
