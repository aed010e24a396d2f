"""Arithmetic on ARRAY<DOUBLE> columns, all JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vectors up to this width get one generated expression per coordinate (compiled
# by whole-stage codegen); wider ones use array functions or Arrow batches.
NARROW_WIDTH = 24


def array_sql(values: Sequence[float]) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def vector_literal(values: Sequence[float]) -> Column:
    """ARRAY<DOUBLE> literal; one SQL parse instead of one call per value."""
    return F.expr(array_sql(values))


def parameter_sql(values: Sequence[float]) -> str:
    """SQL for a vector that changes from pass to pass.

    As a scalar subquery over an inline table its values stay out of the generated code, so
    all passes of a solver run the same compiled and warmed-up classes.
    """
    return f"(SELECT p FROM VALUES ({array_sql(values)}) AS parameters(p))"


def at(vector: Column, i: int) -> Column:
    """Coordinate i, counted from 0."""
    return F.get(vector, F.lit(i))


def dot(vector: Column, weights: Sequence[float] | Column) -> Column:
    """Scalar product with a fixed model (list of floats) or with another vector column.

    NULL for vectors of another length and for vectors with a NULL.
    """
    if isinstance(weights, Column):
        product = total(F.zip_with(vector, weights, lambda a, b: a * b))
        return F.when(F.size(vector) == F.size(weights), product)
    if len(weights) > NARROW_WIDTH:
        return dot(vector, vector_literal(weights))
    terms = [at(vector, i) * float(w) for i, w in enumerate(weights)]
    product = terms[0]
    for term in terms[1:]:
        product = product + term
    return F.when(F.size(vector) == len(weights), product)


def finite(value: Column) -> Column:
    """True for numbers; false for NULL, NaN and infinity."""
    return F.coalesce(F.abs(value) < float("inf"), F.lit(False))


def checked(value: Column | str) -> Column:
    """A result next to ``n_rows`` of ``rows_counted``, tied to that check: neither is pruned alone."""
    return F.when(F.col("n_rows") >= 0, F.col(value) if isinstance(value, str) else value)


def rows_counted(usable: Column, what: str) -> Column:
    """Aggregate: the number of rows, an error if any of them is not usable."""
    n = F.count(F.lit(1))
    return F.when(F.count(F.when(usable, 1)) == n, n).otherwise(
        F.raise_error(F.lit(f"a row is not {what}")).cast("long"))


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v)


def scale(a: Column, factor: Column | float) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(a, lambda x: x * factor)
