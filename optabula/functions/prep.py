"""Row preparation: labels, intercept slot, sign folding. Plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import dot


def label01(label: Column) -> Column:
    """-1 becomes 0, any other label becomes 1; NULL and NaN are no labels and become NULL."""
    return F.when(label == -1, F.lit(0.0)).when(label.isNotNull() & ~F.isnan(label), F.lit(1.0))


def features_only(values: Column) -> Column:
    """All slots but the last one, which holds the label."""
    return F.slice(values, F.lit(1), F.size(values) - 1)


def label_slot(values: Column) -> Column:
    return F.element_at(values, -1)


def with_intercept(values: Column) -> Column:
    """Overwrites the last slot (the label) with 1, the intercept feature."""
    return F.concat(features_only(values), F.array(F.lit(1.0)))


def add_intercept(features: Column) -> Column:
    """Appends the intercept feature 1."""
    return F.concat(features, F.array(F.lit(1.0)))


def sign_fold(features: Column, label_pm: Column) -> Column:
    """-y * x for labels y in {-1, 1}: the row loss becomes log(1 + exp(D.w))."""
    return F.transform(features, lambda v: -label_pm * v)


def label_by_model(features: Column, model: Sequence[float] | Column) -> Column:
    """0 where x.m < 0, else 1; NULL where x.m is no number."""
    return sign_class(dot(features, model))


def target_by_model(features: Column, model: Sequence[float] | Column) -> Column:
    """Synthetic regression target A x."""
    return dot(features, model)


def sign_class(margin: Column) -> Column:
    """0 below zero, else 1; NULL for a NULL or NaN margin."""
    return F.when(margin < 0, F.lit(0.0)).when(margin.isNotNull() & ~F.isnan(margin), F.lit(1.0))


def training_rows(df: DataFrame, values: str = "values") -> DataFrame:
    """Raw records (label in the last slot) -> (features with intercept, label 0/1)."""
    raw = F.col(values)
    return df.select(
        with_intercept(raw).alias("features"), label01(label_slot(raw)).alias("label")
    )


def row_defects(df: DataFrame, width: int, features: str = "features",
                label: str = "label") -> DataFrame:
    """One row of defect counts: wrong width, null or non-finite features, label not 0/1."""
    vector, y = F.col(features), F.col(label)
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    count = lambda condition: F.count(F.when(condition, 1))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        count(vector.isNull() | (F.size(vector) != width)).alias("wrong_width"),
        count(F.coalesce(bad, F.lit(True))).alias("not_finite"),
        count(~F.coalesce(y.isin(0.0, 1.0), F.lit(False))).alias("bad_label"),
    )


def require_clean(df: DataFrame, width: int, features: str = "features",
                  label: str = "label") -> DataFrame:
    """Runs ``row_defects`` and raises if any row is unusable; returns ``df``."""
    found = row_defects(df, width, features, label).first().asDict()
    total = found.pop("n_rows")
    if any(found.values()):
        raise ValueError(f"unusable training rows among {total}: {found}")
    return df
