"""Elastic-net logistic regression by spark.ml, as the cross-check of the other solvers."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame

from ..sources.tables import to_ml_frame
from .passes import held, infer_width
from .trace import Fit, Trace


def ml_logistic(df: DataFrame, reg: float | None = None, alpha: float = 1.0, max_iter: int = 200,
                tol: float = 1e-9, standardization: bool = False, features: str = "features",
                label: str = "label", aggregation_depth: int = 2, run_id: str = "ml_logistic") -> Fit:
    """reg defaults to 0.1 / d. The intercept slot is dropped; spark.ml fits its own.

    Raise ``aggregation_depth`` for wide models on many partitions.

    ``standardization`` changes the L1 optimum; leave it off to compare with ``owlqn``.
    """
    d = infer_width(df, features)
    estimator = LogisticRegression(
        regParam=0.1 / d if reg is None else reg, elasticNetParam=alpha, maxIter=max_iter,
        tol=tol, standardization=standardization, fitIntercept=True,
        aggregationDepth=aggregation_depth,
    )
    trace = Trace(run_id, "ml_logistic")
    with held(df, features, label, True) as rows:
        frame = to_ml_frame(rows, features, label, drop_intercept=True)
        trace.ready()
        fitted = estimator.fit(frame)
    weights = np.append(fitted.coefficients.toArray(), fitted.intercept)
    history = list(fitted.summary.objectiveHistory)
    for k, value in enumerate(history):
        # spark.ml tells the objective of each iteration, but neither its model nor its time.
        trace.add(k, weights if k == len(history) - 1 else None, value, timed=k == len(history) - 1)
    done = len(history) <= max_iter
    return Fit(df.sparkSession, weights, trace, done, history[-1],
               stop_reason="spark.ml" if done else "iterations")
