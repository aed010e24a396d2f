"""Comparing models: objectives of a whole trace in few scans, distances, scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import MAX_SHIPPED_BYTES
from ..functions.prep import sign_class
from ..functions.prox import sigmoid
from ..functions.vectors import dot, vector_literal
from .objectives import logistic_pass

# Most models evaluated by one scan; fewer where their values pass the bound on what is shipped.
MODELS_PER_PASS = 256


def score(df: DataFrame, w: Sequence[float], features: str = "features") -> DataFrame:
    """Adds probability and prediction (0/1) of a model; both NULL where the margin is no number."""
    margin = dot(F.col(features), list(w))
    return df.withColumns({
        "probability": F.when(~F.isnan(margin), sigmoid(margin)),
        "prediction": sign_class(margin),
    })


def accuracy(scored: DataFrame, label: str = "label") -> DataFrame:
    """One row (n_rows, accuracy); a row without prediction or label is no hit."""
    hit = F.when(F.col("prediction") == F.col(label), 1.0).otherwise(0.0)
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(hit).alias("accuracy"))


def evaluate_models(rows: DataFrame, models: Sequence[Sequence[float]],
                    features: str = "features", label: str = "label") -> np.ndarray:
    """Mean logistic loss of every model; many models share one scan."""
    models = np.atleast_2d(np.asarray(models, dtype=float))
    step = max(1, min(MODELS_PER_PASS, MAX_SHIPPED_BYTES // (8 * models.shape[1])))
    found = [
        logistic_pass(rows, models[i:i + step], with_gradient=False,
                      features=features, label=label).mean_loss
        for i in range(0, len(models), step)
    ]
    return np.concatenate(found)


def compare_methods(traces: DataFrame, rows: DataFrame, optimum: Sequence[float],
                    tol: float, features: str = "features", label: str = "label") -> DataFrame:
    """Trace rows with ``objective`` on the given rows, ``distance`` to the optimum and
    ``first_within`` (first iteration of the run whose distance is at most ``tol``).

    The trace, a driver-made table of d-vectors, is read back to ship its models; the
    training rows are scanned once per MODELS_PER_PASS models.
    """
    keyed = traces.select("run_id", "iteration", "model").collect()
    values = evaluate_models(rows, [r["model"] for r in keyed], features, label)
    spark = traces.sparkSession
    losses = spark.createDataFrame(
        [(r["run_id"], r["iteration"], float(v)) for r, v in zip(keyed, values)],
        "run_id string, iteration int, loss double")
    gap = F.zip_with("model", vector_literal(optimum), lambda a, b: (a - b) * (a - b))
    measured = traces.join(losses, ["run_id", "iteration"]).select(
        "run_id", "method", "iteration", "elapsed_seconds", F.col("loss").alias("objective"),
        F.sqrt(F.aggregate(gap, F.lit(0.0), lambda acc, v: acc + v)).alias("distance"),
    )
    reached = measured.groupBy("run_id").agg(
        F.min(F.when(F.col("distance") <= tol, F.col("iteration"))).alias("first_within"))
    return measured.join(reached, "run_id")


def time_to_tolerance(compared: DataFrame) -> DataFrame:
    """(run_id, method, best_iteration, best_objective, first_within, seconds_within)."""
    within = F.col("iteration") == F.col("first_within")
    return compared.groupBy("run_id", "method").agg(
        F.min_by("iteration", "objective").alias("best_iteration"),
        F.min("objective").alias("best_objective"),
        F.max("first_within").alias("first_within"),
        F.min(F.when(within, F.col("elapsed_seconds"))).alias("seconds_within"),
    )
