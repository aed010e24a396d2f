"""Unusable rows are an error, or have no value, at every width."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from optabula.functions.prep import label01, label_by_model
from optabula.operators import objectives as O
from optabula.operators.blocks import fold_blocks, fold_labeled_blocks, mirror_noise, to_blocks
from optabula.operators.gram import gram, inverse_hessian_diag
from optabula.operators.report import score
from optabula.plans import admm as A
from optabula.plans.quasi_newton import lbfgs
from optabula.plans.sweep import Problem, run_sweep, summaries
from optabula.plans.ml_baseline import ml_logistic

WIDTHS = [2, 8, 9, 24, 25, 30]
DEFECTS = ["null", "nan", "infinite", "short", "long", "missing", "label"]


def rows_with(spark, width, defect):
    good = [([float(i % 3 + j % 2) for j in range(width)], float(i % 2), 0) for i in range(6)]
    x, y = list(good[0][0]), 1.0
    if defect == "null":
        x[-1] = None
    if defect == "nan":
        x[0] = float("nan")
    if defect == "infinite":
        x[-1] = float("inf")
    if defect == "short":
        x = x[:-1]
    if defect == "long":
        x = [*x, 1.0]
    if defect == "missing":
        x = None
    if defect == "label":
        y = None
    rows = good + [(x, y, 0)] if defect else good
    return spark.createDataFrame(rows, "features array<double>, label double, block_id long")


def evaluations(rows, width):
    w = [0.1] * width
    yield lambda: O.augmented_value_grad(rows, w, w, w, 1.0, by="block_id")
    yield lambda: O.augmented_value_grad(rows, w, w, w, 1.0)
    yield lambda: O.logistic_value_grad(rows, w)
    yield lambda: O.logistic_loss(rows, w)
    yield lambda: O.least_squares_value(rows, w, target="label")
    yield lambda: O.total_value(rows, "logistic", w)
    yield lambda: O.total_value(rows, "least_squares", w, target="label")
    yield lambda: gram(rows, width, target="label")
    yield lambda: gram(rows, width, by="block_id", target="label")


@pytest.mark.parametrize("width", WIDTHS)
def test_sums_of_usable_rows(spark, width):
    for evaluate in evaluations(rows_with(spark, width, None), width):
        assert evaluate().collect()


@pytest.mark.parametrize("width", [2, 9, 25])
@pytest.mark.parametrize("defect", DEFECTS)
def test_sums_refuse_unusable_rows(spark, width, defect):
    for number, evaluate in enumerate(evaluations(rows_with(spark, width, defect), width)):
        with pytest.raises(Exception, match="(?i)not a complete|no complete|null|vectors of|finite|NaN"):
            evaluate().collect()
            pytest.fail(f"evaluation {number} took a row with a defect: {defect}")


@pytest.mark.parametrize("width", [2, 9])
def test_curvature_refuses_unusable_rows(spark, width):
    with pytest.raises(Exception, match="(?i)complete|null|finite"):
        inverse_hessian_diag(rows_with(spark, width, "null"), [0.1] * width, 1.0).collect()


@pytest.mark.parametrize("width", [2, 30])
def test_rows_without_a_defined_value(spark, width):
    for defect in ["null", "nan", "short", "long", "missing"]:
        found = score(rows_with(spark, width, defect), [0.1] * width).select(
            "probability", "prediction",
            label_by_model(F.col("features"), [0.1] * width).alias("label")).collect()
        assert sum(r["probability"] is None for r in found) == 1
        assert sum(r["prediction"] is None for r in found) == 1
        assert sum(r["label"] is None for r in found) == 1
    labels = spark.createDataFrame([(-1.0,), (1.0,), (None,), (float("nan"),)], "y double")
    assert [r[0] for r in labels.select(label01(F.col("y"))).collect()] == [0.0, 1.0, None, None]


@pytest.mark.parametrize("label", [None, -1.0, 0.5, float("nan")])
def test_folds_refuse_unknown_labels(spark, label):
    rows = spark.createDataFrame([([1.0, 2.0], label)], "features array<double>, label double")
    rows = rows.union(rows)
    with pytest.raises(Exception, match="label is not 0 or 1"):
        fold_blocks(rows).collect()
    raw = spark.createDataFrame([([1.0, 2.0, -2.0 if label in (None, -1.0) else label],)], "values array<double>")
    with pytest.raises(Exception, match="not -1 or 1"):
        fold_labeled_blocks(to_blocks(raw, 4, 3)).collect()


def logistic_rows(spark, width, bad=None, n=400):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, width))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=n) > 0).astype(float)
    data = [([float(v) for v in row], float(t)) for row, t in zip(x, y)]
    if bad is not None:
        data[37] = (data[37][0][:-1] + [bad], data[37][1])
    return spark.createDataFrame(data, "features array<double>, label double").coalesce(1)


@pytest.mark.parametrize("width", [3, 40])
def test_consensus_refuses_a_nan(spark, width):
    assert A.admm_logistic_rows(logistic_rows(spark, width), height=100, abstol=1e-4,
                                reltol=1e-3).converged
    with pytest.raises(Exception, match="not finite"):
        A.admm_logistic_rows(logistic_rows(spark, width, float("nan")), height=100)
    with pytest.raises(Exception, match="label is not 0 or 1"):
        rows = logistic_rows(spark, width).withColumn(
            "label", F.when(F.rand(3) > 0.02, F.col("label")))
        A.admm_logistic_rows(rows, height=100)


def test_least_squares_consensus_refuses_a_half_null_column(spark):
    rows = spark.range(200).selectExpr(
        "array(CASE WHEN id % 2 = 0 THEN id / 100D END, 1D) AS features", "id / 50D AS target",
        "id % 4 AS block_id")
    with pytest.raises(Exception, match="not a complete vector"):
        A.admm_least_squares(gram(rows, 2, by="block_id"))


def test_unsolved_blocks_are_counted(spark, monkeypatch):
    """With an inner tolerance out of reach, blocks end at the precision of their value: solved."""
    fit = A.admm_logistic_rows(logistic_rows(spark, 3), height=100, inner_tol=0.0, abstol=1e-4, reltol=1e-3)
    assert fit.converged and fit.stop_reason == "residuals"
    assert all(r["unsolved_blocks"] == 0 for r in fit.trace_rows.rows)
    blocks = to_blocks(fold_blocks(logistic_rows(spark, 3)), 100, 3).persist()
    never = lambda z, rho, tol, memory: F.expr(
        "named_struct('x', u, 'steps', 1, 'grad_norm', 1D, 'solved', block_id % 2 = 0)")
    fit = A.consensus_admm(blocks, never, 3, 400, 4, max_iter=3, abstol=10.0, reltol=10.0)
    assert not fit.converged and fit.stop_reason == "iterations"
    assert [r["unsolved_blocks"] for r in fit.trace_rows.rows] == [2, 2, 2]


def test_objectives_of_a_consensus_trace(spark):
    rows = logistic_rows(spark, 3)
    fit = A.admm_logistic_rows(rows, height=100, max_iter=5)
    for r in fit.trace_rows.rows:
        loss = O.logistic_loss(rows, r["model"]).first()["loss"]
        assert np.isclose(r["objective"], loss / 400, rtol=1e-12)
    assert np.isclose(fit.summary.first()["objective"], fit.trace_rows.rows[-1]["objective"])


@pytest.mark.parametrize("positions", [[0, 2, 3], [0, 1, 1], [1, 2], [0, None]])
def test_mirror_noise_refuses_gaps_and_repeats(spark, positions):
    rows = spark.createDataFrame(
        [(1, p, [1.0, 2.0, 1.0]) for p in positions], "block_id long, pos long, features array<double>")
    with pytest.raises(Exception, match="0 to n-1|not below"):
        mirror_noise(rows, [1.0, 1.0, 1.0], 10).collect()


def test_stop_reasons(spark):
    rows = logistic_rows(spark, 3)
    assert lbfgs(rows).stop_reason == "gradient"
    tight = lbfgs(rows, tol=1e-40)
    assert tight.stop_reason == "precision" and not tight.converged
    short = lbfgs(rows, max_iter=1)
    assert short.stop_reason == "iterations" and not short.converged


def test_ml_trace_says_what_it_knows(spark):
    rows = logistic_rows(spark, 3).withColumn("features", F.concat("features", F.array(F.lit(1.0))))
    trace = ml_logistic(rows, reg=0.01).trace_rows.rows
    assert all(r["model"] is None and r["elapsed_seconds"] is None for r in trace[:-1])
    assert trace[-1]["model"] is not None and all(r["objective"] is not None for r in trace)


def test_sweep_of_problems(spark):
    rows = logistic_rows(spark, 3)
    problem = Problem([rows.limit(100), rows], expected=[[1.0, 0.0, 0.0], [2.0, 0.0, 0.0]])
    runs = run_sweep({"a": problem}, {"s": {"max_iter": 2}}, lbfgs, 2)
    found = summaries(runs).orderBy("rep").collect()
    assert [r["expected"][0] for r in found] == [1.0, 2.0] and found[0]["final"] != found[1]["final"]
    with pytest.raises(ValueError, match="repetitions"):
        run_sweep({"a": problem}, {"s": {}}, lbfgs, 3)
