"""Solver invariants on a small noisy problem, against a numpy Newton fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from optabula.operators.blocks import fold_blocks, to_blocks
from optabula.operators.gram import gram
from optabula.operators.report import evaluate_models
from optabula.plans import admm as A
from optabula.plans.ml_baseline import ml_logistic
from optabula.plans.penalties import Penalty
from optabula.plans.quasi_newton import lbfgs, owlqn
from optabula.plans.sgd import sgd, sgd_grid
from optabula.plans.sweep import sweep
from optabula.sources.tables import write_trace

N, D = 600, 4
RNG = np.random.default_rng(8)
X = np.column_stack([RNG.normal(size=(N, D - 1)), np.ones(N)])
Y = (X @ [1.0, -0.7, 0.0, 0.2] + RNG.logistic(size=N) > 0).astype(float)


def mean_grad(w):
    return X.T @ (1 / (1 + np.exp(-X @ w)) - Y) / N


def newton():
    w = np.zeros(D)
    for _ in range(20):
        s = 1 / (1 + np.exp(-X @ w))
        w = w - np.linalg.solve((X * (s * (1 - s))[:, None]).T @ X / N, mean_grad(w))
    return w


BEST = newton()
FAST = {"alpha": 1.8, "abstol": 1e-6, "reltol": 1e-9, "max_iter": 80}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(
        [(i, x.tolist(), float(y)) for i, (x, y) in enumerate(zip(X, Y))],
        "id long, features array<double>, label double").repartition(3).persist()
    df.count()
    return df


@pytest.fixture(scope="module")
def blocks(rows):
    folded = rows.select("id").join(rows, "id").selectExpr(
        "id", "CASE WHEN label = 1 THEN transform(features, v -> -v) ELSE features END AS values")
    made = to_blocks(folded, 100, D, pos="id").persist()
    made.count()
    return made


def objective(fit):
    return [r["objective"] for r in fit.trace_rows.rows]


def test_lbfgs(rows):
    fit = lbfgs(rows)
    assert fit.converged and np.allclose(fit.weights, BEST, atol=1e-7)
    values = objective(fit)
    assert all(b <= a + 1e-12 for a, b in zip(values, values[1:]))
    model = fit.model.orderBy("pos").collect()
    assert [r["is_intercept"] for r in model] == [False] * 3 + [True]


@pytest.mark.parametrize("lam", [0.0, 0.02, 0.1])
def test_owlqn_satisfies_the_optimality_conditions(rows, lam):
    fit = owlqn(rows, lam)
    w, g = fit.weights, mean_grad(fit.weights)
    assert abs(g[-1]) < 1e-7
    for wi, gi in zip(w[:-1], g[:-1]):
        assert abs(gi + lam * np.sign(wi)) < 1e-7 if wi else abs(gi) <= lam + 1e-9
    values = objective(fit)
    assert all(b <= a + 1e-12 for a, b in zip(values, values[1:]))
    if lam == 0.1:
        assert w[2] == 0.0


def test_owlqn_takes_a_penalty_per_coordinate(rows):
    fit = owlqn(rows, [10.0, 0.0, 0.0, 0.0])
    assert fit.weights[0] == 0.0 and abs(fit.weights[1]) > 0.1


def test_ml_cross_check(rows):
    mine, theirs = owlqn(rows, 0.03).weights, ml_logistic(rows, 0.03, tol=1e-12).weights
    assert np.allclose(mine, theirs, atol=1e-5)


def test_sgd_steps(rows):
    lam, step = 0.05, 0.6
    w = np.zeros(D)
    for k in range(1, 7):
        size = step / np.sqrt(k)
        moved = w - size * mean_grad(w)
        w = np.append(np.sign(moved) * np.maximum(np.abs(moved) - size * lam, 0), 0)[:D]
        w[-1] = moved[-1]
    fit = sgd(rows, lam, iters=6)
    assert np.allclose(fit.weights, w, atol=1e-12)
    grid = sgd_grid(rows, [0.0, lam], iters=6)
    assert np.allclose(grid[1].weights, w, atol=1e-12)
    assert not np.allclose(grid[0].weights, w, atol=1e-3)


def test_sampled_sgd_is_reproducible(rows):
    """The same batches for any partitioning."""
    keyed = rows.withColumn("k", F.expr("CAST(abs(xxhash64(features)) % 1000000 AS BIGINT)"))
    fits = [sgd(keyed.repartition(n), iters=3, fraction=0.4, seed=5, key="k") for n in (2, 7)]
    assert np.allclose(fits[0].weights, fits[1].weights, atol=1e-12)
    assert not np.allclose(
        fits[0].weights, sgd(keyed, iters=3, fraction=0.4, seed=6, key="k").weights, atol=1e-6)
    with pytest.raises(ValueError, match="key"):
        sgd(rows, iters=3, fraction=0.4)


def test_admm_reaches_the_optimum_for_any_blocking(rows, blocks):
    for made in (blocks, to_blocks(fold_blocks(rows), 250, D), to_blocks(fold_blocks(rows), 10_000, D)):
        fit = A.admm_logistic(made, **FAST)
        assert fit.converged and np.allclose(fit.weights, BEST, atol=1e-6)
        last = fit.trace_rows.rows[-1]
        assert last["primal_residual"] <= last["primal_tol"]
        assert last["dual_residual"] <= last["dual_tol"]


@pytest.mark.parametrize("height, least", [(23, 22), (46, 17)])
def test_few_rows_left_over_do_not_slow_admm_down(rows, height, least):
    """A last block of 2 rows, far below rho in curvature: 46 and 37 iterations instead of 22 and 17."""
    folded = fold_blocks(rows.sort("id").coalesce(1))
    fit = A.admm_logistic(to_blocks(folded, height, D), **FAST)
    assert fit.converged and np.allclose(fit.weights, BEST, atol=1e-6)
    assert len(fit.trace_rows.rows) <= least + 3


def test_admm_durable_blocks(blocks):
    fit = A.admm_logistic(blocks, durable=True, **FAST)
    assert np.allclose(fit.weights, BEST, atol=1e-6)


def test_admm_from_rows_with_lasso(rows):
    fit = A.admm_logistic_rows(rows, height=150, prox=Penalty("l1", 0.1), **FAST)
    assert np.allclose(fit.weights, owlqn(rows, 0.1).weights, atol=1e-6) and fit.weights[2] == 0.0


def test_admm_with_lagged_residual_and_schedule(blocks):
    fit = A.admm_logistic(blocks, residual="lagged", rho=13.0, max_iter=3)
    assert fit.trace_rows.rows[0]["primal_residual"] == 0.0
    assert fit.trace_rows.rows[1]["primal_residual"] > 0.0
    fit = A.admm_logistic(blocks, inner_schedule=True, inner_tol=1e-8, **FAST)
    assert np.allclose(fit.weights, BEST, atol=1e-4)
    assert fit.trace_rows.rows[1]["inner_tol"] > 1e-8


def test_current_residual_is_the_spread_of_the_blocks(blocks):
    with A.co_partitioned(blocks) as held:
        z = np.zeros(D)
        state = A.admm_relax(A.admm_local_solve(
            held, A.admm_dual_update(A.admm_start(held, D), z), z, 13.0), z, 1.0)
        x = np.array([r["x"] for r in state.collect()])
    want = np.sqrt(((x - x.mean(axis=0)) ** 2).sum())
    fit = A.admm_logistic(blocks, rho=13.0, max_iter=1)
    assert np.isclose(fit.trace_rows.rows[0]["primal_residual"], want, rtol=1e-9)


def test_rho_adapts_and_rescales(blocks):
    fit = A.admm_logistic(blocks, rho=400.0, factor=2.0, mu=5.0, alpha=1.8, abstol=1e-6,
                          reltol=1e-9, max_iter=120)
    assert len({r["rho"] for r in fit.trace_rows.rows}) > 2
    assert np.allclose(fit.weights, BEST, atol=1e-5)


def test_admm_takes_a_callable_prox(blocks):
    fit = A.admm_logistic(blocks, prox=lambda v, weight: np.minimum(v, 0.5), **FAST)
    assert np.isclose(fit.weights[0], 0.5) and fit.weights.max() <= 0.5
    bound = A.admm_logistic(blocks, prox=Penalty("lower_bound", threshold=-0.2), **FAST)
    assert np.isclose(bound.weights[1], -0.2)
    assert np.array_equal(
        A.admm_logistic(blocks, prox=Penalty("zero_set"), max_iter=2).weights, np.zeros(D))


def test_wide_blocks_use_quasi_newton(spark):
    d = 300
    x = np.random.default_rng(2).normal(size=(80, d))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, values array<double>")
    made = to_blocks(df, 40, d, pos="id")
    state = A.admm_start(made, d)
    solved = A.admm_local_solve(made, state, np.zeros(d), 2.0, 1e-8).collect()
    assert len(solved) == 2
    for r in solved:
        part = x[:40] if r["block_id"] == 0 else x[40:]
        w = np.array(r["x"])
        grad = 2.0 * w + part.T @ (1 / (1 + np.exp(-part @ w)))
        assert np.linalg.norm(grad) < 1e-6 and r["grad_norm"] < 1e-6


def test_least_squares_equals_closed_form(spark, rows):
    df = rows.selectExpr("id % 5 AS block_id", "features", "3D * features[0] - label AS target")
    target = 3 * X[:, 0] - Y
    want = np.linalg.lstsq(X, target, rcond=None)[0]
    fit = A.admm_least_squares(gram(df, D, by="block_id"), **FAST)
    assert np.allclose(fit.weights, want, atol=1e-6)


def test_no_exchange_on_the_blocks(blocks):
    with A.co_partitioned(blocks, 3) as held:
        held.count()
        state = A.admm_start(held, D)
        solved = A.admm_local_solve(held, state, np.zeros(D), 1.0)
        plan = solved._jdf.queryExecution().executedPlan().toString()
    top = plan.split("InMemoryRelation")[0]
    assert "SortMergeJoin" in top and "Exchange" not in top and "Sort [" not in top


def test_sweep_and_traces(spark, rows, tmp_path):
    frame = sweep({"p": rows.select("features", "label")},
                  {"a": {"lam": 0.0, "iters": 2}, "b": {"lam": 0.1, "iters": 2}}, sgd, repetitions=2)
    assert frame.count() == 8 and frame.select("run_id").distinct().count() == 4
    fit = lbfgs(rows)
    for fmt in ("parquet", "csv"):
        write_trace(fit.trace, str(tmp_path / fmt), fmt, fit.summary)
    back = spark.read.parquet(str(tmp_path / "parquet/iterations"))
    assert back.count() == len(fit.trace_rows.rows)
    assert spark.read.csv(str(tmp_path / "csv/summary"), header=True).count() == 1
    total = back.agg(F.sum("iter_seconds")).first()[0]
    assert np.isclose(total, fit.trace_rows.rows[-1]["elapsed_seconds"])


def test_evaluate_models_shares_scans(rows):
    models = np.random.default_rng(1).normal(size=(300, D))
    found = evaluate_models(rows, models)
    m = X @ models.T
    want = np.logaddexp(0, (1 - 2 * Y)[:, None] * m).mean(axis=0)
    assert np.allclose(found, want)


def test_one_row_and_empty(spark):
    schema = "features array<double>, label double"
    one = spark.createDataFrame([([1.0, 1.0], 1.0)], schema)
    assert np.isfinite(owlqn(one, 0.1, max_iter=5).weights).all()
    assert np.isfinite(A.admm_logistic_rows(one, rho=1.0, max_iter=3).weights).all()
    empty = spark.createDataFrame([], schema)
    for fit in (lambda: lbfgs(empty), lambda: sgd(empty, iters=1), lambda: A.admm_logistic_rows(empty)):
        with pytest.raises(ValueError, match="no training rows"):
            fit()
