"""Tiled sums, objectives given as functions, runs in lockstep, factored grams."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from optabula import kernels
from optabula.operators.gram import factored, gram
from optabula.operators.objectives import (
    augmented_value_grad,
    logistic_pass,
    objective_pass,
    segment_pass,
)
from optabula.operators.proximal import prox_least_squares
from optabula.plans import admm as A
from optabula.plans import passes, quasi_newton
from optabula.plans.quasi_newton import lbfgs, lbfgs_by_segment, owlqn, owlqn_path
from optabula.plans.sgd import sgd


def rows_of(rng, n, d, segments=5):
    x = np.c_[rng.normal(size=(n, d - 1)), np.ones(n)]
    w = rng.normal(size=d)
    y = (x @ w + rng.logistic(size=n) > 0).astype(float)
    return x, y, x @ w + rng.normal(size=n), rng.integers(0, segments, n)


def table(spark, x, y, target, segment):
    data = [(r.tolist(), float(a), float(b), int(s)) for r, a, b, s in zip(x, y, target, segment)]
    return spark.createDataFrame(
        data, "features array<double>, label double, target double, segment int").repartition(5)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 5000), st.booleans())
def test_vectors_come_back_from_their_pieces(k, size, keyed):
    rng = np.random.default_rng(size)
    vectors, keys = rng.normal(size=(k, size)), list(range(10, 10 + k))
    if not keyed:
        vectors, keys = vectors[:1], [0]
    cut = pa.Table.from_batches(kernels.piece_batches(vectors, keys if keyed else None))
    assert max(map(len, cut["values"].to_pylist())) <= kernels.PIECE
    # Twice the pieces, in small batches: every number is added up once for each.
    order = [("block_id", "ascending")] * keyed + [("piece", "ascending")]
    doubled = pa.concat_tables([cut, cut]).sort_by(order).combine_chunks().to_batches(max_chunksize=3)
    summed = pa.Table.from_batches(kernels.add_pieces(keyed)(doubled))
    assert summed.num_rows == cut.num_rows
    back = pa.Table.from_batches(kernels.whole_vectors(size, keyed)(summed.to_batches(max_chunksize=2)))
    assert np.array_equal(np.array(back["partial"].to_pylist()), 2 * vectors)
    if keyed:
        assert back["block_id"].to_pylist() == keys


def test_a_missing_piece_is_an_error():
    cut = pa.Table.from_batches(kernels.piece_batches(np.ones((1, 3000)))).slice(1).to_batches()
    with pytest.raises(ValueError, match="lacks"):
        list(kernels.whole_vectors(3000, False)(cut))


@pytest.mark.parametrize("d", [1, 5, 32, 33, 100])
def test_symmetric_matrices_come_back_from_their_tiles(d):
    a = np.random.default_rng(d).normal(size=(d, d))
    packed = kernels.pack_symmetric(a + a.T)
    assert len(packed) == kernels.packed_size(d)
    assert np.array_equal(kernels.unpack_symmetric(packed, d), a + a.T)


@pytest.mark.parametrize("by", [None, "segment"])
def test_wide_sums_collect_no_group(spark, by):
    x, y, target, segment = rows_of(np.random.default_rng(1), 300, 70)
    df = table(spark, x, y, target, segment)
    found = gram(df, 70, by=by)
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Generate" not in plan
    for r in found.collect():
        mine = segment == r.segment if by else slice(None)
        assert np.allclose(np.array(r.ata).reshape(70, 70), x[mine].T @ x[mine])
        assert np.allclose(r.atb, x[mine].T @ target[mine]) and np.isclose(r.btb, target[mine] @ target[mine])
        assert r.n_cols == 70 and r.n_rows == len(target[mine])
    w = np.linspace(-0.1, 0.1, 70)
    grads = augmented_value_grad(df, w, 0 * w, 0 * w, 1.0, by=by)
    assert "collect_list" not in grads._jdf.queryExecution().toString()
    for r in grads.collect():
        mine = segment == r.segment if by else slice(None)
        s = 1 / (1 + np.exp(-x[mine] @ w))
        assert np.allclose(r.gradient, x[mine].T @ (s - y[mine]) + w)


def test_objectives_given_as_functions(spark):
    x, y, target, segment = rows_of(np.random.default_rng(2), 400, 6)
    df = table(spark, x, y, target, segment)
    models = np.random.default_rng(3).normal(size=(3, 6))
    one, other = logistic_pass(df, models), objective_pass(df, models, kernels.logistic_objective)
    assert np.allclose(one.loss, other.loss) and np.allclose(one.grad, other.grad) and one.n == other.n
    best = np.linalg.lstsq(x, target, rcond=None)[0]
    fit = lbfgs(df, label="target", objective=kernels.least_squares_objective)
    assert fit.converged and np.allclose(fit.weights, best, atol=1e-6)

    def quantile(x, y, models):  # smooth enough: squared, with unlike weights for either side
        r = x @ models.T - y[:, None]
        weight = np.where(r > 0, 0.2, 0.8)
        return 0.5 * (weight * r * r).sum(axis=0), (weight * r).T @ x

    w = lbfgs(df, label="target", objective=quantile).weights
    r = x @ w - target
    assert np.abs((np.where(r > 0, 0.2, 0.8) * r) @ x).max() / len(r) < 1e-6
    h = kernels.huber_objective(0.3)
    step = 1e-6 * np.eye(6)
    for k in range(6):
        slope = (h(x, target, models + step[k])[0] - h(x, target, models - step[k])[0]) / 2e-6
        assert np.allclose(slope, h(x, target, models)[1][:, k], rtol=1e-4, atol=1e-3)


def test_objectives_of_wrong_shape_are_refused(spark):
    x, y, target, segment = rows_of(np.random.default_rng(2), 20, 3)
    with pytest.raises(Exception, match="an objective gives"):
        lbfgs(table(spark, x, y, target, segment), objective=lambda x, y, m: (np.zeros(1), np.zeros(3)))


def test_updater_given_as_a_function(spark):
    x, y, target, segment = rows_of(np.random.default_rng(5), 100, 3)
    df = table(spark, x, y, target, segment)
    fit = sgd(df, step=0.2, iters=4, label="target", objective=kernels.least_squares_objective,
              updater=lambda w, size: np.clip(w, -0.1, 0.1))
    w = np.zeros(3)
    for k in range(1, 5):
        w = np.clip(w - 0.2 / np.sqrt(k) * x.T @ (x @ w - target) / 100, -0.1, 0.1)
    assert np.allclose(fit.weights, w)


def test_rows_without_a_batch_key_are_refused(spark):
    df = table(spark, *rows_of(np.random.default_rng(5), 50, 3)).selectExpr(
        "*", "CASE WHEN rand(1) < 0.9 THEN 7L END AS row_key")
    with pytest.raises(Exception, match="no batch key"):
        sgd(df, iters=1, fraction=0.5, key="row_key")


def test_a_path_takes_the_scans_of_its_slowest_fit(spark, monkeypatch):
    df = table(spark, *rows_of(np.random.default_rng(7), 500, 5)).cache()
    scans = []
    real = passes.logistic_pass
    monkeypatch.setattr(passes, "logistic_pass", lambda *a, **k: scans.append(1) or real(*a, **k))
    weights = [0.0, 0.01, 0.05, 0.2]
    alone, counts = {}, []
    for lam in weights:
        del scans[:]
        alone[lam] = owlqn(df, lam)
        counts.append(len(scans))
    del scans[:]
    path = owlqn_path(df, weights)
    assert len(scans) == path.scans == max(counts) < sum(counts)
    for lam in weights:
        assert path.fits[lam].stop_reason == alone[lam].stop_reason
        assert np.allclose(path.fits[lam].weights, alone[lam].weights, atol=1e-7)
        assert [r["n_eval"] for r in path.fits[lam].trace_rows.rows] == [
            r["n_eval"] for r in alone[lam].trace_rows.rows]
    for bad in ([], [0.1, 0.1], [-1.0]):
        with pytest.raises(ValueError):
            owlqn_path(df, bad)


def test_segments_are_fitted_together(spark, monkeypatch):
    df = table(spark, *rows_of(np.random.default_rng(8), 900, 4, segments=6)).cache()
    scans = []
    monkeypatch.setattr(quasi_newton, "segment_pass",
                        lambda *a, **k: scans.append(set(a[1])) or segment_pass(*a, **k))
    runs = lbfgs_by_segment(df, "segment")
    assert len(scans) == runs.scans and scans[0] == set(range(6)) and len(scans[-1]) <= 6
    for key, fit in runs.fits.items():
        alone = lbfgs(df.where(f"segment = {key}"))
        assert fit.converged and np.allclose(fit.weights, alone.weights, atol=1e-6)
    lasso = lbfgs_by_segment(df, "segment", l1=0.05)
    one = owlqn(df.where("segment = 3"), 0.05)
    assert np.allclose(lasso.fits[3].weights, one.weights, atol=1e-6)
    assert runs.models("segment").count() == 24
    monkeypatch.setattr(quasi_newton, "MAX_SEGMENTS", 5)
    with pytest.raises(ValueError, match="segment"):
        lbfgs_by_segment(df, "segment")
    monkeypatch.undo()
    with pytest.raises(ValueError, match="segment"):
        lbfgs_by_segment(df.selectExpr("features", "label", "nullif(segment, 2) AS segment"), "segment")


def test_factors_solve_for_any_rho(spark, monkeypatch):
    x, y, target, segment = rows_of(np.random.default_rng(9), 300, 12)
    x[:, 3] = x[:, 4]  # a singular gram
    grams = gram(table(spark, x, y, target, segment), 12, by="segment").cache()
    kept = factored(grams, 12).cache()
    vectors = grams.selectExpr("segment", f"array_repeat(0.3D, 12) AS v")
    for rho in (1e-3, 1.0, 500.0):
        one = {r.segment: r.x for r in prox_least_squares(grams, vectors, 12, rho, key="segment").collect()}
        two = {r.segment: r.x for r in prox_least_squares(kept, vectors, 12, rho, key="segment").collect()}
        assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], atol=1e-7) for k in one)
    calls = []
    for name in ("solve_grams", "eigen_grams", "solve_eigen"):
        real = getattr(kernels, name)
        monkeypatch.setattr(kernels, name, lambda *a, n=name, f=real: calls.append(n) or f(*a))
    fit = A.admm_least_squares(grams.withColumnRenamed("segment", "block_id"), rho=3.0, factor=2.0, max_iter=5)
    assert calls.count("eigen_grams") == 1 and calls.count("solve_eigen") == 5 and "solve_grams" not in calls
    assert len({r["rho"] for r in fit.trace_rows.rows}) > 1


def test_objectives_of_iterates_beyond_one_shipment(spark, monkeypatch):
    x, y, target, segment = rows_of(np.random.default_rng(4), 200, 4)
    blocks = A.to_blocks(A.fold_blocks(table(spark, x, y, target, segment)), 50, 4)
    models = np.random.default_rng(1).normal(size=(7, 4))
    whole = A.logistic_losses(blocks, models)
    monkeypatch.setattr(A, "MAX_SHIPPED_BYTES", 2 * 8 * 4)
    assert np.allclose(A.logistic_losses(blocks, models), whole)
    margins = x @ models.T
    assert np.allclose(whole, np.logaddexp(0, np.where(y[:, None] > 0, -margins, margins)).sum(axis=0))
