"""Fits that keep their iterations in a table: stopped and resumed ones are those of an unbroken fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from optabula.cluster import exists, shared_path
from optabula.operators.gram import gram
from optabula.plans import admm as A
from optabula.plans.journal import Journal
from optabula.plans.penalties import Penalty
from optabula.plans.quasi_newton import lbfgs, owlqn
from optabula.plans.sgd import sgd_grid
from optabula.plans.trace import Trace


class Died(Exception):
    pass


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=(400, 3)), np.ones(400)])
    y = (x @ [1.5, -1.0, 0.0, 0.3] + rng.logistic(size=400) > 0).astype(float)
    df = spark.createDataFrame(
        [(i % 4, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))],
        "block_id int, features array<double>, label double").coalesce(1).persist()
    df.count()
    return df


def models(fit):
    return np.array([r.model for r in fit.trace.orderBy("iteration").collect()])


def dies_at(monkeypatch, iteration):
    """The driver dies right after it has recorded an iteration."""
    add = Trace.add

    def once(self, k, *args, **kwargs):
        add(self, k, *args, **kwargs)
        if k == iteration:
            raise Died

    monkeypatch.setattr(Trace, "add", once)


def resumed(spark, monkeypatch, fit, iteration, every=1):
    journal = Journal(shared_path(spark, "journal"), every)
    with monkeypatch.context() as patch, pytest.raises(Died):
        dies_at(patch, iteration)
        fit(journal=journal)
    return fit(journal=journal), journal


@pytest.mark.parametrize("memory, every", [(2, 1), (20, 2)])
def test_quasi_newton(spark, monkeypatch, rows, memory, every):
    for fit in (lambda **o: lbfgs(rows, m=memory, **o), lambda **o: owlqn(rows, 0.02, m=memory, **o)):
        whole = fit()
        found, _ = resumed(spark, monkeypatch, fit, 3, every)
        assert np.array_equal(models(found), models(whole))
        assert np.array_equal(found.weights, whole.weights) and found.objective == whole.objective
        assert found.stop_reason == whole.stop_reason and len(found.trace_rows.rows) == 1
        kept, expected = found.summary.first(), whole.summary.first()
        assert (kept.iterations, kept.final) == (expected.iterations, expected.final)


def test_a_finished_fit_takes_no_pass(spark, rows):
    journal = shared_path(spark, "journal")
    first = lbfgs(rows, journal=journal)
    again = lbfgs(rows.where("false").union(rows), journal=journal)
    assert np.array_equal(first.weights, again.weights) and again.stop_reason == "gradient"
    assert again.summary.first().n_eval == first.summary.first().n_eval
    assert np.array_equal(models(first), models(again))


def test_sgd(spark, monkeypatch, rows):
    def fit(**o):
        return sgd_grid(rows, [0.0, 0.05], iters=5, **o)

    whole, (found, _) = fit(), resumed(spark, monkeypatch, fit, 2)
    for a, b in zip(found, whole):
        # One run had its row and the other had not: both go on from the iteration before.
        assert np.array_equal(models(a), models(b))
        assert np.array_equal(
            [r.objective for r in a.trace.orderBy("iteration").collect()],
            [r["objective"] for r in b.trace_rows.rows])


@pytest.mark.parametrize("every", [1, 3])
def test_consensus(spark, monkeypatch, rows, every):
    blocks = A.to_blocks(A.fold_blocks(rows), 60, 4)
    grams = gram(rows.withColumnRenamed("label", "target"), 4, by="block_id")
    lasso = Penalty("l1", 0.02)
    for fit in (
        lambda **o: A.admm_logistic(blocks, rho=900.0, factor=1.5, mu=2.0, alpha=1.6, max_iter=8,
                                    inner_schedule=True, prox=lasso, **o),
        lambda **o: A.admm_least_squares(grams, max_iter=8, residual="lagged", **o),
    ):
        whole = fit()
        found, journal = resumed(spark, monkeypatch, fit, 4, every)
        assert np.allclose(models(found), models(whole), rtol=0, atol=1e-12)
        names = ["rho", "primal_residual", "dual_residual", "inner_tol", "objective"]
        for a, b in zip(found.trace.orderBy("iteration").collect(), whole.trace_rows.rows):
            assert np.allclose([a[n] for n in names], [b[n] for n in names], atol=1e-10)
        assert np.isclose(found.objective, whole.objective)
        states = [k for k in range(9) if exists(spark, f"{journal.path}/state-{found.trace_rows.run_id}-{k}")]
        assert states == [8]  # the newest alone
        again = fit(journal=journal)
        assert np.array_equal(again.weights, found.weights) and np.isclose(again.objective, found.objective)


def test_other_settings_are_refused(spark, rows):
    journal = shared_path(spark, "journal")
    owlqn(rows, 0.1, max_iter=2, journal=journal)
    assert owlqn(rows, 0.1, max_iter=3, tol=1e-3, journal=journal).trace.count() <= 3
    with pytest.raises(ValueError, match="was fitted with"):
        owlqn(rows, 0.2, max_iter=3, journal=journal)
    lbfgs(rows, max_iter=2, journal=journal)  # another run in the same folder
    with pytest.raises(ValueError, match="another set of runs"):
        sgd_grid(rows, [0.0, 0.1], iters=2, run_ids=["owlqn", "lbfgs"], journal=journal)
        sgd_grid(rows, [0.0, 0.1], iters=2, run_ids=["owlqn", "new"], journal=journal)
    with pytest.raises(ValueError, match="every"):
        lbfgs(rows, journal=Journal(journal, 0))


def test_a_lost_append_leaves_whole_iterations(spark, rows):
    """Rows of a file that never came into place are not there; the fit repeats their iterations."""
    journal = Journal(shared_path(spark, "journal"), 100)
    first = lbfgs(rows, max_iter=3, journal=journal)
    assert first.trace.agg(F.max("iteration")).first()[0] == 3
    assert np.array_equal(models(lbfgs(rows, journal=journal)), models(lbfgs(rows)))


def test_bucketed_blocks_stay_where_they_are(spark, rows):
    """The table of blocks is scanned by bucket: no exchange and no sort on its side."""
    blocks = A.to_blocks(A.fold_blocks(rows), 30, 4)
    with A.co_partitioned(blocks, 5, durable=True) as kept:
        state = A.admm_start(kept, 4).repartition(3)  # states lie anywhere
        solved = A.admm_local_solve(kept, state, np.zeros(4), 1.0)
        plan = solved._jdf.queryExecution().executedPlan().toString()
        table, path = kept.inputFiles()[0], kept.inputFiles()[0].rsplit("/", 1)[0]
        assert table.endswith(".parquet") and kept.rdd.getNumPartitions() == 5
        assert solved.count() == blocks.count() == 14
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert "ShuffledHashJoin" in plan and "SelectedBucketsCount: 5 out of 5" in plan
    assert len(moved) == 1 and "Sort" not in plan.replace("SortMergeJoin", "Sort")
    # The one exchange is the state's: what is joined first is the scan of the buckets.
    first = plan.split("ShuffledHashJoin")[1].split("Exchange")[0]
    assert "FileScan" in first or "Scan parquet" in first
    assert not exists(spark, path) and not spark.catalog.listTables(pattern="optabula_blocks*")


def test_steps_within_an_iteration_are_bounded(spark, rows):
    blocks = A.to_blocks(A.fold_blocks(rows), 60, 4)
    fit = A.admm_logistic(blocks, inner_steps=1, inner_tol=1e-3, max_iter=30, abstol=1e-3, reltol=1e-3)
    left = [r["unsolved_blocks"] for r in fit.trace_rows.rows]
    assert left[0] == 7 and left[-1] == 0 and fit.converged
    assert all(r["n_eval"] <= 7 for r in fit.trace_rows.rows)
    assert np.allclose(fit.weights, lbfgs(rows).weights, atol=1e-2)
